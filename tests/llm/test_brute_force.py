"""Leaks and the pipeline's stages against plain Python over everything."""

import random
import re

from conftest import DOCS, WORD
from pyspark.sql import functions as F
from test_near import reach, sets
from test_repeats import late

import corpus_pipeline
from castleflow.llm import leaks, quality

TOKEN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
    return row[-1]


def all_leaks(docs, items):
    """(doc_id, item_id) to the best share: every window of every document against every item."""
    out = {}
    for d, text in docs:
        words = TOKEN.findall((text or "").lower())
        for i, item in items:
            item = TOKEN.findall(item.lower())
            for a in range(0, len(words), 8):
                window = words[a : a + 8 * (-(-len(item) // 8) + 1)]
                whole = any(window[k : k + len(item)] == item for k in range(len(window)))
                share = float(whole) if len(item) < 5 else subsequence(item, window) / len(item)
                if share >= 0.6 - 1e-9:
                    out[d, i] = max(share, out.get((d, i), 0))
    return out


def test_leaks_are_those_of_all_windows_and_items(spark):
    r = random.Random(16)
    vocabulary = [f"w{i}" for i in range(60)] + ["été", "naïve"]
    draw = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(draw(r.choice([3, 4, 5, 9, 16, 17, 33])))) for i in range(16)]
    docs = []
    for d in range(60):
        words = draw(r.randint(0, 80))
        if d % 2:  # part of an item, with words left out, put in and changed
            source = items[r.randrange(16)][1].split()
            cut = [w for w in source if r.random() > 0.25]
            at = r.randint(0, len(words))
            words[at:at] = [x for w in cut for x in ([w, r.choice(vocabulary)] if r.random() < 0.15 else [w])]
        docs.append((d, " ".join(words).upper() if d % 7 == 0 else ", ".join(words)))
    expected = all_leaks(docs, items)
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]): round(x["lcs_share"], 9) for x in got} == {k: round(v, 9) for k, v in expected.items()}
    assert 20 < len(expected) and any(v < 1 for v in expected.values())


def cut_lines(rows):
    full = {d: [x for x in (t or "").split("\n") if WORD.search(x.encode())] for d, t in rows}
    runs, single = late(full, 2), late(full, 1)
    out = []
    for d, t in rows:
        gone = iter([a or (b and len(x.split()) >= 50) for x, a, b in zip(full[d], runs[d], single[d], strict=True)])
        kept = None if t is None else "\n".join(x for x in t.split("\n") if not WORD.search(x.encode()) or not next(gone))
        if kept == t or WORD.search((kept or "").encode()):
            out.append((d, kept))
    return out


def test_stages_against_brute_force(spark, rows, tmp_path):
    folder = f"file://{tmp_path}"
    docs = spark.createDataFrame(rows, DOCS)
    texts = {r[0]: r[1] for r in rows}
    # the labels say that short texts are bad, so that something goes
    more = [(r[0] + 5000 * k, *r[1:]) for k in range(8) for r in rows]
    labels = spark.createDataFrame([(r[0], int(len((r[1] or "").split()) > 60), 0) for r in more], "doc_id long, quality int, toxic int")
    item = next(" ".join(t.split()[3:40]) for _, t, *_ in rows if t and len(t.split()) > 60)
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item), (1, "hot word")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    held = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    stage = dict(corpus_pipeline.STAGES)

    many = spark.createDataFrame(more, DOCS)
    good = {r["doc_id"] for r in quality.classify(many, labels.select("doc_id", "quality")).where("score >= 0.7").collect()}
    one = held(stage["quality"](spark, many, folder))
    assert one == sorted(((r[0], r[1]) for r in more if r[0] in good), key=repr) and 100 < len(one) < len(more)

    two = held(stage["lines"](spark, docs, folder))
    assert two == sorted(cut_lines(sorted(texts.items())), key=repr) and two != held(docs)

    three = held(stage["near_duplicates"](spark, docs, folder))
    s = sets([(d, t) for d, t in texts.items()], 5)
    ids = sorted(s)
    label = reach(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])])
    assert three == sorted(((d, texts[d]) for d in ids if label[d] == d), key=repr) and len(three) < len(rows)

    four = held(stage["leaks"](spark, docs, folder))
    found = {d for d, _ in all_leaks(texts.items(), [(0, item), (1, "hot word")])}
    assert four == sorted(((d, t) for d, t in texts.items() if d not in found), key=repr) and len(four) < len(rows)

    five = stage["mix"](spark, docs, folder)
    assert five.where("taken <= 0 or taken > 3 * size").count() == 0 and held(five) == sorted(((r["doc_id"], texts[r["doc_id"]]) for r in five.collect()), key=repr)
    for r in five.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 0.02 * r["target"] + 1
