"""Near duplicates, neighbours and leaks against brute force."""

import random

import numpy as np
import pytest
from conftest import DOCS, WORD
from pyspark.sql import functions as F

from castleflow.llm import components, leaks, minhash, neighbours


def sets(rows, k):
    out = {}
    for d, t, *_ in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode())
        out[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def reach(nodes, links):
    label = {d: d for d in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, rows, k):
    s = sets(rows, k)
    ids = sorted(s)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    label = reach(ids, links)
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_duplicates(docs, words=k).collect()}
    assert got == {d: (len(s[d]), label[d], label[d] == d) for d in ids} and links
    assert {r["doc_id"] for r in minhash.drop_near_duplicates(docs, words=k).collect()} == {d for d in ids if label[d] == d}


def test_near_duplicates_of_odd_tables(odd, none):
    got = minhash.near_duplicates(odd).collect()
    # equal texts, and one that differs by a word, are one group; its first row is the null id's
    assert sorted((str(r["doc_id"]), r["kept"]) for r in got) == [("1", False), ("1", False), ("1", False), ("2", True), ("None", True)]
    assert minhash.near_duplicates(none).count() == 0 and minhash.drop_near_duplicates(odd).columns == ["doc_id", "text", "row", "spans", "size", "source"]


def test_salted_classes(docs, rows, monkeypatch):
    before = sorted(map(tuple, minhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(minhash, "PARTNERS", 1)
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect())) == before


@pytest.mark.parametrize("members", [256, 40])
def test_links_in_a_family_under_the_threshold(spark, monkeypatch, members):
    """600 texts at similarity 0.75 to each other: a bucket's centre is a stranger to most of its members."""
    monkeypatch.setattr(minhash, "MEMBERS", members)
    template = [f"t{i}" for i in range(120)]
    own = lambda d, n: [f"d{d}w{i}" for i in range(n)]
    rows, links = [], []
    for d in range(0, 600, 2):
        shared = [f"p{d}w{i}" for i in range(6 + d % 6)]  # similarity 0.8 to 0.84 within a pair
        rows += [(e, " ".join(template + shared + own(e, 20 - len(shared))), "en", "s", 0) for e in (d, d + 1)]
    rows += [(10_000, rows[40][1] + " tail", "en", "s", 0)]  # a chain to a member
    s = sets(rows, 1)
    ids = sorted(s)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    strangers = len(s[0] & s[2]) / len(s[0] | s[2])
    assert len(links) > 250 and 0.74 < strangers < 0.76
    label = reach(ids, links)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), words=1).collect()}
    assert got == label


def test_common_shingles_of_a_cell(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    r = np.random.default_rng(5)
    held = [np.unique(r.integers(0, 60, r.integers(1, 30))).astype(np.uint64) for _ in range(9)]
    got = minhash._shared(np.concatenate(held), np.cumsum([0, *map(len, held)]))
    for i, a in enumerate(held):
        for j, b in enumerate(held):
            assert i == j or got[i, j] == len(np.intersect1d(a, b))


def test_signature_agreement_follows_similarity():
    r = np.random.default_rng(2)
    pool = r.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)
    for size, common in ((400, 320), (10, 8)):
        hits = []
        for _ in range(200):
            x = r.permutation(pool)
            a, b = np.sort(x[:size]), np.sort(np.r_[x[:common], x[size : size + size - common]])
            s = minhash.signatures(np.r_[a, b], np.array([0, size, 2 * size]))
            hits.append((s[0] == s[1]).mean())
        assert abs(np.mean(hits) - common / (2 * size - common)) < 0.05


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    label = reach({x for e in edges for x in e}, edges)
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(d, d) == c for d, c in label.items())
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(n=300, seed=4):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, 8)) * r.uniform(0.5, 2, (n, 1))
    v[50:80] = v[49]  # a large group of equal vectors
    rows = [(i, v[i].tolist()) for i in range(n)]
    return v, rows + [(1001, None), (1002, [0.0] * 8), (1003, [None] * 8), (1004, [float("nan")] * 8), (None, [1.0] * 8), (1006, [float("inf")] + [0.0] * 7)]


def brute(v, q, k=20):
    """(vec_id, score) by products that are summed from left to right."""
    s = np.cumsum(v * v[q], 1)[:, -1]
    return [(i, s[i]) for i in sorted((i for i in range(len(v)) if i != q), key=lambda i: (-s[i], i))[:k]]


def found_by_query(rows):
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


@pytest.mark.parametrize("least", [1000, 30])
def test_neighbours(spark, monkeypatch, least):
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    monkeypatch.setattr(neighbours, "GROUP", 7)
    v, rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("cell", F.lit("x"))
    got = found_by_query(neighbours.nearest(df, F.col("vec_id") % 20 == 0, least=least).collect())
    assert sorted(got) == list(range(0, 300, 20))
    hits = 0
    for q, found in got.items():
        best = brute(v, q)
        if least == 1000:  # to the last digit, ties across blocks too
            assert found == best
        hits += len({i for i, _ in found} & {i for i, _ in best})
    assert hits / (20 * len(got)) >= 0.9


def test_neighbours_in_cells(spark, monkeypatch):
    r = np.random.default_rng(8)
    centres = r.normal(size=(40, 16)) * 3
    v = centres[r.integers(0, 40, 4000)] + r.normal(size=(4000, 16))
    v[:900] = v[0]  # one vector, and so one cell, holds a good part of all rows
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    monkeypatch.setattr(neighbours, "GROUP", 10)
    monkeypatch.setattr(neighbours, "CELL", 20)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = found_by_query(neighbours.nearest(df, F.col("vec_id") % 100 == 0, pivots=20, visits=30).collect())
    assert len(got) == 40 and all(len(found) == 20 for found in got.values())
    hits = sum(len({i for i, _ in found} & {i for i, _ in brute(v, q)}) for q, found in got.items())
    assert hits / 800 >= 0.9


def test_tables_of_few_cells_are_cut_like_larger_ones(spark, monkeypatch):
    # pivots that say next to nothing: of a table that is searched as one block, most neighbours would be missed
    monkeypatch.setattr(neighbours, "CELL", 40)
    v = np.random.default_rng(3).normal(size=(400, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    for visits in (10, 11, 64):  # all of the ten cells
        got = found_by_query(neighbours.nearest(df, F.col("vec_id") % 20 == 0, pivots=2, prefix=1, probe=1, share=0.001, least=250, visits=visits, k=5).collect())
        assert got == {q: brute(v, q)[:5] for q in range(0, 400, 20)}


def test_vectors_of_other_lengths_meet_their_like(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)] + [(100 + i, [1.0, float(i), 2.0]) for i in range(6)] + [(200, [5.0])], "vec_id long, embedding array<double>")
    got = found_by_query(neighbours.nearest(df, F.col("vec_id") % 100 == 0, k=3).collect())
    assert got == {0: [(1, 1.0), (2, 1.0), (3, 1.0)], 100: [(101, 5.0), (102, 5.0), (103, 5.0)]}


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.5, 0.5]), (4, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 3, 0.5), (0, 2, 4, 0.5)]
    assert neighbours.nearest(df.where("false"), F.col("vec_id") == 0).count() == 0


def test_leaks(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    items = [(i, [word() for _ in range(r.randint(12, 50))]) for i in range(30)]
    other = lambda n: [word() for _ in range(n)]
    docs = [(100 + i, " ".join(other(r.randint(0, 300)))) for i in range(60)] + [(1, None), (2, "")]
    planted = set()
    for i, w in items[:20]:
        edited = [x if r.random() > 0.15 else word() for x in w]
        text = {0: w, 1: [x.upper() + "," for x in w], 2: edited, 3: w}[i % 4]
        docs.append((i + 500, " ".join(other(r.randint(0, 90)) + text + other(r.randint(0, 90)))))
        planted.add((i + 500, i))
    half = items[25][1]
    docs.append((700, " ".join(other(20) + half[: len(half) // 3] + other(40))))  # a third of an item is none
    d = spark.createDataFrame([(a, b, "en", "s", 0) for a, b in docs], DOCS)
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(90, "too few words"), (91, None), (None, "a b c d e f g")], "item_id long, text string")
    got = leaks.find_leaks(d, b)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == planted
    assert leaks.find_leaks(d.where("false"), b).count() == 0 and leaks.find_leaks(d, b.where("false")).count() == 0


def test_leaks_that_are_cut_off_or_edited_at_an_end(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    items = [(i, [word() for _ in range(r.randint(20, 50))]) for i in range(12)]
    cuts = [lambda w: w[: round(0.85 * len(w))], lambda w: w[: round(0.7 * len(w))], lambda w: w[round(0.3 * len(w)) :], lambda w: w[: round(0.7 * len(w))] + [word() for _ in w[round(0.7 * len(w)) :]]]
    docs = [(i, " ".join([word() for _ in range(r.randint(0, 60))] + cuts[i % 4](w) + [word() for _ in range(r.randint(0, 60))])) for i, w in items]
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in leaks.find_leaks(d, b).collect()} == {(i, i) for i, _ in items}
    # with an answer that the copies lack, only those that hold nearly all of the item stay
    assert leaks.find_leaks(d, b.withColumn("answer", F.lit("zzz yyy"))).count() == 0


def test_leaks_of_an_item_that_a_third_of_short_documents_hold(spark, monkeypatch):
    monkeypatch.setattr(leaks, "CHUNK", 50)
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    items = [(i, [word() for _ in range(r.randint(15, 50))]) for i in range(20)]
    items[7] = (7, items[7][1][:15])
    text = lambda: [word() for _ in range(r.randint(0, 12))]
    docs = [(i, " ".join(text() + (items[7][1] if i % 3 == 0 else []) + text())) for i in range(900)]
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == {(i, 7) for i in range(0, 900, 3)} and all(x["lcs_share"] == 1 for x in got)


def test_leaks_of_rows_with_repeated_and_null_ids(spark, tmp_path):
    import corpus_pipeline as p

    item, clean = " ".join(f"b{i}" for i in range(30)), " ".join(f"c{i}" for i in range(30))
    rows = [(None, "x " + item), (None, "y " + item), (None, clean), (7, item + " z"), (7, clean + " z"), (8, clean + " y")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOCS)
    benchmark = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert sorted(str(r["doc_id"]) for r in leaks.find_leaks(docs, benchmark).collect()) == ["7", "None", "None"]
    benchmark.write.parquet(f"file://{tmp_path}/benchmark.parquet")
    left = p.drop_leaks(spark, docs, f"file://{tmp_path}").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in left) == [("7", clean + " z"), ("8", clean + " y"), ("None", clean)]


def test_leaks_of_short_items(spark):
    b = spark.createDataFrame([(0, "Red blue, green."), (1, "solo"), (2, "..."), (3, "one two three four")], "item_id long, text string")
    fill = " ".join(f"w{i}" for i in range(30))
    docs = [(0, f"{fill} red BLUE green {fill}"), (1, f"{fill} red blue x green"), (2, "green blue red"), (3, f"w solo {fill}"), (4, "one two three"), (5, f"{fill} a b c d one two three four"), (6, "... !")]
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()
    assert sorted((r["doc_id"], r["item_id"], r["lcs_share"]) for r in got) == [(0, 0, 1.0), (3, 1, 1.0), (5, 3, 1.0)]


def test_common_subsequence():
    r = random.Random(7)
    for _ in range(200):
        a, b = [[r.randint(0, 4) for _ in range(r.randint(0, 12))] for _ in range(2)]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert leaks.common_subsequence(tuple(a), b) == table[-1][-1]
