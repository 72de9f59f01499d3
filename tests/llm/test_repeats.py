"""Suffix-array, substring and line dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
from conftest import WORD

from castleflow.llm import common, lines, repeats, substrings, suffixes


def late(sequences, window):
    """Covered places by document, for windows that start earlier too."""
    seen, out = set(), {}
    for d in sorted(sequences):
        s = sequences[d]
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            key = tuple(s[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out[d] = gone
    return out


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_suffix_array():
    r = random.Random(5)
    for _ in range(400):
        text = [r.randint(0, r.choice([0, 1, 4])) for _ in range(r.randint(0, 50))]
        assert suffixes.suffix_array(np.array(text, int)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("n", [100, 40])
def test_bytes(docs, rows, n):
    texts = {d: (t or "").encode() for d, t, *_ in rows}
    gone = late(texts, n)
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffixes.dedup_suffixes(docs, n_bytes=n).collect()}
    for d, t in texts.items():
        g = gone[d]
        spans = sum(g[i] and (i == 0 or not g[i - 1]) for i in range(len(g)))
        assert got[d] == (len(t), sum(g), spans, sha(bytes(b for b, x in zip(t, g, strict=True) if not x)))
    assert any(any(g) for g in gone.values())


def test_long_windows(spark):
    r = random.Random(13)
    shared = [[f"s{r.random()}" for _ in range(900)] for _ in range(8)]
    # every other copy is in other surroundings
    texts = {i: ([f"a{i}"] * (i % 5) + shared[i % 8] + [f"z{i}"] * (i % 3)) for i in range(24)}
    gone = late(texts, 400)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {x["doc_id"]: x["n_removed"] for x in substrings.dedup_substrings(docs, words=400).collect()}
    assert got == {i: sum(gone[i]) for i in texts} and sum(got.values()) > 10_000
    with pytest.raises(ValueError, match="too long"):
        substrings.dedup_substrings(docs, words=70_000)


@pytest.mark.parametrize("n", [20, 7])
def test_words(docs, rows, n):
    texts = {d: WORD.findall((t or "").encode()) for d, t, *_ in rows}
    gone = late(texts, n)
    got = {r["doc_id"]: tuple(r) for r in substrings.dedup_substrings(docs, words=n).collect()}
    for d, t in texts.items():
        kept = b" ".join(w for w, x in zip(t, gone[d], strict=True) if not x)
        assert got[d] == (d, len(t), sum(gone[d]), sha(kept), kept.decode())


def test_lines(docs, rows):
    full = {d: [x for x in (t or "").split("\n") if WORD.search(x.encode())] for d, t, *_ in rows}
    runs, single = late(full, 2), late(full, 1)
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs, keep=("lang",)).collect()}
    cut = 0
    for d, t, *_ in rows:
        gone = iter([a or (b and len(x.split()) >= 50) for x, a, b in zip(full[d], runs[d], single[d], strict=True)])
        kept = None if t is None else "\n".join(x for x in t.split("\n") if not WORD.search(x.encode()) or not next(gone))
        assert (got[d]["n_lines"], got[d]["kept"], got[d]["lang"]) == (len(full[d]), kept, "en")
        cut += got[d]["n_removed"]
    assert cut


def test_long_documents_are_cut_with_overlap(monkeypatch):
    monkeypatch.setattr(repeats, "LONGEST", 64)
    r = np.random.default_rng(1)
    sym = r.integers(0, 3, 300).astype(np.uint8)
    plan = repeats.Plan(suffixes.byte_symbols, 10, 4)
    first = np.array([0, 170, 170, 300])
    _, _, doc, start, count = repeats.runs(sym, first, plan)
    windows = {(d, s + k) for d, s, c in zip(doc.tolist(), start.tolist(), count.tolist(), strict=True) for k in range(c)}
    assert windows == {(0, i) for i in range(161)} | {(2, i) for i in range(121)}


def test_odd_and_empty_tables(odd, none):
    for f, n in ((substrings.dedup_substrings, "n_words"), (suffixes.dedup_suffixes, "n_bytes"), (lines.dedup_lines, "n_lines")):
        got = f(odd).collect()
        assert len(got) == 5 and f(none).count() == 0
        # null comes first, and so keeps its text; of the others with the same text nothing is left
        kept = {(r["doc_id"], r[n] - r["n_removed"] if r[n] else None) for r in got}
        assert any(i is None and left for i, left in kept) and sum(r["n_removed"] == 0 for r in got) in (2, 3)


def thue_morse(n, pair="ab"):
    s = pair[0]
    while len(s) < n:
        s += s.translate(str.maketrans(pair, pair[::-1]))
    return s


def test_strings_that_polynomials_confuse(spark):
    one = thue_morse(2048)
    two = one.translate(str.maketrans("ab", "ba"))
    for k in (common.FIRST, common.SECOND):
        a, b = (np.frombuffer(x.encode(), np.uint8) for x in (one, two))
        assert common.range_hash(a, [0], [2048], k) != common.range_hash(b, [0], [2048], k)
    docs = spark.createDataFrame([(1, f"{one}\nnext"), (2, f"{two}\nnext"), (3, f"{one}\nnext"), (4, " ".join([one] * 25)), (5, " ".join([two] * 25))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(docs).collect()} == {1: 0, 2: 0, 3: 2, 4: 0, 5: 0}
    # 25 equal words repeat their own window, and nothing of the other document
    assert {r["doc_id"]: r["n_removed"] for r in substrings.dedup_substrings(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 24, 5: 24}


def test_hashes_of_long_arrays_agree_with_those_of_their_parts(monkeypatch):
    monkeypatch.setattr(common, "STRETCH", 256)
    r = np.random.default_rng(3)
    v = r.integers(0, 256, 5000).astype(np.uint8)
    start = r.integers(0, 4700, 400)
    end = start + r.integers(0, 300, 400)
    whole = common.range_hash(v, start, end)
    assert all(whole[i] == common.range_hash(v[start[i] : end[i]].copy(), [0], [end[i] - start[i]])[0] for i in range(400))


@pytest.mark.parametrize("n", [400, 129])
def test_long_byte_windows(spark, n):
    r = random.Random(14)
    shared = ["".join(r.choice("abcdefg ") for _ in range(1500)) for _ in range(4)]
    texts = {i: "x" * (i % 3) + shared[i % 4][i % 5 : 1500 - 7 * i] + "é" * (i % 2) for i in range(16)}
    gone = late({i: t.encode() for i, t in texts.items()}, n)
    got = {x["doc_id"]: x["n_removed"] for x in suffixes.dedup_suffixes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), n_bytes=n).collect()}
    assert got == {i: sum(g) for i, g in gone.items()} and sum(got.values()) > 5000


def one_bucket(texts, window, gram):
    """All runs of the texts in one bucket, with their symbols."""
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    first = np.cumsum([0, *map(len, texts)])
    ha, _, doc, start, count = repeats.runs(raw, first, repeats.Plan(suffixes.byte_symbols, window, gram))
    n = count - 1 + window
    take = np.repeat(first[doc] + start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return repeats.Bucket(ha, doc, start, count, raw[take], np.r_[0, np.cumsum(n)])


def windows_of(spans):
    return {(r, s + k) for r, s, c in zip(*(spans.column(c).to_pylist() for c in ("row", "start", "count")), strict=True) for k in range(c)}


TEXTS = ["the cat sat on the mat and sat on the mat", "a cat sat on the mat", "on the mat and sat", "zzzzzzzzzzzzzzzz", "the cat"]


def expected(window):
    seen, out = set(), set()
    for d, t in enumerate(TEXTS):
        for i in range(len(t) - window + 1):
            out |= {(d, i)} if t[i : i + window] in seen else set()
            seen.add(t[i : i + window])
    return out


@pytest.mark.parametrize(("window", "gram"), [(8, 3), (5, 5), (6, 1)])
def test_matches_are_grown_symbol_by_symbol(monkeypatch, window, gram):
    bucket = one_bucket(TEXTS, window, gram)
    assert windows_of(repeats.extend(bucket, window, gram)) == expected(window)
    if window > gram:  # what is beside the seed decides
        monkeypatch.setattr(repeats, "refine", lambda labels, symbols: labels)
        assert windows_of(repeats.extend(bucket, window, gram)) != expected(window)


def test_the_suffix_array_decides(monkeypatch):
    bucket = one_bucket(TEXTS, 8, 3)
    assert windows_of(suffixes.sort_suffixes(bucket, 8, 3)) == expected(8)
    # the filter makes no two windows equal: nothing changes if it lets all pass
    monkeypatch.setattr(suffixes, "_filter_hash", lambda values, starts, ends: np.zeros(len(starts), np.uint64))
    assert windows_of(suffixes.sort_suffixes(bucket, 8, 3)) == expected(8)
    # in another order neighbours don't agree, and repeats are lost
    right = suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda text: np.random.default_rng(1).permutation(right(text)))
    assert windows_of(suffixes.sort_suffixes(bucket, 8, 3)) != expected(8)


@pytest.mark.parametrize("limits", [(20_000, 8), (10**9, 2)])
def test_hot_anchors_change_nothing(spark, monkeypatch, limits):
    monkeypatch.setattr(repeats, "HOT_SAMPLE", limits[0])
    monkeypatch.setattr(repeats, "HOT_RUNS", limits[1])
    r = random.Random(15)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    phrase, passage = [word() for _ in range(9)], [word() for _ in range(30)]
    texts = {}
    for i in range(240):  # a phrase under the threshold in ever new surroundings, and a passage over it
        around = [[word() for _ in range(r.randint(0, 30))] for _ in range(4)]
        texts[i] = around[0] + phrase + around[1] + (passage[: r.randint(15, 30)] if i % 3 == 0 else []) + around[2] + phrase + around[3]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    plan = repeats.Plan(substrings.word_symbols, 20, 6)
    (hot,) = repeats.hot_anchors(repeats.keyed(docs), (plan,))
    assert len(hot)
    gone = late(texts, 20)
    got = {x["doc_id"]: x["n_removed"] for x in substrings.dedup_substrings(docs).collect()}
    assert got == {i: sum(gone[i]) for i in texts} and sum(got.values()) > 300
    raw = {i: " ".join(t).encode() for i, t in texts.items()}
    gone = late(raw, 100)
    assert {x["doc_id"]: x["n_removed"] for x in suffixes.dedup_suffixes(docs).collect()} == {i: sum(gone[i]) for i in raw}
    # the same words as lines
    gone = late(texts, 2)
    as_lines = spark.createDataFrame([(i, "\n".join(t)) for i, t in texts.items()], "doc_id long, text string")
    assert {x["doc_id"]: x["n_removed"] for x in lines.dedup_lines(as_lines).collect()} == {i: sum(gone[i]) for i in texts}
