"""Suffix-array dedup of bytes.

The array is built by linear grouping (Baier, "Linear-time Suffix Sorting", CPM 2016). First
all suffixes are put into groups by their Lyndon prefix: groups are handled from the highest
down, and each member points to the nearest earlier suffix of a lower group; what is pointed
at k times by one group moves to a new group right above its own, since its context grows by
k times the handled one. Then one pass over the array emits the order inside the groups: each
suffix that is placed places the one before it and the chain of its pointers. Nothing is
renamed, and no shorter string is sorted in between.

A corpus is too long for one array. Runs of windows that share an anchor meet in one bucket
(see ``repeats``), so that whatever repeats does so inside a bucket, and each bucket has an
array of its own. Before it is built, windows whose hash is unique in the bucket are cut off,
since they repeat nothing, and equal strings are laid together. A hash never makes two windows
equal: the array decides byte by byte; neighbours in its order that agree in a whole window are
one class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from castleflow.llm.common import blocks, lean, range_hash, utf8
from castleflow.llm.repeats import Bucket, Plan, covered, keyed, late_spans

BYTES = 100
GRAM = 32
#: Symbols of one array; a bucket with more is cut between anchors.
ARRAY = 400_000


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of an array of non-negative integers, in lexicographic order."""
    n = len(text) + 1
    text = np.append(np.asarray(text, np.int64) + 1, 0)
    group, prev, size, above = _group(text)
    # every group's next free place
    free, g, at = [0] * len(size), 0, 0
    while g >= 0:
        free[g], at, g = at, at + size[g], above[g]
    out = [-1] * n
    out[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = prev[s]
    return np.array(out[1:], np.int64)


def _group(text: np.ndarray) -> tuple[list[int], list[int], list[int], list[int]]:
    """Of each suffix its group and pointer; of each group its size and the next one up. Group 0 is the lowest."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    members = [m.tolist() for m in np.split(order, np.flatnonzero(np.diff(text[order])) + 1)]
    size = [len(m) for m in members]
    start = np.empty(n, np.int64)
    start[order] = np.repeat(np.arange(len(members)), size)
    group: list[int] = start.tolist()
    above, below = [*range(1, len(members)), -1], list(range(-1, len(members) - 1))
    prev = [-1] * n
    left = list(range(n))  # left[i] is i while its group isn't handled, and then some place between it and its pointer
    at = len(members) - 1
    while at >= 0:
        times: dict[int, int] = {}
        for s in members[at]:  # from left to right; those that have moved since are skipped
            if group[s] != at:
                continue
            p = s - 1
            while p >= 0:
                q = left[p]
                if q == p:
                    times[p] = times.get(p, 0) + 1
                    break
                if q >= 0:
                    left[p] = q = left[q]
                p = q
            prev[s] = left[s] = p
        moves: dict[tuple[int, int], list[int]] = {}
        for p, k in times.items():
            moves.setdefault((group[p], k), []).append(p)
        for old, k in sorted(moves, reverse=True):
            moved = moves[old, k]
            if len(moved) == size[old]:
                continue  # all that is left of it moves, so it stays where it is
            new, up = len(members), above[old]
            members.append(moved)
            size.append(len(moved))
            size[old] -= len(moved)
            above.append(up)
            below.append(old)
            above[old] = new
            if up >= 0:
                below[up] = new
            for p in moved:
                group[p] = new
        members[at] = ()
        at = below[at]
    return group, prev, size, above


def _may_repeat(bucket: Bucket, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Run and offset of the windows whose hash occurs again in the bucket.

    Only a filter: what it leaves out differs from all others; what it keeps the array judges.
    """
    run = np.repeat(np.arange(len(bucket.count)), bucket.count)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(bucket.count) - bucket.count, bucket.count)
    begin = bucket.first[run] + offset
    found = _filter_hash(bucket.symbols, begin, begin + window)
    order = np.argsort(found, kind="stable")
    same = found[order][1:] == found[order][:-1]
    again = np.zeros(len(run), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    return run[again], offset[again]


_filter_hash = range_hash


def _distinct(bucket: Bucket, window: int) -> tuple[list[bytes], np.ndarray, np.ndarray, pa.Table]:
    """The bucket's strings of windows that may repeat, each content once, with the row and start of its first.

    The table holds the spans of the other copies, all of whose windows are late.
    """
    run, offset = _may_repeat(bucket, window)
    new = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(run) else np.zeros(0, int)
    count = np.diff(np.r_[new, len(run)])
    begin = bucket.first[run[new]] + offset[new]
    row, start = bucket.row[run[new]], bucket.start[run[new]] + offset[new]
    data = bucket.symbols.tobytes()
    firsts: dict[bytes, int] = {}
    other = []
    for i in np.lexsort((start, row)).tolist():
        a = int(begin[i])
        text = data[a : a + int(count[i]) - 1 + window]
        if text in firsts:
            other.append(i)
        else:
            firsts[text] = i
    kept = np.fromiter(firsts.values(), np.int64, len(firsts))
    return list(firsts), row[kept], start[kept], _spans(row[other], start[other], count[other])


def _spans(row: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.Table:
    return pa.table({"row": pa.array(row, pa.int64()), "start": pa.array(np.asarray(start, np.int32)), "count": pa.array(np.asarray(count, np.int32))})


def _late_windows(texts: list[bytes], row: np.ndarray, start: np.ndarray, window: int) -> pa.Table:
    """Late windows among the texts, by one suffix array over all of them."""
    length = np.array([len(t) for t in texts])
    first = np.cumsum(length + 1) - length - 1
    text = np.frombuffer(b"\0".join(texts), np.uint8).astype(np.int16) + 1
    text[first[1:] - 1] = 0
    of = np.repeat(np.arange(len(texts)), length - window + 1)
    place = np.arange(len(of)) - np.repeat(np.cumsum(length - window + 1) - (length - window + 1), length - window + 1)
    owner = np.full(len(text), -1)
    owner[first[of] + place] = np.arange(len(of))
    inner = owner[suffix_array(text)]
    inner = inner[inner >= 0]  # windows in the order of their suffixes
    at = first[of[inner]] + place[inner]
    same = np.zeros(len(at), bool)
    reach = np.arange(window)
    for a in range(1, len(at), 4096):
        b = min(a + 4096, len(at))
        same[a:b] = (text[at[a:b, None] + reach] == text[at[a - 1 : b - 1, None] + reach]).all(1)
    label = np.cumsum(~same)
    order = np.lexsort((start[of[inner]] + place[inner], row[of[inner]], label))
    late = order[1:][label[order][1:] == label[order][:-1]]
    late = np.sort(inner[late])
    of, place = of[late], place[late]
    new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (place[1:] != place[:-1] + 1)]) if len(of) else np.zeros(0, int)
    return _spans(row[of[new]], start[of[new]] + place[new], np.diff(np.r_[new, len(of)]))


def sort_suffixes(bucket: Bucket, window: int, gram: int) -> pa.Table:
    """Late windows of a bucket, cut between anchors into arrays of bounded length."""
    order = np.argsort(bucket.anchor, kind="stable")
    length = bucket.count[order] - 1 + window
    piece = np.cumsum(length) // ARRAY
    head = np.r_[True, bucket.anchor[order][1:] != bucket.anchor[order][:-1]]
    piece = piece[np.flatnonzero(head)][np.cumsum(head) - 1]
    found = [_spans(*[np.zeros(0, np.int64)] * 3)]
    for o in np.split(order, np.flatnonzero(np.diff(piece)) + 1):
        n = bucket.count[o] - 1 + window
        take = np.repeat(bucket.first[o] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        part = Bucket(bucket.anchor[o], bucket.row[o], bucket.start[o], bucket.count[o], bucket.symbols[take], np.r_[0, np.cumsum(n)])
        texts, row, start, copies = _distinct(part, window)
        found.append(copies)
        if texts:
            found.append(_late_windows(texts, row, start, window))
    return pa.concat_tables(found)


def byte_symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return raw, offsets


def _finish(window: int, with_text: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column("text"))
            spans = batch.column("spans")
            n_removed, n_spans, digest, texts = [], [], [], []
            for a, b in blocks(offs):
                first = offs[a : b + 1] - offs[a]
                part = raw[offs[a] : offs[b]]
                gone = covered(len(part), first, spans.slice(a, b - a), window)
                for lo, hi in zip(first[:-1], first[1:], strict=True):
                    cut, text = gone[lo:hi], part[lo:hi]
                    n_removed.append(int(np.count_nonzero(cut)))
                    n_spans.append(int(np.count_nonzero(cut[1:] & ~cut[:-1])) + int(cut[:1].sum()) if n_removed[-1] else 0)
                    kept = text[~cut].tobytes() if n_removed[-1] else text.tobytes()
                    digest.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        texts.append(kept)
            out = {"doc_id": batch.column("doc_id"), "n_bytes": pa.array(np.diff(offs), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            if with_text:
                out["kept"] = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return of


def dedup_suffixes(docs: DataFrame, *, n_bytes: int = BYTES, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, unless it isn't wanted, the kept bytes.

    A byte of a text's UTF-8 goes if ``n_bytes`` consecutive bytes that cover it also start
    earlier (smaller doc_id, or earlier in the document); strings are judged on the input. Null
    and empty texts have no bytes. Where doc_id repeats or is null, rows are ordered by doc_id
    (nulls first) and text. Extra columns are ignored; an empty table gives an empty result.
    What is kept is binary, since a cut may fall inside a character.
    """
    docs = keyed(docs)
    late = late_spans(docs, Plan(byte_symbols, n_bytes, min(GRAM, n_bytes)), sort_suffixes, np.uint8, "suffixes")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return docs.join(late, "row", "left").select("doc_id", "text", "spans").mapInArrow(lean(_finish(n_bytes, with_text)), schema)


#: DuckDB SQL for the columns without the kept bytes, at 100 bytes, where doc_id is unique. Bytes are pairs of hexadecimal digits.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents),
places AS (SELECT doc_id, unnest(b) AS s1, generate_subscripts(b, 1) AS i FROM d),
-- strings of 100 bytes, by doubling: 64 and 32 and 4
s2 AS (SELECT *, s1 || lead(s1, 1) OVER (PARTITION BY doc_id ORDER BY i) AS s2 FROM places),
s4 AS (SELECT *, s2 || lead(s2, 2) OVER (PARTITION BY doc_id ORDER BY i) AS s4 FROM s2),
s8 AS (SELECT *, s4 || lead(s4, 4) OVER (PARTITION BY doc_id ORDER BY i) AS s8 FROM s4),
s16 AS (SELECT *, s8 || lead(s8, 8) OVER (PARTITION BY doc_id ORDER BY i) AS s16 FROM s8),
s32 AS (SELECT *, s16 || lead(s16, 16) OVER (PARTITION BY doc_id ORDER BY i) AS s32 FROM s16),
s64 AS (SELECT *, s32 || lead(s32, 32) OVER (PARTITION BY doc_id ORDER BY i) AS s64 FROM s32),
windows AS (SELECT doc_id, i, md5(s64 || lead(s32, 64) OVER w || lead(s4, 96) OVER w) AS h FROM s64 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
judged AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS late FROM windows WHERE h IS NOT NULL),
covered AS (SELECT doc_id, i, s1, coalesce(max(CAST(late AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 0) AS cut FROM places LEFT JOIN judged USING (doc_id, i)),
spans AS (SELECT *, cut = 1 AND coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS begins FROM covered)
SELECT d.doc_id, CAST(len(any_value(d.b)) AS BIGINT) AS n_bytes, CAST(coalesce(sum(cut), 0) AS BIGINT) AS n_removed, CAST(count(*) FILTER (begins) AS BIGINT) AS n_spans, sha256(unhex(coalesce(string_agg(s1, '' ORDER BY i) FILTER (cut = 0), ''))) AS kept_sha256
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""
