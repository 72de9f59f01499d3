"""Repeated windows of a corpus: the engine below suffix-array, substring and line dedup.

A document is a sequence of symbols (bytes, word hashes or line hashes). A window is
``window`` consecutive symbols of one document. A window is *late* if the same symbols also
start earlier: in a document with a smaller id, or earlier in the same document. The engine
finds exactly the late windows of all documents.

Winnowing routes the work. Each window picks the k-gram with the smallest hash in it, its
anchor; equal windows pick the same anchor at the same offset. Consecutive windows with one
anchor form a *run*, about two for each ``window - gram`` symbols.

1. ``_runs`` finds all runs and sends 30 bytes for each to a bucket by the anchor's hash, as
   packed arrays. Equal runs of one batch are settled there, so that a text that a third of
   all documents share reaches its bucket once a batch.
2. ``_meet`` joins the runs of a bucket on their anchors. A run whose anchor occurs once holds
   no repeat and goes. Equal runs are late but for the first. Where an anchor stands in
   different surroundings, the first run of each content is asked for its symbols.
3. ``_contexts`` reads these symbols from the documents and sends them to buckets again.
4. The operator's resolver decides which windows of a bucket are late; ``extend`` grows the
   matches of each seed symbol by symbol.

An anchor may stand in very many surroundings, and then one bucket would hold them all. Such
anchors are looked up in a bounded sample of documents first. Their runs are taken apart: each
window goes to a bucket of its own, by a 128-bit cryptographic hash of its symbols, and the first
one stays. Equal windows have equal anchors and thus the same way, whatever the sample found; it
moves work and decides nothing.

Where windows are short, as of lines, runs carry their symbols from the start, and steps 2 and 3
fall away (``late_spans_at_once``).

``late_spans`` gives the late windows as rows (row, start, count): ``count`` windows that start
at symbol ``start`` and after.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castleflow.llm.common import SECOND, blocks, lean, lean_group, mix64, parts_for, range_hash, stash, utf8

#: Low bits of a sort key that hold a position; longer symbol arrays are cut, with overlap.
PLACE_BITS = 24
LONGEST = 1 << 22

#: Documents that are searched for hot anchors, the surroundings that make one, and the most of them.
HOT_SAMPLE, HOT_RUNS, HOT_ANCHORS = 20_000, 8, 100_000

SPAN = "row long, start int, count int"
MARK = "row long, start int, count int, anchor long"
BLOB = "bucket int, payload binary"


@dataclass(frozen=True)
class Plan:
    """How to read symbols and which windows to compare.

    symbols: (raw bytes, document offsets) to (symbols, first symbol of each document and the end).
    """

    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    window: int
    gram: int

    def __post_init__(self) -> None:
        # a run's number of windows is packed in two bytes
        if self.window - self.gram + 1 >= 1 << 16:
            raise ValueError(f"a window of {self.window} symbols is too long for grams of {self.gram}")


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with a unique, ordered long ``row``: doc_id itself wherever that is one.

    Where doc_id repeats or is null, the table is sorted by doc_id (nulls first) and text and
    numbered; rows equal in both are interchangeable.
    """
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    kept = docs.select("doc_id", "text", *columns)
    if not odd:
        return kept.withColumn("row", F.col("doc_id").cast("long"))
    return stash(kept.orderBy(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).withColumn("row", F.monotonically_increasing_id()), "keyed")


# --- runs ---------------------------------------------------------------------------------


def runs(sym: np.ndarray, first: np.ndarray, plan: Plan) -> tuple[np.ndarray, ...]:
    """(anchor hash, content hash, document, start, windows) of every run of the documents."""
    if len(sym) > LONGEST:
        return _long_runs(sym, first, plan)
    n, width = len(sym), plan.window - plan.gram + 1
    if n < plan.window:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    at = np.arange(n - plan.gram + 1)
    grams = range_hash(sym, at, at + plan.gram)
    low = grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | at.astype(np.uint64)
    size = 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: size - width], low[width - size :])
    ends = np.zeros(n + 1, np.int32)
    np.add.at(ends, np.maximum(first[:-1], first[1:] - plan.window + 1), 1)
    np.add.at(ends, first[1:], -1)
    start = np.flatnonzero(np.cumsum(ends[: len(low)]) == 0)
    if not len(start):
        return runs(sym[:0], first[:1], plan)
    anchor = (low[start] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
    count, start, anchor = np.diff(np.r_[new, len(start)]), start[new], anchor[new]
    doc = np.searchsorted(first, start, "right") - 1
    content = range_hash(sym, start, start + count - 1 + plan.window, SECOND) + mix64((anchor - start).astype(np.uint64))
    # minima crowd at the low end of the hashes: spread them, since they are dealt to buckets by their high bits
    return mix64(grams[anchor]), content, doc, start - first[doc], count


def _long_runs(sym: np.ndarray, first: np.ndarray, plan: Plan) -> tuple[np.ndarray, ...]:
    """Runs of arrays that are too long for one go: each document in overlapping pieces."""
    found = []
    for d in range(len(first) - 1):
        for a in range(int(first[d]), int(first[d + 1]), LONGEST - plan.window):
            piece = sym[a : min(a + LONGEST - 1, int(first[d + 1]))]
            ha, hc, _, start, count = runs(piece, np.array([0, len(piece)]), plan)
            found.append((ha, hc, np.full(len(ha), d), start + a - first[d], count))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


PACKED = (np.uint64, np.uint64, np.int64, np.uint32, np.uint16)


def pack(columns: tuple[np.ndarray, ...], kinds: tuple = PACKED) -> bytes:
    return b"".join(np.ascontiguousarray(c, k).tobytes() for c, k in zip(columns, kinds, strict=True))


def unpack(payloads: list[bytes], kinds: tuple = PACKED) -> tuple[np.ndarray, ...]:
    each = sum(np.dtype(k).itemsize for k in kinds)
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for p in payloads:
        n, at = len(p) // each, 0
        for k, out in zip(kinds, parts, strict=True):
            out.append(np.frombuffer(p, k, n, at))
            at += n * np.dtype(k).itemsize
    return tuple(np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(parts, kinds, strict=True))


SETTLED = (np.int64, np.uint32, np.uint16)
WINDOW = (np.uint64, np.uint64, np.int64, np.uint32)


def hot_anchors(docs: DataFrame, plans: tuple[Plan, ...]) -> tuple[np.ndarray, ...]:
    """Of each plan the anchors that many surroundings share in a sample of at most about ``HOT_SAMPLE`` documents, sorted."""
    share = -(-docs.count() // HOT_SAMPLE)
    sample = docs.select("row", "text").where(F.pmod(F.xxhash64("row", F.lit(5)), F.lit(max(1, share))) == 0).repartition(8)
    counted = sample.mapInArrow(lean(_count_surroundings(plans)), "plan int, anchor long, n long").groupBy("plan", "anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_RUNS)
    # a bounded number of them; which ones are left out is a matter of balance alone
    found = counted.orderBy(F.desc("n"), "plan", "anchor").limit(HOT_ANCHORS).collect()
    return tuple(np.sort(np.array([r["anchor"] for r in found if r["plan"] == k], np.int64).view(np.uint64)) for k in range(len(plans)))


def _count_surroundings(plans: tuple[Plan, ...]) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column("text"))
            for k, plan in enumerate(plans):
                found = [runs(*plan.symbols(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]), plan)[:2] for a, b in blocks(offs)]
                if not found:
                    continue
                ha, hc = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((hc, ha))
                new = np.r_[True, (ha[order][1:] != ha[order][:-1]) | (hc[order][1:] != hc[order][:-1])] if len(ha) else np.zeros(0, bool)
                anchor, n = np.unique(ha[order][new], return_counts=True)
                often = n > 1
                yield pa.RecordBatch.from_pydict({"plan": pa.array(np.full(often.sum(), k), pa.int32()), "anchor": pa.array(anchor[often].view(np.int64)), "n": pa.array(n[often].astype(np.int64))})

    return of


def _equal_runs(ha: np.ndarray, hc: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, later) of runs with equal anchor and content, both in the order of anchors."""
    order = np.lexsort((start, row, hc, ha))
    again = np.r_[False, (ha[order][1:] == ha[order][:-1]) & (hc[order][1:] == hc[order][:-1])] if len(order) else np.zeros(0, bool)
    return order[~again], order[again]


def _take_apart(sym: np.ndarray, begin: np.ndarray, ha, hc, row, start, count, window: int) -> tuple[tuple, tuple]:
    """Runs of hot anchors in one block: (spans that are late already, (hash, hash, row, start) of the windows of the others)."""
    first, later = _equal_runs(ha, hc, row, start)
    data, each = memoryview(np.ascontiguousarray(sym)).cast("B"), sym.itemsize
    n = count[first]
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = (np.repeat(begin[first], n) + place) * each
    digests = b"".join(hashlib.blake2b(data[a : a + window * each], digest_size=16).digest() for a in at.tolist())
    pair = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    return (row[later], start[later], count[later]), (pair[:, 0], pair[:, 1], np.repeat(row[first], n), np.repeat(start[first], n) + place)


def _late_windows(one: np.ndarray, two: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Places of the first window of each hash, and the others joined to spans (row, start, count)."""
    order = np.lexsort((start, row, two, one))
    again = np.r_[False, (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])] if len(order) else np.zeros(0, bool)
    late = order[again]
    late = late[np.lexsort((start[late], row[late]))]
    r, s = row[late], start[late].astype(np.int64)
    new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)]) if len(late) else np.zeros(0, int)
    return order[~again], (r[new], s[new], np.diff(np.r_[new, len(late)]))


class _Packer:
    """Payloads of a batch by bucket. Buckets below 0 pass on what is settled; those from ``buckets`` on hold single windows."""

    def __init__(self, buckets: int, first_row: int) -> None:
        self.buckets, self.own = buckets, -1 - first_row % buckets
        self.shift = np.uint64(64 - (buckets - 1).bit_length()) if buckets > 1 else None
        self.numbers: list[int] = []
        self.payloads: list[bytes] = []

    def cuts(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(bucket, from, to) of hashes in order."""
        number = (hashes >> self.shift).astype(np.int64) if self.shift is not None else np.zeros(len(hashes), np.int64)
        ends = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True]) if len(number) else [0]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield int(number[a]), a, b

    def add(self, bucket: int, payload: bytes) -> None:
        self.numbers.append(bucket)
        self.payloads.append(payload)

    def settled(self, spans: tuple) -> None:
        row, start, count = spans
        for a in range(0, len(row), 1 << 20):
            self.add(self.own, pack((row[a : a + (1 << 20)], start[a : a + (1 << 20)], count[a : a + (1 << 20)]), SETTLED))

    def windows(self, parts: list[tuple]) -> None:
        if not parts:
            return
        one, two, row, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        first, late = _late_windows(one, two, row, start)
        self.settled(late)
        cols = (one[first], two[first], row[first], start[first])
        for bucket, a, b in self.cuts(cols[0]):
            self.add(self.buckets + bucket, pack(tuple(c[a:b] for c in cols), WINDOW))


def _is_hot(ha: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(ha), bool)
    return hot[np.minimum(np.searchsorted(hot, ha), len(hot) - 1)] == ha


def _split(sym, first, found, hot, rows, window):
    """(runs that aren't hot with where they begin, spans, windows) of one block; ``rows`` are the documents'."""
    ha, hc, doc, start, count = found
    begin = first[doc] + start
    warm = _is_hot(ha, hot)
    spans = windows = None
    if warm.any():
        spans, windows = _take_apart(sym, begin[warm], ha[warm], hc[warm], rows[doc[warm]], start[warm], count[warm], window)
    cold = ~warm
    return (ha[cold], hc[cold], rows[doc[cold]], start[cold], count[cold]), begin[cold], spans, windows


def _runs(plan: Plan, buckets: int, hot: np.ndarray) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            raw, offs = utf8(batch.column("text"))
            out, found, windows = _Packer(buckets, int(rows[0])), [], []
            for a, b in blocks(offs):
                sym, first = plan.symbols(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                cold, _, spans, apart = _split(sym, first, runs(sym, first, plan), hot, rows[a:b], plan.window)
                found.append(cold)
                if apart is not None:
                    out.settled(spans)
                    windows.append(apart)
            ha, hc, row, start, count = (np.concatenate(x) for x in zip(*found, strict=True))
            kept, late = _equal_runs(ha, hc, row, start)
            out.settled((row[late], start[late], count[late]))
            cols = (ha[kept], hc[kept], row[kept], start[kept], count[kept])
            for bucket, a, b in out.cuts(cols[0]):
                out.add(bucket, pack(tuple(c[a:b] for c in cols)))
            out.windows(windows)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(out.numbers, pa.int32()), "payload": pa.array(out.payloads, pa.binary())})

    return of


def _resolved(bucket: int, buckets: int, payloads: list[bytes]) -> tuple | None:
    """Spans of a bucket that holds settled runs or single windows; None for any other."""
    if bucket < 0:
        return unpack(payloads, SETTLED)
    if bucket >= buckets:
        return _late_windows(*unpack(payloads, WINDOW))[1]
    return None


def _meet(buckets: int) -> Callable:
    def of(table: pa.Table) -> pa.Table:
        payloads = [p.as_py() for p in table.column("payload")]
        if (spans := _resolved(table.column("bucket")[0].as_py(), buckets, payloads)) is not None:
            return _marks(*spans, None)
        ha, hc, row, start, count = unpack(payloads)
        order = np.lexsort((start, row, hc, ha))
        ha, hc, row, start, count = (x[order] for x in (ha, hc, row, start, count))
        head = np.r_[True, ha[1:] != ha[:-1]]
        fresh = head | np.r_[True, hc[1:] != hc[:-1]]
        contents = np.add.reduceat(fresh, np.flatnonzero(head))[np.cumsum(head) - 1]
        ask = fresh & (contents > 1)
        out = ~fresh | ask
        return _marks(row[out], start[out], count[out], np.where(ask, ha, 0)[out], ask[out])

    return of


def _marks(row, start, count, anchor, ask=None) -> pa.Table:
    asked = pa.nulls(len(row), pa.int64()) if anchor is None else pa.array(anchor.view(np.int64), mask=~ask)
    return pa.table({"row": pa.array(row, pa.int64()), "start": pa.array(start.astype(np.int32)), "count": pa.array(count.astype(np.int32)), "anchor": asked})


# --- contexts -----------------------------------------------------------------------------


def _contexts(plan: Plan, buckets: int) -> Callable:
    """Asked runs with their symbols, packed by bucket: pieces of (anchor, row, start, windows, symbols)."""
    shift = np.uint64(64 - (buckets - 1).bit_length()) if buckets > 1 else None

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            raw, offs = utf8(batch.column("text"))
            asked = batch.column("asked")
            a_offs = asked.offsets.to_numpy()
            items = asked.values
            start_all, count_all = (items.field(n).to_numpy(zero_copy_only=False) for n in ("start", "count"))
            anchor_all = items.field("anchor").to_numpy(zero_copy_only=False).view(np.uint64)
            heads, lengths, symbols = [], [], []
            for a, b in blocks(offs):
                sym, first = plan.symbols(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                lo, hi = a_offs[a], a_offs[b]
                doc = np.repeat(np.arange(a, b), np.diff(a_offs[a : b + 1]))
                start, count, anchor = start_all[lo:hi].astype(np.int64), count_all[lo:hi].astype(np.int64), anchor_all[lo:hi]
                n = count - 1 + plan.window
                begin = first[doc - a] + start
                take = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
                heads.append((anchor, rows[doc], start, count))
                lengths.append(n)
                symbols.append(sym[take])
            if not heads:
                continue
            anchor, row, start, count = (np.concatenate(x) for x in zip(*heads, strict=True))
            n, sym = np.concatenate(lengths), np.concatenate(symbols)
            number = (anchor >> shift).astype(np.int64) if shift is not None else np.zeros(len(anchor), np.int64)
            order = np.argsort(number, kind="stable")
            at = np.cumsum(n) - n
            numbers, payloads = [], []
            cuts = np.flatnonzero(np.r_[True, np.diff(number[order]) != 0, True]) if len(order) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                o = order[a:b]
                take = np.repeat(at[o] - (np.cumsum(n[o]) - n[o]), n[o]) + np.arange(n[o].sum())
                numbers.append(int(number[o[0]]))
                payloads.append(np.int64(len(o)).tobytes() + pack((anchor[o], row[o], start[o], count[o]), HEAD) + sym[take].tobytes())
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(numbers, pa.int32()), "payload": pa.array(payloads, pa.binary())})

    return of


HEAD = (np.uint64, np.int64, np.uint32, np.uint16)


@dataclass
class Bucket:
    """Runs that share anchors, with their symbols one after another; first[i] is where run i's begin."""

    anchor: np.ndarray
    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    symbols: np.ndarray
    first: np.ndarray

    @classmethod
    def read(cls, payloads: list[bytes], kind: np.dtype, window: int) -> Bucket:
        heads, symbols = [], []
        each = sum(np.dtype(k).itemsize for k in HEAD)
        for p in payloads:
            n = int(np.frombuffer(p, np.int64, 1)[0])
            heads.append(unpack([p[8 : 8 + n * each]], HEAD))
            symbols.append(np.frombuffer(p, kind, offset=8 + n * each))
        anchor, row, start, count = (np.concatenate(x) for x in zip(*heads, strict=True))
        n = count.astype(np.int64) - 1 + window
        return cls(anchor, row, start.astype(np.int64), count.astype(np.int64), np.concatenate(symbols), np.r_[0, np.cumsum(n)])


def joined_spans(row: np.ndarray, start: np.ndarray, run: np.ndarray, offset: np.ndarray) -> pa.Table:
    """Windows (run, offset), in order, joined to spans; ``row`` and ``start`` are the runs'."""
    new = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(run) else np.zeros(0, int)
    count = np.diff(np.r_[new, len(run)])
    return pa.table({"row": pa.array(row[run[new]], pa.int64()), "start": pa.array((start[run[new]] + offset[new]).astype(np.int32)), "count": pa.array(count.astype(np.int32))})


def refine(labels: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Numbers of the classes of equal (label, symbol)."""
    order = np.lexsort((symbols, labels))
    new = np.r_[False, (labels[order][1:] != labels[order][:-1]) | (symbols[order][1:] != symbols[order][:-1])]
    out = np.empty(len(labels), np.int64)
    out[order] = np.cumsum(new)
    return out


def _shared(labels: np.ndarray) -> np.ndarray:
    return np.bincount(labels)[labels] > 1 if len(labels) else np.zeros(0, bool)


def extend(bucket: Bucket, window: int, gram: int) -> pa.Table:
    """Late windows of a bucket: its seeds' matches, grown to the left and to the right symbol by symbol.

    The occurrences of a seed are one class. Each step to the right splits the classes by the next
    symbol, each step to the left by the one before; an occurrence that is left alone repeats no
    further and drops out. Windows with the same place of the seed are equal if they agree in
    what stands to the left and to the right of it. Symbols are compared, not hashes of windows.
    """
    place = _seed_places(bucket, window, gram)
    order = np.lexsort((bucket.start + place, bucket.row))
    place, row, start, count, first = place[order], bucket.row[order], bucket.start[order], bucket.count[order], bucket.first[:-1][order]
    seed, length = first + place, count - 1 + window
    n = len(order)
    # to the right: right[k] says of each occurrence the class of its first gram + k symbols, or -1
    right = np.full((window - gram + 1, n), -1, np.int32)
    alive, label = np.arange(n), np.zeros(n, np.int64)
    for k in range(window):
        inside = place[alive] + k < length[alive]
        alive, label = alive[inside], label[inside]
        label = refine(label, bucket.symbols[seed[alive] + k])
        held = _shared(label)
        alive, label = alive[held], label[held]
        if k + 1 >= gram:
            right[k + 1 - gram, alive] = label
    late_run, late_offset = [], []
    alive, label = np.arange(n), np.zeros(n, np.int64)
    for k in range(window - gram + 1):  # windows that begin k symbols to the left of the seed
        if k:
            inside = place[alive] >= k
            alive, label = alive[inside], label[inside]
            label = refine(label, bucket.symbols[seed[alive] - k])
            held = _shared(label)
            alive, label = alive[held], label[held]
        if not len(alive):
            break
        tail = right[window - gram - k, alive]
        own = (place[alive] - k < count[alive]) & (place[alive] >= k) & (tail >= 0)
        at = alive[own]
        same = refine(label[own], tail[own])
        # occurrences stand in order, so that the first of a class isn't late
        _, firsts = np.unique(same, return_index=True)
        late = np.ones(len(at), bool)
        late[firsts] = False
        late_run.append(at[late])
        late_offset.append(place[at[late]] - k)
    run, offset = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (late_run, late_offset))
    by = np.lexsort((offset, run))
    return joined_spans(row, start, run[by], offset[by])


def _seed_places(bucket: Bucket, window: int, gram: int) -> np.ndarray:
    """Where in its run each seed stands: the first gram of its first window with the anchor's hash."""
    at = np.arange(max(0, len(bucket.symbols) - gram + 1))
    grams = mix64(range_hash(bucket.symbols, at, at + gram))
    place = np.full(len(bucket.count), -1)
    for k in range(window - gram, -1, -1):
        place[grams[bucket.first[:-1] + k] == bucket.anchor] = k
    return place


def late_spans(docs: DataFrame, plan: Plan, resolver: Callable[[Bucket, int, int], pa.Table], kind: type, label: str) -> DataFrame:
    """One row (row, spans) for each document with late windows. ``docs`` needs row and text."""
    buckets = 1 << (4 * parts_for(docs, 16 << 20) - 1).bit_length()
    buckets = min(buckets, 1 << 24)
    text = docs.select("row", "text")
    met = text.mapInArrow(lean(_runs(plan, buckets, *hot_anchors(docs, (plan,)))), BLOB).groupBy("bucket").applyInArrow(lean_group(_meet(buckets)), MARK)
    marks = stash(met, f"{label}-marks")
    asked = marks.where("anchor is not null").groupBy("row").agg(F.collect_list(F.struct("start", "count", "anchor")).alias("asked"))
    held = text.join(asked, "row").select("row", "text", "asked")

    def resolve(table: pa.Table) -> pa.Table:
        return resolver(Bucket.read([p.as_py() for p in table.column("payload")], np.dtype(kind), plan.window), plan.window, plan.gram)

    extended = held.mapInArrow(lean(_contexts(plan, buckets)), BLOB).groupBy("bucket").applyInArrow(lean_group(resolve), SPAN)
    spans = marks.where("anchor is null").select("row", "start", "count").unionByName(extended)
    return spans.groupBy("row").agg(F.collect_list(F.struct("start", "count")).alias("spans"))


def _carried(plans: tuple[Plan, ...], buckets: int, hot: tuple[np.ndarray, ...]) -> Callable:
    """Runs that take their symbols along, packed by plan and bucket; for plans whose windows are short."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            raw, offs = utf8(batch.column("text"))
            for k, plan in enumerate(plans):
                out, found, symbols, windows = _Packer(buckets, int(rows[0])), [], [], []
                for a, b in blocks(offs):
                    sym, first = plan.symbols(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                    cold, begin, spans, apart = _split(sym, first, runs(sym, first, plan), hot[k], rows[a:b], plan.window)
                    if apart is not None:
                        out.settled(spans)
                        windows.append(apart)
                    n = cold[4] - 1 + plan.window
                    found.append(cold)
                    symbols.append(sym[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())])
                ha, hc, row, start, count = (np.concatenate(x) for x in zip(*found, strict=True))
                sym = np.concatenate(symbols)
                n = count - 1 + plan.window
                at = np.cumsum(n) - n
                kept, late = _equal_runs(ha, hc, row, start)
                out.settled((row[late], start[late], count[late]))
                for bucket, x, y in out.cuts(ha[kept]):
                    o = kept[x:y]
                    take = np.repeat(at[o] - (np.cumsum(n[o]) - n[o]), n[o]) + np.arange(n[o].sum())
                    out.add(bucket, np.int64(len(o)).tobytes() + pack((ha[o], row[o], start[o], count[o]), HEAD) + sym[take].tobytes())
                out.windows(windows)
                yield pa.RecordBatch.from_pydict({"plan": pa.array(np.full(len(out.numbers), k), pa.int32()), "bucket": pa.array(out.numbers, pa.int32()), "payload": pa.array(out.payloads, pa.binary())})

    return of


def late_spans_at_once(docs: DataFrame, plans: tuple[Plan, ...]) -> DataFrame:
    """One row (row, spans_0, spans_1, ...) for each document with late windows of any plan.

    For windows of a few 64-bit symbols, as of lines: runs carry their symbols, so that the
    texts are read once and no bucket asks for more.
    """
    buckets = min(1 << (4 * parts_for(docs, 16 << 20) - 1).bit_length(), 1 << 24)

    def resolve(table: pa.Table) -> pa.Table:
        k = table.column("plan")[0].as_py()
        payloads = [p.as_py() for p in table.column("payload")]
        if (spans := _resolved(table.column("bucket")[0].as_py(), buckets, payloads)) is not None:
            row, start, count = spans
            out = pa.table({"row": pa.array(row, pa.int64()), "start": pa.array(start.astype(np.int32)), "count": pa.array(count.astype(np.int32))})
        else:
            out = extend(Bucket.read(payloads, np.dtype(np.uint64), plans[k].window), plans[k].window, plans[k].gram)
        return out.add_column(0, "plan", pa.array(np.full(len(out), k), pa.int32()))

    met = docs.select("row", "text").mapInArrow(lean(_carried(plans, buckets, hot_anchors(docs, plans))), f"plan int, {BLOB}").groupBy("plan", "bucket").applyInArrow(lean_group(resolve), f"plan int, {SPAN}")
    # a null isn't collected
    own = lambda k: F.collect_list(F.when(F.col("plan") == k, F.struct("start", "count"))).alias(f"spans_{k}")
    return met.groupBy("row").agg(*[own(k) for k in range(len(plans))])


def covered(n: int, first: np.ndarray, spans: pa.ListArray, window: int) -> np.ndarray:
    """Which of ``n`` symbols the late windows of the documents cover."""
    offs = spans.offsets.to_numpy()
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    items = spans.values.slice(offs[0], offs[-1] - offs[0])
    start = items.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
    count = items.field("count").to_numpy(zero_copy_only=False).astype(np.int64)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first[doc] + start, 1)
    np.add.at(edge, first[doc] + start + count - 1 + window, -1)
    return np.cumsum(edge)[:n] > 0
