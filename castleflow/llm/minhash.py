"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidate edges.

1. One pass over the texts hashes each document's set of word shingles once, takes the minimum
   in each of 128 equal ranges of the hash, and fills empty ranges by optimal densification
   (Shrivastava, ICML 2017): an empty bin probes other bins in an order that depends on the bin
   alone until it meets a full one.
2. Documents with equal sets become one class; all that follows works on classes, so that a
   text with any number of copies is one row.
3. Four bins make a band and each band of a class a bucket key. A pair at similarity 0.8 misses
   all 32 bands once in 20 million. A bucket's members are each paired with its centre first, the
   member with the least seeded hash: these pairs grow with rows, not with their square.
4. The sets of all classes that share a bucket are read from the texts once. Pairs are confirmed
   on these full sets. A class with many pairs is salted, so that its set meets about a thousand
   partners in a task.
5. Components of the confirmed links come from alternating stars.
6. Buckets whose members these links leave in several components are open. There, all members of
   different components are compared, in cells of two blocks of members: no pair that meets in a
   bucket is left out, unless its ends are joined already. A pair that meets in several buckets is
   compared in the first. The links found join the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castleflow.llm.common import FIRST, LOWER, SECOND, blocks, lean, lean_group, mix64, range_hash, stash, utf8, word_bounds
from castleflow.llm.components import components
from castleflow.llm.repeats import keyed

SHINGLE = 5
SIMILARITY = 80
BINS, ROWS = 128, 4
#: Probes of an empty bin before the next full one to the right is taken.
PROBES = 64
#: Partners of one class that one task handles.
PARTNERS = 1000
#: Members of an open bucket that make a block; two blocks make a cell.
MEMBERS = 512
#: Shingles whose places in a cell's sets are multiplied at a time.
COLUMNS = 4096

_PROBE = (mix64(np.arange(BINS * PROBES, dtype=np.uint64) + np.uint64(0x51ED27)) % np.uint64(BINS)).astype(np.int64).reshape(BINS, PROBES)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after another, and where each begins."""
    raw = LOWER[raw]
    starts, ends, first = word_bounds(raw, offsets)
    sym = range_hash(raw, starts, ends)
    at = np.arange(max(0, len(sym) - words + 1))
    full = range_hash(sym, at, at + words)
    short = range_hash(sym, first[:-1], first[1:])
    sets = []
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        sets.append(np.unique(full[a : b - words + 1]) if b - a >= words else short[d : d + 1] if b > a else full[:0])
    return np.concatenate(sets) if sets else full[:0], np.cumsum([0, *map(len, sets)])


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of densified bin minima for each set that isn't empty."""
    size = np.diff(first)
    sets = np.repeat(np.cumsum(size > 0) - 1, size)
    n = int((size > 0).sum())
    cell = sets * BINS + (values >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    head = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, int)
    out = np.zeros(n * BINS, np.uint64)
    full = np.zeros(n * BINS, bool)
    out[cell[head]], full[cell[head]] = values[head], True
    out, full = out.reshape(n, BINS), full.reshape(n, BINS)
    who, empty = np.nonzero(~full)
    source = np.full(len(who), -1)
    for t in range(PROBES):
        open_ = np.flatnonzero(source < 0)
        if not len(open_):
            break
        probe = _PROBE[empty[open_], t]
        hit = full[who[open_], probe]
        source[open_[hit]] = probe[hit]
    for step in range(1, BINS):
        open_ = np.flatnonzero(source < 0)
        if not len(open_):
            break
        probe = (empty[open_] + step) % BINS
        hit = full[who[open_], probe]
        source[open_[hit]] = probe[hit]
    out[who, empty] = out[who, source]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    bands = signature.reshape(len(signature), BINS // ROWS, ROWS)
    key = np.arange(BINS // ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(signature), 1), np.uint64)
    for r in range(ROWS):
        key = mix64(key + bands[:, :, r])
    return key


def _sketch(words: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column("text"))
            sizes, one, two, keys = [], [], [], []
            for a, b in blocks(offs):
                values, first = shingle_sets(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], words)
                sizes.append(np.diff(first))
                one.append(range_hash(values, first[:-1], first[1:], FIRST))
                two.append(range_hash(values, first[:-1], first[1:], SECOND))
                keys.append(band_keys(signatures(values, first)).ravel())
            if not sizes:
                continue
            size = np.concatenate(sizes)
            at = np.r_[0, np.cumsum(np.where(size > 0, BINS // ROWS, 0))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys).view(np.int64)))
            hashes = [pa.array(np.concatenate(x).view(np.int64)) for x in (one, two)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(size.astype(np.int64)), *hashes, lists], ["row", "doc_id", "n", "one", "two", "bands"])

    return of


def _sets(words: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column("text"))
            found = []
            for a, b in blocks(offs):
                values, first = shingle_sets(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], words)
                found += [values[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.binary())], ["row", "shingles"])

    return of


def _confirm(percent: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                a, b = (a, b) if len(a) <= len(b) else (b, a)
                place = np.searchsorted(b, a)
                same = int(np.count_nonzero(b[np.minimum(place, len(b) - 1)] == a))
                keep[i] = 100 * same >= percent * (len(a) + len(b) - same)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return of


def _shared(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Common shingles of every two of the sets."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    _, number, count = np.unique(values, return_inverse=True, return_counts=True)
    # a shingle of one set alone is in no intersection
    held = count[number] > 1
    column = (np.cumsum(count > 1) - 1)[number[held]]
    owner = owner[held]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((n, n), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (a, a + COLUMNS))
        block = np.zeros((n, min(COLUMNS, int(column[-1]) + 1 - a)), np.float32)
        block[owner[lo:hi], column[lo:hi] - a] = 1
        out += block @ block.T
    return out


def _open_pairs(cell: pa.Table, percent: int) -> np.ndarray:
    """Which pairs of a cell's members this cell has to compare."""
    part, comp, size = (cell.column(c).to_numpy() for c in ("part", "comp", "n"))
    bands = cell.column("bands").combine_chunks().flatten().to_numpy().reshape(len(part), -1)
    pairs = np.triu(comp[:, None] != comp, 1)
    if part.any():
        pairs &= part[:, None] != part
    pairs &= 100 * np.minimum(size[:, None], size) >= percent * np.maximum(size[:, None], size)
    for k in range(cell.column("band")[0].as_py()):
        pairs &= bands[:, None, k] != bands[:, k]
    return pairs


def _needed(percent: int):
    def of(cell: pa.Table) -> pa.Table:
        pairs = _open_pairs(cell, percent)
        return cell.filter(pa.array(pairs.any(0) | pairs.any(1)))

    return of


def _meet(percent: int):
    """Links between the components of a cell, as few as join all that are linked."""

    def of(cell: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in cell.column("shingles")]
        first = np.cumsum([0, *map(len, sets)])
        size, rep, comp = np.diff(first), cell.column("rep").to_numpy(), cell.column("comp").to_numpy().copy()
        same = _shared(np.concatenate(sets), first)
        x, y = np.nonzero(_open_pairs(cell, percent) & (100 * same >= percent * (size[:, None] + size - same)))
        found = []
        while len(x):
            found.append((rep[x[0]], rep[y[0]]))
            comp[comp == comp[y[0]]] = comp[x[0]]
            apart = comp[x] != comp[y]
            x, y = x[apart], y[apart]
        return pa.table({"a": pa.array([int(a) for a, _ in found], pa.int64()), "b": pa.array([int(b) for _, b in found], pa.int64())})

    return of


def _spokes(classes: DataFrame) -> DataFrame:
    """key, band, rep and centre of all members of buckets but the centres, of classes (rep, n, bands)."""
    bands = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    # in a bucket, rep ^ hash(key) orders the members as a hash would, and gives the least one back
    veil = F.xxhash64("key")
    stars = bands.groupBy("key").agg(F.min(F.col("rep").bitwiseXOR(veil)).alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1")
    return bands.join(stars, "key").select("key", "band", "rep", F.col("least").bitwiseXOR(veil).alias("centre")).where("rep != centre")


def _sets_of(docs: DataFrame, spokes: DataFrame, words: int) -> DataFrame:
    """row and shingles of every class that shares a bucket. The texts are shuffled this once; all that follows takes sets from here."""
    ids = stash(spokes.select(F.explode(F.array("rep", "centre")).alias("row")).distinct(), "pair-ids")
    texts = docs.select("row", "text").join(ids, "row")
    return stash(texts.mapInArrow(lean(_sets(words)), "row long, shingles binary"), "sets")


def _star_links(classes: DataFrame, spokes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between the members of buckets and their centres."""
    ends = stash(spokes.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct(), "candidates")
    size = lambda end: classes.select(F.col("rep").alias(end), F.col("n").alias(f"n_{end}"))
    sizes_allow = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    pairs = stash(ends.join(size("a"), "a").join(size("b"), "b").where(sizes_allow).select("a", "b"), "pairs")
    # b meets a: salt what many b share
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("long").alias("salts"))
    salted = stash(pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt")), "salted")
    left = sets.join(salted.select(F.col("a").alias("row"), "salt").distinct(), "row").select(F.col("row").alias("a"), "salt", F.col("shingles").alias("x"))
    right = sets.join(salted.withColumn("row", F.col("b")), "row").select("a", "salt", "b", F.col("shingles").alias("y"))
    met = left.join(right, ["a", "salt"])
    return met.select("a", "b", "x", "y").mapInArrow(lean(_confirm(percent)), "a long, b long")


CELL = "key long, cell string, part int, band int, rep long, comp long, n long, bands array<long>"


def _open_links(classes: DataFrame, spokes: DataFrame, sets: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that buckets still hold between the components ``joined`` (node, component).

    In a bucket the members of its centre's component need only meet the others, the strays; so
    a large component with a few strays is passed over once, not compared with itself.
    """
    comp = lambda of, name: joined.select(F.col("node").alias(of), F.col("component").alias(name))
    named = spokes.join(comp("rep", "comp"), "rep", "left").join(comp("centre", "main"), "centre", "left")
    named = stash(named.select("key", "band", "rep", F.coalesce("comp", "rep").alias("comp"), F.coalesce("main", "centre").alias("main")), "members")
    counts = named.groupBy("key").agg(F.count_if(F.col("comp") != F.col("main")).alias("strays"), F.count_if(F.col("comp") == F.col("main")).alias("others"), F.min("comp").alias("least"), F.max("comp").alias("most"))
    blocks_of = lambda c: F.ceil(F.col(c) / MEMBERS).cast("int")
    counts = counts.where("least != most").select("key", blocks_of("strays").alias("strays"), blocks_of("others").alias("others"))
    members = named.join(counts, "key").withColumn("stray", F.col("comp") != F.col("main"))
    block = F.pmod(F.xxhash64("rep"), F.when(F.col("stray"), F.col("strays")).otherwise(F.col("others"))).cast("int")
    members = members.withColumn("block", block)
    # a cell is a block of strays and another block: of strays, not before it, or of the centre's component
    cell = lambda i, kind, j, part: F.struct(F.concat_ws(" ", i, F.lit(kind), j).alias("cell"), F.lit(part).cast("int").alias("part"))
    range_of = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    own = F.col("block")
    with_later = F.transform(range_of(own, F.col("strays")), lambda j: cell(own, "s", j, 0))
    with_earlier = F.transform(range_of(F.lit(0), own), lambda j: cell(j, "s", own, 1))
    with_main = F.transform(range_of(F.lit(0), F.col("others")), lambda j: cell(own, "m", j, 0))
    of_main = F.transform(range_of(F.lit(0), F.col("strays")), lambda j: cell(j, "m", own, 1))
    cells = members.select("key", "band", "rep", "comp", F.explode(F.when(F.col("stray"), F.concat(with_later, with_earlier, with_main)).otherwise(of_main)).alias("at"))
    cells = cells.join(classes.select("rep", "n", "bands"), "rep").select("key", "at.cell", "at.part", "band", "rep", "comp", "n", "bands")
    needed = stash(cells.groupBy("key", "cell").applyInArrow(lean_group(_needed(percent)), CELL), "open")
    met = needed.join(sets.withColumnRenamed("row", "rep"), "rep")
    return met.groupBy("key", "cell").applyInArrow(lean_group(_meet(percent)), "a long, b long")


def _joined(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, component) of the classes (rep, n, bands) that links join to a smaller one."""
    spokes = stash(_spokes(classes), "spokes")
    sets = _sets_of(docs, spokes, words)
    joined = stash(components(_star_links(classes, spokes, sets, percent)), "joined")
    more = stash(_open_links(classes, spokes, sets, joined, percent), "more-links")
    return components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)) if more.limit(1).count() else joined


def _placed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """row, doc_id, n (shingles) and component (the first row of those that can be reached) of keyed documents."""
    schema = "row long, doc_id long, n long, one long, two long, bands array<long>"
    sketches = stash(docs.select("row", F.col("doc_id").cast("long"), "text").mapInArrow(lean(_sketch(words)), schema), "sketches")
    same = ["n", "one", "two"]
    classes = sketches.where("n > 0").groupBy(*same).agg(F.min("row").alias("rep"), F.min_by("bands", "row").alias("bands"))
    classes = stash(classes, "classes")
    joined = _joined(docs, classes, words, percent)
    named = classes.select(*same, "rep").join(joined, classes["rep"] == joined["node"], "left").select(*same, F.coalesce("component", "rep").alias("component"))
    return sketches.select("row", "doc_id", *same).join(named, same, "left").select("row", "doc_id", "n", F.coalesce("component", "row").alias("component"))


def near_duplicates(docs: DataFrame, *, words: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    A document's set holds its distinct ``words``-word shingles, with A-Z lower-cased; with
    fewer words, the whole sequence is the one shingle. Documents are linked if their sets'
    intersection is at least ``percent`` hundredths of the union. ``component_id`` is the
    smallest doc_id that can be reached. A document without words, or with a null text, has an
    empty set and is linked with nothing. Where doc_id repeats or is null, rows are told apart
    and only the first of a component is kept. Extra columns are ignored; an empty table gives
    an empty result.
    """
    placed = _placed(keyed(docs), words, percent)
    names = placed.where("row = component").select("component", F.col("doc_id").alias("component_id"))
    return placed.join(names, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("row") == F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, words: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """The documents that are the first of their component, with all their columns. Cases as in ``near_duplicates``."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # in one struct, so that their names can't clash
    docs = keyed(docs.withColumn("_rest", F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in others))), "_rest")
    dropped = stash(_placed(docs, words, percent).where("row != component").select("row"), "dropped")
    return docs.join(dropped, "row", "left_anti").select("doc_id", "text", *(F.col("_rest").getField(c).alias(c) for c in others))


#: DuckDB SQL for near_duplicates with four words and 80 hundredths, where doc_id is unique: all pairs, and reach by recursion.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
held AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM held a JOIN held b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
-- an id spreads over larger ones only: the smallest of a component still gets everywhere
reach AS (SELECT doc_id, doc_id AS low FROM sets UNION SELECT l.y, r.low FROM reach r JOIN both_ways l ON l.x = r.doc_id WHERE r.low < l.y),
named AS (SELECT doc_id, min(low) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN named USING (doc_id)
"""
