"""Nearest neighbours by inner product through a permutation index.

(Chavez, Figueroa and Navarro 2008; Amato and Savino 2008.) A vector is represented by the
order in which it sees a set of pivots, a bounded seeded sample of the data and its negatives.
Vectors are lengthened by one component so that all have the same norm; then the nearest by
angle are those with the largest inner product. Every vector is posted in the inverted files
of its ``prefix`` nearest pivots, with the pivot's place. A query opens the files of its
``probe`` nearest pivots and sums footrule distances; the best tenth is reranked exactly.

All rows are indexed. Every table is cut into cells around the rows of a sample that grows with
it, up to a bound, and a query visits a fixed number of cells, those with the nearest centres (all,
while there are no more); so the work grows with the rows and not with their square. A cell that holds many rows is cut again,
by a hash, into blocks of bounded size, and its queries into groups, each of which meets each
block of its cells once. Equal vectors of a block are one entry that keeps its
smallest ids, since no more of them can be among the nearest. Blocks send on each query's best
only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castleflow.llm.common import lean, stash

#: Pivots are this many rows of the sample and their negatives.
PIVOTS = 256
PREFIX, PROBE = 128, 64
#: Share of a block's entries that is reranked, and the least number.
RERANKED, LEAST = 0.1, 1000
#: Vectors of a block and queries of a group.
BLOCK, GROUP = 16384, 16384
#: Rows for a cell on average, the most cells, and those that a query visits.
CELL, CENTRES, VISITS = 4096, 65536, 64

FOUND = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Space:
    """The pivots, with the norm that vectors are lengthened to."""

    pivots: np.ndarray
    norm: float

    @classmethod
    def of(cls, sample: np.ndarray, norm: float) -> Space:
        x = _longer(sample, norm)
        return cls(np.concatenate([x, -x]), norm)

    def of_queries(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest pivots of each query: its direction, on the sphere that all vectors are lengthened to."""
        return self.order(np.hstack([x / np.sqrt((x**2).sum(1))[:, None], np.zeros((len(x), 1))]), n)

    def order(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest pivots of each row, nearest first."""
        near = x @ self.pivots.T
        n = min(n, len(self.pivots))
        top = np.argpartition(-near, n - 1, axis=1)[:, :n]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), 1, kind="stable"), 1)


def _longer(x: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm**2 - (x**2).sum(1), 0))
    return np.hstack([x, rest[:, None]])


class Files:
    """The pivots' inverted files over one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, space: Space | None, most: int, prefix: int) -> None:
        by_id = np.argsort(ids, kind="stable")
        ids, vectors = ids[by_id], np.ascontiguousarray(vectors[by_id]) + 0.0
        raw = vectors.view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
        _, head, entry = np.unique(raw, return_index=True, return_inverse=True)
        self.vectors = vectors[head]
        self.longest = np.sqrt((self.vectors**2).sum(1).max())
        order = np.argsort(entry, kind="stable")  # smallest ids first within an entry
        first = np.searchsorted(entry[order], np.arange(len(head) + 1))
        place = np.arange(len(order)) - first[entry[order]]
        kept = place <= most  # one more than asked for, since one may be the query's own
        self.ids = ids[order][kept]
        self.first = np.searchsorted(entry[order][kept], np.arange(len(head) + 1))
        if space is None:
            return
        seen = space.order(_longer(self.vectors, space.norm), prefix)
        self.prefix = seen.shape[1]
        pivot = seen.ravel()
        by_pivot = np.argsort(pivot, kind="stable")
        self.cuts = np.searchsorted(pivot[by_pivot], np.arange(len(space.pivots) + 1))
        self.entry = by_pivot // self.prefix
        self.place = (by_pivot % self.prefix).astype(np.int32)

    def footrule(self, seen: np.ndarray) -> np.ndarray:
        """Of every entry, the summed displacement of the query's pivots; an unseen pivot stands behind the prefix."""
        total = np.full(len(self.vectors), int((self.prefix - np.arange(len(seen))).sum()), np.int32)
        for at, pivot in enumerate(seen.tolist()):
            a, b = self.cuts[pivot], self.cuts[pivot + 1]
            total[self.entry[a:b]] += np.abs(self.place[a:b] - at) - (self.prefix - at)
        return total

    def search(self, query_id: int, query: np.ndarray, seen: np.ndarray | None, k: int, share: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k`` among the entries that footrule puts first; without pivots, among all."""
        n = min(len(self.vectors), max(least, int(np.ceil(share * len(self.vectors))))) if seen is not None else len(self.vectors)
        near = np.argpartition(self.footrule(seen), n - 1)[:n] if n < len(self.vectors) else np.arange(n)
        if len(near) > k + 1:
            rough = self.vectors[near] @ query
            slack = 1e-12 * (self.longest * np.sqrt(query @ query) + 1)
            near = near[rough >= np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1] - slack]
        score = inner(self.vectors[near], query)
        count = self.first[near + 1] - self.first[near]
        take = np.repeat(self.first[near] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        ids, score = self.ids[take], np.repeat(score, count)
        other = ids != query_id
        ids, score = ids[other], score[other]
        best = np.lexsort((ids, -score))[:k]
        return ids[best], score[best]


def inner(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component to the last, so that equal vectors score the same in any block."""
    return np.cumsum(vectors * query, axis=1)[:, -1] if len(vectors) else np.zeros(0)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    lists = table.column("embedding").combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return ids, flat.reshape(len(ids), -1)


def _search(space: Space, k: int, prefix: int, probe: int, share: float, least: int):
    def of(block: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if block.num_rows and queries.num_rows:
            ids, vectors = _matrix(queries)
            # vectors of another length than the pivots' are searched without these
            known = vectors.shape[1] == space.pivots.shape[1] - 1
            files = Files(*_matrix(block), space if known else None, k, prefix)
            for a in range(0, len(ids), 1024):
                order = space.of_queries(vectors[a : a + 1024], probe) if known else [None] * len(vectors[a : a + 1024])
                for i, seen in enumerate(order, a):
                    found, score = files.search(int(ids[i]), vectors[i], seen, k, share, least)
                    out.append((np.full(len(found), ids[i]), found, score))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return of


def _cells(centres: np.ndarray, norm: float, visits: int):
    """Rows with the cell of their nearest centre, or with each of the ``visits`` cells whose centres are nearest to a query.

    For vectors of another length than the centres' there is one cell. ``visits`` is 0 for rows.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column("embedding").offsets.to_numpy())
            known = np.flatnonzero(lengths == centres.shape[1] - 1)
            other = np.setdiff1d(np.arange(len(lengths)), known)
            take, cells = [other], [np.full(len(other), -1)]
            for a in range(0, len(known), 1024):
                at = known[a : a + 1024]
                _, x = _matrix(pa.Table.from_batches([batch.take(pa.array(at))]))
                # a query is a direction on the sphere that all vectors are lengthened to
                near = (np.hstack([x, np.zeros((len(x), 1))]) if visits else _longer(x, norm)) @ centres.T
                n = min(max(1, visits), len(centres))
                found = np.argpartition(-near, n - 1, axis=1)[:, :n]
                take.append(np.repeat(at, found.shape[1]))
                cells.append(found.ravel())
            out = batch.take(pa.array(np.concatenate(take)))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(cells).astype(np.int64))], [*out.schema.names, "cell"])

    return of


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (of doubles) where neither is null, all components are finite and some isn't 0."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, probe: int = PROBE, share: float = RERANKED, least: int = LEAST, visits: int = VISITS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of each row that ``is_query`` (over vec_id) picks.

    Nearness is the largest inner product in double precision, ties go to the smaller vec_id,
    and a row with the query's own vec_id is no candidate. Vectors that are null, zero or hold
    a null or non-finite component take no part. Only vectors of one length have an inner
    product: those of another length than most have (ties: the shorter) meet their like, all of
    them. With fewer candidates than ``k`` all are given. A vec_id that repeats is a candidate
    once for each vector, and a query once for each. Blocks of up to ``least`` entries are
    searched exactly. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    vectors = usable(vectors).withColumn("d", F.size("embedding"))
    sizes = vectors.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("s"))
    most = sizes.orderBy(F.desc("n"), "d").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # a sample of at most ``CENTRES`` rows, however large the table; the first ``pivots`` of them are the pivots
    cells = min(CENTRES, -(-most["n"] // CELL))
    visits = max(visits, k + 1)  # each cell holds its centre at least
    sample = vectors.where(F.col("d") == most["d"]).orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(max(pivots, cells)).select("embedding").collect()
    sample, norm = np.array([r["embedding"] for r in sample], np.float64), float(np.sqrt(most["s"]))
    space = Space.of(sample[:pivots], norm)
    centres = np.unique(_longer(sample[:cells], norm), axis=0)
    schema = "vec_id long, embedding array<double>, d int, cell long"
    rows = vectors.mapInArrow(lean(_cells(centres, norm, 0)), schema)
    queries = vectors.where(is_query).mapInArrow(lean(_cells(centres, norm, visits)), schema)
    # a cell of many vectors is cut into blocks, the queries that visit a cell into groups
    parts = lambda df, size, name: df.groupBy("d", "cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    cuts = stash(parts(rows, BLOCK, "blocks").join(parts(queries, GROUP, "groups"), ["d", "cell"]), "cells")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one_of = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("int")
    left = rows.join(cuts, ["d", "cell"]).select("d", "cell", one_of("blocks", 1).alias("block"), each("groups").alias("group"), "vec_id", "embedding")
    right = queries.join(cuts, ["d", "cell"]).select("d", "cell", each("blocks").alias("block"), one_of("groups", 2).alias("group"), "vec_id", "embedding")
    key = ["d", "cell", "block", "group"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_search(space, k, prefix, probe, share, least), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for the 20 nearest of every 20th vector, by brute force: what the index finds at best.
ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
met AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM met)
SELECT * FROM ranked WHERE rank <= 20
"""
