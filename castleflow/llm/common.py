"""Helpers that the corpus operators share: shared-folder tables and vectorised text."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from castleflow.operators.shared import settle

#: Bytes of text that one vectorised block holds; bounds a worker's arrays.
BLOCK_BYTES = 1 << 19
M64 = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Cut lineage: write a frame as Parquet in the shared folder and read it back.
stash = settle


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes behind ``df``: file sizes, without a job."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(size, 1 << 60)


def parts_for(df: DataFrame, each: int) -> int:
    """Enough partitions for ``each`` input bytes apiece, never under the session's number."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(-(-input_bytes(df) // each), 1 << 20))


# --- vectorised text ----------------------------------------------------------------------


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without copying text; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def _table(*inside: int) -> np.ndarray:
    t = np.ones(256, bool)
    t[list(inside)] = False
    return t


#: Bytes of words split at [\x20\x09-\x0D].
NOT_SPACE = _table(0x20, *range(0x09, 0x0E))
#: Bytes of words split at anything ASCII that is no letter or digit.
ALNUM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
#: A-Z to a-z, all else as it is.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def word_bounds(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each document's first word (one more entry at the end)."""
    w = inside[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = w.copy()
    starts[1:] &= ~w[:-1] | edge[1:-1]
    ends = w.copy()
    ends[:-1] &= ~w[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Ranges up to so many symbols get the vectorised hash; longer ones a cryptographic one.
SHORT = 128
#: Symbols of a prefix sum; bounds the arrays of a hash, however long a document is.
STRETCH = 1 << 18


class Powers:
    """Powers of an odd base modulo 2**64 and their inverses, as many as one stretch takes."""

    def __init__(self, base: int, name: bytes) -> None:
        self.base, self.inverse, self.name = base, pow(base, -1, 1 << 64), name
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up, self.down


FIRST, SECOND = Powers(0x9E3779B97F4A7C15, b"first"), Powers(0xD1342543DE82EF95, b"second")


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers = FIRST) -> np.ndarray:
    """A 64-bit hash of each range of ``values``.

    Up to ``SHORT`` symbols it is a polynomial, by prefix sums. Modulo 2**64 there are long strings
    (Thue-Morse) that any polynomial confuses, but they need over a thousand symbols; longer
    ranges are hashed by BLAKE2.
    """
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    length = ends - starts
    if not len(length):
        return np.zeros(0, np.uint64)
    if length.max() <= SHORT:
        return _short_hash(values, starts, ends, powers)
    out = np.empty(len(length), np.uint64)
    short = length <= SHORT
    out[short] = _short_hash(values, starts[short], ends[short], powers)
    far = np.flatnonzero(~short)
    data, each = memoryview(np.ascontiguousarray(values)).cast("B"), values.itemsize
    digests = b"".join(hashlib.blake2b(data[a:b], digest_size=8, person=powers.name).digest() for a, b in zip((starts[far] * each).tolist(), (ends[far] * each).tolist(), strict=True))
    out[far] = np.frombuffer(digests, np.uint64)
    return out


def _short_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    if len(values) <= STRETCH + SHORT:
        up, down = powers.get(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
        return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    order = None if (starts[1:] >= starts[:-1]).all() else np.argsort(starts, kind="stable")
    if order is not None:
        out = np.empty(len(starts), np.uint64)
        out[order] = _short_hash(values, starts[order], ends[order], powers)
        return out
    found = []
    for at in range(0, len(values), STRETCH):
        a, b = np.searchsorted(starts, (at, at + STRETCH if at + STRETCH < len(values) else len(values) + 1))
        found.append(_short_hash(values[at : at + STRETCH + SHORT], starts[a:b] - at, ends[a:b] - at, powers))
    return np.concatenate(found)


# --- memory of workers --------------------------------------------------------------------


def release() -> None:
    """Give freed memory back to the system; workers wait for their next task with what they keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose worker keeps no freed memory after its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from of(batches)
        finally:
            release()

    return run


#: Bytes of a group after which its worker gives memory back.
LARGE_GROUP = 4 << 20


def lean_group(of: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for applyInArrow: memory goes back after each large group."""

    def run(table: pa.Table) -> pa.Table:
        large = table.nbytes > LARGE_GROUP
        out = of(table)
        if large:
            del table
            release()
        return out

    return run
