"""Line dedup: winnowed line fingerprints, joined and extended to repeated runs of lines.

Two plans share the engine of ``repeats``; texts are read once for both, and joined with the
verdicts once. In the first the symbols are the hashes of all
lines that aren't blank; a fingerprint is the smallest hash of each window of ``run_lines``
lines, joined fingerprints are extended both ways, and a run of at least ``run_lines`` equal
lines that also starts earlier goes. In the second the symbols are the lines of at least
``long_words`` words alone; of these a single repeated line goes. A later run is deleted, the
first one stays. Passages that begin or end inside a line, and shorter single lines, are left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castleflow.llm.common import blocks, lean, range_hash, utf8, word_bounds
from castleflow.llm.repeats import Plan, covered, keyed, late_spans_at_once

RUN_LINES = 2
LONG_WORDS = 50

_NO_BREAK = np.arange(256) != 0x0A


def _lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and numbers of words of all lines that aren't blank."""
    starts, ends, _ = word_bounds(raw, offsets, _NO_BREAK)
    begins, _, _ = word_bounds(raw, offsets)
    words = np.searchsorted(begins, ends) - np.searchsorted(begins, starts)
    full = words > 0
    return starts[full], ends[full], words[full]


def line_symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, _ = _lines(raw, offsets)
    return range_hash(raw, starts, ends), np.searchsorted(starts, offsets)


def long_line_symbols(least: int):
    def symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, words = _lines(raw, offsets)
        starts, ends = starts[words >= least], ends[words >= least]
        return range_hash(raw, starts, ends), np.searchsorted(starts, offsets)

    return symbols


def _finish(run_lines: int, long_words: int, extra: list[str], with_text: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column("text"))
            runs, longs = batch.column("spans"), batch.column("long_spans")
            given = batch.column("text")
            n_lines, n_removed, digest, texts = [], [], [], []
            for a, b in blocks(offs):
                part = raw[offs[a] : offs[b]]
                first = offs[a : b + 1] - offs[a]
                starts, _, words = _lines(part, first)
                line = np.searchsorted(starts, first)
                gone = covered(len(starts), line, runs.slice(a, b - a), run_lines)
                at = np.flatnonzero(words >= long_words)
                gone[at] |= covered(len(at), np.searchsorted(starts[at], first), longs.slice(a, b - a), 1)
                for i in range(a, b):
                    lo, hi = line[i - a], line[i - a + 1]
                    cut = int(gone[lo:hi].sum())
                    kept = raw[offs[i] : offs[i + 1]].tobytes()
                    if cut:
                        left = iter((~gone[lo:hi]).tolist())
                        lines = kept.split(b"\n")
                        kept = b"\n".join(compress(lines, [not x.strip(b" \t\n\r\x0b\x0c") or next(left) for x in lines]))
                    n_lines.append(hi - lo)
                    n_removed.append(cut)
                    digest.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        texts.append(kept if given[i].is_valid else None)
            out = {c: batch.column(c) for c in ["doc_id", *extra]}
            out |= {"n_lines": pa.array(n_lines, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            if with_text:
                out["kept"] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return of


def dedup_lines(docs: DataFrame, *, run_lines: int = RUN_LINES, long_words: int = LONG_WORDS, keep: tuple[str, ...] = (), with_text: bool = True) -> DataFrame:
    """doc_id, the columns ``keep``, n_lines, n_removed, kept_sha256 and, unless it isn't wanted, the kept text.

    Lines end at ``\\n``; a line without a word is blank, counts as no line and always stays. A
    line goes if ``run_lines`` consecutive lines that cover it also start earlier (smaller
    doc_id, or earlier in the document), or if it has ``long_words`` words and stands earlier
    too; the input is judged, not what is left. A null text stays null and has no lines. Where
    doc_id repeats or is null, rows are ordered by doc_id (nulls first) and text. Columns that
    aren't named in ``keep`` are ignored; an empty table gives an empty result.
    """
    docs = keyed(docs, *keep)
    late = late_spans_at_once(docs, (Plan(line_symbols, run_lines, 1), Plan(long_line_symbols(long_words), 1, 1)))
    late = late.withColumnsRenamed({"spans_0": "spans", "spans_1": "long_spans"})
    types = dict(docs.dtypes)
    schema = ", ".join(["doc_id long", *(f"`{c}` {types[c]}" for c in keep), "n_lines long", "n_removed long", "kept_sha256 string", *["kept string"] * with_text])
    table = docs.join(late, "row", "left").select(F.col("doc_id").cast("long"), "text", *keep, "spans", "long_spans")
    return table.mapInArrow(lean(_finish(run_lines, long_words, list(keep), with_text)), schema)


#: DuckDB SQL for doc_id, n_lines, n_removed and kept_sha256, where doc_id is unique.
ORACLE = r"""
WITH raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
marked AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS full_line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM raw),
lines AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM marked WHERE full_line),
judged AS (SELECT *, after IS NOT NULL AND row_number() OVER (PARTITION BY line, after ORDER BY doc_id, pos) > 1 AS run_late,
  words >= 50 AND row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1 AS line_late FROM lines),
gone AS (SELECT doc_id, pos, run_late OR line_late OR coalesce(lag(run_late) OVER (PARTITION BY doc_id ORDER BY pos), false) AS cut FROM judged)
SELECT m.doc_id, CAST(count(*) FILTER (full_line) AS BIGINT) AS n_lines, CAST(count(*) FILTER (coalesce(cut, false)) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY m.pos) FILTER (NOT coalesce(cut, false)), '')) AS kept_sha256
FROM marked m LEFT JOIN gone g ON m.doc_id = g.doc_id AND m.pos = g.pos GROUP BY m.doc_id
"""
