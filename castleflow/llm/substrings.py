"""Substring dedup by seed and extend, over words.

Seeds are winnowed anchors: the smallest 6-word gram of every 20-word window. Documents are
joined on equal anchors; each match grows to the left and to the right of its seed, word by
word, as long as another document agrees and as far as windows pick this seed; what reaches the
threshold is kept. Past that the next seed's match goes on, and joined along a document they
make its maximal repeats. Every word in one that also starts earlier goes. No pairs are listed:
the members of a seed are split into classes by what surrounds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from castleflow.llm.common import blocks, lean, range_hash, utf8, word_bounds
from castleflow.llm.repeats import Plan, covered, extend, keyed, late_spans

WORDS = 20
GRAM = 6


def word_symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_bounds(raw, offsets)
    return range_hash(raw, starts, ends), first


def _finish(window: int, with_text: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column("text"))
            spans = batch.column("spans")
            n_words, n_removed, digest, texts = [], [], [], []
            for a, b in blocks(offs):
                part = raw[offs[a] : offs[b]]
                _, _, first = word_bounds(part, offs[a : b + 1] - offs[a])
                gone = covered(int(first[-1]), first, spans.slice(a, b - a), window)
                for i in range(a, b):
                    lo, hi = first[i - a], first[i - a + 1]
                    words = raw[offs[i] : offs[i + 1]].tobytes().split()
                    if (k := int(gone[lo:hi].sum())):
                        words = compress(words, ~gone[lo:hi])
                    kept = b" ".join(words)
                    n_words.append(hi - lo)
                    n_removed.append(k)
                    digest.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        texts.append(kept)
            out = {"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            if with_text:
                out["kept"] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return of


def dedup_substrings(docs: DataFrame, *, words: int = WORDS, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, unless it isn't wanted, the kept text.

    Words are ``[^\\x20\\x09-\\x0D]+``. A word goes if a window of ``words`` consecutive words
    that covers it also starts earlier (smaller doc_id, or earlier in the document); windows
    are judged on the input. Null and empty texts have no words. Where doc_id repeats or is
    null, rows are ordered by doc_id (nulls first) and text. Extra columns are ignored; an
    empty table gives an empty result.
    """
    docs = keyed(docs)
    plan = Plan(word_symbols, words, min(GRAM, words))
    late = late_spans(docs, plan, extend, np.uint64, "substrings")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return docs.join(late, "row", "left").select("doc_id", "text", "spans").mapInArrow(lean(_finish(words, with_text)), schema)


#: DuckDB SQL for doc_id, n_words, n_removed and kept_sha256 at 20 words, where doc_id is unique.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
judged AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS late FROM windows),
covered AS (SELECT doc_id, word, i, coalesce(max(CAST(late AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS cut FROM words LEFT JOIN judged USING (doc_id, i))
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, CAST(coalesce(sum(cut), 0) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (cut = 0), '')) AS kept_sha256
FROM d LEFT JOIN covered USING (doc_id) GROUP BY d.doc_id
"""
