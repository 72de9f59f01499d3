"""Quality classifier: a sparse ensemble of rules over text statistics.

(Friedman and Popescu, "Predictive Learning via Rule Ensembles", 2008.) Small trees are grown
by boosting on a bounded sample of labelled documents; every path in them is a conjunctive
rule; a logistic regression with a lasso penalty gives most rules the weight 0; the rest is
compiled to one Spark column expression over the statistics. The statistics of every document
come from its whole text in one pass of array operations, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castleflow.llm.common import blocks, lean, range_hash, utf8, word_bounds

#: Labelled rows that are learned from at most: those with the smallest hash of their id.
SAMPLE = 20_000
#: Score from which a document counts as good.
THRESHOLD = 0.7

_LETTER = np.array([chr(b).isalpha() if b < 0x80 else True for b in range(256)])
_CLASSES = {
    "upper": np.array([65 <= b <= 90 for b in range(256)]),
    "lower": np.array([97 <= b <= 122 for b in range(256)]),
    "digit": np.array([48 <= b <= 57 for b in range(256)]),
    "mark": np.array([chr(b) in ".,;:?'\"()-" if b < 0x80 else False for b in range(256)]),
    "symbol": np.array([33 <= b <= 126 and not chr(b).isalnum() and chr(b) not in ".,;:?'\"()-" for b in range(256)]),
    "high": np.array([b >= 0x80 for b in range(256)]),
    "control": np.array([b < 32 and b not in (9, 10, 13) or b == 127 for b in range(256)]),
}
STATISTICS = ("n_words", "word_bytes", "upper_share", "digit_share", "mark_share", "symbol_share", "high_share", "control_share", "no_letter_share", "distinct_share", "top_share", "repeat_share", "line_words", "distinct_lines")


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each document; all 0 where there is no word."""
    starts, ends, first = word_bounds(raw, offsets)
    n_bytes, n_words = np.diff(offsets), np.diff(first)

    def total(mask: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[cuts[1:]] - sums[cuts[:-1]]

    of = {k: total(t[raw], offsets) for k, t in _CLASSES.items()}
    letters = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_LETTER[raw], out=letters[1:])
    bare = total(letters[ends] == letters[starts], first)
    word = range_hash(raw, starts, ends)
    echo = np.zeros(len(word), bool)
    echo[1:] = word[1:] == word[:-1]
    echo[first[:-1][n_words > 0]] = False
    l_starts, l_ends, _ = word_bounds(raw, offsets, np.arange(256) != 10)
    line = range_hash(raw, l_starts, l_ends)
    l_first = np.searchsorted(l_starts, offsets)
    distinct, top, lines = (np.zeros(len(n_words)) for _ in range(3))
    for d in np.flatnonzero(n_words):
        _, counts = np.unique(word[first[d] : first[d + 1]], return_counts=True)
        distinct[d], top[d] = len(counts), counts.max()
        lines[d] = len(np.unique(line[l_first[d] : l_first[d + 1]]))
    w, n, n_lines = np.maximum(n_words, 1), np.maximum(n_bytes, 1), np.maximum(np.diff(l_first), 1)
    table = np.stack(
        [n_words, total(np.ones(len(raw), bool), offsets) / w, of["upper"] / np.maximum(of["upper"] + of["lower"], 1), *(of[k] / n for k in ("digit", "mark", "symbol", "high", "control")), bare / w, distinct / w, top / w, total(echo, first) / w, n_words / n_lines, lines / n_lines], 1
    )
    table[n_words == 0] = 0
    return table


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offs = utf8(batch.column("text"))
        found = [statistics(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in blocks(offs)]
        table = np.concatenate(found) if found else np.zeros((0, len(STATISTICS)))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(table[:, i])) for i in range(len(STATISTICS)))], [*batch.schema.names, *(f"_{s}" for s in STATISTICS)])


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics of its text, as columns _n_words and so on."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"_{s} double" for s in STATISTICS)])
    return docs.mapInArrow(lean(_measure), schema)


# --- learning -----------------------------------------------------------------------------

#: A condition is (statistic, True for "above" or False for "at most", threshold).
Condition = tuple[int, bool, float]


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def column(self) -> Column:
        """The score as one expression over the columns of ``measured``."""
        total = F.lit(self.bias)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for s, over, at in conditions:
                c = F.col(f"_{STATISTICS[s]}")
                holds = holds & (c > at if over else c <= at)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, path: tuple[Condition, ...], rules: dict, out: np.ndarray, rate: float) -> None:
    """Grow one tree on binned statistics ``x``; adds each path to ``rules`` and the leaves' steps to ``out``."""
    if path:
        rules.setdefault(path, None)
    best = (1e-3, -1, -1)
    g_all, h_all = gradient[rows].sum(), hessian[rows].sum()
    if depth and len(rows) >= 40:
        for s, c in enumerate(cuts):
            if not len(c):
                continue
            g = np.cumsum(np.bincount(x[rows, s], gradient[rows], len(c) + 1))[:-1]
            h = np.cumsum(np.bincount(x[rows, s], hessian[rows], len(c) + 1))[:-1]
            n = np.cumsum(np.bincount(x[rows, s], minlength=len(c) + 1))[:-1]
            gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
            gain[(n < 10) | (len(rows) - n < 10)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], s, k)
    _, s, k = best
    if s < 0:
        out[rows] += rate * g_all / (h_all + 1)
        return
    low = x[rows, s] <= k
    for over, part in ((False, rows[low]), (True, rows[~low])):
        _grow(x, cuts, gradient, hessian, part, depth - 1, (*path, (s, over, float(cuts[s][k]))), rules, out, rate)


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> np.ndarray:
    """Logistic regression with an L1 penalty on all but the last weight (the bias), by accelerated proximal steps."""
    a = np.hstack([r, np.ones((len(r), 1))])
    rate = 4 * len(a) / max(1e-9, np.linalg.norm(a.T @ a, 2))
    w = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a @ z)))
        v = z - rate * (a.T @ (p - y)) / len(a)
        v[:-1] = np.sign(v[:-1]) * np.maximum(np.abs(v[:-1]) - rate * penalty, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, w = v + (old - 1) / t * (v - w), v
    return w


def _holds(x: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for s, over, at in conditions:
        out &= (x[:, s] > at) if over else (x[:, s] <= at)
    return out


def learn(x: np.ndarray, y: np.ndarray, *, trees: int = 24, depth: int = 3, bins: int = 32, seed: int = 7) -> Model:
    """Rules from boosted trees on seeded halves of the rows, then lasso weights; the penalty is chosen on a fifth of the rows."""
    if not len(y):
        return Model(0.0, ())
    base = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if len(np.unique(y)) < 2:
        return Model(float(base), ())
    cuts = [np.unique(np.quantile(x[:, s], np.linspace(0, 1, bins + 1)[1:-1])) for s in range(x.shape[1])]
    cuts = [c[c < x[:, s].max()] for s, c in enumerate(cuts)]
    # a threshold stands halfway to the next value, so that it doesn't hang on the last digit
    cuts = [np.array([(v + x[:, s][x[:, s] > v].min()) / 2 for v in c]) for s, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, s], "left") for s, c in enumerate(cuts)], 1)
    rng, f, rules = np.random.default_rng(seed), np.full(len(y), base), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        step = np.zeros(len(y))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        own = {}
        _grow(binned, cuts, y - p, p * (1 - p), rows, depth, (), own, step, 0.5)
        rules |= own
        f += step
    paths, columns, seen = [], [], set()
    for path in rules:
        held = _holds(x, path)
        if 0 < held.sum() < len(y) and (key := held.tobytes()) not in seen:
            seen.add(key)
            paths.append(path)
            columns.append(held)
    if not paths:
        return Model(float(base), ())
    r = np.stack(columns, 1).astype(float)
    test = rng.random(len(y)) < 0.2
    loss = {}
    for penalty in (0.01, 0.003, 0.001, 0.0003):
        w = _lasso(r[~test], y[~test], penalty)
        p = np.clip(1 / (1 + np.exp(-(r[test] @ w[:-1] + w[-1]))), 1e-6, 1 - 1e-6)
        loss[penalty] = -(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean() if test.any() else penalty
    w = _lasso(r, y, min(loss, key=loss.get), 800)
    return Model(float(w[-1]), tuple((p, float(v)) for p, v in zip(paths, w[:-1], strict=True) if abs(v) > 1e-6))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """Learns ``labels.quality`` from at most ``sample`` labelled documents outside the held-out fold."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    # bounded by ``sample`` rows of two numbers, and so safe to broadcast
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # an id may stand in many rows: the bound holds for what reaches the driver too
    rows = measured(met).drop("text").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *[f"_{s}" for s in STATISTICS]).limit(sample).toPandas()
    return learn(rows[[f"_{s}" for s in STATISTICS]].to_numpy(float), (rows["quality"] > 0).to_numpy(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """text, _docs (a struct of all other columns, so that no name can clash) and _score; the statistics use the whole text."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return measured(docs.select("text", F.struct(*others).alias("_docs"))).select("text", "_docs", model.column().alias("_score"))


def classify(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    A null or empty text has no words and gets the score of a document whose statistics are all
    0. Rows that repeat get the same score. Columns besides text never enter a score. Without
    any label the score is 0.5; with one kind of label only, it is the same for all.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels, sample=sample))
    doc_id, predicted = F.col("_docs.doc_id"), F.when(F.col("_score") >= threshold, 1).otherwise(0)
    return scored.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col("_score").alias("score"), predicted.alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, whose score reaches ``threshold``. Cases as in ``classify``."""
    good = score(docs, train(docs, labels, sample=sample)).where(F.col("_score") >= threshold)
    return good.select(*[F.col("text") if c == "text" else F.col("_docs").getField(c).alias(c) for c in docs.columns])
