"""Benchmark decontamination by windows that share enough words with an item.

1. Passage frequencies of the benchmark's words over all documents give TF-IDF weights, for the
   cosine that is reported.
2. Documents are cut in steps of 8 words. For each step and item the shared words are counted;
   sums of neighbouring steps, from one running sum, are windows as long as an item plus one step.
3. Windows whose count reaches the share of an item's words are candidates. No window that holds
   a long enough common subsequence has a smaller count, so the confirmation alone decides.
4. Candidates are confirmed: the longest common subsequence of words has to reach a share of the
   item; where the benchmark gives an answer, its words have to be there too. So edited, partly
   reworded and cut off copies count as well.

The latent space of a truncated SVD is not searched: README has the figures.

A benchmark is handled in groups of ``ITEMS`` items, which bounds all that is sent out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castleflow.llm.common import ALNUM, BLOCK_BYTES, blocks, lean, range_hash, stash, utf8, word_bounds
from castleflow.llm.repeats import keyed

ITEMS = 1024
#: Items that are counted together; a group holds several such spaces.
SPACE = 256
STEP, PASSAGE = 8, 64
#: Texts that are put in lower case at a time.
ROWS = 512
#: Steps whose windows are counted at a time.
CHUNK = 2048
SHARE, ANSWER, SURE = 0.6, 0.5, 0.9
#: Items of fewer words would be met by chance in part; they are matched whole.
LEAST_WORDS = 5


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and each document's first."""
    starts, ends, first = word_bounds(raw, offsets, ALNUM)
    return range_hash(raw, starts, ends), first


def _cut(first: np.ndarray, size: int) -> np.ndarray:
    """Where pieces of ``size`` words begin, none across documents; one more entry at the end."""
    n = -(-np.diff(first) // size)
    begin = np.repeat(first[:-1] - (np.cumsum(n) - n) * size, n) + np.arange(n.sum()) * size
    return np.r_[begin, first[-1]]


@dataclass(frozen=True)
class Vocabulary:
    hashes: np.ndarray

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words that the vocabulary has, and their numbers."""
        if not len(self.hashes):
            return np.zeros(0, int), np.zeros(0, int)
        number = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        at = np.flatnonzero(self.hashes[number] == words)
        return at, number[at]


def _text_blocks(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):  # so that a batch is never there twice
            raw, offs = utf8(pc.utf8_lower(batch.column("text").slice(at, ROWS)))
            for a, b in blocks(offs, BLOCK_BYTES // 2):
                yield batch, at + a, *words_of(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])


def _frequencies(vocabulary: Vocabulary):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = len(vocabulary.hashes)
        total, passages = np.zeros(v, np.int64), 0
        for _, _, words, first in _text_blocks(batches):
            at, number = vocabulary.find(words)
            cuts = _cut(first, PASSAGE)
            passages += len(cuts) - 1
            if len(at):
                total += np.bincount(np.unique((np.searchsorted(cuts, at, "right") - 1) * v + number) % v, minlength=v)
        yield pa.RecordBatch.from_pydict({"word": pa.array(np.arange(-1, v)), "n": pa.array(np.r_[passages, total])})

    return of


@dataclass(frozen=True)
class Item:
    item_id: int
    words: tuple[int, ...]
    answer: frozenset[int]

    @property
    def steps(self) -> int:
        return -(-len(self.words) // STEP) + 1

    @property
    def short(self) -> bool:
        return len(self.words) < LEAST_WORDS

    def stands_in(self, text: list[int]) -> bool:
        n = len(self.words)
        return any(tuple(text[k : k + n]) == self.words for k in range(len(text) - n + 1))

    @property
    def least(self) -> int:
        """Words of a common subsequence that reaches the share."""
        return len(self.words) if self.short else math.ceil(SHARE * len(self.words) - 1e-9)

    @cached_property
    def times(self) -> Counter[int]:
        return Counter(self.words)

    def may_share(self, text: list[int]) -> float:
        """No common subsequence is a larger share than the item's places whose word stands in the text."""
        return sum(map(self.times.__getitem__, self.times.keys() & text)) / len(self.words)


@dataclass(frozen=True)
class Space:
    """Items that are searched together.

    A word that an item holds m times counts up to m times in a step: ``held`` has a line for a
    word's first, second, ... occurrence, which says what items hold it so often, and ``lines``
    has the lines of each word, or -1.
    """

    items: tuple[Item, ...]
    lines: np.ndarray
    held: np.ndarray
    #: Of each item, idf times its unit TF-IDF weight, by word.
    weights: tuple[dict[int, float], ...]


def common_subsequence(a: tuple[int, ...], b: list[int]) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of one integer."""
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _search_space(space: Space, words, first, cuts, doc, step, number, rank, norm, best: dict[tuple[int, int], tuple]) -> None:
    """Confirmed items of one space, into ``best``.

    A common subsequence takes each place of the item once, so it is no longer than the sum over
    the window's steps of the words that a step shares with the item. Windows in which that sum
    reaches the share are candidates; this leaves out nothing, however frequent the words are.
    """
    n = len(cuts) - 1
    line = np.where(rank < space.lines.shape[1], space.lines[number, np.minimum(rank, space.lines.shape[1] - 1)], -1)
    step, line = step[line >= 0], line[line >= 0]
    longest = max(i.steps for i in space.items)
    # differences of sums that wrap are right as long as a window's count fits
    kind = np.uint16 if longest * STEP < 1 << 16 else np.uint32
    groups = []
    for steps in sorted({i.steps for i in space.items}):
        own = [i for i, item in enumerate(space.items) if item.steps == steps]
        groups.append((steps, own, np.array([space.items[i].least for i in own], kind)))
    doc_end = np.searchsorted(doc, doc, "right")
    for a in range(0, n, CHUNK):
        b = min(n, a + CHUNK + longest)
        lo, hi = np.searchsorted(step, (a, b))
        if lo == hi:
            continue
        head = np.flatnonzero(np.r_[True, step[lo + 1 : hi] != step[lo : hi - 1]])
        total = np.zeros((b - a + 1, len(space.items)), kind)
        total[step[lo:hi][head] - a + 1] = np.add.reduceat(space.held[line[lo:hi]], head, dtype=kind)
        np.cumsum(total, axis=0, dtype=kind, out=total)
        w = np.arange(a, min(n, a + CHUNK))
        for steps, own, least in groups:
            end = np.minimum(w + steps, doc_end[w])
            part = total[:, own]
            for x, i in zip(*np.nonzero(part[end - a] - part[w - a] >= least), strict=True):
                item, at, to = space.items[own[i]], int(w[x]), int(end[x])
                text = words[cuts[at] : cuts[to]].tolist()
                if not item.stands_in(text) if item.short else item.may_share(text) < SHARE:
                    continue
                share = common_subsequence(item.words, text) / len(item.words)
                # an item without an answer is judged by the subsequence alone
                answer = len(item.answer.intersection(text)) / len(item.answer) if item.answer else 1.0
                d = int(doc[at])
                key = (d, item.item_id)
                if share >= SHARE and (answer >= ANSWER or share >= SURE) and (share, answer) > best.get(key, (0, 0))[:2]:
                    weight = space.weights[own[i]]
                    cosine = sum(weight.get(t, 0.0) for t in text) / max(float(norm[at:to].sum()), 1e-9) ** 0.5
                    best[key] = (share, answer, min(1.0, cosine), int(cuts[at] - first[d]))


def _search(vocabulary: Vocabulary, idf: np.ndarray, other: float, spaces: tuple[Space, ...]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, words, first in _text_blocks(batches):
            best: dict[tuple[int, int], tuple] = {}
            cuts = _cut(first, STEP)
            n = len(cuts) - 1
            at, number = vocabulary.find(words)
            if len(at):
                step = np.searchsorted(cuts, at, "right") - 1
                order = np.lexsort((number, step))
                step, number = step[order], number[order]
                head = np.flatnonzero(np.r_[True, step[1:] != step[:-1]])
                known = np.diff(np.r_[head, len(at)])
                again = np.flatnonzero(np.r_[True, (step[1:] != step[:-1]) | (number[1:] != number[:-1])])
                rank = np.arange(len(step)) - np.repeat(again, np.diff(np.r_[again, len(step)]))
                norm = (np.diff(cuts) * other**2).astype(float)
                norm[step[head]] += np.add.reduceat(idf[number] ** 2, head) - known * other**2
                doc = np.searchsorted(first, cuts[:-1], "right") - 1
                for space in spaces:
                    _search_space(space, words, first, cuts, doc, step, number, rank, norm, best)
            rows = sorted(best.items())
            ids = batch.column("row").take(pa.array([a + d for (d, _), _ in rows], pa.int64()))
            columns = [pa.array([x[1][k] for x in rows], t) for k, t in enumerate((pa.float64(), pa.float64(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([ids, pa.array([i for (_, i), _ in rows], pa.int64()), *columns], ["row", "item_id", "lcs_share", "answer_share", "cosine", "window_start"])

    return of


def _read_items(rows: list[dict]) -> list[Item]:
    items = []
    for r in rows:
        words = _hashes(r["text"])
        answer = _hashes(r["answer"]).tolist() if r.get("answer") else []
        items.append(Item(r["item_id"], tuple(words.tolist()), frozenset(answer)))
    return items


def _hashes(text: str) -> np.ndarray:
    return words_of(*utf8(pc.utf8_lower(pa.array([text], pa.string()))))[0]


def _spaces(items: list[Item], vocabulary: Vocabulary, idf: np.ndarray) -> tuple[Space, ...]:
    out = []
    for a in range(0, len(items), SPACE):
        part = tuple(items[a : a + SPACE])
        times = np.zeros((len(idf), len(part)), np.int64)
        for i, item in enumerate(part):
            times[:, i] = np.bincount(vocabulary.find(np.array(item.words, np.uint64))[1], minlength=len(idf))
        # a step has STEP words
        most = np.minimum(times.max(1), STEP)
        word, rank = np.nonzero(np.arange(max(1, most.max())) < most[:, None])
        lines = np.full((len(idf), max(1, most.max())), -1)
        lines[word, rank] = np.arange(len(word))
        weights = []
        for i in range(len(part)):
            own = np.flatnonzero(times[:, i])
            weight = times[own, i] * idf[own]
            weight = idf[own] * weight / max(np.linalg.norm(weight), 1e-12)
            weights.append(dict(zip(vocabulary.hashes[own].tolist(), weight.tolist(), strict=True)))
        out.append(Space(part, lines, (times[word] > rank[:, None]).astype(np.uint8), tuple(weights)))
    return tuple(out)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, seed: int = 11) -> DataFrame:
    """doc_id, item_id, lcs_share, answer_share, cosine and window_start of each document that holds a benchmark item.

    One row for each document and item, with the best window. Words are runs of letters and
    digits in lower case. lcs_share is the longest common subsequence over the item's
    length, answer_share the part of the item's answer words that the window holds (a column
    ``answer``; 1 where there is none, and then the subsequence alone decides). Null and empty texts hold nothing; items
    of under ``LEAST_WORDS`` words count only where all their words stand in a row; those without a
    word or with a null item_id are left out; equal items
    are each reported. Where doc_id repeats or is null, each row is judged for itself. Extra
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    columns = ["item_id", "text", *(["answer"] if "answer" in benchmark.columns else [])]
    benchmark = benchmark.where("item_id is not null and text is not null").select(*columns).distinct()
    groups = max(1, -(-benchmark.count() // ITEMS))
    docs = keyed(docs)
    text = docs.select("row", "text")
    found = spark.createDataFrame([], LEAKS)
    for g in range(groups):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
        rows = sorted((r.asDict() for r in part.collect()), key=lambda r: (r["item_id"], r["text"]))
        rows = [r for r in rows if len(_hashes(r["text"]))]
        if rows:
            found = found.unionByName(_leaks_of(text, rows))
    best = found.groupBy("row", "item_id").agg(F.max(F.struct("lcs_share", "answer_share", "cosine", "window_start")).alias("best"))
    return best.join(docs.select("row", F.col("doc_id").cast("long").alias("doc_id")), "row").select("doc_id", "item_id", "best.*")


LEAKS = "row long, item_id long, lcs_share double, answer_share double, cosine double, window_start long"


def _leaks_of(text: DataFrame, rows: list[dict]) -> DataFrame:
    vocabulary = Vocabulary(np.unique(np.concatenate([_hashes(r["text"]) for r in rows])))
    counted = text.mapInArrow(lean(_frequencies(vocabulary)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(vocabulary.hashes) + 1, np.int64)
    for r in counted:
        counts[r["word"] + 1] = r["n"]
    idf = np.log((counts[0] + 2) / (counts[1:] + 1))
    other = float(idf.mean())
    spaces = _spaces(_read_items(rows), vocabulary, idf)
    return stash(text.mapInArrow(lean(_search(vocabulary, idf, other, spaces)), LEAKS), "leaks")
