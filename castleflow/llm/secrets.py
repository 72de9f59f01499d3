"""Secret scans through a trigram index.

From every rule's regular expression a Boolean query over trigrams is derived (Cox, "Regular
Expression Matching with a Trigram Index", 2012): an AND of ORs of strings that any match has
to hold. Each block of documents gets an inverted index of the trigrams that the queries name;
a rule's candidates are the documents in the unions and intersections of its postings, and
only these are searched with the expression. A rule whose expression names no mandatory
trigram, as a run of hexadecimal digits does, searches all documents. Blocks are independent,
so that nothing is shuffled and an index never outgrows a block.

The index folds A-Z to a-z. That only adds candidates for rules that mind the case.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from castleflow.llm.common import LOWER, blocks, lean, utf8

#: Strings of a set before it is given up for what its members have in common.
MOST_STRINGS = 64
#: Distinct choices that one character class may spell out.
MOST_CHARS = 16


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    #: Group whose length counts, and the least length.
    group: int = 0
    least: int = 0

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags)

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Leftmost non-overlapping matches; those under the least length take up their place, but drop out."""
        for m in self.regex.finditer(text):
            a, b = m.span(self.group)
            if b - a >= self.least:
                yield m.span()


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 16),
    Rule("hex", r"[0-9a-f]+", re.ASCII, 0, 32),
)
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@[A-Za-z0-9.-]+"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9+/_.=-]{20,}"),
)

# --- trigram queries ----------------------------------------------------------------------
# A query is a set of clauses; each clause is a set of strings of three bytes or more, one of
# which must occur. What is known of a part of an expression: the strings that it can be, if
# these are few (exact), else None, and the query that its matches fulfil.


@dataclass(frozen=True)
class Known:
    exact: frozenset[str] | None
    clauses: frozenset[frozenset[str]] = frozenset()


_EMPTY = Known(frozenset([""]))
_ANY = Known(None)


def _clause(strings: frozenset[str] | None) -> frozenset[frozenset[str]]:
    if not strings or min(map(len, strings)) < 3:
        return frozenset()
    return frozenset([strings])


def _join(parts: list[Known]) -> Known:
    """One after another. Neighbouring exact sets grow together; what grows too large becomes a clause."""
    clauses: set[frozenset[str]] = set()
    run: frozenset[str] | None = frozenset([""])
    whole = True
    for p in parts:
        clauses |= p.clauses
        if p.exact is None:
            clauses |= _clause(run)
            run, whole = frozenset([""]), False
            continue
        grown = frozenset(a + b for a, b in product(run, p.exact)) if len(run) * len(p.exact) <= MOST_STRINGS else None
        if grown is None:
            clauses |= _clause(run)
            run, whole = p.exact, False
        else:
            run = grown
    return Known(run if whole else None, frozenset(clauses) | (frozenset() if whole else _clause(run)))


def _either(parts: list[Known]) -> Known:
    if all(p.exact is not None for p in parts):
        union = frozenset().union(*(p.exact for p in parts))
        if len(union) <= MOST_STRINGS:
            return Known(union)
    # one clause of each branch, together, still is one that any match fulfils
    own = []
    for p in parts:
        best = min([*p.clauses, *_clause(p.exact)], key=len, default=None)
        if best is None:
            return _ANY
        own.append(best)
    return Known(None, frozenset([frozenset().union(*own)]))


def _known(tree, flags: int) -> Known:
    from re import _constants as c

    parts: list[Known] = []
    for op, value in tree:
        if op is c.LITERAL:
            parts.append(Known(frozenset([chr(value).lower()])))
        elif op is c.IN and all(o in (c.LITERAL, c.RANGE) for o, _ in value):
            chars = {chr(x).lower() for o, v in value for x in (range(v, v + 1) if o is c.LITERAL else range(v[0], min(v[1], v[0] + 256) + 1))}
            parts.append(Known(frozenset(chars)) if len(chars) <= MOST_CHARS else _ANY)
        elif op is c.SUBPATTERN:
            parts.append(_known(value[3], flags))
        elif op is c.BRANCH:
            parts.append(_either([_known(x, flags) for x in value[1]]))
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            least, most, body = value
            inner = _known(body, flags)
            if (least, most) == (0, 1) and inner.exact is not None:
                parts.append(Known(inner.exact | {""}))
            elif least == 0:
                parts.append(_ANY)
            elif least == most and least <= 4:
                parts += [inner] * least
            else:
                parts += [*[inner] * min(least, 3), _ANY]
        elif op in (c.AT, c.ASSERT, c.ASSERT_NOT):
            parts.append(_EMPTY)
        else:
            parts.append(_ANY)
    return _join(parts) if parts else _EMPTY


def trigram_query(pattern: str, flags: int = 0) -> frozenset[frozenset[frozenset[str]]]:
    """An AND of ORs of ANDs of trigrams that the folded UTF-8 of any match holds; empty: none is mandatory."""
    from re import _parser

    known = _known(_parser.parse(pattern, flags), flags)
    query = set()
    for clause in known.clauses | _clause(known.exact):
        raw = [s.encode() for s in clause]
        query.add(frozenset(frozenset(r[i : i + 3].decode("latin-1") for i in range(len(r) - 2)) for r in raw))
    return frozenset(query)


class Index:
    """Which trigrams the rules' queries name, and the search of one block through them."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.queries = [trigram_query(r.pattern, r.flags) for r in rules]
        names = sorted({t for q in self.queries for clause in q for grams in clause for t in grams})
        self.number = {t: i + 1 for i, t in enumerate(names)}
        self.table: np.ndarray | None = None

    def postings(self, raw: np.ndarray, offsets: np.ndarray) -> dict[int, np.ndarray]:
        """Documents of each named trigram, ascending."""
        if self.table is None:
            self.table = np.zeros(1 << 24, np.uint8 if len(self.number) < 255 else np.uint16)
            for t, i in self.number.items():
                a, b, c = t.encode("latin-1")
                self.table[a << 16 | b << 8 | c] = i
        if len(raw) < 3:
            return {}
        low = LOWER[raw].astype(np.int32)
        found = self.table[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        at = np.flatnonzero(found)
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[doc + 1]
        pair = np.unique(found[at[inside]].astype(np.int64) << 40 | doc[inside])
        gram, doc = pair >> 40, pair & ((1 << 40) - 1)
        cuts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1], True]) if len(gram) else [0]
        return {int(gram[a]): doc[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)}

    def candidates(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Documents that each rule has to search."""
        lists, none, everyone = self.postings(raw, offsets), np.zeros(0, np.int64), np.arange(len(offsets) - 1)
        out = []
        for query in self.queries:
            docs = everyone
            for clause in query:
                of_clause = none
                for grams in clause:
                    both = None
                    for t in sorted(grams, key=lambda t: len(lists.get(self.number[t], none))):
                        p = lists.get(self.number[t], none)
                        both = p if both is None else np.intersect1d(both, p, assume_unique=True)
                        if not len(both):
                            break
                    of_clause = np.union1d(of_clause, both)
                docs = np.intersect1d(docs, of_clause, assume_unique=True)
            out.append(docs)
        return out


_HEX_RUN = re.compile(r"[0-9a-f]{32,}", re.ASCII)


def scan_texts(raw: np.ndarray, offsets: np.ndarray, index: Index) -> list[list[tuple[int, int, int]]]:
    """(start, rule, end) in code points of all spans of each document, sorted."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    texts: dict[int, str] = {}
    for r, docs in enumerate(index.candidates(raw, offsets)):
        rule = index.rules[r]
        # a greedy run of one class: the least length may as well be asked of the run itself
        spans: Callable = rule.spans if rule.kind != "hex" else lambda t: (m.span() for m in _HEX_RUN.finditer(t))
        for d in docs.tolist():
            if d not in texts:
                texts[d] = raw[offsets[d] : offsets[d + 1]].tobytes().decode()
            found[d] += [(a, r, b) for a, b in spans(texts[d])]
    return [sorted(x) for x in found]


def _scan(rules: tuple[Rule, ...], base: int):
    index = Index(rules)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = lambda spans: ",".join(f"{rules[r].kind}:{a}:{b}" for a, r, b in spans)
        for batch in batches:
            raw, offs = utf8(batch.column("text"))
            counts, digest, spans = [[] for _ in range(base)], [], []
            for a, b in blocks(offs):
                for x in scan_texts(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], index):
                    for r in range(base):
                        counts[r].append(sum(s[1] == r for s in x))
                    digest.append(hashlib.sha256(said(s for s in x if s[1] < base).encode()).hexdigest())
                    spans.append(said(x))
            columns = {f"n_{rules[r].kind}": pa.array(counts[r], pa.int64()) for r in range(base)}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **columns, "base_sha256": pa.array(digest, pa.string()), "spans": pa.array(spans, pa.string())})

    return of


def find_secrets(docs: DataFrame, *, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """doc_id, a count for each base rule, base_sha256 and spans, one row for each input row.

    A span is kind:start:end in code points of the whole match; spans are sorted by start, then
    in the order of the rules, and joined by commas. ``base_sha256`` is of the base rules' spans
    alone. A null text reads as empty and has no spans; rows that repeat are scanned each for
    itself; extra columns are ignored; an empty table gives an empty result.
    """
    rules = (*base, *more)
    schema = ", ".join(["doc_id long", *(f"n_{r.kind} long" for r in base), "base_sha256 string", "spans string"])
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(_scan(rules, len(base))), schema)


def _cased(pattern: str) -> str:
    """An expression whose letters outside of classes stand for either case, for engines that fold more than ASCII."""
    out, depth, escaped = [], 0, False
    for c in pattern:
        depth += (c == "[" and not escaped) - (c == "]" and not escaped)
        out.append(f"[{c.lower()}{c.upper()}]" if c.isalpha() and not depth and not escaped else c)
        escaped = c == "\\" and not escaped
    return "".join(out)


def oracle(base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> str:
    """DuckDB SQL for find_secrets, where doc_id is unique: each match is found behind the shortest rest of text before it."""
    finds = []
    for k, rule in enumerate((*base, *more)):
        pattern = _cased(rule.pattern) if rule.flags & re.IGNORECASE else rule.pattern
        # white space with a vertical tab, as in the scan
        pattern = pattern.replace(r"\s", r" \t\n\r\f\v").replace("'", "''")
        piece = f"'(?s)(.*?)({pattern})'"
        finds.append(
            f"SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all(text, {piece}, 1) AS before, regexp_extract_all(text, {piece}, 2) AS found, regexp_extract_all(text, {piece}, {2 + rule.group}) AS valued FROM d"
        )
    counts = ", ".join(f"CAST(count(*) FILTER (k = {k}) AS BIGINT) AS n_{r.kind}" for k, r in enumerate(base))
    said = "coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k){}, '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pieces AS ({" UNION ALL ".join(finds)}),
each AS (SELECT doc_id, k, kind, least, unnest(before) AS before, unnest(found) AS found, unnest(valued) AS valued, generate_subscripts(found, 1) AS i FROM pieces),
placed AS (SELECT doc_id, k, kind, least, length(valued) AS n, sum(length(before) + length(found)) OVER (PARTITION BY doc_id, k ORDER BY i) AS b, length(found) AS m FROM each),
spans AS (SELECT doc_id, k, kind, b - m AS a, b FROM placed WHERE n >= least)
SELECT d.doc_id, {counts}, sha256({said.format(f" FILTER (k < {len(base)})")}) AS base_sha256, {said.format(" FILTER (k IS NOT NULL)")} AS spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""
