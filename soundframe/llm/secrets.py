"""Secret scanning over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over mandatory trigrams. Texts are indexed by segments (about
1 MB of text inside a task): the index has, for each trigram that any query names, the sorted list of texts that hold it. A rule's
query intersects and unites those postings; only its candidates are verified by the expression itself. Rules without a
mandatory trigram scan every text. The index lives and dies within a segment, so nothing is shuffled and memory is bounded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundframe.llm.common import LOWER, pieces, text_buffer


@dataclass(frozen=True)
class Rule:
    """A match counts if its group has least characters or more; failing matches still use up their text."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    flags: int = re.ASCII


#: The three base kinds.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # runs of [0-9a-f]+ are maximal, so asking for 24 finds the same ones
)
#: Well-known public token formats.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opusr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9a-zA-Z]{24,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,80}:[^\s/:@]{1,80}@"),
)
RULES = BASE_RULES + MORE_RULES
ALL = ("all",)
WIDEST = 24


def _exact(items) -> set[str] | None:
    """All strings that a parsed expression can match, lower-cased; None if they are many or unbounded."""
    out = {""}
    for op, arg in items:
        if op is K.LITERAL:
            part = {chr(arg).lower()}
        elif op is K.IN and all(o is K.LITERAL for o, _ in arg):
            part = {chr(a).lower() for _, a in arg}
        elif op is K.BRANCH:
            sets = [_exact(x) for x in arg[1]]
            part = None if None in sets else set().union(*sets)
        elif op is K.SUBPATTERN:
            part = _exact(arg[-1])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[1] == 1 and (inner := _exact(arg[2])) is not None:
            part = inner | ({""} if arg[0] == 0 else set())
        elif op is K.AT:
            part = {""}
        else:
            return None
        if part is None or len(part) * len(out) > WIDEST:
            return None
        out = {a + b for a in out for b in part}
    return out


def _both(queries: list[tuple]) -> tuple:
    queries = list(dict.fromkeys(q for q in queries if q != ALL))
    return ALL if not queries else queries[0] if len(queries) == 1 else ("and", *queries)


def _either(queries: list[tuple]) -> tuple:
    queries = list(dict.fromkeys(queries))
    return ALL if ALL in queries or not queries else queries[0] if len(queries) == 1 else ("or", *queries)


def _needs(strings: set[str]) -> tuple:
    """What a text that holds one of strings must hold. Only ASCII trigrams take part."""
    return _either([_both([("tri", s[i : i + 3]) for i in range(len(s) - 2) if s[i : i + 3].isascii()]) for s in sorted(strings)])


def _query(items) -> tuple:
    found, run = [], {""}

    def flush():
        found.append(_needs(run))
        run.clear()
        run.add("")

    for item in items:
        one = _exact([item])
        if one is not None and len(one) * len(run) <= WIDEST:
            longer = {a + b for a in run for b in one}
            run.clear()
            run.update(longer)
            continue
        flush()
        op, arg = item
        if one is not None:
            run.clear()
            run.update(one)
        elif op is K.SUBPATTERN:
            found.append(_query(arg[-1]))
        elif op is K.BRANCH:
            found.append(_either([_query(x) for x in arg[1]]))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] > 0:
            found.append(_query(arg[2]))
    flush()
    return _both(found)


def trigram_query(pattern: str, flags: int = 0) -> tuple:
    """The Boolean trigram query of an expression: ("tri", t), ("and", ...), ("or", ...) or ALL. Trigrams are lower case."""
    return _query(_parser.parse(pattern, flags))


def trigrams(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "tri" else set().union(*[trigrams(q) for q in query[1:]]) if query[0] in ("and", "or") else set()


class SegmentIndex:
    """Postings of the wanted trigrams over the texts of a segment."""

    def __init__(self, wanted: list[str]):
        self.wanted = {t: k for k, t in enumerate(wanted)}
        alphabet = sorted({c for t in wanted for c in t})
        base = len(alphabet) + 1
        self.code = np.zeros(256, np.uint32)
        for k, c in enumerate(alphabet):
            self.code[ord(c)] = k + 1
        self.code = self.code[LOWER]
        self.base = np.uint32(base)
        self.table = np.full(base**3, -1, np.int16)
        for t, k in self.wanted.items():
            a, b, c = (int(self.code[ord(x)]) for x in t)
            self.table[(a * base + b) * base + c] = k

    def build(self, data: np.ndarray, off: np.ndarray) -> None:
        lo, self.n = int(off[0]), len(off) - 1
        c = self.code[data[lo : int(off[-1])]]
        if len(c) < 3:
            self.lists = {}
            return
        hit = self.table[(c[:-2] * self.base + c[1:-1]) * self.base + c[2:]]
        at = np.flatnonzero(hit >= 0)
        text = np.searchsorted(off, at + lo, "right") - 1
        whole = at + lo + 3 <= off[text + 1]
        pairs = np.unique(hit[at[whole]].astype(np.int64) * self.n + text[whole])
        self.lists = {k: pairs[i:j] - k * self.n for k in range(len(self.wanted)) if (i := np.searchsorted(pairs, k * self.n)) < (j := np.searchsorted(pairs, (k + 1) * self.n))}

    def candidates(self, query: tuple) -> np.ndarray:
        if query == ALL:
            return np.arange(self.n)
        if query[0] == "tri":
            return self.lists.get(self.wanted[query[1]], np.zeros(0, np.int64))
        found = [self.candidates(q) for q in query[1:]]
        if query[0] == "or":
            return np.unique(np.concatenate(found))
        out = found[0]
        for other in sorted(found[1:], key=len):
            out = np.intersect1d(out, other, assume_unique=True)
        return out


def find(rule: Rule, text: str) -> list[tuple[int, int]]:
    """Spans of the rule's matches that count, leftmost first, in code points."""
    return [m.span() for m in re.finditer(rule.pattern, text, rule.flags) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id as doc_id and secrets, an array of (kind, start, end) by start, then rule order.

    Positions are code points, end exclusive. Null and empty texts have no secrets; null ids and repeated rows stay; other
    columns are ignored, whatever their names; an empty table gives an empty result. Texts may be of any length: a text is scanned
    whole, and no rule looks at a character more than a few times.
    """
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    wanted = sorted(set().union(*map(trigrams, queries)))
    order = {r.kind: k for k, r in enumerate(rules)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = SegmentIndex(wanted)
        spans_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for i, j in pieces(off):
                index.build(data, off[i : j + 1])
                spans: list[list] = [[] for _ in range(j - i)]
                texts: dict[int, str] = {}
                for rule, query in zip(rules, queries, strict=True):
                    for d in index.candidates(query).tolist():
                        text = texts.get(d)
                        if text is None:
                            text = texts[d] = data[off[i + d] : off[i + d + 1]].tobytes().decode("utf-8", "replace")
                        spans[d] += [(s, order[rule.kind], e) for s, e in find(rule, text)]
                rows = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(x)] for x in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rows, spans_of)], names=["doc_id", "secrets"])

    kind = docs.select(F.col(id_col).alias("doc_id")).dtypes[0][1]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, f"doc_id {kind}, secrets array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each united span of secrets in text_col replaced by mark; all other columns, whatever their names, and rows stay as they are.

    Null and empty texts stay as they are; texts may be of any length; rows that repeat are treated alike; an empty table gives an empty one.
    """
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    wanted = sorted(set().union(*map(trigrams, queries)))
    place = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = SegmentIndex(wanted)
        for batch in batches:
            data, off = text_buffer(batch.column(place))
            texts = {}
            for i, j in pieces(off):
                index.build(data, off[i : j + 1])
                spans: dict[int, list] = {}
                for rule, query in zip(rules, queries, strict=True):
                    for d in index.candidates(query).tolist():
                        text = texts[i + d] if i + d in texts else data[off[i + d] : off[i + d + 1]].tobytes().decode("utf-8", "replace")
                        if found := find(rule, text):
                            texts[i + d] = text
                            spans.setdefault(i + d, []).extend(found)
                for d, found in spans.items():
                    text, at, out = texts[d], 0, []
                    for s, e in sorted(found):
                        if s >= at:
                            out += [text[at:s], mark]
                        at = max(at, e)
                    texts[d] = "".join(out) + text[at:]
            column = batch.column(place)
            if texts:
                values = column.to_pylist()
                for d, text in texts.items():
                    values[d] = text
                column = pa.array(values, column.type)
            yield pa.RecordBatch.from_arrays([column if k == place else x for k, x in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(scan, docs.schema)


def query_secrets(spark, sf_dir: str) -> DataFrame:
    from soundframe.llm.common import read

    found = scan_secrets(read(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s.kind.isin("assign", "access", "hex"))
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter("secrets", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
