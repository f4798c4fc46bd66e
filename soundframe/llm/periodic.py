"""Runs: stretches of words that repeat with a smallest period several times over, found by suffix classes that are united.

Positions of a text fall into classes of suffixes that agree on l words. From the largest l down, classes join where neighbours of the
suffix order share just l words (Kruskal's order). A class keeps its positions in order, and the smaller one goes into the larger. Two
positions that become neighbours at level l and lie d <= l apart start a stretch with period d of d + l words; d is its smallest
period, since with a smaller one a position between them would be in the class by then. Every start in a run but its last words seeds
the same run, so the smallest of them is its beginning.

A run of `least` words with `exponent` periods has starts that agree on at least `floor_of(least, exponent)` words (16 for 24 and 3).
Classes below that level seed nothing and are not united, and texts in which no such stretch of words occurs twice are done.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundframe.llm.common import Powers, mix, pieces, read, span_hashes, text_buffer, word_spans

LEAST, EXPONENT = 24, 3
ODD = np.uint64(0x9FB21C651E98DF25)
Plant = Callable[[object, int], "tuple[int, int] | None"]


def floor_of(least: int, exponent: int) -> int:
    """Words that the first two starts of a run agree on at least: a run of period d has max(least, exponent * d) words or more."""
    return min(max(least - d, (exponent - 1) * d) for d in range(1, least + 1))


def sums(words: np.ndarray) -> np.ndarray:
    up, _ = Powers.get(len(words) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])


def stretch(prefix: np.ndarray, at: np.ndarray, size) -> np.ndarray:
    """Hashes of `size` words from each place."""
    _, down = Powers.get(len(prefix))
    return (prefix[at + size] - prefix[at]) * down[at]


def repeated(words: np.ndarray, end: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """Places whose next `size` words stand elsewhere in their text too."""
    at = np.flatnonzero(np.arange(len(words)) + size <= end)
    key = mix(stretch(sums(words), at, size) ^ mix(text[at].astype(np.uint64) * ODD + ODD))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    return at[twice]


def suffix_ranks(words: np.ndarray, end: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes, each within its text, by prefix doubling; places whose rank is settled are left out of later rounds."""
    n = len(words)
    _, letter = np.unique(words, return_inverse=True)
    key = text.astype(np.int64) * n + letter
    rank, live, reach = np.zeros(n, np.int64), np.arange(n), 0
    while len(live):
        if reach:
            ahead = live + reach
            second = np.where(ahead < end[live], rank[np.minimum(ahead, n - 1)], -1)
            order = np.lexsort((second, rank[live]))
            first, second = rank[live][order], second[order]
            new_group = np.concatenate([[True], first[1:] != first[:-1]])
            new_rank = new_group | np.concatenate([[True], second[1:] != second[:-1]])
        else:
            order = np.argsort(key, kind="stable")
            first = np.zeros(n, np.int64)
            new_group = np.arange(n) == 0
            new_rank = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        at = np.arange(len(live))
        base = np.maximum.accumulate(np.where(new_group, at, 0))
        lead = np.maximum.accumulate(np.where(new_rank, at, 0))
        live = live[order]
        rank[live] = first + lead - base
        alone = new_rank & np.concatenate([new_rank[1:], [True]])
        live = live[~alone]
        reach = 2 * reach or 1
    return rank


def shared(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words the places a and b have in common, up to most, by bisection of hashes."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = stretch(prefix, a, middle) == stretch(prefix, b, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def seeds(places: list[int], levels: list[int], order: list[int], least: int, exponent: int) -> dict[tuple[int, int], int]:
    """(end, period) -> first start, by uniting classes of neighbours k and k + 1 in the suffix order, levels[k] words in common."""
    lead, member = list(range(len(places))), [None] * len(places)
    found: dict[tuple[int, int], int] = {}

    def find(x: int) -> int:
        while lead[x] != x:
            lead[x] = lead[lead[x]]
            x = lead[x]
        return x

    for k in order:
        a, b, level = find(k), find(k + 1), levels[k]
        big, small = member[a] or [places[a]], member[b] or [places[b]]
        if len(big) < len(small):
            a, b, big, small = b, a, small, big
        near, last = [], -1
        for n, x in enumerate(small):
            at = bisect_left(big, x)
            if at != last:  # the first of the small class in this gap of the large one, and the last in the gap before
                if at:
                    near.append((big[at - 1], x))
                if n and last < len(big):
                    near.append((small[n - 1], big[last]))
                last = at
        if last < len(big):
            near.append((small[-1], big[last]))
        for x, y in near:
            d = y - x
            if (exponent - 1) * d <= level and level + d >= least:
                key = (y + level, d)
                if x < found.get(key, y):
                    found[key] = x
        if len(small) * 16 < len(big):
            for x in small:
                insort(big, x)
        else:
            big += small
            big.sort()
        lead[b], member[a], member[b] = a, big, None
    return found


def runs_of(words: np.ndarray, woff: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each of several texts of word hashes, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(woff) - 1)]
    floor = floor_of(least, exponent)
    text = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
    places = repeated(words, woff[1:][text], text, floor) if len(words) >= floor else np.zeros(0, np.int64)
    if not len(places):
        return out
    with_some = np.zeros(len(woff) - 1, bool)
    with_some[text[places]] = True
    part = np.flatnonzero(with_some[text])  # from here on, only texts in which words repeat
    words, text, of = words[part], text[part], np.cumsum(with_some[text]) - 1
    places = of[places]
    begin = np.searchsorted(text, np.arange(len(woff) - 1))
    end = np.searchsorted(text, text, "right")
    rank = suffix_ranks(words, end, text)
    places = places[np.argsort(rank[places])]
    a, b = places[:-1], places[1:]
    most = np.where(text[a] == text[b], np.minimum(end[a] - a, end[b] - b), 0)
    level = shared(sums(words), a, b, most)
    order = np.argsort(-level, kind="stable")
    order = order[level[order] >= floor]
    for (stop, d), start in seeds(places.tolist(), level.tolist(), order.tolist(), least, exponent).items():
        t = int(text[start])
        out[t].append((start - int(begin[t]), stop - start, d))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    keep, at = [], 0
    for a, b in sorted((s + d, s + n) for s, n, d in runs):
        if a > at:
            keep += words[at:a]
        at = max(at, b)
    return keep + words[at:]


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, id_col: str = "doc_id", text_col: str = "text", plant: Plant | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start, then period) and collapsed of every row.

    A run is a stretch of words with smallest period d, of max(least, exponent * d) words or more, that no neighbour extends. collapsed
    is the text's words without those after any run's first period, joined by single spaces. Words with equal 64-bit hashes count as
    equal. plant, a function of (id, words), may name (a, p): words from a on are then first replaced by those of a, a + 1, ..
    a + p - 1 in turn, which makes inputs with known runs.

    Null and empty texts have no words, no runs and an empty collapsed; null ids and repeated rows stay, each by itself; a text may be
    of any length (one text is one task's work, in time n log n of its repeated words); other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    kinds = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for i, j in pieces(off):
                piece = off[i : j + 1]
                _, s, e, woff = word_spans(data, piece)
                n = np.diff(woff)
                hashes, turned = span_hashes(data[piece[0] : piece[-1]], s, e), {}
                for k, row in enumerate(batch.column(0).slice(i, j - i).to_pylist() if plant else ()):
                    if at := plant(row, int(n[k])):
                        turned[k] = at[0] + np.arange(n[k] - at[0]) % at[1]
                        hashes[woff[k] + at[0] : woff[k + 1]] = hashes[woff[k] + turned[k]]
                runs = runs_of(hashes, woff, least, exponent)
                texts = []
                for k in range(j - i):
                    words = data[piece[k] : piece[k + 1]].tobytes().split()  # at the same bytes as word_spans
                    if k in turned:
                        words[len(words) - len(turned[k]) :] = [words[x] for x in turned[k]]
                    texts.append(b" ".join(collapse(words, runs[k])))
                flat = [x for r in runs for x in r]
                columns = [pa.array([x[c] for x in flat], pa.int64()) for c in range(3)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kinds)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.select(F.col(id_col).alias("doc_id")).dtypes[0][1]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equals; null without runs."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    better = lambda a, x: a.isNull() | (x.length * a.period > a.length * x.period)
    return F.aggregate(runs, none, lambda a, x: F.when(better(a, x), x).otherwise(a))


def planted(doc_id, n: int) -> tuple[int, int] | None:
    """The contract's repetitions: one document in ten, chosen by its id, is periodic from some word on."""
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def query_periodic(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(read(spark, sf_dir, "documents"), plant=planted).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
