"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios (NB-SVM style, logistic loss).

Fitting takes at most max_rows labelled rows (those with the smallest hashes of doc_id). Tasks count by class in how many of them each
hashed n-gram occurs; of these counts' log ratios the max_features that separate most are kept, and a regularised logistic regression
on the scaled features is fitted in one task, which gets no texts. The model (max_features weights) goes to every task; scoring is
one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from soundframe.llm.common import pieces, read, text_buffer, written

#: At most so many labelled rows are used for fitting.
MAX_ROWS = 8000
MAX_FEATURES = 6000
BITS = 20
SIZES = (3, 4, 5)
FOLDS = 5


def grams(texts: list[str], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct hashed character n-grams of lower-cased texts; only buckets that keep marks, if given.

    White space of any length counts as one space and each text is set between spaces, so word starts and ends are features.
    """
    rows = [np.frombuffer(f" {' '.join(t.lower().split())} ".encode("utf-32-le"), np.uint32) for t in texts]
    ends = np.cumsum([len(r) for r in rows])
    c = np.concatenate(rows) * np.uint32(2654435761) if rows else np.zeros(0, np.uint32)
    found = []
    for n in SIZES:
        if len(c) < n:
            continue
        h = c[: len(c) - n + 1].copy()
        for k in range(1, n):
            h *= np.uint32(0x01000193)
            h ^= c[k : len(c) - n + 1 + k]
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h >>= np.uint32(32 - BITS)
        at = np.arange(len(h)) if keep is None else np.flatnonzero(keep[h])
        row = np.searchsorted(ends, at, "right")
        whole = at + n <= ends[row]
        found.append((row[whole] << BITS) | h[at[whole]].astype(np.int64))
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys >> BITS, keys & ((1 << BITS) - 1)


def gram_counts(rows: DataFrame) -> DataFrame:
    """(bucket, zeros, ones): of the rows (text, toxic) with label 0 and 1, how many hold a hashed n-gram; summed in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            data, off = text_buffer(batch.column(0))
            y = np.asarray(batch.column(1))
            for i, j in pieces(off):
                row, bucket = grams([data[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace") for k in range(i, j)])
                for k in (0, 1):
                    count[k] += np.bincount(bucket[y[i + row] == k], minlength=1 << BITS)
        at = np.flatnonzero(count.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[0, at]), pa.array(count[1, at])], names=["bucket", "zeros", "ones"])

    return rows.select("text", "toxic").mapInArrow(run, "bucket long, zeros long, ones long").groupBy("bucket").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))


def held_grams(rows: DataFrame, buckets: np.ndarray) -> DataFrame:
    """(doc_id, toxic, held): places in buckets (sorted) of the n-grams that each row holds."""
    shared = rows.sparkSession.sparkContext.broadcast(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(1 << BITS, bool)
        keep[shared.value] = True
        for batch in batches:
            data, off = text_buffer(batch.column(2))
            for i, j in pieces(off):
                row, bucket = grams([data[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace") for k in range(i, j)], keep)
                ends = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.searchsorted(shared.value, bucket).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), held], names=["doc_id", "toxic", "held"])

    return rows.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, held array<int>")


def fit(row: np.ndarray, col: np.ndarray, y: np.ndarray, ratio: np.ndarray, l2: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights (ratio times coefficient) and intercept of a logistic regression; row holds n-gram col, whose value is its ratio."""
    n, m, ones = len(y), len(ratio), float(y.sum())
    x = ratio[col]
    scale = 1 / np.sqrt(np.bincount(col, x**2, m) / n + 1e-9)
    scale /= np.sqrt(max(1, len(row) / n))
    x = x * scale[col]
    w, b, vw, vb, step = np.zeros(m), np.log(ones / (n - ones)), np.zeros(m), 0.0, 1.0
    for _ in range(rounds):  # momentum on the mean loss
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[col], n) + b, -30, 30)))
        g = np.bincount(col, x * (p - y)[row], m) / n + l2 * w / n
        vw, vb = 0.9 * vw - step * g, 0.9 * vb - step * (p - y).mean()
        w, b = w + vw, b + vb
    return w * scale * ratio, float(b)


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, folds: int = FOLDS, max_features: int = MAX_FEATURES, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Learns toxic from labelled documents of the folds other than 0 (crc32 of the id as text): buckets, weights and intercept.

    Of several labels of an id the largest counts, of several texts the smallest; null ids and labels other than 0 and 1 teach nothing; null
    texts are empty.
    Without rows the score is that of label 0, with one class that of the class seen. Texts are counted where they lie; only the
    max_features numbers of each of at most max_rows rows meet in the task that fits.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    labelled = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(fold != 0)
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # max_rows rows of two numbers
    rows = written(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")
    total = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    if not n0 or not n1:
        return np.zeros(0, np.int64), np.zeros(0), 20.0 if n1 else -20.0
    share = lambda c, n: (F.col(c) + smooth) / (n + 2 * smooth)
    ratio = F.ln(share("ones", n1)) - F.ln(share("zeros", n0))
    worth = F.abs(ratio) * F.abs(share("ones", n1) - share("zeros", n0))
    best = gram_counts(rows).where("zeros + ones >= 2").select("bucket", ratio.alias("ratio"), worth.alias("worth")).where("worth > 0").orderBy(F.desc("worth"), "bucket").limit(max_features).toPandas().sort_values("bucket")
    buckets, ratios = best["bucket"].to_numpy(np.int64), best["ratio"].to_numpy(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches, pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("held", pa.list_(pa.int32()))])).sort_by("doc_id").combine_chunks()
        held = t["held"].combine_chunks()
        row = np.repeat(np.arange(len(held)), np.diff(np.asarray(held.offsets)))
        weights, intercept = fit(row, np.asarray(held.flatten()), t["toxic"].to_numpy().astype(float), ratios)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(weights))), pa.array(np.r_[intercept, weights])], names=["place", "weight"])

    model = held_grams(rows, buckets).repartition(1).mapInArrow(run, "place long, weight double").toPandas().sort_values("place")["weight"].to_numpy()  # max_features + 1 rows
    return buckets, model[1:], float(model[0])


def score_toxicity(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """All columns of documents and out_col, the probability of label 1; a column of that name is replaced.

    Null and empty texts get the score of a text without features; repeated rows are scored alike; texts may be of any length.
    """
    buckets, weights, intercept = model
    documents = documents.drop(out_col)
    place = documents.columns.index(text_col)
    shared = documents.sparkSession.sparkContext.broadcast((buckets, weights, intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, weights, intercept = shared.value
        keep, weight = np.zeros(1 << BITS, bool), np.zeros(1 << BITS)
        keep[buckets] = True
        weight[buckets] = weights
        for batch in batches:
            data, off = text_buffer(batch.column(place))
            score = np.full(batch.num_rows, intercept)
            for i, j in pieces(off):
                row, bucket = grams([data[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace") for k in range(i, j)], keep)
                score[i:j] += np.bincount(row, weight[bucket], j - i)
            score = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, out_col])

    schema = StructType([*documents.schema.fields, StructField(out_col, DoubleType())])
    return documents.mapInArrow(run, schema)


def query_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = train(documents, read(spark, sf_dir, "labels"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0
    return score_toxicity(documents.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
