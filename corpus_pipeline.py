"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, benchmark leaks go, secrets are
masked, and what is left is tokenised. Each stage works on all that the one before kept.

In every stage null texts count as empty, texts may be of any length, other columns are kept as they are whatever their names, and an
empty table gives an empty one. What a stage does with null ids, ties and repeated rows stands with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundframe.llm import bpe, decontaminate, minhash, secrets, toxicity
from soundframe.llm.common import free, read, written

#: Rows that a task hands to Python at once: whole texts, which both sides hold, so Spark's 10,000 would be many megabytes a task.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's size of Arrow batches, for what a stage runs itself and for the write of what it returns. Results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half, learned from the labels of the whole documents table.

    A score of exactly one half goes. Rows are judged one by one: null ids and repeated rows by their texts, repeated ones alike.
    """
    small_batches(spark)
    model, score = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")), free(docs, "_toxicity")
    return toxicity.score_toxicity(docs, model, out_col=score).where(F.col(score) < 0.5).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; rows that repeat its id stay, rows without an id do too."""
    small_batches(spark)
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. All rows of an id go if one of its texts has one; null ids count as one id."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents and rows, secrets in their texts masked; n_chars follows the text (null for a null text)."""
    small_batches(spark)
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: its id (or null), number of tokens, and digests of the ids and of the text they decode to."""
    small_batches(spark)
    return bpe.digests(bpe.encode(docs, bpe.vocabulary(), decoded=True))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("bpe", tokenise),
]
#: Learned and hashed stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
