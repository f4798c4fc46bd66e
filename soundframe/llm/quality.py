"""Quality rules with verdicts on hosts, all in built-in functions.

Each document gets counts and a base verdict. Hosts are judged by the share of their documents that fail: a beta prior is
fitted to the rates of all hosts by moments (weighted by documents), each host's rate is shrunk towards it (small hosts most), and a
host is rejected whole where its shrunk rate stands out from that prior: over SPREAD deviations of the prior above its mean,
with over ODDS times the mean's odds. Hosts that fail alike, however often, are all left to the base verdicts. Verdicts are
joined back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundframe.llm.common import SPACE_RE, WORD_RE, read, written

#: What rejects a host: deviations above the prior's mean, and its odds of failure over the mean's.
SPREAD, ODDS = 2.0, 3.0


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the counts of every text. A null text has no words. Other columns are ignored.

    Words in repeated 3-word windows: window hashes carry their position in their low bits (as many as the text needs), so a
    sort puts equal windows side by side; neighbours are then compared on the whole hash. The work is W log W for W words.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("w", F.array_remove(F.split("text", SPACE_RE), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD_RE))
    d = d.withColumn("lines", lines)
    d = d.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    two = F.greatest(F.size("h") - 2, F.lit(0))
    d = d.withColumn("win", F.transform(F.slice("h", F.lit(1), two), lambda x, i: F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2))))
    repeats = F.size(F.array_distinct("win")) < F.size("win")
    d = d.withColumn("win", F.when(repeats, F.col("win")).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("mask", F.expr("shiftleft(1L, cast(ceil(log2(size(win) + 1)) as int)) - 1")).drop("h")
    d = d.withColumn("s", F.sort_array(F.transform("win", lambda x, i: x.bitwiseAND(F.bitwise_not("mask")).bitwiseOR(i.cast("long")))))

    def same(a: Column, b: Column) -> Column:
        place = lambda v: v.bitwiseAND(F.col("mask")).cast("int")
        return ((a.bitwiseXOR(b)).bitwiseAND(F.bitwise_not("mask")) == 0) & (F.get("win", place(a)) == F.get("win", place(b)))

    dup = F.filter("s", lambda x, i: F.coalesce(same(x, F.get("s", i + 1)), F.lit(False)) | F.coalesce(same(x, F.get("s", i - 1)), F.lit(False)))
    d = d.withColumn("dup", dup)
    d = d.withColumn("at", F.sort_array(F.transform("dup", lambda x: x.bitwiseAND(F.col("mask")))))
    steps = F.aggregate(F.transform("at", lambda x, i: F.coalesce(F.least(F.lit(3).cast("long"), F.get("at", i + 1) - x), F.lit(3).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", steps.alias("n_repeat_words"))


def host_verdicts(docs: DataFrame, spread: float = SPREAD, odds: float = ODDS) -> DataFrame:
    """(host, n_docs, n_failed, rate, host_rejected) from documents with host and base_failed; a null host is one host.

    Hosts with equal rates (or one host alone) give a prior without width that rejects none.
    """
    hosts = docs.groupBy("host").agg(F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_failed"))
    n, failed, square = hosts.agg(F.sum("n_docs"), F.sum("n_failed"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs"))).first()  # three numbers
    m = failed / n if n else 0.0
    v = square / n - m * m if n else 0.0
    strength = min(max(m * (1 - m) / v - 1, 0.01), 1e6) if v > 1e-12 else 1e6
    limit = m + spread * (m * (1 - m) / (strength + 1)) ** 0.5
    shrunk = (F.col("n_failed") + F.lit(m * strength)) / (F.col("n_docs") + F.lit(strength))
    stands_out = (F.col("rate") > limit) & (F.col("rate") * (1 - m) > odds * m * (1 - F.col("rate")))
    return hosts.withColumn("rate", shrunk).withColumn("host_rejected", stands_out)


def quality(docs: DataFrame, spread: float = SPREAD, odds: float = ODDS, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """features, base_failed, kept and the host's shrunk rate, one row per row of docs.

    Rows that repeat are judged alike and all count for their host; texts may be of any length; an empty table gives an empty result.
    """
    f = features(docs, id_col, text_col, host_col)
    f = f.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    f = written(f, "quality")  # a few numbers per document, read twice
    verdicts = host_verdicts(f, spread, odds).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"), "host_rejected")
    out = f.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).drop("_host")


def query_quality(spark, sf_dir: str) -> DataFrame:
    q = quality(read(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


SQL = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
n AS (SELECT row_number() OVER () AS r, *, len(w) AS n_words FROM d),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT r, w, unnest(range(1, n_words - 1)) AS i FROM n WHERE n_words > 2)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + j) AS c FROM dup, (VALUES (0), (1), (2)) AS v(j) GROUP BY r),
f AS (SELECT doc_id, host, CAST(n_words AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words FROM n LEFT JOIN cov USING (r)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
hosts AS (SELECT host, count(*) AS nd, count(*) FILTER (base_failed) AS nf FROM g GROUP BY host),
prior AS (SELECT sum(nf) / sum(nd) AS m, sum(nf * nf / nd) / sum(nd) - power(sum(nf) / sum(nd), 2) AS v FROM hosts),
strength AS (SELECT m, CASE WHEN v > 1e-12 THEN least(greatest(m * (1 - m) / v - 1, 0.01), 1e6) ELSE 1e6 END AS s FROM prior),
rates AS (SELECT host, m, m + 2 * sqrt(m * (1 - m) / (s + 1)) AS high, (nf + m * s) / (nd + s) AS rate FROM hosts, strength)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (rate > high AND rate * (1 - m) > 3 * m * (1 - rate)) AS kept, round(rate, 6) AS host_rate
FROM g JOIN rates ON g.host IS NOT DISTINCT FROM rates.host
"""
