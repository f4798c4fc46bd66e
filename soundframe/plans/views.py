"""The library's tables derived from the driver's parquet tables, as DataFrames and, for the oracle, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundframe.functions import rules

#: The key names that clips carry.
KEYS = ["C", "C#", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B"]
KEYS = KEYS + [k + "m" for k in KEYS]
TYPES = ["kick", "snare", "hihat", "bass", "synth", "pad"]
SEGMENTS = [(0, 34, "timbre"), (34, 40, "spectrum"), (40, 50, "amplitude"), (50, 61, "pitch"), (61, 64, "spectrum")]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    unless = lambda n, v: F.when(k % n != 0, v)
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    p = read(spark, sf, "part")
    s = p.select(
        k.alias("id"), F.concat(F.lit("/lib/"), "p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), k.cast("string"), F.lit(".wav")).alias("path"),
        F.when(k % 4 == 0, "recorded").otherwise("imported").alias("source_type"), unless(9, pick(TYPES, k % 6)).alias("sample_type"),
        unless(5, (60 + (7 * k) % 140).cast("double")).alias("bpm"), unless(7, pick(KEYS, k % 24)).alias("key"), (F.col("p_size") / 5.0).alias("duration"),
        pick([44100, 22050, 8000], k % 3).alias("sample_rate"), (1 + k % 2).cast("int").alias("channels"), (-(k % 50)).cast("double").alias("rms_db"),
        unless(11, (3 + k % 18).cast("double")).alias("crest_factor"), (k % 25).cast("double").alias("dynamic_range"), (k % 10 == 0).alias("clipping_detected"),
        unless(13, (100 + (37 * k) % 8000).cast("double")).alias("spectral_centroid"), unless(13, (k % 100) / 100.0).alias("spectral_flatness"),
        unless(3, (k % 101) / 100.0).alias("loop_quality"), unless(6, k % 2 == 0).alias("is_loopable"), F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long").alias("pack_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=k.cast("int"))).alias("created_at"),
    )
    s = s.withColumns({"peak_db": F.col("rms_db") + F.col("crest_factor"), "spectral_bandwidth": F.col("spectral_centroid") / 2, "spectral_rolloff": F.col("spectral_centroid") * 1.8})
    a = rules.applicability()
    return s.withColumns({"quality_score": a["quality"], "applicability_score": a["total"]})


def packs(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_brand").distinct().select(F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long").alias("id"), F.col("p_brand").alias("name"), F.concat(F.lit("/lib/"), "p_brand").alias("path"))


def sample_tag(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    s = k.cast("string")
    tags = F.array_union(
        F.array_union(F.split("p_name", " "), F.array(F.lower("p_type"))),
        F.array_compact(F.array(F.when(k % 4 == 0, F.concat(F.lit("session:"), (k % 20).cast("string"))), F.when(k % 8 == 1, F.concat(F.lit("parent:"), (k - 1).cast("string"))), F.when(k % 16 == 1, F.concat(F.lit("stem:r"), (k % 4).cast("string"))), F.when(k % 16 == 0, F.lit("stems-done")))),
    )
    return read(spark, sf, "part").select(k.alias("sample_id"), F.explode(F.array_distinct(tags)).alias("tag"))


def projects(spark: SparkSession, sf: str) -> DataFrame:
    r = read(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    return r.unionByName(r.agg((F.max("id") + 1).alias("id")).withColumn("name", F.lit("EMPTY")))


def project_samples(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    p = read(spark, sf, "part").where(k % 3 == 0)
    role = F.when(k % 5 != 0, F.element_at(F.array(*map(F.lit, ["lead", "drums", "bass"])), (k % 3 + k % 2 + 1).cast("int")))
    return p.select((k % 5).alias("project_id"), k.alias("sample_id"), role.alias("role"), (F.lit("2024-02-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=((k * 7) % 1000).cast("int"))).alias("added_at"))


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    o, k = read(spark, sf, "orders"), F.col("o_orderkey")
    status = F.when((F.col("o_orderstatus") == "F") & (k % 10 == 0), "failed").when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
    at = F.col("o_orderdate").cast("timestamp")
    return o.select(k.alias("id"), (k % 2000 + 1).alias("sample_id"), F.element_at(F.array(*map(F.lit, ["analysis", "embedding", "fingerprint", "waveform"])), (k % 4 + 1).cast("int")).alias("job_type"), (5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), status.alias("status"), at.alias("created_at"), F.when(F.col("o_orderstatus") == "F", at + F.make_dt_interval(mins=F.lit(5))).alias("completed_at"))


def dup_items(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("/docs/"), F.col("doc_id").cast("string")).alias("path"), F.md5(F.col("text").cast("binary")).alias("fingerprint_hash"), F.col("n_chars").alias("size_bytes"))
    q = read(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("quality_score"))
    return d.join(q, "id", "left")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def levels(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    x = F.col("value") / 400
    db = F.when(x > 0, F.greatest(F.lit(-96.0), 20 * F.log10(F.when(x > 0, x)))).otherwise(-96.0)
    return e.select("event_id", F.col("user_id").alias("device_id"), F.col("ts").cast("timestamp").alias("ts"), F.lit(0).alias("channel"), db.alias("peak_db"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    return read(spark, sf, "pages").select("page_id", F.concat(F.lit("/"), path).alias("path"), F.length("html").cast("long").alias("length"))


def signal(spark: SparkSession, sf: str) -> DataFrame:
    """(clip_id, vec_id, pos, x): each label's vectors one after the other; blocks of 64 samples, the parallel unit."""
    return read(spark, sf, "embeddings").select(F.col("label").alias("clip_id"), "vec_id", F.col("embedding").cast("array<double>").alias("pcm"))


_k = "p_partkey"
SAMPLES = f"""
base AS (SELECT {_k} AS id, '/lib/' || p_brand || '/' || replace(p_name, ' ', '_') || '_' || {_k} || '.wav' AS path,
 CASE WHEN {_k} % 4 = 0 THEN 'recorded' ELSE 'imported' END AS source_type,
 CASE WHEN {_k} % 9 <> 0 THEN {TYPES}[{_k} % 6 + 1] END AS sample_type, CASE WHEN {_k} % 5 <> 0 THEN CAST(60 + (7 * {_k}) % 140 AS DOUBLE) END AS bpm,
 CASE WHEN {_k} % 7 <> 0 THEN {KEYS}[{_k} % 24 + 1] END AS key, p_size / 5.0::DOUBLE AS duration, [44100, 22050, 8000][{_k} % 3 + 1] AS sample_rate, CAST(1 + {_k} % 2 AS INT) AS channels,
 CAST(-({_k} % 50) AS DOUBLE) AS rms_db, CASE WHEN {_k} % 11 <> 0 THEN CAST(3 + {_k} % 18 AS DOUBLE) END AS crest_factor, CAST({_k} % 25 AS DOUBLE) AS dynamic_range, {_k} % 10 = 0 AS clipping_detected,
 CASE WHEN {_k} % 13 <> 0 THEN CAST(100 + (37 * {_k}) % 8000 AS DOUBLE) END AS spectral_centroid, CASE WHEN {_k} % 13 <> 0 THEN ({_k} % 100) / 100.0::DOUBLE END AS spectral_flatness,
 CASE WHEN {_k} % 3 <> 0 THEN ({_k} % 101) / 100.0::DOUBLE END AS loop_quality, CASE WHEN {_k} % 6 <> 0 THEN {_k} % 2 = 0 END AS is_loopable,
 CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS pack_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST({_k} AS INT)) AS created_at FROM part),
parts AS (SELECT *, rms_db + crest_factor AS peak_db, spectral_centroid / 2 AS spectral_bandwidth, spectral_centroid * 1.8::DOUBLE AS spectral_rolloff,
 CASE WHEN abs(rms_db + 18) <= 6 THEN 100.0 ELSE greatest(100 - (abs(rms_db + 18) - 6) * 5, 0) END AS q1,
 CASE WHEN crest_factor BETWEEN 6 AND 12 THEN 100.0 WHEN crest_factor < 6 THEN greatest(100 - (6 - crest_factor) * 10, 0) ELSE greatest(100 - (crest_factor - 12) * 5, 0) END AS q2,
 CASE WHEN clipping_detected THEN 0.0 ELSE 100.0 END AS q3, CASE WHEN dynamic_range >= 12 THEN 100.0 WHEN dynamic_range >= 6 THEN 50 + (dynamic_range - 6) / 6 * 50 ELSE dynamic_range / 6 * 50 END AS q4,
 CASE WHEN loop_quality IS NOT NULL THEN least(greatest(loop_quality, 0), 100) WHEN is_loopable THEN 75.0 WHEN NOT is_loopable THEN 25.0 ELSE 50.0 END AS lo,
 CASE WHEN abs(spectral_centroid - 3000) <= 2000 THEN 100 - abs(spectral_centroid - 3000) / 2000 * 30 ELSE greatest(70 - (abs(spectral_centroid - 3000) - 2000) / 1000 * 20, 0) END AS s1,
 CASE WHEN spectral_flatness < 0.3 THEN 60 + spectral_flatness / 0.3 * 40 WHEN spectral_flatness <= 0.6 THEN 100.0 ELSE greatest(100 - (spectral_flatness - 0.6) * 100, 50) END AS s2,
 CASE WHEN duration < 0.1 THEN duration / 0.1 * 50 WHEN duration <= 30 THEN 100.0 ELSE greatest(100 - (duration - 30) / 60 * 50, 20) END AS u1,
 CASE WHEN sample_rate >= 44100 THEN 100.0 WHEN sample_rate >= 22050 THEN 70.0 ELSE 30.0 END AS u2 FROM base),
scored AS (SELECT *, CAST(CASE WHEN crest_factor IS NULL THEN (0.4 * q1 + 0.2 * q3 + 0.1 * q4) / 0.7 ELSE 0.4 * q1 + 0.3 * q2 + 0.2 * q3 + 0.1 * q4 END AS DOUBLE) AS q, CAST(CASE WHEN spectral_centroid IS NULL THEN 50 ELSE 0.7 * s1 + 0.3 * s2 END AS DOUBLE) AS sp, CAST(0.6 * u1 + 0.4 * u2 AS DOUBLE) AS us FROM parts),
samples AS (SELECT *, round(round(q, 9), 1) AS quality_score, round(round(0.35 * q + 0.25 * lo + 0.20 * sp + 0.20 * us, 9), 1) AS applicability_score FROM scored)"""
PACKS = "packs AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS id, p_brand AS name, '/lib/' || p_brand AS path FROM part)"
TAGS = f"""sample_tag AS (SELECT DISTINCT sample_id, tag FROM (SELECT {_k} AS sample_id, unnest(string_split(p_name, ' ')) AS tag FROM part UNION ALL SELECT {_k}, lower(p_type) FROM part
 UNION ALL SELECT {_k}, 'session:' || ({_k} % 20) FROM part WHERE {_k} % 4 = 0 UNION ALL SELECT {_k}, 'parent:' || ({_k} - 1) FROM part WHERE {_k} % 8 = 1
 UNION ALL SELECT {_k}, 'stem:r' || ({_k} % 4) FROM part WHERE {_k} % 16 = 1 UNION ALL SELECT {_k}, 'stems-done' FROM part WHERE {_k} % 16 = 0))"""
PROJECTS = "projects AS (SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region UNION ALL SELECT max(r_regionkey) + 1, 'EMPTY' FROM region)"
MEMBERS = f"project_samples AS (SELECT {_k} % 5 AS project_id, {_k} AS sample_id, CASE WHEN {_k} % 5 <> 0 THEN ['lead', 'drums', 'bass'][{_k} % 3 + {_k} % 2 + 1] END AS role, TIMESTAMP '2024-02-01 00:00:00' + to_minutes(CAST(({_k} * 7) % 1000 AS INT)) AS added_at FROM part WHERE {_k} % 3 = 0)"
JOBS = """jobs AS (SELECT o_orderkey AS id, o_orderkey % 2000 + 1 AS sample_id, ['analysis', 'embedding', 'fingerprint', 'waveform'][o_orderkey % 4 + 1] AS job_type, 5 - CAST(o_orderpriority[1] AS INT) AS priority,
 CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 = 0 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'running' END AS status,
 CAST(o_orderdate AS TIMESTAMP) AS created_at, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS TIMESTAMP) + to_minutes(5) END AS completed_at FROM orders)"""
DUPS = "dup_items AS (SELECT d.doc_id AS id, '/docs/' || d.doc_id AS path, md5(text) AS fingerprint_hash, n_chars AS size_bytes, CAST(quality AS DOUBLE) AS quality_score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
LEVELS = "levels AS (SELECT event_id, user_id AS device_id, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN value > 0 THEN greatest(-96.0, 20 * log10(value / 400)) ELSE -96.0 END AS peak_db FROM events)"
FILES = r"files AS (SELECT page_id, '/' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, length(html) AS length FROM pages)"
SIGNAL = "signal AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY vec_id, pos) - 1 AS n, x FROM (SELECT label AS clip_id, vec_id, unnest(range(0, 64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings))"


def sql(*views: str, select: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + select
