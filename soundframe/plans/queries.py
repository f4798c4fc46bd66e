"""Registered queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundframe.functions import music, rules, text
from soundframe.operators import catalog as C
from soundframe.operators import edges as E
from soundframe.operators import maintain as M
from soundframe.operators import signal as S
from soundframe.operators import vectors as X
from soundframe.plans import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, *ctes: str, select: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if select:
            SQL[name] = V.sql(*ctes, select=select) if ctes else select
        return f

    return keep


def six(df, *columns):
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


SAMPLES, TAGS, PACKS = V.SAMPLES, V.TAGS, V.PACKS
ROW = "id, path, sample_type, bpm, key, duration, pack_id, quality_score, applicability_score"
COLS = ROW.split(", ")


@query("search_enriched", SAMPLES, TAGS, PACKS, select="""
SELECT s.id, s.path, s.bpm, s.applicability_score, p.name AS pack_name, (SELECT string_agg(tag, '|' ORDER BY tag) FROM sample_tag t WHERE t.sample_id = s.id) AS tags
FROM samples s LEFT JOIN packs p ON s.pack_id = p.id WHERE bpm BETWEEN 80 AND 180 AND s.path ILIKE '%an%' AND EXISTS (SELECT 1 FROM sample_tag t WHERE t.sample_id = s.id AND tag LIKE 'session:%')
ORDER BY applicability_score DESC NULLS LAST, id LIMIT 100""")
def search_enriched(spark, sf):
    s, t = V.samples(spark, sf), V.sample_tag(spark, sf)
    with_session = t.where(F.col("tag").startswith("session:")).select(F.col("sample_id").alias("id"))
    found = C.search(s, t, query="an", min_bpm=80, max_bpm=180).join(with_session, "id", "left_semi")
    out = C.enrich(C.page(found.select("id", "path", "bpm", "applicability_score", "pack_id")), t, V.packs(spark, sf))
    return out.select("id", "path", "bpm", "applicability_score", "pack_name", F.array_join("tags", "|").alias("tags"))


@query("search_basic", SAMPLES, TAGS, select=f"SELECT {ROW} FROM samples WHERE sample_type = 'kick' AND bpm >= 90 AND applicability_score <= 80")
def search_basic(spark, sf):
    return C.search(V.samples(spark, sf), V.sample_tag(spark, sf), sample_type="kick", min_bpm=90, max_score=80).select(*COLS)


@query("search_text", SAMPLES, select="SELECT id, path FROM samples WHERE path ILIKE '%BRAND#1_/%c_ld%'")
def search_text(spark, sf):
    return C.search(V.samples(spark, sf), V.sample_tag(spark, sf), query="BRAND#1_/%c_ld").select("id", "path")


@query("search_type", SAMPLES, select="SELECT id, sample_type, pack_id FROM samples WHERE sample_type = 'bass' AND pack_id = 12")
def search_type(spark, sf):
    return C.search(V.samples(spark, sf), V.sample_tag(spark, sf), sample_type="bass", pack_id=12).select("id", "sample_type", "pack_id")


@query("search_range", SAMPLES, select="SELECT id, bpm, applicability_score FROM samples WHERE bpm BETWEEN 100 AND 140 AND applicability_score BETWEEN 40 AND 60")
def search_range(spark, sf):
    return C.search(V.samples(spark, sf), V.sample_tag(spark, sf), min_bpm=100, max_bpm=140, min_score=40, max_score=60).select("id", "bpm", "applicability_score")


@query("search_all_tags", TAGS, select="SELECT sample_id AS id FROM sample_tag WHERE tag IN ('session:4', 'stems-done') GROUP BY sample_id HAVING count(DISTINCT tag) = 2")
def search_all_tags(spark, sf):
    return C.search(V.samples(spark, sf), V.sample_tag(spark, sf), tags=["session:4", "stems-done"]).select("id")


@query("search_page", SAMPLES, select="SELECT id, bpm FROM samples ORDER BY bpm ASC NULLS LAST, id LIMIT 50 OFFSET 20")
def search_page(spark, sf):
    return C.page(V.samples(spark, sf), "bpm", "asc", 50, 20).select("id", "bpm")


@query("browse_recent", SAMPLES, select="SELECT id, created_at FROM samples WHERE sample_type = 'snare' AND bpm >= 100 ORDER BY created_at DESC, id LIMIT 40 OFFSET 5")
def browse_recent(spark, sf):
    return C.browse(V.samples(spark, sf), "snare", 100, limit=40, offset=5).select("id", "created_at")


@query("lookup_ids", SAMPLES, select="SELECT id, path FROM samples WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def lookup_ids(spark, sf):
    keys = V.read(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("id"))
    return V.samples(spark, sf).join(keys, "id", "left_semi").select("id", "path")


@query("lookup_paths", SAMPLES, select="SELECT id, path FROM samples WHERE id % 5 = 2")
def lookup_paths(spark, sf):
    s = V.samples(spark, sf)
    return C.lookup(s, s.where("id % 5 = 2").select("path").unionByName(V.files(spark, sf).select("path")), "path").select("id", "path")


@query("enrich_samples", SAMPLES, TAGS, PACKS, select="SELECT s.id, p.name AS pack_name, coalesce((SELECT string_agg(tag, '|' ORDER BY tag) FROM sample_tag t WHERE t.sample_id = s.id), '') AS tags FROM samples s LEFT JOIN packs p ON p.id = s.pack_id")
def enrich_samples(spark, sf):
    return C.enrich(V.samples(spark, sf), V.sample_tag(spark, sf), V.packs(spark, sf)).select("id", "pack_name", F.array_join("tags", "|").alias("tags"))


@query("path_exclude", V.FILES, select="SELECT path FROM files WHERE NOT (regexp_extract(path, '[^/]*$') LIKE '.%' OR starts_with(regexp_extract(path, '[^/]*$'), '1') OR ends_with(regexp_extract(path, '[^/]*$'), '5') OR contains(regexp_extract(path, '[^/]*$'), '77'))")
def path_exclude(spark, sf):
    return V.files(spark, sf).where(~C.excluded(C.basename(F.col("path")), [".*", "1*", "*5", "*77*"])).select("path")


@query("list_directory", V.FILES, SAMPLES, "tree AS (SELECT path FROM samples UNION ALL SELECT '/lib' || path FROM files UNION ALL SELECT '/lib/new_' || page_id || '.wav' FROM files WHERE page_id < 5 UNION ALL SELECT '/lib/Brand#2/blue_rod_4.wav')", select=r"""SELECT DISTINCT split_part(path, '/', 3) AS name, len(string_split(path, '/')) > 3 AS is_directory, CAST(NULL AS BIGINT) AS sample_id FROM tree""")
def list_directory(spark, sf):
    s, f = V.samples(spark, sf), V.files(spark, sf)
    return C.list_directory(_tree(s, f), s, "/lib/")


@query("list_files", SAMPLES, select="SELECT DISTINCT regexp_extract(path, '[^/]*$') AS name, false AS is_directory, id AS sample_id FROM samples WHERE starts_with(path, '/lib/Brand#2/') UNION ALL SELECT 'unknown.wav', false, NULL")
def list_files(spark, sf):
    """The files of one pack's folder, with the ids of those that are known."""
    s = V.samples(spark, sf)
    return C.list_directory(s.select("path").unionByName(s.limit(1).select(F.lit("/lib/Brand#2/unknown.wav").alias("path"))), s, "/lib/Brand#2")


def _tree(s, f):
    loose = f.where("page_id < 5").select(F.concat(F.lit("/lib/new_"), F.col("page_id").cast("string"), F.lit(".wav")).alias("path"))
    return s.select("path").unionByName(f.select(F.concat(F.lit("/lib"), "path").alias("path"))).unionByName(loose)


@query("tree_search", V.FILES, select=r"""SELECT DISTINCT '/' || array_to_string(p[1:n], '/') AS directory FROM (SELECT p, unnest(range(1, len(p))) AS n FROM (SELECT list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM files WHERE contains(lower(regexp_extract(path, '[^/]*$')), '12')))""")
def tree_search(spark, sf):
    return C.tree_search(V.files(spark, sf), "12")


@query("user_tags", TAGS, select="SELECT DISTINCT tag FROM sample_tag WHERE NOT regexp_matches(tag, '^(session:|parent:|stem:|stems-)')")
def user_tags(spark, sf):
    return C.user_tags(V.sample_tag(spark, sf))


@query("list_tags", TAGS, select="SELECT DISTINCT tag FROM sample_tag")
def list_tags(spark, sf):
    return V.sample_tag(spark, sf).select("tag").distinct().orderBy("tag")


@query("list_packs", PACKS, select="SELECT id, name, path FROM packs")
def list_packs(spark, sf):
    return V.packs(spark, sf).orderBy("name")


@query("tag_suggest", TAGS, select="SELECT DISTINCT tag FROM sample_tag WHERE contains(lower(tag), 'st') AND tag <> 'stems-done' ORDER BY tag LIMIT 10")
def tag_suggest(spark, sf):
    return C.suggest_tags(V.sample_tag(spark, sf), "St", ["stems-done"])


@query("preset_apply", SAMPLES, TAGS, select="SELECT id FROM samples WHERE is_loopable AND duration <= 8 AND bpm >= 90 AND id IN (SELECT sample_id FROM sample_tag WHERE tag = 'cold')")
def preset_apply(spark, sf):
    """A saved filter: JSON decoded by Spark (one row), then the same predicates as a search."""
    presets = spark.createDataFrame([("loops", '{"is_loopable": true, "max_duration": 8, "min_bpm": 90, "tags": ["cold"]}')], "name string, filters string")
    return C.apply_preset(V.samples(spark, sf), V.sample_tag(spark, sf), presets, "loops").select("id")


@query("basename_filter", SAMPLES, select="SELECT id, regexp_extract(path, '[^/]*$') AS name FROM samples WHERE contains(regexp_extract(path, '[^/]*$'), 'cold') AND sample_type IN ('kick', 'pad')")
def basename_filter(spark, sf):
    n = C.basename(F.col("path"))
    return V.samples(spark, sf).where(n.contains("cold") & F.col("sample_type").isin("kick", "pad")).select("id", n.alias("name"))


@query("key_in_scale", SAMPLES, select="SELECT id, key FROM samples WHERE regexp_extract(key, '^[A-G][#b]?') IN ('A', 'B', 'C', 'D', 'E', 'F', 'G')")
def key_in_scale(spark, sf):
    return C.in_scale(V.samples(spark, sf), 9, True).select("id", "key")


@query("missing_embeddings", SAMPLES, select="SELECT id, created_at FROM samples WHERE id NOT IN (SELECT vec_id FROM embeddings) ORDER BY created_at DESC, id LIMIT 100")
def missing_embeddings(spark, sf):
    return V.samples(spark, sf).join(V.vectors(spark, sf).select("id"), "id", "left_anti").orderBy(F.desc("created_at"), "id").limit(100).select("id", "created_at")


@query("missing_work", SAMPLES, V.JOBS, select="SELECT id FROM samples WHERE id NOT IN (SELECT vec_id FROM embeddings) AND id NOT IN (SELECT sample_id FROM jobs WHERE job_type = 'embedding' AND status IN ('pending', 'running'))")
def missing_work(spark, sf):
    live = V.jobs(spark, sf).where("job_type = 'embedding' and status in ('pending', 'running')").select(F.col("sample_id").alias("id"))
    return V.samples(spark, sf).join(V.vectors(spark, sf).select("id"), "id", "left_anti").join(live, "id", "left_anti").select("id")


@query("session_list", SAMPLES, TAGS, select="SELECT tag, min(created_at) AS started_at, max(created_at) AS ended_at, count(*) AS clip_count FROM sample_tag JOIN samples ON id = sample_id WHERE tag LIKE 'session:%' GROUP BY tag")
def session_list(spark, sf):
    return C.sessions(V.samples(spark, sf), V.sample_tag(spark, sf))


@query("session_get", SAMPLES, TAGS, select="SELECT id, created_at FROM samples WHERE id IN (SELECT sample_id FROM sample_tag WHERE tag = 'session:8')")
def session_get(spark, sf):
    return C.with_all_tags(V.samples(spark, sf), V.sample_tag(spark, sf), ["session:8"]).select("id", "created_at").orderBy("created_at", "id")


@query("session_timeline", SAMPLES, TAGS, select="SELECT tag, sample_id, round(CASE WHEN hi > lo THEN (t - lo) / CAST(hi - lo AS DOUBLE) * 100 ELSE 50 END, 6) AS percent FROM (SELECT tag, sample_id, epoch_us(created_at) AS t, min(epoch_us(created_at)) OVER w AS lo, max(epoch_us(created_at)) OVER w AS hi FROM sample_tag JOIN samples ON id = sample_id WHERE tag LIKE 'session:%' WINDOW w AS (PARTITION BY tag))")
def session_timeline(spark, sf):
    return six(C.session_timeline(V.samples(spark, sf), V.sample_tag(spark, sf)), "percent")


@query("session_name", SAMPLES, select="SELECT id, 'session at ' || CASE WHEN id % 6 = 5 THEN 'garbage-' || id ELSE strftime(created_at, '%Y-%m-%d %H:%M') END AS name FROM samples")
def session_name(spark, sf):
    """Time stamps in the four known formats, one with a Z, and one that is none."""
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss'Z'"]
    at = F.concat(F.lit("garbage-"), F.col("id").cast("string"))
    for k, f in enumerate(forms):
        at = F.when(F.col("id") % 6 == k, F.date_format("created_at", f)).otherwise(at)
    return V.samples(spark, sf).select("id", C.session_name(at).alias("name"))


@query("project_counts", V.PROJECTS, V.MEMBERS, select="SELECT id, name, (SELECT count(*) FROM project_samples WHERE project_id = p.id) AS clips FROM projects p")
def project_counts(spark, sf):
    n = V.project_samples(spark, sf).groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("clips"))
    return V.projects(spark, sf).join(n, "id", "left").select("id", "name", F.coalesce("clips", F.lit(0)).alias("clips"))


@query("project_members", V.MEMBERS, SAMPLES, select="SELECT sample_id, role, added_at, path FROM project_samples JOIN samples ON id = sample_id WHERE project_id = 2")
def project_members(spark, sf):
    m = V.project_samples(spark, sf).where("project_id = 2")
    return m.join(V.samples(spark, sf).select(F.col("id").alias("sample_id"), "path"), "sample_id").select("sample_id", "role", "added_at", "path").orderBy(F.desc("added_at"), "sample_id")


@query("export_manifest", V.PROJECTS, V.MEMBERS, SAMPLES, select="""SELECT project_id, sample_id, p.name || '_' || coalesce(role, 'sample') || '_' || lpad(CAST(row_number() OVER (PARTITION BY project_id, coalesce(role, 'sample') ORDER BY added_at DESC, sample_id) AS VARCHAR), 3, '0') || '_' || regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]+$', '') || '.wav' AS output_name
FROM project_samples m JOIN samples s ON s.id = m.sample_id JOIN projects p ON p.id = m.project_id""")
def export_manifest(spark, sf):
    return C.export_manifest(V.projects(spark, sf), V.project_samples(spark, sf), V.samples(spark, sf), "{project}_{role}_{index}_{original}")


@query("lineage", TAGS, select="SELECT sample_id AS child_id, CAST(split_part(tag, ':', 2) AS BIGINT) AS parent_id FROM sample_tag WHERE tag LIKE 'parent:%'")
def lineage(spark, sf):
    return C.lineage(V.sample_tag(spark, sf))


@query("inherit_tags", TAGS, "c AS (SELECT sample_id AS child_id, CAST(split_part(tag, ':', 2) AS BIGINT) AS parent_id FROM sample_tag WHERE tag LIKE 'parent:%')", select="""
SELECT child_id, 'parent:' || parent_id AS tag FROM c UNION ALL SELECT child_id, (SELECT min(tag) FROM sample_tag t WHERE t.sample_id = parent_id AND tag LIKE 'session:%') FROM c WHERE EXISTS (SELECT 1 FROM sample_tag t WHERE t.sample_id = parent_id AND tag LIKE 'session:%')""")
def inherit_tags(spark, sf):
    t = V.sample_tag(spark, sf)
    return C.inherit_tags(C.lineage(t), t)


@query("type_counts", SAMPLES, select="SELECT coalesce(sample_type, 'unknown') AS sample_type, count(*) AS n FROM samples GROUP BY samples.sample_type")
def type_counts(spark, sf):
    return V.samples(spark, sf).groupBy("sample_type").agg(F.count("*").alias("n")).select(F.coalesce("sample_type", F.lit("unknown")).alias("sample_type"), "n").orderBy(F.desc("n"))


@query("category_counts", SAMPLES, select="SELECT coalesce(sample_type, 'unknown') AS category, count(*) AS n FROM samples GROUP BY 1")
def category_counts(spark, sf):
    return V.samples(spark, sf).groupBy(F.coalesce("sample_type", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))


@query("duplicate_groups", V.DUPS, select="SELECT id, fingerprint_hash, members FROM (SELECT *, count(*) OVER (PARTITION BY fingerprint_hash) AS members FROM dup_items) WHERE members > 1")
def duplicate_groups(spark, sf):
    return C.duplicate_groups(V.dup_items(spark, sf)).select("id", "fingerprint_hash", "members")


@query("duplicate_savings", V.DUPS, select="SELECT fingerprint_hash, count(*) AS members, min(id) AS first_id, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, CAST(sum(size_bytes) - max(size_bytes) AS BIGINT) AS savings FROM dup_items GROUP BY 1 HAVING count(*) > 1")
def duplicate_savings(spark, sf):
    return C.duplicate_savings(V.dup_items(spark, sf))


@query("duplicate_pages", V.DUPS, select="SELECT fingerprint_hash, CAST((k - 1) // 2 AS BIGINT) AS page, string_agg(path, '|' ORDER BY path) AS paths FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint_hash ORDER BY path) AS k, count(*) OVER (PARTITION BY fingerprint_hash) AS n FROM dup_items) WHERE n > 1 GROUP BY 1, 2")
def duplicate_pages(spark, sf):
    """The members of each duplicate group, two a page."""
    return C.duplicate_pages(V.dup_items(spark, sf), 2).select("fingerprint_hash", "page", F.array_join("paths", "|").alias("paths"))


@query("duplicate_stats", V.DUPS, select="SELECT count(*) AS n_groups, CAST(sum(m - 1) AS BIGINT) AS surplus, CAST(sum(s) AS BIGINT) AS wasted FROM (SELECT count(*) AS m, sum(size_bytes) - max(size_bytes) AS s FROM dup_items GROUP BY fingerprint_hash HAVING count(*) > 1)")
def duplicate_stats(spark, sf):
    return C.duplicate_savings(V.dup_items(spark, sf)).agg(F.count("*").alias("n_groups"), F.sum(F.col("members") - 1).alias("surplus"), F.sum("savings").alias("wasted"))


KEEP = "SELECT fingerprint_hash, id AS keep_id FROM dup_items QUALIFY row_number() OVER (PARTITION BY fingerprint_hash ORDER BY quality_score DESC NULLS LAST, size_bytes DESC, id) = 1 AND count(*) OVER (PARTITION BY fingerprint_hash) > 1"


@query("duplicate_keep", V.DUPS, select=KEEP)
def duplicate_keep(spark, sf):
    return C.keep_best(V.dup_items(spark, sf))


@query("duplicate_resolve", V.DUPS, f"k AS ({KEEP})", select="SELECT id, path FROM dup_items d WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.fingerprint_hash = d.fingerprint_hash AND k.keep_id <> d.id)")
def duplicate_resolve(spark, sf):
    d = V.dup_items(spark, sf)
    gone = C.duplicate_groups(d).join(C.keep_best(d), "fingerprint_hash").where("id <> keep_id").select("id")
    return M.delete(d, gone).select("id", "path")


@query("job_stats", V.JOBS, select="SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'failed') AS failed, count(*) AS total FROM jobs")
def job_stats(spark, sf):
    return V.jobs(spark, sf).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "complete", "failed")], F.count("*").alias("total"))


@query("next_jobs", V.JOBS, select="SELECT id, priority, created_at FROM jobs WHERE status = 'pending' ORDER BY priority DESC, created_at, id LIMIT 20")
def next_jobs(spark, sf):
    return C.next_jobs(V.jobs(spark, sf), 20).select("id", "priority", "created_at")


@query("recent_jobs", V.JOBS, select="SELECT id, status FROM jobs ORDER BY CASE status WHEN 'running' THEN 0 WHEN 'pending' THEN 1 WHEN 'failed' THEN 2 ELSE 3 END, created_at DESC, id LIMIT 50")
def recent_jobs(spark, sf):
    return C.recent_jobs(V.jobs(spark, sf)).select("id", "status")


@query("job_retention", V.JOBS, select="SELECT id, CASE status WHEN 'running' THEN 'pending' ELSE status END AS status FROM jobs WHERE NOT coalesce(status IN ('complete', 'failed') AND completed_at < TIMESTAMP '1996-01-01' - INTERVAL 30 DAY, false)")
def job_retention(spark, sf):
    return M.expire_jobs(V.jobs(spark, sf), F.lit("1996-01-01 00:00:00").cast("timestamp"), 30).select("id", "status")


@query("job_latest", V.JOBS, select="SELECT sample_id, arg_max(status, (created_at, id)) AS status, max(created_at) AS at FROM jobs GROUP BY sample_id")
def job_latest(spark, sf):
    return V.jobs(spark, sf).groupBy("sample_id").agg(F.max_by("status", F.struct("created_at", "id")).alias("status"), F.max("created_at").alias("at"))


@query("pack_rollup", SAMPLES, PACKS, select="SELECT p.id, p.name, count(s.id) AS sample_count, round(avg(quality_score), 4) AS avg_quality_score FROM packs p LEFT JOIN samples s ON s.pack_id = p.id GROUP BY 1, 2")
def pack_rollup(spark, sf):
    g = V.samples(spark, sf).groupBy(F.col("pack_id").alias("id")).agg(F.count("*").alias("sample_count"), F.round(F.avg("quality_score"), 4).alias("avg_quality_score"))
    return V.packs(spark, sf).join(g, "id", "left").select("id", "name", F.coalesce("sample_count", F.lit(0)).alias("sample_count"), "avg_quality_score")


@query("search_stats", SAMPLES, select="SELECT (SELECT count(*) FROM samples) AS clips, (SELECT count(*) FROM embeddings) AS vectors")
def search_stats(spark, sf):
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"))
    both = one(V.samples(spark, sf), "clip").unionByName(one(V.vectors(spark, sf), "vector"))
    return both.agg(F.count_if(F.col("kind") == "clip").alias("clips"), F.count_if(F.col("kind") == "vector").alias("vectors"))


ATTRS = ["spectral_centroid", "rms_db", "crest_factor", "spectral_flatness", "dynamic_range", "duration", "channels", "loop_quality"]


@query("coverage_stats", SAMPLES, select=f"SELECT round(avg(CASE WHEN {' + '.join(f'({a} IS NOT NULL)::INT' for a in ATTRS)} >= 4 THEN 1.0 ELSE 0 END), 6) AS covered, round(avg(CASE WHEN key IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS keyed FROM samples")
def coverage_stats(spark, sf):
    full = rules.coverage([F.col(a) for a in ATTRS]) >= 4
    return V.samples(spark, sf).agg(F.round(F.avg(F.when(full, 1.0).otherwise(0.0)), 6).alias("covered"), F.round(F.avg(F.when(music.semitone(F.col("key")).isNotNull(), 1.0).otherwise(0.0)), 6).alias("keyed"))


@query("applicability", SAMPLES, select="SELECT id, quality_score AS quality, round(round(lo, 9), 1) AS loop_score, round(round(sp, 9), 1) AS spectral, round(round(us, 9), 1) AS usability, applicability_score AS total FROM samples")
def applicability(spark, sf):
    return V.samples(spark, sf).select("id", *[v.alias(k) for k, v in rules.applicability().items()])


@query("quality_simple", SAMPLES, select="SELECT id, greatest(0, least(100, dynamic_range / 20 * 100) - CASE WHEN clipping_detected THEN 20 ELSE 0 END) AS q FROM samples")
def quality_simple(spark, sf):
    return V.samples(spark, sf).select("id", rules.simple_quality(F.col("dynamic_range"), F.col("clipping_detected")).alias("q"))


@query("score_band", SAMPLES, select="SELECT CASE WHEN applicability_score >= 70 THEN 'high' WHEN applicability_score >= 40 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM samples GROUP BY 1")
def score_band(spark, sf):
    return V.samples(spark, sf).groupBy(rules.score_band(F.col("applicability_score")).alias("band")).agg(F.count("*").alias("n"))


@query("acoustic_tags", SAMPLES, select="""SELECT id, concat_ws(',', CASE WHEN spectral_centroid > 4000 THEN 'bright' WHEN spectral_centroid < 1500 THEN 'dark' WHEN spectral_centroid IS NOT NULL THEN 'neutral' END,
CASE WHEN spectral_centroid < 200 THEN 'sub' WHEN spectral_centroid < 500 THEN 'low' WHEN spectral_centroid < 2000 THEN 'mid' WHEN spectral_centroid < 6000 THEN 'high' WHEN spectral_centroid IS NOT NULL THEN 'air' END,
CASE WHEN crest_factor > 12 THEN 'punchy' WHEN crest_factor < 6 THEN 'sustained' WHEN crest_factor IS NOT NULL THEN 'balanced' END, CASE WHEN spectral_flatness > 0.5 THEN 'noisy' WHEN spectral_flatness < 0.1 THEN 'tonal' WHEN spectral_flatness IS NOT NULL THEN 'mixed' END,
CASE WHEN duration < 0.5 THEN 'short' WHEN duration > 4 THEN 'long' ELSE 'medium' END, CASE WHEN is_loopable THEN 'loopable' END) AS tags FROM samples""")
def acoustic_tags(spark, sf):
    return V.samples(spark, sf).select("id", F.array_join(rules.acoustic_tags(), ",").alias("tags"))


@query("suggest_type", SAMPLES, select="""SELECT id, CASE WHEN spectral_centroid IS NULL OR crest_factor IS NULL THEN NULL WHEN duration < 0.5 AND crest_factor > 10 THEN CASE WHEN spectral_centroid < 300 THEN 'kick' WHEN spectral_centroid > 5000 THEN 'hihat' WHEN spectral_centroid > 2000 THEN 'snare' ELSE 'perc' END
WHEN duration > 1 AND crest_factor < 8 AND coalesce(spectral_flatness, 0.5) < 0.2 THEN CASE WHEN spectral_centroid > 2000 THEN 'lead' ELSE 'pad' END WHEN spectral_centroid < 500 AND duration > 0.3 THEN 'bass'
WHEN spectral_flatness > 0.7 THEN 'fx' WHEN duration < 0.3 THEN 'oneshot' WHEN is_loopable THEN 'loop' END AS suggested FROM samples""")
def suggest_type(spark, sf):
    return V.samples(spark, sf).select("id", rules.suggest_type().alias("suggested"))


@query("drum_type", SAMPLES, select="""SELECT id, CASE WHEN spectral_centroid IS NULL OR crest_factor IS NULL OR duration > 1 THEN NULL WHEN spectral_centroid < 300 AND crest_factor > 8 THEN 'kick' WHEN spectral_centroid > 5000 AND spectral_flatness > 0.3 THEN CASE WHEN duration < 0.2 THEN 'hihat' ELSE 'cymbal' END
WHEN spectral_centroid > 1000 AND spectral_centroid < 5000 AND spectral_flatness > 0.2 AND spectral_flatness < 0.6 THEN 'snare' WHEN spectral_centroid > 2000 AND spectral_centroid < 6000 AND spectral_flatness > 0.4 AND crest_factor < 10 THEN 'clap'
WHEN spectral_centroid > 200 AND spectral_centroid < 1000 AND spectral_flatness < 0.3 AND crest_factor > 6 THEN 'tom' WHEN spectral_centroid > 3000 AND duration < 0.1 AND crest_factor > 12 THEN 'rim' ELSE 'perc' END AS drum FROM samples""")
def drum_type(spark, sf):
    return V.samples(spark, sf).select("id", rules.drum_type().alias("drum"))


def _c01(e):
    return f"round(CASE WHEN ({e}) IS NOT NULL THEN least(1, greatest(0, {e})) END, 6)"


_crest = "(CASE WHEN crest_factor IS NOT NULL THEN least(1, greatest(0, (crest_factor - 3) / 17)) END)"
PERC = f"""SELECT id, {_c01('(ln(spectral_centroid) - ln(100)) / (ln(8000) - ln(100))')} AS brightness, {_c01('(rms_db + 60) / 60')} AS energy, round({_crest}, 6) AS percussiveness, {_c01('1 - spectral_flatness')} AS tonality, {_c01('dynamic_range / 40')} AS complexity,
round({_crest} * 0.6 + least(1, greatest(0, 1 - duration / 2)) * 0.4, 6) AS attack, CASE WHEN channels >= 2 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS width, coalesce({_c01('loop_quality')}, CASE WHEN is_loopable THEN 0.7::DOUBLE WHEN NOT is_loopable THEN 0.3::DOUBLE END) AS regularity FROM samples"""


@query("perceptual", SAMPLES, select=PERC)
def perceptual(spark, sf):
    return V.samples(spark, sf).select("id", *[F.round(v, 6).alias(k) for k, v in rules.perceptual().items()])


@query("coverage", SAMPLES, select=f"SELECT id, CAST({' + '.join(f'({a} IS NOT NULL)::INT' for a in ATTRS)} AS INT) AS n FROM samples")
def coverage(spark, sf):
    return V.samples(spark, sf).select("id", rules.coverage([F.col(a) for a in ATTRS]).alias("n"))


@query("attr_sort", SAMPLES, select="SELECT id, round(CASE WHEN crest_factor IS NULL THEN -1 ELSE least(1, greatest(0, (crest_factor - 3) / 17)) END, 6) AS v FROM samples ORDER BY v DESC, id")
def attr_sort(spark, sf):
    v = F.round(F.coalesce(rules.perceptual()["percussiveness"], F.lit(-1.0)), 6)
    return V.samples(spark, sf).select("id", v.alias("v")).orderBy(F.desc("v"), "id")


@query("key_normalize", SAMPLES, select="SELECT id, regexp_replace(key, 'm$', '') || CASE WHEN ends_with(key, 'm') THEN 'm' ELSE '' END AS k FROM samples")
def key_normalize(spark, sf):
    spelled = F.when(F.col("key").endswith("m"), F.concat(F.lower(F.substring("key", 1, 1)), F.regexp_replace(F.substring("key", 2, 9), "m$", " minor"))).otherwise(F.col("key"))
    return V.samples(spark, sf).select("id", music.normalize_key(spelled).alias("k"))


_F, _R = music.FIFTHS, music.RELATIVE
REL = f"CASE WHEN list_position({_F}, key) > 0 THEN {_R}[list_position({_F}, key)] WHEN list_position({_R}, key) > 0 THEN {_F}[list_position({_R}, key)] END"


@query("key_relation", SAMPLES, select=f"SELECT DISTINCT key, {REL} AS relative, CASE WHEN list_position({_R}, key) > 0 THEN {_F}[list_position({_R}, key)] ELSE key END AS root_major FROM samples WHERE key IS NOT NULL")
def key_relation(spark, sf):
    k = F.col("key")
    return V.samples(spark, sf).where("key is not null").select("key", music.relative_key(k).alias("relative"), music.root_major(k).alias("root_major")).distinct()


SEMI = "list_position(['C', 'C#', 'D', 'Eb', 'E', 'F', 'F#', 'G', 'Ab', 'A', 'Bb', 'B', 'Cx', 'Db', 'x', 'D#', 'x', 'x', 'Gb', 'x', 'G#', 'x', 'A#'], regexp_extract(key, '^[A-G][#b]?')) - 1"


@query("key_hue", SAMPLES, select=f"SELECT id, CAST(30 * (({SEMI}) % 12) AS INT) AS hue FROM samples WHERE key IS NOT NULL")
def key_hue(spark, sf):
    return V.samples(spark, sf).where("key is not null").select("id", (30 * music.semitone(F.col("key"))).cast("int").alias("hue"))


COMPAT = f"""pairs AS (SELECT a.id AS a_id, b.id,
CASE WHEN a.key IS NULL OR b.key IS NULL THEN 0.5 WHEN a.key = b.key THEN 1.0 WHEN ar = b.key THEN 0.95 WHEN am = 0 OR bm = 0 THEN 0.3 WHEN least(abs(am - bm), 12 - abs(am - bm)) <= 1 THEN 0.85 WHEN least(abs(am - bm), 12 - abs(am - bm)) <= 2 THEN 0.7 ELSE 0.3 END::DOUBLE AS key_score,
CASE WHEN a.bpm IS NULL OR b.bpm IS NULL THEN 0.5 WHEN abs(a.bpm - b.bpm) / a.bpm <= 0.05 THEN 1.0 WHEN len(list_filter([0.5, 2.0, 0.25, 4.0, 0.75, 1.5], lambda r: abs(a.bpm - b.bpm * r) / a.bpm <= 0.05)) > 0 THEN 0.9 ELSE 0.2 END::DOUBLE AS bpm_score,
CASE WHEN a.spectral_centroid IS NULL OR b.spectral_centroid IS NULL THEN 0.5 ELSE 1 - 0.7 * greatest(0, least(a.spectral_centroid + a.spectral_bandwidth / 2, b.spectral_centroid + b.spectral_bandwidth / 2) - greatest(a.spectral_centroid - a.spectral_bandwidth / 2, b.spectral_centroid - b.spectral_bandwidth / 2)) / (greatest(a.spectral_centroid + a.spectral_bandwidth / 2, b.spectral_centroid + b.spectral_bandwidth / 2) - least(a.spectral_centroid - a.spectral_bandwidth / 2, b.spectral_centroid - b.spectral_bandwidth / 2)) END::DOUBLE AS frequency_score,
CASE WHEN a.crest_factor IS NULL OR b.crest_factor IS NULL THEN 0.5 WHEN abs(a.crest_factor - b.crest_factor) > 6 THEN 0.9 WHEN abs(a.crest_factor - b.crest_factor) < 3 AND (a.crest_factor + b.crest_factor) / 2 > 12 THEN 0.5 ELSE 0.7 END::DOUBLE AS dynamics_score
FROM (SELECT *, {REL} AS ar, coalesce(list_position({_F}, key), 0) + coalesce(list_position({_R}, key), 0) AS am FROM samples) a, (SELECT *, coalesce(list_position({_F}, key), 0) + coalesce(list_position({_R}, key), 0) AS bm FROM samples) b WHERE a.id <> b.id AND {{where}})"""


@query("compatible_to", SAMPLES, COMPAT.replace("{where}", "a.id % 50 = 0"), select="SELECT a_id, id, round((key_score + bpm_score + frequency_score + dynamics_score) / 4, 6) AS score FROM pairs QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY round((key_score + bpm_score + frequency_score + dynamics_score) / 4, 9) DESC, id) <= 10")
def compatible_to(spark, sf):
    s = V.samples(spark, sf)
    return E.top_edges(s, 10, source=s.where("id % 50 = 0")).select("a_id", "id", F.round("score", 6).alias("score"))


@query("compatible_pack", SAMPLES, COMPAT.replace("{where}", "a.id % 50 = 1"), select="SELECT a_id, id, round((key_score + bpm_score + frequency_score + dynamics_score) / 4, 6) AS score FROM pairs QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY round((key_score + bpm_score + frequency_score + dynamics_score) / 4, 9) DESC, id) <= 5")
def compatible_pack(spark, sf):
    """What fits into a pack with each of some clips: all parts of the score."""
    s = V.samples(spark, sf)
    return E.top_edges(s, 5, parts=C.PURPOSES["pack"], source=s.where("id % 50 = 1")).select("a_id", "id", F.round("score", 6).alias("score"))


@query("compat_pairs", SAMPLES, COMPAT.replace("{where}", "a.id < b.id"), select="SELECT a_id, id, round((key_score + bpm_score + frequency_score + dynamics_score) / 4, 6) AS score FROM pairs WHERE (key_score + bpm_score + frequency_score + dynamics_score) / 4 >= 0.6")
def compat_pairs(spark, sf):
    millionths = F.floor(F.col("score") * 1e6 + 0.5)  # as SQL rounds; F.round goes by decimal digits, which differs halfway between two
    return E.edges_above(V.samples(spark, sf), 0.6).select("a_id", "id", (millionths / 1e6).alias("score"))


@query("compat_edges", SAMPLES, COMPAT.replace("{where}", "true"), select="SELECT a_id, id, round((key_score + bpm_score + frequency_score + dynamics_score) / 4, 6) AS score, CAST(row_number() OVER (PARTITION BY a_id ORDER BY round((key_score + bpm_score + frequency_score + dynamics_score) / 4, 9) DESC, id) AS INT) AS rank FROM pairs WHERE (key_score + bpm_score + frequency_score + dynamics_score) / 4 >= 0.3 QUALIFY rank <= 5")
def compat_edges(spark, sf):
    """The five best partners of every clip of the library."""
    return E.top_edges(V.samples(spark, sf), 5).select("a_id", "id", F.round("score", 6).alias("score"), "rank")


@query("stem_from_seed", SAMPLES, select=f"SELECT id, {text.ADJECTIVES}[('0x' || substr(md5(path), 1, 2))::INT % 12 + 1] || '-' || {text.NOUNS}[('0x' || substr(md5(path), 3, 2))::INT % 12 + 1] AS stem FROM samples")
def stem_from_seed(spark, sf):
    return V.samples(spark, sf).select("id", text.stem_from_seed(F.col("path")).alias("stem"))


@query("transcript_stem", select=f"""SELECT conv_id, turn, nullif(array_to_string(list_filter(list_transform(string_split_regex(lower(text), '\\s+'), lambda w: regexp_replace(w, '[^a-z]', '', 'g')), lambda w: length(w) >= 3 AND NOT list_contains({text.STOP_WORDS}, w))[1:3], '-'), '') AS stem FROM conversations""")
def transcript_stem(spark, sf):
    return V.read(spark, sf, "conversations").select("conv_id", "turn", text.transcript_stem(F.col("text")).alias("stem"))


@query("sanitize_name", V.FILES, select="SELECT path, CASE WHEN trim(regexp_replace(path, '[^A-Za-z0-9_-]+', '-', 'g'), '-') = '' THEN 'recording' ELSE trim(regexp_replace(path, '[^A-Za-z0-9_-]+', '-', 'g'), '-') END AS name FROM files")
def sanitize_name(spark, sf):
    return V.files(spark, sf).select("path", text.sanitize_name(F.col("path")).alias("name"))


@query("detect_pack", SAMPLES, select="SELECT id, split_part(path, '/', 3) AS pack, split_part(path, '/', 3) AS parent FROM samples")
def detect_pack(spark, sf):
    return V.samples(spark, sf).select("id", text.detect_pack(F.col("path"), "/lib").alias("pack"), text.parent_directory(F.col("path")).alias("parent"))


@query("unit_convert", SAMPLES, select="SELECT id, round(2595 * log10(1 + spectral_centroid / 700), 6) AS mel, CAST(((round(69 + 12 * log2(spectral_centroid / 440)) % 12) + 12) % 12 AS INT) AS pitch_class FROM samples")
def unit_convert(spark, sf):
    c = F.col("spectral_centroid")
    return V.samples(spark, sf).select("id", F.round(text.hz_to_mel(c), 6).alias("mel"), text.pitch_class(c).alias("pitch_class"))


@query("heuristic_tag", SAMPLES, "f AS (SELECT id, power(10, rms_db / 20) AS rms, spectral_centroid AS c, spectral_flatness / 3 AS z, duration AS d, bpm AS t FROM samples)", select="""
SELECT id, CASE WHEN d < 0.6 THEN CASE WHEN c > 5000 OR z > 0.25 THEN 'hat' WHEN c < 700 THEN 'kick' ELSE 'perc' END WHEN d > 2.5 AND t > 60 THEN 'loop' WHEN c < 500 THEN 'bass' WHEN c > 3500 AND rms < 0.1 THEN 'texture' WHEN d > 1.5 AND c < 2000 THEN 'pad' END AS tag,
d >= 0.5 AND rms >= 0.005 AND c BETWEEN 300 AND 4500 AND z BETWEEN 0.03 AND 0.25 AS speech FROM f""")
def heuristic_tag(spark, sf):
    a = (F.pow(F.lit(10.0), F.col("rms_db") / 20), F.col("spectral_centroid"), F.col("spectral_flatness") / 3, F.col("duration"))
    return V.samples(spark, sf).select("id", rules.heuristic_tag(*a, F.col("bpm")).alias("tag"), rules.speech_like(*a).alias("speech"))


@query("ingest_new", V.FILES, "n AS (SELECT path, min(length) AS length FROM files GROUP BY path)", select="SELECT path, length, (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY path) AS id FROM n")
def ingest_new(spark, sf):
    f = V.files(spark, sf).groupBy("path").agg(F.min("length").alias("length"))
    return M.ingest(V.samples(spark, sf).select("id", "path"), f).select("path", "length", "id")


@query("merge_analysis", SAMPLES, select="SELECT id, coalesce(CASE WHEN id % 2 = 0 AND id % 3 <> 0 THEN 111.0::DOUBLE END, bpm) AS bpm, key FROM samples")
def merge_analysis(spark, sf):
    s = V.samples(spark, sf).select("id", "bpm", "key")
    new = s.where("id % 2 = 0").select("id", F.when(F.col("id") % 3 != 0, 111.0).alias("bpm"))
    return M.merge(s, new, "id")


@query("batch_update", SAMPLES, select="SELECT id, CASE WHEN id IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) THEN 'edited' ELSE sample_type END AS sample_type FROM samples")
def batch_update(spark, sf):
    ids = V.read(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("id"))
    return M.batch_update(V.samples(spark, sf).select("id", "sample_type"), ids, sample_type="edited")


@query("batch_delete", TAGS, select="SELECT sample_id, tag FROM sample_tag WHERE sample_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def batch_delete(spark, sf):
    ids = V.read(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("id")).distinct()
    return M.delete(V.sample_tag(spark, sf), ids, "sample_id").select("sample_id", "tag")


@query("add_tags", TAGS, select="SELECT sample_id, tag FROM sample_tag UNION SELECT sample_id, unnest(['new', 'stems-done']) FROM sample_tag WHERE tag LIKE 'session:%'")
def add_tags(spark, sf):
    t = V.sample_tag(spark, sf)
    return M.add_tags(t, t.where(F.col("tag").startswith("session:")).select(F.col("sample_id").alias("id")), ["new", "stems-done"])


@query("remove_tags", TAGS, select="SELECT sample_id, tag FROM sample_tag WHERE NOT (tag = 'stems-done' AND sample_id IN (SELECT sample_id FROM sample_tag WHERE tag = 'session:16'))")
def remove_tags(spark, sf):
    t = V.sample_tag(spark, sf)
    return M.remove_tags(t, t.where("tag = 'session:16'").select(F.col("sample_id").alias("id")), ["stems-done"])


@query("stems_pending", SAMPLES, TAGS, select="SELECT id FROM samples WHERE (duration IS NULL OR duration >= 5) AND id NOT IN (SELECT sample_id FROM sample_tag WHERE tag = 'stems-done')")
def stems_pending(spark, sf):
    return M.stems_pending(V.samples(spark, sf), V.sample_tag(spark, sf)).select("id")


@query("cosine", select="SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark, sf):
    v = V.vectors(spark, sf)
    nxt = v.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    return v.join(nxt, "id").select("id", F.round(X.cosine(F.col("v"), F.col("w")), 6).alias("similarity"))


@query("euclidean", select="SELECT a.vec_id AS id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def euclidean(spark, sf):
    v = V.vectors(spark, sf)
    nxt = v.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    return v.join(nxt, "id").select("id", F.round(X.euclidean(F.col("v"), F.col("w")), 6).alias("distance"))


@query("knn_exact", select="SELECT query_id, id, round(s, 6) AS similarity FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 10")
def knn_exact(spark, sf):
    v = V.vectors(spark, sf)
    return X.knn(v.where("id % 50 = 0"), v, 10).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query("knn_weighted", select="""WITH w AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x, i: x * CASE WHEN i <= 34 THEN 2.0 WHEN i <= 40 THEN 1.0 WHEN i <= 50 THEN 0.5 ELSE 1.0 END::DOUBLE) AS v FROM embeddings)
SELECT query_id, id, round(s, 6) AS similarity, round(1 - s, 6) AS distance FROM (SELECT a.id AS query_id, b.id, list_cosine_similarity(a.v, b.v) AS s FROM w a, w b WHERE a.id % 50 = 0 AND a.id <> b.id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 5""")
def knn_weighted(spark, sf):
    v = V.vectors(spark, sf)
    w = lambda c: X.weight_vector(c, V.SEGMENTS, {"timbre": 2.0, "amplitude": 0.5})
    return six(X.knn(v.where("id % 50 = 0"), v, 5, weights=w), "similarity", "distance").select("query_id", "id", "similarity", "distance")


@query("find_similar", select="""WITH w AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, list_transform(embedding::DOUBLE[], lambda x, i: x * CASE WHEN i <= 34 THEN 2.0 WHEN i <= 40 THEN 1.0 WHEN i <= 50 THEN 0.5 ELSE 1.0 END::DOUBLE) AS q FROM embeddings)
SELECT query_id, id, round(s, 6) AS similarity FROM (SELECT a.id AS query_id, b.id, list_cosine_similarity(a.q, b.v) AS s FROM w a, w b WHERE a.id % 50 = 0 AND a.id <> b.id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 7""")
def find_similar(spark, sf):
    v = V.vectors(spark, sf)
    w = lambda c: X.weight_vector(c, V.SEGMENTS, {"timbre": 2.0, "amplitude": 0.5})
    return six(X.find_similar(v, v.where("id % 50 = 0").select("id"), 7, w), "similarity").select("query_id", "id", "similarity")


@query("label_tags", select="""WITH e AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(range(1, 65)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL), l AS (SELECT label, list(x ORDER BY pos) AS v FROM e GROUP BY label),
t AS (SELECT vec_id AS id, l.label, list_cosine_similarity(embedding::DOUBLE[], v) AS c, row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, l.label) AS r FROM embeddings, l)
SELECT id, max(label) FILTER (r = 1) AS label, round(max(c) FILTER (r = 1), 6) AS confidence, coalesce(string_agg(label::VARCHAR, ',' ORDER BY r) FILTER (r <= 3 AND c >= 0.2), '') AS tags FROM t GROUP BY id HAVING max(c) FILTER (r = 1) >= 0.3""")
def label_tags(spark, sf):
    v = V.vectors(spark, sf)
    mean = v.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))
    labels = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("v"))
    return X.label_tags(v, labels).select("id", "label", F.round("confidence", 6).alias("confidence"), F.array_join(F.transform("tags", lambda t: t.cast("string")), ",").alias("tags"))


@query("knn_lsh")
def knn_lsh(spark, sf):
    v = V.vectors(spark, sf)
    return X.knn_lsh(v.where("id % 50 = 0"), v, 10, 64).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query("knn_cells")
def knn_cells(spark, sf):
    v = V.vectors(spark, sf)
    return X.knn_cells(v.where("id % 50 = 0"), v, 10).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query("knn_cells_recall", select="SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def knn_cells_recall(spark, sf):
    """Whether the search by cells finds nine in ten of the exact neighbours of the query set."""
    exact, found = QUERIES["knn_exact"](spark, sf), QUERIES["knn_cells"](spark, sf).withColumn("hit", F.lit(1))
    j = exact.join(found.select("query_id", "id", "hit"), ["query_id", "id"], "left")
    return j.agg(F.count_distinct("query_id").alias("queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("enough"))


@query("aspect_weight", select="""WITH w AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x, i: x * CASE WHEN i <= 34 THEN 2.0 WHEN i <= 40 THEN 1.0 WHEN i <= 50 THEN 0.5 WHEN i <= 61 THEN 1.0 ELSE 1.0 END::DOUBLE) AS v FROM embeddings)
SELECT id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS head, round(v[45] / sqrt(list_inner_product(v, v)), 6) AS middle FROM w""")
def aspect_weight(spark, sf):
    w = X.weight_vector(F.col("v"), V.SEGMENTS, {"timbre": 2.0, "amplitude": 0.5})
    return V.vectors(spark, sf).select("id", w.alias("w")).select("id", F.round(F.col("w")[0], 6).alias("head"), F.round(F.col("w")[44], 6).alias("middle"))


@query("label_vectors", select="""WITH e AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(range(1, 65)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL), l AS (SELECT label, list(x ORDER BY pos) AS v FROM e GROUP BY label)
SELECT vec_id AS id, l.label, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS confidence FROM embeddings, l QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, l.label) <= 3""")
def label_vectors(spark, sf):
    v = V.vectors(spark, sf)
    mean = v.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))
    labels = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("v"))
    return X.label_by_vectors(v, labels).select("id", "label", F.round("confidence", 6).alias("confidence"))


SIG = V.SIGNAL
FR = "fr AS (SELECT clip_id, n // 32 + d AS frame, n - 32 * (n // 32 + d) + 32 AS t, x FROM signal, (VALUES (0), (1)) AS v(d))"
PW = f"""pw AS (SELECT clip_id, frame, k, power(sum(x * (0.5 - 0.5 * cos(2 * pi() * t / 63)) * cos(2 * pi() * k * t / 64)), 2) + power(sum(x * (0.5 - 0.5 * cos(2 * pi() * t / 63)) * sin(2 * pi() * k * t / 64)), 2) AS p FROM fr, (SELECT unnest(range(0, 33)) AS k) GROUP BY ALL)"""
LV = "lv AS (SELECT clip_id, frame, sqrt(sum(x * x) / 64) AS rms FROM fr GROUP BY ALL)"


def _blocks(spark, sf):
    return S.blocks(V.signal(spark, sf))


#: The view's blocks have SIZE samples at RATE Hz; frames are as long as a block, so that the SQL can do the transform.
SIZE, RATE, N_FFT, HOP = 64, 640.0, 64, 32


def _frames(spark, sf):
    return S.frames(_blocks(spark, sf), N_FFT, HOP, SIZE)


def _power(spark, sf):
    return S.power(_frames(spark, sf))


def _analysed(spark, sf, columns, rise=False):
    return S.analysed(_blocks(spark, sf), columns, N_FFT, HOP, SIZE, rise=rise)


def _env(spark, sf):
    return S.onset_envelope(_analysed(spark, sf, {}, True))


@query("power_spectrum", SIG, FR, PW, select="SELECT clip_id, CAST(k AS INT) AS bin, round(avg(p), 6) AS power FROM pw GROUP BY ALL")
def power_spectrum(spark, sf):
    return _power(spark, sf).select("clip_id", F.posexplode("power").alias("bin", "p")).groupBy("clip_id", "bin").agg(F.round(F.avg("p"), 6).alias("power"))


SPEC = """f AS (SELECT clip_id, frame, sum(p) AS t, sum(p * k * 10) / nullif(sum(p), 0) AS c, exp(avg(ln(greatest(p, 1e-10)))) / avg(greatest(p, 1e-10)) AS fl FROM pw GROUP BY ALL),
m AS (SELECT clip_id, avg(coalesce(c, 0)) AS centroid, avg(least(1, fl)) AS flatness FROM f GROUP BY ALL), b AS (SELECT clip_id, frame, coalesce(sqrt(sum(p * power(k * 10 - centroid, 2)) / nullif(sum(p), 0)), 0) AS b FROM pw JOIN m USING (clip_id) GROUP BY ALL)"""


@query("spectral", SIG, FR, PW, SPEC, select="SELECT clip_id, round(centroid, 4) AS centroid, round(flatness, 4) AS flatness, (SELECT round(avg(b), 4) FROM b WHERE b.clip_id = m.clip_id) AS bandwidth FROM m")
def spectral(spark, sf):
    s = S.spectral(_analysed(spark, sf, S.tones(RATE / N_FFT)))
    return s.select("clip_id", *[F.round(c, 4).alias(c) for c in ("centroid", "flatness", "bandwidth")])


@query("rolloff", SIG, FR, PW, select="SELECT clip_id, round(avg(r), 6) AS rolloff FROM (SELECT clip_id, frame, CASE WHEN max(t) > 0 THEN min(k) FILTER (s >= 0.85 * t) * 10 ELSE 0 END AS r FROM (SELECT *, sum(p) OVER (PARTITION BY clip_id, frame ORDER BY k) AS s, sum(p) OVER (PARTITION BY clip_id, frame) AS t FROM pw) GROUP BY ALL) GROUP BY ALL")
def rolloff(spark, sf):
    return S.spectral(_analysed(spark, sf, S.tones(RATE / N_FFT))).select("clip_id", F.round("rolloff", 6).alias("rolloff"))


@query("zcr", SIG, select="SELECT clip_id, round(avg(CASE WHEN (x >= 0) <> (prev >= 0) THEN 1.0 ELSE 0 END), 6) AS zcr FROM (SELECT clip_id, x, lag(x) OVER (PARTITION BY clip_id ORDER BY n) AS prev FROM signal) WHERE prev IS NOT NULL GROUP BY clip_id")
def zcr(spark, sf):
    return six(S.zero_crossing_rate(_blocks(spark, sf)), "zcr")


@query("quality", SIG, "m AS (SELECT clip_id, avg(x) AS mean FROM signal GROUP BY ALL)", select="""SELECT clip_id, round(mean, 6) AS dc_offset, round(20 * log10(sqrt(avg(power(x - mean, 2)))), 6) AS rms_db, round(20 * log10(max(abs(x - mean))), 6) AS peak_db,
round(20 * log10(max(abs(x - mean))) - 20 * log10(sqrt(avg(power(x - mean, 2)))), 6) AS crest_factor, round(avg(CASE WHEN abs(x) >= 0.99 THEN 1.0 ELSE 0 END), 6) AS clip_ratio, avg(CASE WHEN abs(x) >= 0.99 THEN 1.0 ELSE 0 END) > 0.0001 AS clipping_detected FROM signal JOIN m USING (clip_id) GROUP BY clip_id, mean""")
def quality(spark, sf):
    return six(S.quality(_blocks(spark, sf)), "dc_offset", "rms_db", "peak_db", "crest_factor", "clip_ratio")


@query("dynamic_range", SIG, FR, LV, "r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY rms) AS i, count(*) OVER (PARTITION BY clip_id) AS n FROM lv WHERE rms > 0)", select="SELECT clip_id, round(20 * log10(max(rms) FILTER (i = least(floor(n * 0.9::DOUBLE) + 1, n)) / max(rms) FILTER (i = least(floor(n * 0.1::DOUBLE) + 1, n))), 6) AS dynamic_range FROM r GROUP BY clip_id")
def dynamic_range(spark, sf):
    return six(S.dynamic_range(_analysed(spark, sf, S.LEVEL)), "dynamic_range")


ENV = """fx AS (SELECT clip_id, frame, sum(greatest(0, coalesce(p - q, 0))) AS flux FROM (SELECT *, lag(p) OVER (PARTITION BY clip_id, k ORDER BY frame) AS q FROM pw) GROUP BY ALL), env AS (SELECT clip_id, frame, flux / max(flux) OVER (PARTITION BY clip_id) AS env FROM fx)"""


@query("onset_env", SIG, FR, PW, ENV, select="SELECT clip_id, frame, round(env, 6) AS env FROM env")
def onset_env(spark, sf):
    return six(_env(spark, sf), "env")


@query("onsets", SIG, FR, PW, ENV, select="SELECT clip_id, frame FROM (SELECT *, lag(env) OVER w AS p, lead(env) OVER w AS q FROM env WINDOW w AS (PARTITION BY clip_id ORDER BY frame)) WHERE env > 0.1 AND env > p AND env >= q")
def onsets(spark, sf):
    return S.onsets(_env(spark, sf))


@query("tempo", SIG, FR, PW, ENV, "e0 AS (SELECT clip_id, sum(env * env) AS s0 FROM env GROUP BY ALL)", select="SELECT a.clip_id, CAST(b.frame - a.frame AS INT) AS lag, round(sum(a.env * b.env) / max(s0), 6) AS r FROM env a JOIN env b ON a.clip_id = b.clip_id AND b.frame - a.frame BETWEEN 6 AND 20 JOIN e0 ON e0.clip_id = a.clip_id GROUP BY 1, 2")
def tempo(spark, sf):
    return six(S.tempo_lags(_env(spark, sf), 6, 20), "r")


@query("waveform", SIG, "l AS (SELECT clip_id, count(*) AS len FROM signal GROUP BY ALL)", select="SELECT b.clip_id, CAST(b.bar AS INT) AS bar, round(coalesce(max(abs(x)), 0), 6) AS peak FROM (SELECT clip_id, len, unnest(range(0, 50)) AS bar FROM l) b LEFT JOIN signal s ON s.clip_id = b.clip_id AND CAST(floor(s.n / ceil(len / 50)) AS INT) = bar GROUP BY ALL")
def waveform(spark, sf):
    return six(S.waveform(_blocks(spark, sf), 50, SIZE), "peak")


@query("channel_levels", SIG, select="SELECT clip_id, CAST(n % 2 AS INT) AS channel, round(greatest(-96, 20 * log10(sqrt(avg(x * x)))), 6) AS rms_db, round(greatest(-96, 20 * log10(max(abs(x)))), 6) AS peak_db FROM signal GROUP BY ALL")
def channel_levels(spark, sf):
    return six(S.channel_levels(_blocks(spark, sf), 2, SIZE), "rms_db", "peak_db")


FLAT = FR.replace("fr AS", "ff AS").replace("n // 32 + d AS frame, n - 32 * (n // 32 + d) + 32 AS t", "n // 32 - d AS frame, n - 32 * (n // 32 - d) AS t")
CUTS = """ln AS (SELECT clip_id, count(*) AS len FROM signal GROUP BY ALL), q AS (SELECT clip_id, frame, sqrt(sum(x * x) / 64) < power(10, -0.9::DOUBLE) AS quiet FROM ff JOIN ln USING (clip_id) WHERE frame >= 0 AND 32 * frame + 64 <= len GROUP BY clip_id, frame),
i AS (SELECT *, sum((quiet IS DISTINCT FROM p)::INT) OVER (PARTITION BY clip_id ORDER BY frame) AS isl FROM (SELECT *, lag(quiet) OVER (PARTITION BY clip_id ORDER BY frame) AS p FROM q)), r AS (SELECT clip_id, isl, quiet, min(frame) AS a, max(frame) + 1 AS b FROM i GROUP BY ALL),
k AS (SELECT *, 32 * a AS s, 32 * b AS e FROM r SEMI JOIN (SELECT clip_id, isl - 1 AS isl FROM r WHERE NOT quiet) n USING (clip_id, isl) WHERE quiet AND b - a >= 2),
t AS (SELECT clip_id, coalesce(lag(e) OVER (PARTITION BY clip_id ORDER BY s), 0) AS start, s AS "end" FROM k UNION ALL SELECT ln.clip_id, coalesce(max(e), 0), max(len) FROM ln LEFT JOIN k ON k.clip_id = ln.clip_id GROUP BY ln.clip_id),
u AS (SELECT * FROM t WHERE "end" > start AND "end" - start >= 200), v AS (SELECT * FROM u UNION ALL SELECT clip_id, 0, len FROM ln WHERE len >= 200 AND clip_id NOT IN (SELECT clip_id FROM u))"""


@query("silence_segments", SIG, FLAT, CUTS, select='SELECT clip_id, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY start) - 1 AS INT) AS part, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM v')
def silence_segments(spark, sf):
    b = _blocks(spark, sf)
    return S.silence_segments(S.analysed(b, S.LEVEL, N_FFT, HOP, SIZE, False), S.lengths(b), HOP, -18.0, 2, 200)


@query("takes", V.LEVELS, """q AS (SELECT *, peak_db > -21.0 AS loud FROM levels), i AS (SELECT *, sum(CASE WHEN loud IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY ts, event_id) AS isl FROM (SELECT *, lag(loud) OVER (PARTITION BY device_id ORDER BY ts, event_id) AS p FROM q)),
r AS (SELECT device_id, isl, loud, min(ts) AS a, max(ts) AS b, count(*) AS n FROM i GROUP BY ALL), s AS (SELECT *, sum((NOT loud AND epoch_us(b) - epoch_us(a) >= 86400000000)::INT) OVER (PARTITION BY device_id ORDER BY isl) AS take FROM r)""", select="SELECT device_id, CAST(take AS BIGINT) AS take, min(a) AS started_at, max(b) AS ended_at, CAST(sum(n) AS BIGINT) AS loud_readings FROM s WHERE loud GROUP BY device_id, take")
def takes(spark, sf):
    return S.takes(V.levels(spark, sf), -21.0, 86400)


@query("level_smoothing", V.LEVELS, select="SELECT device_id, round(list_reduce(list_prepend(-96.0::DOUBLE, list(peak_db ORDER BY ts, event_id)), lambda a, x: a + (x - a) * CASE WHEN x > a THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END), 6) AS smoothed_db, count(*) AS readings FROM levels GROUP BY device_id")
def level_smoothing(spark, sf):
    return six(S.smooth(V.levels(spark, sf)), "smoothed_db")


@query("level_series", V.LEVELS, "h AS (SELECT *, list(peak_db) OVER w AS p, list(peak_db - 3 - event_id % 7) OVER w AS r FROM levels WINDOW w AS (PARTITION BY device_id ORDER BY ts, event_id))", select="SELECT device_id, ts, event_id, round(list_reduce(list_prepend(-96.0::DOUBLE, p), lambda a, x: a + (x - a) * CASE WHEN x > a THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END), 6) AS smoothed_peak_db, round(list_reduce(list_prepend(-96.0::DOUBLE, r), lambda a, x: a + (x - a) * CASE WHEN x > a THEN 0.4::DOUBLE ELSE 0.15::DOUBLE END), 6) AS smoothed_rms_db FROM h")
def level_series(spark, sf):
    """Peak and level of each reading as a meter shows them (the view has no level: it is made from the peak)."""
    l = V.levels(spark, sf).withColumn("rms_db", F.col("peak_db") - 3 - F.col("event_id") % 7)
    return six(S.smoothed(l, {"peak_db": (0.5, 0.1), "rms_db": (0.4, 0.15)}), "smoothed_peak_db", "smoothed_rms_db")


@query("chunk_peaks", V.LEVELS, select="SELECT device_id, time_bucket(INTERVAL 1 DAY, ts) AS chunk_start, round(max(peak_db), 6) AS peak_db, count(*) AS readings FROM levels GROUP BY ALL")
def chunk_peaks(spark, sf):
    w = V.levels(spark, sf).groupBy("device_id", F.window("ts", "1 day").alias("w")).agg(F.round(F.max("peak_db"), 6).alias("peak_db"), F.count("*").alias("readings"))
    return w.select("device_id", F.col("w.start").alias("chunk_start"), "peak_db", "readings")


@query("debounce", V.LEVELS, select="SELECT device_id, ts, event_id FROM (SELECT *, lag(ts) OVER (PARTITION BY device_id ORDER BY ts, event_id) AS p FROM levels) WHERE p IS NULL OR ts - p >= INTERVAL 6 HOUR")
def debounce(spark, sf):
    return C.first_of_bursts(V.levels(spark, sf), "device_id", 6 * 3600).select("device_id", "ts", "event_id")
