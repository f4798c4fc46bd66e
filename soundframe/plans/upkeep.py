"""Registered queries on catalogue upkeep, naming and layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundframe.functions import music, rules, text
from soundframe.operators import catalog as C
from soundframe.operators import edges as E
from soundframe.operators import maintain as M
from soundframe.operators import naming as N
from soundframe.plans import views as V
from soundframe.plans.queries import ATTRS, query, six
from soundframe.plans.signals import FNV_OF

SAMPLES, TAGS, PACKS = V.SAMPLES, V.TAGS, V.PACKS
def _now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")

HEAVY = "SELECT l_partkey AS id FROM lineitem WHERE l_quantity >= 49"


def _ids(spark, sf):
    return V.read(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("id")).distinct()


for _field in C.SORTABLE:
    _column = "created_at" if _field == "updated_at" else _field

    @query(f"sort_{_field}", SAMPLES, select=f"SELECT id, row_number() OVER (ORDER BY {_column} DESC NULLS LAST, id) AS place FROM samples QUALIFY place <= 30")
    def sort_field(spark, sf, field=_field):
        """The first thirty clips by each column that may be sorted by, with their places."""
        s = V.samples(spark, sf).withColumn("updated_at", F.col("created_at"))
        p = C.page(s, field, "desc", 30)
        w = C.Window.orderBy(F.desc_nulls_last(field), "id")
        return p.withColumn("place", F.row_number().over(w)).select("id", "place")  # thirty rows


@query("search_total", SAMPLES, select="SELECT id, (SELECT count(*) FROM samples WHERE sample_type = 'kick' AND bpm >= 90) AS total FROM samples WHERE sample_type = 'kick' AND bpm >= 90 ORDER BY duration NULLS LAST, id LIMIT 10")
def search_total(spark, sf):
    rows, total = C.search_page(V.samples(spark, sf), V.sample_tag(spark, sf), "duration", "asc", 10, sample_type="kick", min_bpm=90)
    return rows.select("id", F.lit(total).cast("long").alias("total"))


@query("import_summary", SAMPLES, V.FILES, "i AS (SELECT path, CASE WHEN length % 5 = 0 THEN 'bad' END AS error FROM files UNION ALL SELECT path, NULL FROM samples WHERE id % 3 = 0), g AS (SELECT path, count(*) AS n, max(error) AS error, path IN (SELECT path FROM samples) AS known FROM i GROUP BY path)", select="SELECT count(*) FILTER (NOT known AND error IS NULL) AS imported, CAST(sum(CASE WHEN known THEN n ELSE n - 1 END) AS BIGINT) AS skipped, count(*) FILTER (NOT known AND error IS NOT NULL) AS failed FROM g")
def import_summary(spark, sf):
    s = V.samples(spark, sf)
    files = V.files(spark, sf).select("path", F.when(F.col("length") % 5 == 0, "bad").alias("error")).unionByName(s.where("id % 3 = 0").select("path", F.lit(None).cast("string").alias("error")))
    return C.import_summary(files, s)


@query("duplicate_details", V.DUPS, select="SELECT fingerprint_hash, count(*) AS members, CAST(sum(size_bytes) - max(size_bytes) AS BIGINT) AS savings, string_agg(path, '|' ORDER BY path) AS paths FROM dup_items GROUP BY 1 HAVING count(*) > 1")
def duplicate_details(spark, sf):
    return C.duplicate_details(V.dup_items(spark, sf)).select("fingerprint_hash", "members", "savings", F.array_join("paths", "|").alias("paths"))


@query("failed_jobs", V.JOBS, select="SELECT id, created_at FROM jobs WHERE status = 'failed' ORDER BY created_at DESC, id LIMIT 25")
def failed_jobs(spark, sf):
    return C.recent_jobs(V.jobs(spark, sf), 25, "failed").select("id", "created_at")


@query("types_to_tags", SAMPLES, TAGS, select="SELECT sample_id, tag FROM sample_tag UNION SELECT id, lower(sample_type) FROM samples WHERE sample_type IS NOT NULL")
def types_to_tags(spark, sf):
    return M.types_to_tags(V.samples(spark, sf), V.sample_tag(spark, sf))


@query("typed_clips", SAMPLES, select="SELECT count(*) AS typed FROM samples WHERE sample_type IS NOT NULL")
def typed_clips(spark, sf):
    return M.typed_clips(V.samples(spark, sf))


@query("frame_units", SAMPLES, select="SELECT id, round(id * 512 / 22050, 6) AS seconds, CAST(floor(duration * 22050 / 512) AS BIGINT) AS frame, round(CASE WHEN id % 50 > 0 THEN 60 * 22050.0::DOUBLE / 512 / (id % 50) ELSE 0 END, 6) AS bpm FROM samples")
def frame_units(spark, sf):
    k = F.col("id")
    return V.samples(spark, sf).select("id", F.round(text.frame_seconds(k, 22050.0, 512), 6).alias("seconds"), text.seconds_frame(F.col("duration"), 22050.0, 512).alias("frame"), F.round(text.lag_bpm((k % 50).cast("int"), 22050.0, 512), 6).alias("bpm"))


@query("tag_union", SAMPLES, select="SELECT id, array_to_string(list_sort(list_distinct(list_filter(['recorded', sample_type, CASE WHEN id % 2 = 0 THEN 'even' END, CASE WHEN id % 4 = 0 THEN 'session:' || (id % 20) END], lambda x: x IS NOT NULL))), ',') AS tags FROM samples")
def tag_union(spark, sf):
    k = F.col("id")
    s = V.samples(spark, sf).select("id", F.array_compact(F.array("sample_type")).alias("a"), F.when(k % 2 == 0, F.array(F.lit("even"), F.lit("recorded"))).alias("b"), F.when(k % 4 == 0, F.concat(F.lit("session:"), (k % 20).cast("string"))).alias("c"))
    return M.tag_union(s, "a", "b", "c").select("id", F.array_join("tags", ",").alias("tags"))


@query("delete_cascade", SAMPLES, TAGS, V.JOBS, V.MEMBERS, f"gone AS ({HEAVY})", select="""SELECT 'samples' AS kind, count(*) AS n, CAST(coalesce(sum(CASE WHEN (id - id % 7) NOT IN (SELECT id FROM gone) THEN id - id % 7 END), 0) AS BIGINT) AS links FROM samples WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'sample_tag', count(*), 0 FROM sample_tag WHERE sample_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'jobs', count(*), 0 FROM jobs WHERE sample_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'project_samples', count(*), 0 FROM project_samples WHERE sample_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'embeddings', count(*), 0 FROM embeddings WHERE vec_id NOT IN (SELECT id FROM gone)""")
def delete_cascade(spark, sf):
    """How many rows of each table are left; samples point to a clip near them, and links adds up what still points somewhere."""
    k = F.col("id")
    s = V.samples(spark, sf).withColumn("duplicate_of_id", k - k % 7)
    t = {"samples": s, "sample_tag": V.sample_tag(spark, sf), "jobs": V.jobs(spark, sf), "project_samples": V.project_samples(spark, sf), "embeddings": V.vectors(spark, sf).select(F.col("id").alias("sample_id"))}
    out = M.delete_clips(t, _ids(spark, sf))
    rows = [df.agg(F.lit(n).alias("kind"), F.count("*").alias("n"), F.coalesce(F.sum("duplicate_of_id"), F.lit(0).cast("long")).alias("links") if n == "samples" else F.lit(0).cast("long").alias("links")) for n, df in out.items()]
    return C.reduce(lambda a, b: a.unionByName(b), rows)


@query("merge_stamped", SAMPLES, select="SELECT id, CASE WHEN id % 2 = 0 THEN CASE WHEN id % 3 <> 0 THEN 111.0::DOUBLE END ELSE bpm END AS bpm, CASE WHEN id % 2 = 0 THEN TIMESTAMP '2024-06-01' END AS analyzed_at FROM samples")
def merge_stamped(spark, sf):
    """Overwriting merge (NULLs win) that stamps the rows it touches."""
    s = V.samples(spark, sf).select("id", "bpm", F.lit(None).cast("timestamp").alias("analyzed_at"))
    return M.merge(s, s.where("id % 2 = 0").select("id", F.when(F.col("id") % 3 != 0, 111.0).alias("bpm")), "id", False, _now())


@query("upsert_packs", PACKS, V.FILES, "n AS (SELECT DISTINCT split_part(path, '/', 2) AS name FROM files EXCEPT SELECT name FROM packs)", select="SELECT id, name FROM packs UNION ALL SELECT (SELECT max(id) FROM packs) + row_number() OVER (ORDER BY name), name FROM n")
def upsert_packs(spark, sf):
    new = V.files(spark, sf).select(F.split("path", "/")[1].alias("name")).unionByName(V.packs(spark, sf).select("name"))
    return M.upsert_names(V.packs(spark, sf), new)


@query("embed_upsert", select="SELECT vec_id AS id, CAST(CASE WHEN vec_id % 4 = 0 THEN 3 ELSE 2 END AS INT) AS version, label + CASE WHEN vec_id % 4 = 0 THEN 100 ELSE 0 END AS label FROM embeddings")
def embed_upsert(spark, sf):
    v = V.vectors(spark, sf).select("id", F.lit(2).alias("version"), "label")
    newer = v.where("id % 4 = 0").select("id", F.lit(3).alias("version"), (F.col("label") + 100).alias("label"))
    return M.upsert_latest(v, newer.unionByName(v.where("id % 8 = 0").withColumn("version", F.lit(1))), "id", "version")


@query("project_merge", V.MEMBERS, select="SELECT project_id, sample_id, CASE WHEN sample_id % 6 = 0 THEN 'solo' ELSE role END AS role, CASE WHEN sample_id % 2 = 0 THEN 'note ' || sample_id END AS notes FROM project_samples WHERE sample_id % 9 <> 0 UNION ALL SELECT project_id, sample_id, 'new', NULL FROM project_samples WHERE sample_id % 9 = 0")
def project_merge(spark, sf):
    """Members replaced (every ninth clip) and others updated where the change has a value."""
    m = V.project_samples(spark, sf).withColumn("notes", F.lit(None).cast("string"))
    new = m.where("sample_id % 9 = 0").withColumn("role", F.lit("new"))
    k = F.col("sample_id")
    change = m.where("sample_id % 9 <> 0").select("project_id", "sample_id", F.when(k % 2 == 0, F.concat(F.lit("note "), k.cast("string"))).alias("notes"), F.when(k % 6 == 0, "solo").alias("role"))
    return M.update_members(M.put_members(m, new), change).select("project_id", "sample_id", "role", "notes")


@query("project_bump", V.PROJECTS, V.MEMBERS, select="SELECT id, CASE WHEN id IN (SELECT project_id FROM project_samples WHERE sample_id % 5 IN (1, 2)) THEN TIMESTAMP '2024-06-01' ELSE TIMESTAMP '2020-01-01' END AS updated_at FROM projects")
def project_bump(spark, sf):
    p = V.projects(spark, sf).withColumn("updated_at", F.lit("2020-01-01").cast("timestamp"))
    return M.bump(p, V.project_samples(spark, sf).where("sample_id % 5 in (1, 2)"), _now()).select("id", "updated_at")


PRESETS = "ps AS (SELECT id, name, 'f' || id AS filters, id % 3 = 0 AS is_system, id AS sort_order FROM (SELECT DISTINCT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS id, p_brand AS name FROM part)), ch AS (SELECT name, CASE WHEN id % 2 = 0 THEN 'new' END AS filters, CASE WHEN id % 5 < 3 THEN 100 + id END AS sort_order FROM ps UNION ALL SELECT n_name, 'n', CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END FROM nation)"


@query("preset_merge", PRESETS, select="SELECT id, name, CASE WHEN is_system THEN ps.filters ELSE coalesce(ch.filters, ps.filters) END AS filters, is_system, CASE WHEN is_system THEN ps.sort_order ELSE coalesce(ch.sort_order, ps.sort_order) END AS sort_order FROM ps JOIN ch USING (name) WHERE is_system OR id % 4 <> 1 UNION ALL SELECT (SELECT max(id) FROM ps) + row_number() OVER (ORDER BY name), name, filters, false, coalesce(sort_order, 0) FROM ch WHERE name NOT IN (SELECT name FROM ps)")
def preset_merge(spark, sf):
    """Presets named after the brands (every third is the system's) are renewed, one per nation is made, and some are removed."""
    k = F.col("id")
    p = V.packs(spark, sf).select("id", "name", F.concat(F.lit("f"), k.cast("string")).alias("filters"), (k % 3 == 0).alias("is_system"), k.alias("sort_order"))
    n = V.read(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit("n").alias("filters"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("long")).alias("sort_order"))
    changes = p.select("name", F.when(k % 2 == 0, "new").alias("filters"), F.when(k % 5 < 3, 100 + k).alias("sort_order")).unionByName(n)
    gone = p.where("id % 4 = 1").select("id")
    return M.remove_presets(M.merge_presets(p, changes), gone)


@query("job_enqueue", SAMPLES, V.JOBS, "n AS (SELECT id FROM samples WHERE id NOT IN (SELECT sample_id FROM jobs WHERE job_type = 'embedding' AND status IN ('pending', 'running')))", select="SELECT (SELECT max(id) FROM jobs) + row_number() OVER (ORDER BY id) AS id, id AS sample_id, 'pending' AS status, TIMESTAMP '2024-06-01' AS created_at FROM n")
def job_enqueue(spark, sf):
    j = M.enqueue(V.jobs(spark, sf), V.samples(spark, sf), "embedding", 3, _now())
    return j.where(F.col("created_at") == _now()).select("id", "sample_id", "status", "created_at")


@query("job_finish", V.JOBS, select="SELECT id, CASE WHEN id % 10 = 0 THEN 'failed' WHEN id % 5 = 0 THEN 'complete' ELSE status END AS status, CASE WHEN id % 5 = 0 THEN TIMESTAMP '2024-06-01' ELSE completed_at END AS completed_at FROM jobs")
def job_finish(spark, sf):
    j = V.jobs(spark, sf)
    done = j.where("id % 5 = 0").select("id", F.when(F.col("id") % 10 == 0, "broken").alias("error"))
    return M.finish_jobs(j, done, _now()).select("id", "status", "completed_at")


STEMS = "st AS (SELECT id AS parent_id, role, '/stems/' || id || '_' || role || '.wav' AS path FROM samples, (VALUES ('bass'), ('drums')) AS r(role) WHERE id % 10 = 1)"


@query("stems_register", SAMPLES, TAGS, STEMS, "n AS (SELECT *, (SELECT max(id) FROM samples) + row_number() OVER (ORDER BY path) AS id FROM st)", select="SELECT sample_id, tag FROM sample_tag UNION SELECT id, 'parent:' || parent_id FROM n UNION SELECT id, 'stem:' || role FROM n UNION SELECT parent_id, 'stems-done' FROM st")
def stems_register(spark, sf):
    s = V.samples(spark, sf)
    stems = s.where("id % 10 = 1").select(F.col("id").alias("parent_id"), F.explode(F.array(F.lit("bass"), F.lit("drums"))).alias("role"))
    stems = stems.withColumn("path", F.concat(F.lit("/stems/"), F.col("parent_id").cast("string"), F.lit("_"), "role", F.lit(".wav")))
    return M.register_stems(s.select("id", "path", "pack_id", "source_type"), V.sample_tag(spark, sf), stems)[1]


@query("save_recordings", SAMPLES, "n AS (SELECT '/rec/' || id || '.wav' AS path, duration, id AS o, (SELECT max(id) FROM samples) + row_number() OVER (ORDER BY '/rec/' || id || '.wav') AS id FROM samples WHERE id % 8 = 0)", select="SELECT id AS sample_id, 'analysis' AS job_type FROM n UNION ALL SELECT id, 'stems' FROM n WHERE o % 16 = 0 AND duration >= 5")
def save_recordings(spark, sf):
    """Jobs that saving recordings queues: an analysis each, stems where the session asks for them and the clip is long enough."""
    s = V.samples(spark, sf)
    rec = s.where("id % 8 = 0").select(F.concat(F.lit("/rec/"), F.col("id").cast("string"), F.lit(".wav")).alias("path"), "duration", F.array(F.lit("a")).alias("tags"), F.array("sample_type").alias("model_tags"), F.lit("session:1").alias("session_tag"), F.when(F.col("id") % 16 == 0, True).alias("stems"))
    none = V.jobs(spark, sf).where("false")
    return M.save_recordings(s.select("id", "path", "pack_id", "source_type", "duration"), V.sample_tag(spark, sf), none, rec, 99, _now())[2].select("sample_id", "job_type")


@query("orphan_ingest", SAMPLES, TAGS, V.FILES, "n AS (SELECT DISTINCT path FROM files WHERE length % 2 = 0), i AS (SELECT path, (SELECT max(id) FROM samples) + row_number() OVER (ORDER BY path) AS id FROM n)", select="SELECT sample_id, tag FROM sample_tag UNION ALL SELECT id, 'recorded' FROM i")
def orphan_ingest(spark, sf):
    f = V.files(spark, sf).where("length % 2 = 0").select("path", F.lit("valid").alias("status")).unionByName(V.files(spark, sf).where("length % 2 = 1").select(F.concat(F.lit("/bad"), "path").alias("path"), F.lit("invalid").alias("status")))
    return M.orphan_ingest(V.samples(spark, sf).select("id", "path", "pack_id", "source_type"), V.sample_tag(spark, sf), f, 99)[1]


@query("key_parse", SAMPLES, "k AS (SELECT id, key, CASE id % 4 WHEN 0 THEN key WHEN 1 THEN replace(key, 'm', '') || ' minor' WHEN 2 THEN lower(key) ELSE 'H' || key END AS spelled FROM samples)", select="SELECT id, CASE WHEN id % 4 <> 3 THEN regexp_replace(key, 'm$', '') END AS root, CASE WHEN id % 4 = 3 OR key IS NULL THEN NULL WHEN id % 4 = 1 OR ends_with(key, 'm') THEN 'minor' ELSE 'major' END AS mode FROM k")
def key_parse(spark, sf):
    k, i = F.col("key"), F.col("id") % 4
    spelled = F.when(i == 0, k).when(i == 1, F.concat(F.replace(k, F.lit("m"), F.lit("")), F.lit(" minor"))).when(i == 2, F.lower(k)).otherwise(F.concat(F.lit("H"), k))
    p = music.parse_key(spelled)
    return V.samples(spark, sf).select("id", p["root"].alias("root"), p["mode"].alias("mode"))


FNV = FNV_OF.format("samples")


@query("stem_fnv", SAMPLES, FNV, select=f"SELECT id, {text.ADJECTIVES}[CAST(h % 12 AS INT) + 1] || '-' || {text.NOUNS}[CAST((h // 65536) % 12 AS INT) + 1] AS stem FROM h")
def stem_fnv(spark, sf):
    return V.samples(spark, sf).select("id", text.stem_fnv(F.col("path")).alias("stem"))


def _pool(x, low, high, below, above):
    return f"CASE WHEN {x} > {high} THEN {text.MOODS[above]} WHEN {x} < {low} THEN {text.MOODS[below]} ELSE []::VARCHAR[] END"


MOOD = f"""w AS (SELECT id, path, {_pool('spectral_centroid', 800, 3000, 'dark', 'bright')} || {_pool('power(10, rms_db / 20)', 0.03, 0.15, 'thin', 'dense')} || {_pool('spectral_flatness / 3', 0.05, 0.2, 'smooth', 'sharp')} || {_pool('duration', 0.6, 3.0, 'short', 'long')} AS w FROM samples),
m AS (SELECT id, path, CASE WHEN len(w) > 0 THEN w ELSE {text.MOODS['neutral']} END AS w FROM w)"""


@query("mood_adjective", SAMPLES, MOOD, select="SELECT id, w[('0x' || substr(md5(path), 5, 2))::INT % len(w) + 1] AS mood FROM m")
def mood_adjective(spark, sf):
    mood = text.mood_adjective(F.col("path"), F.pow(F.lit(10.0), F.col("rms_db") / 20), F.col("spectral_centroid"), F.col("spectral_flatness") / 3, F.col("duration"))
    return V.samples(spark, sf).select("id", mood.alias("mood"))


NAMED = f"""nf AS (SELECT * REPLACE (regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]+$', '') AS path), power(10, rms_db / 20) AS rms, spectral_flatness / 3 AS z FROM samples), {MOOD.replace('FROM samples', 'FROM nf')},
tr AS (SELECT conv_id * 4 AS id, nullif(array_to_string(list_filter(list_transform(string_split_regex(lower(text), '\\s+'), lambda w: regexp_replace(w, '[^a-z]', '', 'g')), lambda w: length(w) >= 3 AND NOT list_contains({text.STOP_WORDS}, w))[1:3], '-'), '') AS said FROM conversations WHERE turn = 0),
nd AS (SELECT nf.*, m.w[('0x' || substr(md5(nf.path), 5, 2))::INT % len(m.w) + 1] AS mood, {text.ADJECTIVES}[('0x' || substr(md5(nf.path), 1, 2))::INT % 12 + 1] || '-' || {text.NOUNS}[('0x' || substr(md5(nf.path), 3, 2))::INT % 12 + 1] AS seed, coalesce(sample_type, 'vocal') AS label, nf.id % 3 = 0 AND nf.id % 10 >= 3 AS sure, said,
CASE WHEN duration < 0.6 THEN CASE WHEN spectral_centroid > 5000 OR z > 0.25 THEN 'hat' WHEN spectral_centroid < 700 THEN 'kick' ELSE 'perc' END WHEN duration > 2.5 AND bpm > 60 THEN 'loop' WHEN spectral_centroid < 500 THEN 'bass' WHEN spectral_centroid > 3500 AND rms < 0.1 THEN 'texture' WHEN duration > 1.5 AND spectral_centroid < 2000 THEN 'pad' END AS kind,
coalesce(duration >= 0.5 AND rms >= 0.005 AND spectral_centroid BETWEEN 300 AND 4500 AND z BETWEEN 0.03 AND 0.25, false) AS talk FROM nf JOIN m USING (id) LEFT JOIN tr USING (id)),
ne AS (SELECT *, sure AND label = 'vocal' AS vocal, CASE WHEN talk OR (sure AND label = 'vocal') THEN said END AS plain FROM nd)"""


@query("name_recordings", SAMPLES, NAMED, select="""SELECT id, concat_ws('_', CASE WHEN plain IS NOT NULL THEN plain WHEN sure THEN mood || '-' || label WHEN kind IS NOT NULL THEN mood || '-' || kind ELSE seed END, CASE WHEN bpm > 0 THEN CAST(bpm AS INT) || 'bpm' END, nullif(regexp_replace(key, '[^A-Za-z0-9-]', '', 'g'), '')) AS stem,
CASE WHEN plain IS NOT NULL THEN 'transcription' WHEN sure THEN 'labels' WHEN kind IS NOT NULL THEN 'heuristic' ELSE 'seed' END AS method, CASE WHEN plain IS NOT NULL AND NOT vocal THEN 'vocal' WHEN sure THEN label || ',noise' WHEN kind IS NOT NULL THEN kind ELSE '' END AS tags, NULL::VARCHAR AS alternative FROM ne""")
def name_recordings(spark, sf):
    """Names of the clips of the samples view; every third has labels and every fourth a transcript (a conversation's first turn)."""
    k = F.col("id")
    words = V.read(spark, sf, "conversations").where("turn = 0").select((F.col("conv_id") * 4).alias("id"), F.col("text").alias("transcript"))
    labels = F.when(k % 3 == 0, F.array(F.struct(F.coalesce("sample_type", F.lit("vocal")).alias("label"), ((k % 10) / 10.0).alias("confidence")), F.struct(F.lit("noise").alias("label"), F.lit(0.25).alias("confidence"))))
    c = V.samples(spark, sf).join(words, "id", "left").select("id", "path", labels.alias("labels"), "transcript", F.lit(None).cast("string").alias("refined"), F.pow(F.lit(10.0), F.col("rms_db") / 20).alias("rms"), F.col("spectral_centroid").alias("centroid"), (F.col("spectral_flatness") / 3).alias("zcr"), F.col("duration").alias("dur_s"), F.col("bpm").alias("tempo"), "bpm", "key")
    return N.name_recordings(c).select("id", "stem", "method", F.array_join("tags", ",").alias("tags"), "alternative")


@query("rename_with_stem", SAMPLES, select="SELECT id, regexp_extract(path, '^(.*/)') || 'pad' || CASE WHEN id % 2 = 0 THEN '_20240102_030405' ELSE '' END || '.wav' AS path FROM samples")
def rename_with_stem(spark, sf):
    stamped = F.regexp_replace("path", r"[.]wav$", F.when(F.col("id") % 2 == 0, "_20240102_030405.wav").otherwise(""))
    return V.samples(spark, sf).select("id", text.renamed(stamped, F.lit("pad")).alias("path"))


@query("db_convert", SAMPLES, select="SELECT id, round(power(10, rms_db / 20), 9) AS level, round(rms_db, 6) AS back, round(spectral_centroid, 6) AS hz, CASE WHEN bpm IS NOT NULL THEN CAST(floor(60 / bpm * 22050 / 512 + 0.5) AS BIGINT) END AS lag FROM samples")
def db_convert(spark, sf):
    level = text.from_db(F.col("rms_db"))
    return V.samples(spark, sf).select("id", F.round(level, 9).alias("level"), F.round(text.to_db(level, -120.0), 6).alias("back"), F.round(text.mel_to_hz(text.hz_to_mel(F.col("spectral_centroid"))), 6).alias("hz"), text.bpm_lag(F.col("bpm"), 22050.0, 512).alias("lag"))


LAYOUT = f"""a AS (SELECT id, lower(sample_type) AS t, (({' + '.join(f'({x} IS NOT NULL)::INT' for x in ATTRS)}) / 8.0 - id % 2)::DOUBLE AS share, radians((id * 137.508::DOUBLE) % 360) AS ang, 1.8::DOUBLE * (0.3 + ((id * 0.618::DOUBLE) % 1) * 0.7) AS r,
coalesce(CASE WHEN spectral_centroid IS NOT NULL THEN least(1, greatest(0, (ln(spectral_centroid) - ln(100)) / (ln(8000) - ln(100)))) END, 0.5) AS bx, coalesce(least(1, greatest(0, (rms_db + 60) / 60)), 0.5) AS ey, coalesce(CASE WHEN crest_factor IS NOT NULL THEN least(1, greatest(0, (crest_factor - 3) / 17)) END, 0.5) AS pz FROM samples),
p AS (SELECT *, CASE t {' '.join(f"WHEN '{k}' THEN {list(map(float, v))}::DOUBLE[]" for k, v in rules.CORNERS.items())} ELSE [0, 0, 0]::DOUBLE[] END AS c FROM a)"""


@query("layout_3d", SAMPLES, LAYOUT, select="SELECT id, round(CASE WHEN share >= 0.5 THEN (bx * 2 - 1) * 5 ELSE c[1] + cos(ang) * r END, 6) AS x, round(CASE WHEN share >= 0.5 THEN (ey * 2 - 1) * 5 ELSE c[2] + sin(ang) * r * 0.6 END, 6) AS y, round(CASE WHEN share >= 0.5 THEN (pz * 2 - 1) * 5 ELSE c[3] + sin(ang * 0.7) * r END, 6) AS z FROM p")
def layout_3d(spark, sf):
    """Places of clips; every second one counts as not analysed."""
    share = rules.coverage([F.col(a) for a in ATTRS]) / 8.0 - F.col("id") % 2
    return six(V.samples(spark, sf).select("id", *[v.alias(k) for k, v in rules.layout(F.col("id"), share).items()]), "x", "y", "z")


@query("radius_neighbours", SAMPLES, LAYOUT, "q AS (SELECT id, CASE WHEN share >= 0.5 THEN (bx * 2 - 1) * 5 ELSE c[1] + cos(ang) * r END AS x, CASE WHEN share >= 0.5 THEN (ey * 2 - 1) * 5 ELSE c[2] + sin(ang) * r * 0.6 END AS y, CASE WHEN share >= 0.5 THEN (pz * 2 - 1) * 5 ELSE c[3] + sin(ang * 0.7) * r END AS z FROM p),\nd AS (SELECT a.id AS a_id, b.id, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) AS distance FROM q a JOIN q b ON a.id <> b.id)", select="SELECT a_id, id, round(distance, 6) AS distance FROM d WHERE distance <= 1 QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY distance, id) <= 5")
def radius_neighbours(spark, sf):
    """The five nearest clips within 1 of each clip of the layout."""
    share = rules.coverage([F.col(a) for a in ATTRS]) / 8.0 - F.col("id") % 2
    p = V.samples(spark, sf).select("id", *[v.alias(k) for k, v in rules.layout(F.col("id"), share).items()])
    return E.radius_neighbours(p, 1.0, 5).select("a_id", "id", F.round("distance", 6).alias("distance"))


@query("sanitize_text", select="SELECT conv_id, turn, CASE WHEN length(n) BETWEEN 3 AND 60 THEN n END AS name FROM (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(split_part(trim(text), chr(10), 1))), '[\"''`*_]', '', 'g'), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-{2,}', '-', 'g'), '-') AS n FROM conversations)")
def sanitize_text(spark, sf):
    return V.read(spark, sf, "conversations").select("conv_id", "turn", text.sanitize_text(F.col("text")).alias("name"))


@query("arm_sessions", V.LEVELS, "ar AS (SELECT device_id, event_id AS session, ts AS on_at, lead(ts) OVER (PARTITION BY device_id ORDER BY ts, event_id) AS nxt FROM levels WHERE event_id % 5 = 0)", select="SELECT l.event_id AS id, max(CASE WHEN ar.on_at + (ar.nxt - ar.on_at) / 2 >= l.ts OR ar.nxt IS NULL THEN 'session:' || session END) AS session_tag FROM levels l LEFT JOIN ar ON ar.device_id = l.device_id AND ar.on_at <= l.ts AND (l.ts < ar.nxt OR ar.nxt IS NULL) WHERE l.event_id % 5 <> 0 GROUP BY l.event_id")
def arm_sessions(spark, sf):
    """Every fifth event of a device arms it until half way to the next such event (the last one for good); other events are finished clips."""
    l = V.levels(spark, sf)
    nxt = F.lead("ts").over(C.Window.partitionBy("device_id").orderBy("ts", "event_id"))
    arms = l.where("event_id % 5 = 0").withColumn("nxt", nxt).select("device_id", F.col("event_id").alias("session"), F.col("ts").alias("on_at"), (F.timestamp_micros(F.unix_micros("ts") + F.floor((F.unix_micros("nxt") - F.unix_micros("ts")) / 2))).alias("off_at"))
    return C.armed_clips(l.where("event_id % 5 <> 0").select(F.col("event_id").alias("id"), "device_id", F.col("ts").alias("stopped_at")), arms).select("id", "session_tag")
