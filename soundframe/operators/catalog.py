"""Search, browsing, tags, packs, sessions, projects, the work ledger and duplicates of the catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundframe.functions import music
from soundframe.operators.stored import stored

#: Columns that a search may sort by.
SORTABLE = ("path", "sample_type", "bpm", "key", "duration", "quality_score", "applicability_score", "created_at", "updated_at", "rms_db", "spectral_centroid", "spectral_flatness", "crest_factor", "dynamic_range")
SYSTEM_TAGS = ("session:", "parent:", "stem:", "stems-")
#: Groups of a fixed, small size may be broadcast; larger ones are left to the planner.
BROADCAST_ROWS = 100_000
#: Rows in a block of the pair join: two blocks meet in one cell.
PAIR_BLOCK = 500


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def with_all_tags(samples: DataFrame, sample_tag: DataFrame, tags: list[str]) -> DataFrame:
    """Clips that have every tag: one grouping of the bridge, then a semi join."""
    wanted = list(dict.fromkeys(tags))
    if not wanted:
        return samples
    full = sample_tag.where(F.col("tag").isin(wanted)).groupBy("sample_id").agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(wanted))
    return samples.join(full, samples.id == full.sample_id, "left_semi")


def search(samples, sample_tag, *, query=None, tags=(), pack_id=None, min_score=None, max_score=None, sample_type=None, min_bpm=None, max_bpm=None, is_loopable=None, max_duration=None) -> DataFrame:
    """All predicates that are given, joined by AND; NULL never matches. % and _ in query are wildcards, a backslash is a plain character, case is ignored."""
    tests = []
    if query:
        tests.append(F.col("path").ilike("%" + query.replace("\\", "\\\\") + "%"))
    for column, value, op in (("sample_type", sample_type, "=="), ("pack_id", pack_id, "=="), ("bpm", min_bpm, ">="), ("bpm", max_bpm, "<="), ("applicability_score", min_score, ">="), ("applicability_score", max_score, "<="), ("is_loopable", is_loopable, "=="), ("duration", max_duration, "<=")):
        if value is not None and value != "":
            c = F.col(column)
            tests.append(c == value if op == "==" else c >= value if op == ">=" else c <= value)
    for t in tests:
        samples = samples.where(t)
    return with_all_tags(samples, sample_tag, list(tags))


def page(df: DataFrame, sort_field: str = "applicability_score", direction: str = "desc", limit: int = 100, offset: int = 0) -> DataFrame:
    """One page, NULLs last in both directions, ties by id. Unknown fields fall back to applicability_score."""
    field = F.col(sort_field if sort_field in SORTABLE else "applicability_score")
    first = field.asc_nulls_last() if direction in ("asc", "ASC") else field.desc_nulls_last()
    return df.orderBy(first, "id").offset(offset).limit(limit)


def search_page(samples, sample_tag, sort_field="applicability_score", direction="desc", limit=100, offset=0, **filters) -> tuple[DataFrame, int]:
    """One page of a search and how many clips it finds in all."""
    found = search(samples, sample_tag, **filters)
    return page(found, sort_field, direction, limit, offset), found.count()


def browse(samples, sample_type=None, min_bpm=None, max_bpm=None, limit=100, offset=0) -> DataFrame:
    """Newest clips first."""
    return search(samples, None, sample_type=sample_type, min_bpm=min_bpm, max_bpm=max_bpm).orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


FILTERS = "tags array<string>, query string, sample_type string, pack_id bigint, min_bpm double, max_bpm double, min_score double, max_score double, is_loopable boolean, max_duration double"


def apply_preset(samples, sample_tag, presets: DataFrame, name: str) -> DataFrame:
    """The search that a saved preset (name, filters as JSON) describes; an unknown name is an error."""
    row = presets.where(F.col("name") == name).select(F.from_json("filters", FILTERS).alias("f")).select("f.*").first()  # one row
    if row is None:
        raise ValueError(f"no preset {name}")
    return search(samples, sample_tag, **{k: v for k, v in row.asDict().items() if v is not None})


def ordered_presets(presets: DataFrame) -> DataFrame:
    return presets.orderBy("sort_order", "name")


def import_summary(files: DataFrame, samples: DataFrame) -> DataFrame:
    """One row: imported and skipped (known path, or a path given before) files, and those with an error (column error)."""
    known = samples.select("path").distinct().withColumn("_known", F.lit(True))
    f = files.groupBy("path").agg(F.count("*").alias("n"), F.max("error").alias("error")).join(known, "path", "left")
    new = F.col("_known").isNull()
    return f.agg(F.count_if(new & F.col("error").isNull()).alias("imported"), F.coalesce(F.sum(F.when(new, F.col("n") - 1).otherwise(F.col("n"))), F.lit(0)).alias("skipped"), F.count_if(new & F.col("error").isNotNull()).alias("failed"))


def enrich(samples: DataFrame, sample_tag: DataFrame, packs: DataFrame) -> DataFrame:
    """Adds the sorted tags of each clip and its pack's name in one join each; only the bridge rows of these clips are grouped."""
    tags = sample_tag.join(samples.select(F.col("id").alias("sample_id")), "sample_id", "left_semi").groupBy(F.col("sample_id").alias("id")).agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    names = packs.select(F.col("id").alias("pack_id"), F.col("name").alias("pack_name"))
    return samples.join(tags, "id", "left").join(names, "pack_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def excluded(name: Column, patterns: list[str]) -> Column:
    """True where a file name matches a pattern: *x* holds, *x ends, x* begins, else equals. None of it is a regular expression."""

    def test(p: str) -> Column:
        if p.startswith("*") and p.endswith("*") and len(p) > 1:
            return name.contains(p[1:-1])
        return name.endswith(p[1:]) if p.startswith("*") else name.startswith(p[:-1]) if p.endswith("*") else name == p

    return any_of([test(p) for p in patterns])


DEFAULT_EXCLUDES = [".*", "_*", "*.tmp", "*.bak"]


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def list_directory(files: DataFrame, samples: DataFrame, directory: str) -> DataFrame:
    """Children of a directory: hidden ones dropped, directories first, then by name; files get the clip's id."""
    root = directory.rstrip("/") + "/"
    rest = F.substr("path", F.lit(len(root) + 1))
    inside = files.where(F.col("path").startswith(root)).select("path", F.split(rest, "/").alias("p"))
    children = inside.select(F.col("p")[0].alias("name"), (F.size("p") > 1).alias("is_directory"), F.when(F.size("p") == 1, F.col("path")).alias("path")).where("name <> '' and not startswith(name, '.')").distinct()
    ids = samples.select("path", F.col("id").alias("sample_id"))
    return children.join(ids, "path", "left").select("name", "is_directory", "sample_id").orderBy(F.desc("is_directory"), F.lower("name"))


def ancestors(paths: DataFrame) -> DataFrame:
    """Every directory above each path, once."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return paths.where(F.size(parts) > 1).select(F.explode(ups).alias("directory")).distinct()


def tree_search(files: DataFrame, text: str) -> DataFrame:
    return ancestors(files.where(F.lower(basename(F.col("path"))).contains(text.lower())))


def user_tags(sample_tag: DataFrame) -> DataFrame:
    return sample_tag.select("tag").where(~any_of([F.col("tag").startswith(p) for p in SYSTEM_TAGS])).distinct()


def suggest_tags(sample_tag: DataFrame, text: str, chosen: list[str], limit: int = 10) -> DataFrame:
    t = sample_tag.select("tag").distinct().where(F.lower("tag").contains(text.lower()))
    return t.where(~F.col("tag").isin(chosen) if chosen else F.lit(True)).orderBy("tag").limit(limit)


def in_scale(samples: DataFrame, root: int, minor: bool) -> DataFrame:
    return samples.where(music.semitone(F.col("key")).isin(music.scale_degrees(root, minor)))


def sessions(samples: DataFrame, sample_tag: DataFrame) -> DataFrame:
    """Span and size of each session tag that has clips; newest first."""
    s = sample_tag.where(F.col("tag").startswith("session:")).join(samples.select(F.col("id").alias("sample_id"), "created_at"), "sample_id")
    return s.groupBy("tag").agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"), F.count("*").alias("clip_count")).orderBy(F.desc("ended_at"), "tag")


def session_timeline(samples: DataFrame, sample_tag: DataFrame) -> DataFrame:
    """Each clip's place in its session's span in percent; 50 where the span is zero. The span is aggregated and joined back."""
    s = sample_tag.where(F.col("tag").startswith("session:")).join(samples.select(F.col("id").alias("sample_id"), F.unix_micros("created_at").alias("t")), "sample_id")
    span = s.groupBy("tag").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    s = s.join(span, "tag")
    return s.select("tag", "sample_id", F.when(F.col("hi") > F.col("lo"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), (F.col("t") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0).cast("bigint")) * 100))).otherwise(50.0).alias("percent"))


def session_name(ts: Column, zone: str = "UTC") -> Column:
    """session at YYYY-MM-DD HH:MM in a zone, or the raw text if no known format fits."""
    clean = F.rtrim(ts, F.lit("Z"))
    formats = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS"]
    parsed = F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)) for f in formats])
    return F.concat(F.lit("session at "), F.coalesce(F.date_format(F.from_utc_timestamp(parsed, zone), "yyyy-MM-dd HH:mm"), ts))


def duplicate_groups(items: DataFrame) -> DataFrame:
    """Members of hashes that several clips share. The counts are aggregated first; only then are members joined."""
    shared = items.where(F.col("fingerprint_hash").isNotNull()).groupBy("fingerprint_hash").agg(F.count("*").alias("members")).where("members > 1")
    return items.join(shared, "fingerprint_hash")


def duplicate_savings(items: DataFrame) -> DataFrame:
    g = items.where(F.col("fingerprint_hash").isNotNull()).groupBy("fingerprint_hash").agg(F.count("*").alias("members"), F.min("id").alias("first_id"), F.sum("size_bytes").alias("total_bytes"), (F.sum("size_bytes") - F.max("size_bytes")).alias("savings"))
    return g.where("members > 1")


def duplicate_details(items: DataFrame) -> DataFrame:
    """duplicate_savings with paths, the members' sorted paths: one row of text a group, as a report shows it."""
    paths = duplicate_groups(items).groupBy("fingerprint_hash").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return duplicate_savings(items).join(paths, "fingerprint_hash")


def duplicate_pages(items: DataFrame, size: int = 1000) -> DataFrame:
    """(fingerprint_hash, page, paths): the members' paths of each duplicate group in order, in pages of at most size, however large a group is."""
    members = duplicate_groups(items).select("fingerprint_hash", F.coalesce("path", F.lit("")).alias("path"))
    p = pack(members, "fingerprint_hash", ["path"], size)
    return p.select("fingerprint_hash", F.col("piece").alias("page"), F.transform("rows", lambda r: r.path).alias("paths"))


def lookup(samples: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Clips whose id or path (column) is among keys, once each."""
    return samples.join(keys.select(column), column, "left_semi")


def keep_best(items: DataFrame) -> DataFrame:
    """Of each duplicate group the best: quality (unknown last), then size, then id. An aggregate, not a window over a group."""
    order = F.struct(F.col("quality_score").isNotNull().alias("known"), F.coalesce("quality_score", F.lit(0.0)).alias("q"), F.coalesce("size_bytes", F.lit(0)).alias("size"), (-F.col("id")).alias("neg"))
    g = items.where(F.col("fingerprint_hash").isNotNull()).groupBy("fingerprint_hash").agg(F.max(order).alias("b"), F.count("*").alias("n")).where("n > 1")
    return g.select("fingerprint_hash", (-F.col("b.neg")).alias("keep_id"))


def recent_jobs(jobs: DataFrame, limit: int = 50, status: str | None = None) -> DataFrame:
    """Running, pending, failed, then finished jobs, newest first; or those of one status."""
    jobs = jobs if status is None else jobs.where(F.col("status") == status)
    rank = F.when(F.col("status") == "running", 0).when(F.col("status") == "pending", 1).when(F.col("status") == "failed", 2).otherwise(3)
    return jobs.orderBy(rank, F.desc("created_at"), "id").limit(limit)


def next_jobs(jobs: DataFrame, k: int) -> DataFrame:
    return jobs.where("status = 'pending'").orderBy(F.desc("priority"), "created_at", "id").limit(k)


def export_manifest(projects: DataFrame, members: DataFrame, samples: DataFrame, pattern: str) -> DataFrame:
    """Output names of a project's clips; index counts per role, newest first. Clips that are missing are skipped."""
    j = members.join(samples.select(F.col("id").alias("sample_id"), "path", "sample_type"), "sample_id").join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project")), "project_id")
    role = F.coalesce("role", F.lit("sample"))
    j = places(j.withColumn("_role", role), ["project_id", "_role"], [F.desc("added_at"), F.col("sample_id")], "idx")
    name, ext = basename(F.col("path")), F.regexp_extract("path", r"\.([^./]+)$", 1)
    out = F.lit(pattern)
    for key, value in (("project", F.col("project")), ("category", F.coalesce("sample_type", F.lit("uncategorized"))), ("role", role), ("index", F.lpad(F.col("idx").cast("string"), 3, "0")), ("original", F.regexp_replace(name, r"\.[^.]+$", ""))):
        out = F.replace(out, F.lit("{" + key + "}"), value)
    return j.select("project_id", "sample_id", F.concat(out, F.lit("."), F.when(ext != "", ext).otherwise("wav")).alias("output_name"))


def places(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """df with the place from 1 of each row in its group. Range partitions cut large groups; each adds the rows that ranges before have."""
    keys = [F.col(g) for g in group]
    ranged = df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id())
    inner = Window.partitionBy("_p", *keys).orderBy(*order)
    ranged = stored(ranged.withColumn("_i", F.row_number().over(inner)))
    counts = ranged.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))  # a row per group and range
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(g).alias(f"_{g}_") for g in group], F.col("_p").alias("_q"), before.alias("_o"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_{g}_")) for g in group]) & (F.col("_p") == F.col("_q"))
    return ranged.join(counts, same).withColumn(name, F.col("_i") + F.col("_o")).drop("_p", "_q", "_i", "_o", *[f"_{g}_" for g in group])


def pack(df: DataFrame, group: str, columns: list[str], size: int) -> DataFrame:
    """(group, piece, rows, n, first_id): rows of each group as arrays of structs of columns (id first), at most size each, in order of id."""
    p = places(df, [group], [F.col(columns[0])], "_place").withColumn("piece", F.floor((F.col("_place") - 1) / size))
    rows = F.array_sort(F.collect_list(F.struct(*columns)))
    return p.groupBy(group, "piece").agg(rows.alias("rows"), F.count("*").alias("n"), F.min(columns[0]).alias("first_id"))


PAIRED = ("id", "bpm", "spectral_centroid", "spectral_bandwidth", "crest_factor")


def side(clips: DataFrame, prefix: str = "", *keep: str) -> DataFrame:
    """One side of a pair: the compared columns and the key's facts, under a prefix."""
    return clips.select(*keep, *[F.col(c).alias(prefix + c) for c in PAIRED], *[v.alias(k) for k, v in music.key_facts(F.col("key"), prefix).items()])


#: Parts of the score for common purposes.
PURPOSES = {"all": ("key", "bpm", "frequency", "dynamics"), "layering": ("frequency", "dynamics"), "melodic": ("key", "bpm"), "pack": ("key", "bpm", "frequency", "dynamics")}


def compatible(source: DataFrame, candidates: DataFrame, k: int = 20, floor: float = 0.3, parts=PURPOSES["all"], notes: bool = False) -> DataFrame:
    """Top k candidates for each clip of a source set by the mean of the enabled parts; a small set (it is counted) is broadcast.

    Candidates are dealt over all tasks first, and the floor comes after the top k, so that no pair is scored twice. notes adds
    what is worth saying about each pair.
    """
    a, b, other = side(source, "a_"), side(candidates), F.col("id") != F.col("a_id")
    few = source.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    tasks = candidates.sparkSession.sparkContext.defaultParallelism
    j = b.repartition(4 * tasks, "id").join(F.broadcast(a), other) if few else meet(a, b, "a_id", "id", other)
    scored = compatibility(j, parts).withColumn("score", F.round("score", 9))
    best = top_k(scored, "a_id", "score", "id", k).where(F.col("score") >= floor)
    return best.withColumn("notes", pair_notes()) if notes else best


def pair_notes() -> Column:
    """Remarks on a pair of sides, in the order key, tempo, frequency, dynamics; only what is known is remarked on."""
    c = F.col
    key, low, high = c("key_score"), F.least("a_spectral_centroid", "spectral_centroid"), F.greatest("a_spectral_centroid", "spectral_centroid")
    both = c("a_norm").isNotNull() & c("norm").isNotNull()
    gap, mean = F.abs(c("a_crest_factor") - c("crest_factor")), (c("a_crest_factor") + c("crest_factor")) / 2
    return F.array_compact(F.array(
        F.when(both & (key >= 1), "same key").when(both & (key >= 0.95), "relative key").when(both & (key >= 0.7), "neighbouring key"),
        F.when(c("a_bpm").isNotNull() & c("bpm").isNotNull(), F.when(c("bpm_score") >= 1, "same tempo").when(c("bpm_score") >= 0.9, "related tempo")),
        F.when((low < 500) & (high > 4000), "well apart in frequency").when((low < 500) & (high > 1000), "apart in frequency"),
        F.when(gap > 6, "one punchy, one sustained").when((gap < 3) & (mean > 12), "both punchy").when((gap < 3) & (mean < 6), "both sustained"),
    ))


def compatibility(pairs: DataFrame, parts=("key", "bpm", "frequency", "dynamics")) -> DataFrame:
    c = F.col
    score = {
        "key": music.key_part(),
        "bpm": music.bpm_part(c("a_bpm"), c("bpm")),
        "frequency": music.frequency_part(c("a_spectral_centroid"), c("a_spectral_bandwidth"), c("spectral_centroid"), c("spectral_bandwidth")),
        "dynamics": music.dynamics_part(c("a_crest_factor"), c("crest_factor")),
    }
    pairs = pairs.withColumns({f"{k}_score": v for k, v in score.items()})
    return pairs.withColumn("score", sum(c(f"{k}_score") for k in parts) / len(parts))


def top_k(df: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """Best k rows per group; Spark keeps only k per group and task before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def meet(a: DataFrame, b: DataFrame, a_id: str, b_id: str, match: Column) -> DataFrame:
    """Every row of a with every row of b that matches, without a broadcast.

    Ids are hashed into blocks of about PAIR_BLOCK rows, and one cell holds the pairs of a block of a and a block of b, so a row is
    copied once a block of the other side and no cell depends on the values of the rows.
    """
    rows, columns = (max(-(-x.count() // PAIR_BLOCK), 1) for x in (a, b))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = min(-(-rows * columns // 4), 4096)
    x = a.withColumn("_row", block(a_id, rows)).withColumn("_column", every(columns)).repartition(tasks, "_row", "_column")
    y = b.withColumn("_column_b", block(b_id, columns)).withColumn("_row_b", every(rows)).repartition(tasks, "_row_b", "_column_b")
    cell = (F.col("_row") == F.col("_row_b")) & (F.col("_column") == F.col("_column_b"))
    return x.join(y.hint("shuffle_hash"), cell & match).drop("_row", "_column", "_row_b", "_column_b")


def lineage(sample_tag: DataFrame) -> DataFrame:
    p = sample_tag.where(F.col("tag").startswith("parent:"))
    return p.select(F.col("sample_id").alias("child_id"), F.substring_index("tag", ":", -1).cast("long").alias("parent_id"))


def inherit_tags(children: DataFrame, sample_tag: DataFrame) -> DataFrame:
    """Tags of derived clips: parent:<id> and the parent's first session tag."""
    session = sample_tag.where(F.col("tag").startswith("session:")).groupBy(F.col("sample_id").alias("parent_id")).agg(F.min("tag").alias("session"))
    c = children.join(session, "parent_id", "left")
    return c.select("child_id", F.explode(F.array_compact(F.array(F.concat(F.lit("parent:"), F.col("parent_id").cast("string")), "session"))).alias("tag"))


def first_of_bursts(events: DataFrame, key: str, idle_s: float) -> DataFrame:
    """The first event of each burst of a key (ts, event_id): a burst ends when nothing comes for idle_s seconds."""
    before = F.lag("ts").over(Window.partitionBy(key).orderBy("ts", "event_id"))
    gap = (F.unix_micros("ts") - F.unix_micros("_p")) / 1e6
    return events.withColumn("_p", before).where(F.col("_p").isNull() | (gap >= idle_s)).drop("_p")


def armed_clips(clips: DataFrame, arms: DataFrame) -> DataFrame:
    """clips (id, device_id, stopped_at) with session_tag, that of the cycle in arms (device_id, session, on_at, off_at) in which each stopped.

    off_at may be NULL for a cycle that goes on. Cycles of a device don't overlap, so the last one begun before is the only candidate: one
    pass in order of time, no range join.
    """
    c = clips.select("id", "device_id", F.col("stopped_at").alias("at"), F.lit(1).alias("o"), F.lit(None).cast("struct<session:string,off_at:timestamp>").alias("arm"))
    a = arms.select(F.lit(None).cast("long").alias("id"), "device_id", F.col("on_at").alias("at"), F.lit(0).alias("o"), F.struct(F.col("session").cast("string").alias("session"), "off_at").alias("arm"))
    last = F.last("arm", True).over(Window.partitionBy("device_id").orderBy("at", "o"))
    both = c.unionByName(a).withColumn("arm", last).where("o = 1")
    inside = F.col("arm.off_at").isNull() | (F.col("at") <= F.col("arm.off_at"))
    return both.select("id", "device_id", F.col("at").alias("stopped_at"), F.when(F.col("arm").isNotNull() & inside, F.concat(F.lit("session:"), "arm.session")).alias("session_tag"))
