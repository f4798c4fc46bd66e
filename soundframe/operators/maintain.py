"""Catalogue maintenance as pure table-to-table jobs: each returns the new table, which the caller writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundframe.functions import text
from soundframe.operators import catalog
from soundframe.operators.stored import stored


def new_ids(df: DataFrame, start: int, order: list[str]) -> DataFrame:
    """Ids from start on in that order, dense and without gathering rows: each range partition adds the rows that those before it have.

    The partitioned rows are stored before they are counted: planned twice, the ranges would be sampled twice and differ.
    """
    df = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    counts = df.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_o", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_o", F.lit(0)).alias("_o"))  # a row per partition
    return df.join(F.broadcast(offsets), part == F.col("_p")).withColumn("id", F.lit(start) + F.col("_o") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_o")


def ingest(samples: DataFrame, files: DataFrame, source_type: str = "imported") -> DataFrame:
    """Rows to append for files whose path is new; ids follow the largest so far."""
    fresh = files.dropDuplicates(["path"]).join(samples.select("path"), "path", "left_anti")
    start = samples.agg(F.max("id")).first()[0] or 0
    return new_ids(fresh, start + 1, ["path"]).withColumn("source_type", F.lit(source_type))


def upsert_names(existing: DataFrame, names: DataFrame) -> DataFrame:
    """existing (id, name) and new ids for names it lacks."""
    start = existing.agg(F.max("id")).first()[0] or 0
    fresh = names.select("name").where("name is not null").distinct().join(existing, "name", "left_anti")
    return existing.select("id", "name").unionByName(new_ids(fresh, start + 1, ["name"]).select("id", "name"))


def merge(current: DataFrame, changes: DataFrame, key: str, keep_old: bool = True, now: Column | None = None, stamps: tuple[str, ...] = ("analyzed_at", "updated_at")) -> DataFrame:
    """current with the columns of changes; with keep_old a NULL leaves the old value. now stamps the rows that changes names."""
    columns = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    j = current.join(new, F.col(key) == F.col("_k"), "left")
    value = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)) if keep_old else F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c))
    stamped = lambda c: F.when(F.col("_hit"), now).otherwise(F.col(c)) if now is not None and c in stamps else F.col(c)
    return j.select(*[value(c).alias(c) if c in columns else stamped(c).alias(c) for c in current.columns])


def batch_update(current: DataFrame, ids: DataFrame, **values) -> DataFrame:
    if not values:
        return current
    hit = ids.select(F.col("id").alias("_id")).distinct().withColumn("_hit", F.lit(True))
    j = current.join(hit, F.col("id") == F.col("_id"), "left")
    return j.select(*[F.when(F.col("_hit"), values[c] if isinstance(values[c], Column) else F.lit(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in current.columns])


def touched(current: DataFrame, ids: DataFrame, **values) -> int:
    """How many rows batch_update changes; without values none."""
    return current.join(ids.select("id"), "id", "left_semi").count() if values else 0


def delete_clips(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The catalogue's tables without some clips: rows of sample_tag, embeddings, project_samples and jobs that name them go too,
    and duplicate_of_id of samples that point to them becomes NULL."""
    out = {name: delete(t, ids, "id" if name == "samples" else "sample_id") if name in ("samples", "sample_tag", "embeddings", "project_samples", "jobs") else t for name, t in tables.items()}
    if "duplicate_of_id" in out.get("samples", ids).columns:
        s, gone = out["samples"], ids.select(F.col("id").alias("_gone")).distinct()
        j = s.join(gone, F.col("duplicate_of_id") == F.col("_gone"), "left")
        out["samples"] = j.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == "duplicate_of_id" else F.col(c) for c in s.columns])
    return out


def types_to_tags(samples: DataFrame, sample_tag: DataFrame) -> DataFrame:
    """The bridge with each clip's type, in lower case, as a tag."""
    typed = samples.where("sample_type <> ''").select(F.col("id").alias("sample_id"), F.lower("sample_type").alias("tag"))
    return sample_tag.unionByName(typed).distinct()


def typed_clips(samples: DataFrame) -> DataFrame:
    """One row, typed: how many clips have a type, that is how many types_to_tags reads."""
    return samples.agg(F.count_if(F.col("sample_type") != "").alias("typed"))


def tag_union(clips: DataFrame, *columns: str, always: str = "recorded") -> DataFrame:
    """clips with tags: the union of array or text columns and one tag that all get, sorted."""
    kinds = dict(clips.dtypes)
    arrays = [F.coalesce(F.col(c), F.array().cast("array<string>")) if kinds[c].startswith("array") else F.array_compact(F.array(c)) for c in columns]
    return clips.withColumn("tags", F.array_sort(F.array_distinct(F.concat(*arrays, F.array(F.lit(always))))))


def append_rows(table: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """table with rows under new ids; columns that rows lacks are NULL."""
    start = table.agg(F.max("id")).first()[0] or 0
    new = new_ids(rows, start + 1, order)
    return table.unionByName(new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(k).alias(c) for c, k in table.dtypes]))


def put_members(members: DataFrame, changes: DataFrame) -> DataFrame:
    """Project members with rows of changes replaced or added, by project_id and sample_id."""
    rest = members.join(changes.select("project_id", "sample_id"), ["project_id", "sample_id"], "left_anti")
    return rest.select(members.columns).unionByName(changes.select(members.columns))


def update_members(members: DataFrame, changes: DataFrame) -> DataFrame:
    """notes and role of members, where changes has them."""
    new = changes.select("project_id", "sample_id", F.col("notes").alias("_notes"), F.col("role").alias("_role"))
    j = members.join(new, ["project_id", "sample_id"], "left")
    return j.withColumns({"notes": F.coalesce("_notes", "notes"), "role": F.coalesce("_role", "role")}).select(members.columns)


def bump(projects: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """projects with updated_at set where a member changed (ids: project_id)."""
    return batch_update(projects, ids.select(F.col("project_id").alias("id")), updated_at=now)


def merge_presets(presets: DataFrame, changes: DataFrame) -> DataFrame:
    """presets (id, name, filters, is_system, sort_order, ...) with those of changes (name, filters, sort_order) made or, by name, renewed.

    A new name gets the next ids in order of names, and place 0 where changes give none; of a known one, filters and place change where
    changes have a value. Presets of the system stay as they are. Of changes to one name any one counts.
    """
    new = changes.where("name is not null").dropDuplicates(["name"]).select(F.col("name").alias("_name"), F.col("filters").alias("_filters"), F.col("sort_order").alias("_order"))
    j = presets.join(new, F.col("name") == F.col("_name"), "left")
    value = lambda c, v: F.when(F.col("is_system"), F.col(c)).otherwise(F.coalesce(v, c)).alias(c)
    kept = j.select(*[value("filters", "_filters") if c == "filters" else value(c, "_order") if c == "sort_order" else F.col(c) for c in presets.columns])
    fresh = new.join(presets.select(F.col("name").alias("_name")), "_name", "left_anti")
    fresh = fresh.select(F.col("_name").alias("name"), F.col("_filters").alias("filters"), F.lit(False).alias("is_system"), F.coalesce("_order", F.lit(0)).alias("sort_order"))
    start = presets.agg(F.max("id")).first()[0] or 0
    new_rows = new_ids(fresh, start + 1, ["name"])
    return kept.unionByName(new_rows.select(*[F.col(c).cast(k).alias(c) if c in new_rows.columns else F.lit(None).cast(k).alias(c) for c, k in presets.dtypes]))


def remove_presets(presets: DataFrame, ids: DataFrame) -> DataFrame:
    """presets without some; those of the system stay."""
    return presets.where("is_system").unionByName(delete(presets.where("not is_system"), ids))


def enqueue(jobs: DataFrame, samples: DataFrame, job_type: str, priority: int, now: Column) -> DataFrame:
    """The ledger with a pending job for each clip of samples (id) that has none of the type pending or running."""
    live = jobs.where((F.col("job_type") == job_type) & F.col("status").isin("pending", "running")).select(F.col("sample_id").alias("id"))
    rows = samples.select("id").distinct().join(live, "id", "left_anti").select(F.col("id").alias("sample_id"), F.lit(job_type).alias("job_type"), F.lit(priority).alias("priority"), F.lit("pending").alias("status"), now.alias("created_at"))
    return append_rows(jobs, rows, ["sample_id"])


def finish_jobs(jobs: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Jobs of done (id, error) become complete, or failed where there is an error."""
    new = done.select(F.col("id").alias("_id"), F.col("error").alias("_error"))
    j = jobs.join(new, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    change = {"status": F.when(hit, F.when(F.col("_error").isNull(), "complete").otherwise("failed")).otherwise(F.col("status")), "completed_at": F.when(hit, now).otherwise(F.col("completed_at")), "error_message": F.when(hit, F.col("_error"))}
    return j.select(*[change[c].alias(c) if c in change else F.col(c) for c in jobs.columns])


def register_stems(samples: DataFrame, sample_tag: DataFrame, stems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, sample_tag) with separated parts (parent_id, role, path): clips of source stem in the parent's pack, tagged with
    parent and role; the parents are then marked stems-done. Paths that are known are left out."""
    packs = samples.select(F.col("id").alias("parent_id"), "pack_id")
    rows = stems.join(samples.select("path"), "path", "left_anti").join(packs, "parent_id", "left").withColumn("source_type", F.lit("stem"))
    start = samples.agg(F.max("id")).first()[0] or 0
    new = new_ids(rows, start + 1, ["path"])
    out = samples.unionByName(new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(k).alias(c) for c, k in samples.dtypes]))
    tags = new.select(F.col("id").alias("sample_id"), F.explode(F.array(F.concat(F.lit("parent:"), F.col("parent_id").cast("string")), F.concat(F.lit("stem:"), "role"))).alias("tag"))
    done = stems.select(F.col("parent_id").alias("sample_id"), F.lit("stems-done").alias("tag"))
    return out, sample_tag.unionByName(tags).unionByName(done).distinct()


def save_recordings(samples: DataFrame, sample_tag: DataFrame, jobs: DataFrame, recordings: DataFrame, pack_id: int, now: Column, stems_default: bool = False, least: float = 5.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, sample_tag, jobs) after finished recordings (path, duration, tags, model_tags, session_tag, stems) are saved.

    Clips are recorded ones in the pack; they get their tags and the session's, an analysis job, and a stems job where the session (else
    the default) asks for it and they last least seconds. Known paths are left out.
    """
    fresh = tag_union(recordings.dropDuplicates(["path"]).join(samples.select("path"), "path", "left_anti"), "tags", "model_tags", "session_tag")
    start = samples.agg(F.max("id")).first()[0] or 0
    new = new_ids(fresh.withColumns({"source_type": F.lit("recorded"), "pack_id": F.lit(pack_id).cast("long")}), start + 1, ["path"])
    out = samples.unionByName(new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(k).alias(c) for c, k in samples.dtypes]))
    bridge = sample_tag.unionByName(new.select(F.col("id").alias("sample_id"), F.explode("tags").alias("tag"))).distinct()
    wanted = F.coalesce("stems", F.lit(stems_default)) & (F.col("duration") >= least)
    ledger = enqueue(jobs, new, "analysis", 5, now)
    return out, bridge, enqueue(ledger, new.where(wanted), "stems", 0, now)


def split_clips(samples: DataFrame, sample_tag: DataFrame, parts: DataFrame, rate: float, extra: tuple[str, ...] = ("split",)) -> tuple[DataFrame, DataFrame]:
    """(samples, sample_tag) with a recorded clip for each of parts (clip_id, part, start, end in samples) in the parent's folder and pack.

    Names are the parent path's words (by FNV) and the part's number; tags are the parent, its session and extra ones. Clips without
    parts, and paths that are known, are left alone.
    """
    p = samples.select(F.col("id").alias("clip_id"), F.col("path").alias("from"), "pack_id")
    c = parts.join(p, "clip_id")
    folder = F.regexp_extract("from", r"^(.*/)?[^/]*$", 1)
    name = F.concat(folder, text.stem_fnv(F.col("from")), F.lit("_"), F.lpad((F.col("part") + 1).cast("string"), 3, "0"), F.lit(".wav"))
    c = c.select("clip_id", "pack_id", name.alias("path"), ((F.col("end") - F.col("start")) / rate).alias("duration"), F.lit("recorded").alias("source_type"), F.lit(1).alias("channels"))
    start = samples.agg(F.max("id")).first()[0] or 0
    new = new_ids(c.join(samples.select("path"), "path", "left_anti"), start + 1, ["path"])
    out = samples.unionByName(new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(k).alias(c) for c, k in samples.dtypes]))
    born = new.select(F.col("id").alias("child_id"), F.col("clip_id").alias("parent_id"))
    more = born.select(F.col("child_id").alias("sample_id"), F.explode(F.array(*map(F.lit, extra))).alias("tag"))
    return out, sample_tag.unionByName(catalog.inherit_tags(born, sample_tag).select(F.col("child_id").alias("sample_id"), "tag")).unionByName(more).distinct()


def orphan_ingest(samples: DataFrame, sample_tag: DataFrame, files: DataFrame, pack_id: int) -> tuple[DataFrame, DataFrame]:
    """(samples, sample_tag) with valid orphaned files (path, status, ...) as recorded clips of the pack, tagged recorded."""
    fresh = files.where("status = 'valid'").dropDuplicates(["path"]).join(samples.select("path"), "path", "left_anti")
    start = samples.agg(F.max("id")).first()[0] or 0
    new = new_ids(fresh.withColumns({"source_type": F.lit("recorded"), "pack_id": F.lit(pack_id).cast("long")}), start + 1, ["path"])
    out = samples.unionByName(new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(k).alias(c) for c, k in samples.dtypes]))
    return out, sample_tag.unionByName(new.select(F.col("id").alias("sample_id"), F.lit("recorded").alias("tag"))).distinct()


def delete(table: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    return table.join(ids.select(F.col("id").alias(column)), column, "left_anti").select(table.columns)


def add_tags(sample_tag: DataFrame, ids: DataFrame, tags: list[str]) -> DataFrame:
    """Bridge rows with tags added to every id; those that exist stay single."""
    added = ids.select(F.col("id").alias("sample_id"), F.explode(F.array(*map(F.lit, tags))).alias("tag"))
    return sample_tag.unionByName(added).distinct()


def remove_tags(sample_tag: DataFrame, ids: DataFrame, tags: list[str]) -> DataFrame:
    gone = ids.select(F.col("id").alias("sample_id")).distinct()
    keep = sample_tag.where(~F.col("tag").isin(tags))
    return keep.unionByName(sample_tag.where(F.col("tag").isin(tags)).join(gone, "sample_id", "left_anti"))


def upsert_latest(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key, that of the largest version."""
    rest = [c for c in current.columns if c != key]
    best = current.unionByName(changes).groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in rest]).select(current.columns)


def expire_jobs(jobs: DataFrame, now: Column, days: int) -> DataFrame:
    """The ledger without finished jobs older than days; running ones go back to pending."""
    old = F.col("status").isin("complete", "failed") & (F.col("completed_at") < now - F.make_dt_interval(days=F.lit(days)))
    return jobs.where(~F.coalesce(old, F.lit(False))).withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


def stems_pending(samples: DataFrame, sample_tag: DataFrame, least: float = 5.0) -> DataFrame:
    done = sample_tag.where("tag = 'stems-done'").select(F.col("sample_id").alias("id"))
    return samples.where(F.col("duration").isNull() | (F.col("duration") >= least)).join(done, "id", "left_anti")
