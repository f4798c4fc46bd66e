"""Sources, maintenance, rules and streams on small data made here."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundframe.functions import music, rules, text
from soundframe.operators import catalog, edges, maintain, signal
from soundframe.sources import audio, wav
from soundframe.streaming import jobs


def wav_bytes(x, rate=8000, channels=1, bits=16):
    body = (np.repeat(x, channels) * (2 ** (bits - 1) - 1)).astype(f"<i{bits // 8}").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits, b"data", len(body))
    return head + body


@pytest.fixture
def folder(tmp_path):
    x = 0.5 * np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.wav").write_bytes(wav_bytes(x))
    (tmp_path / "sub" / "b.WAV").write_bytes(wav_bytes(x, channels=2))
    (tmp_path / "bad.wav").write_bytes(b"x" * 100)
    (tmp_path / "short.wav").write_bytes(b"x" * 30)
    (tmp_path / "note.txt").write_text("no")
    return tmp_path


def test_wav_files(spark, folder):
    files = audio.scan_audio(spark, str(folder))
    assert files.count() == 4
    info = {r.path.rpartition("/")[2]: r for r in wav.wav_info(files).collect()}
    assert (info["b.WAV"].channels, info["b.WAV"].sample_rate, info["b.WAV"].bit_depth) == (2, 8000, 16)
    assert abs(info["a.wav"].duration - 1) < 1e-6 and info["bad.wav"].channels is None
    blocks = wav.decode_wav_blocks(files, 1000)
    assert blocks.where("path like '%/a.wav'").count() == 8
    peak = blocks.select(F.max(F.array_max("pcm"))).first()[0]
    assert abs(peak - 0.5) < 0.01
    status = {r.path.rpartition("/")[2]: r.status for r in wav.orphans(files, files.where("path like '%b.WAV'")).collect()}
    assert status == {"a.wav": "valid", "bad.wav": "invalid", "short.wav": "invalid"}


def test_watch_folder_appends_once(spark, folder, tmp_path_factory):
    catalogue, point = (str(tmp_path_factory.mktemp(n)) for n in ("catalogue", "point"))
    spark.createDataFrame([(7, "/old.wav", 1, "imported")], "id bigint, path string, length bigint, source_type string").write.mode("append").parquet(catalogue)
    for _ in range(2):
        jobs.watch_folder(spark, str(folder), catalogue, point).awaitTermination(60)
    got = spark.read.parquet(catalogue).orderBy("id").collect()
    assert [r.id for r in got] == [7, 8, 9, 10, 11] and got[1].source_type == "watched"


def test_rules_keep_their_bands(spark):
    columns = "rms_db double, crest_factor double, dynamic_range double, clipping_detected boolean, loop_quality double, is_loopable boolean, spectral_centroid double, spectral_flatness double, duration double, sample_rate int"
    best = (-18.0, 9.0, 15.0, False, 80.0, None, 3000.0, 0.45, 2.0, 44100)
    df = spark.createDataFrame([best, (*best[:3], True, *best[4:]), (None,) * 10], columns)
    a, b, c = df.select(*[v.alias(k) for k, v in rules.applicability().items()]).collect()
    assert a.quality > 90 and a.spectral > 90 and a.usability > 90 and a.total > 80 and b.quality < 90
    assert (c.quality, c.loop_score, c.spectral, c.usability) == (50, 50, 50, 50)


def test_keys_and_tempo(spark):
    df = spark.createDataFrame([("Am", "Am", 120.0, 120.0), ("Am", "C", 120.0, 60.0), ("Am", "F#m", 120.0, 90.0), ("bb min", "Bbm", 0.0, 5.0), (None, "C", None, 1.0)], "ka string, kb string, ba double, bb double")
    df = df.withColumns(music.key_facts(F.col("ka"), "a_") | music.key_facts(F.col("kb")))
    got = df.select(music.key_part().alias("k"), music.bpm_part(F.col("ba"), F.col("bb")).alias("b")).collect()
    assert [(r.k, r.b) for r in got] == [(1.0, 1.0), (0.95, 0.9), (0.3, 0.2), (1.0, 0.2), (0.5, 0.5)]


def test_names(spark):
    df = spark.createDataFrame([("**My  Pad!**\nmore", "take_20240102_030405", "é?")], "a string, b string, c string")
    r = df.select(text.sanitize_text(F.col("a")), text.timestamp_suffix(F.col("b")), text.sanitize_name(F.col("c"))).first()
    assert tuple(r) == ("my-pad", "20240102_030405", "recording")


def test_paths(spark):
    df = spark.createDataFrame([(".hidden.wav",), ("x.tmp",), ("_t.wav",), ("ok.wav",)], "n string")
    assert [r.n for r in df.where(~catalog.excluded(F.col("n"), catalog.DEFAULT_EXCLUDES)).collect()] == ["ok.wav"]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, name string, version int")
    new = spark.createDataFrame([(2, "B", 2), (3, "c", 1)], "id long, name string, version int")
    assert {tuple(r) for r in maintain.upsert_latest(old, new, "id", "version").collect()} == {(1, "a", 1), (2, "B", 2), (3, "c", 1)}
    names = {r.name: r.id for r in maintain.upsert_names(old.select("id", "name"), new.select("name")).collect()}
    assert names == {"a": 1, "b": 2, "B": 3, "c": 4}


def test_sine_and_silence(spark):
    n = np.arange(640 * 4)
    tone = 0.5 * np.sin(2 * np.pi * 80 * n / 640)
    x = np.concatenate([tone[:1280], np.zeros(640), tone[:1280]])
    rows = [(0, i, x[i * 64 : i * 64 + 64].tolist()) for i in range(len(x) // 64)]
    b = signal.blocks(spark.createDataFrame(rows, "clip_id long, vec_id long, pcm array<double>"))
    f = signal.frames(b, 64, 32, 64)
    p = signal.power(f)
    top = p.where("frame = 5").select(F.array_position("power", F.array_max("power"))).first()[0]
    assert top == 9  # bin 8 is 80 Hz
    q = signal.quality(b).first()
    assert abs(q.peak_db + 6.02) < 0.1 and not q.clipping_detected
    levels = signal.frame_levels(signal.frames(b, 64, 32, 64, False))
    parts = [(r.part, r.start, r.end) for r in signal.silence_segments(levels, signal.lengths(b), 32, -40.0, 5, 100).orderBy("part").collect()]
    assert parts == [(0, 0, 1280), (1, 1888, 3200)]


def played(spark, df, f, path, mode="append"):
    """The rows that a stream gives for df, which comes as one file per minute of ts, in order."""
    for k, part in enumerate(sorted(r.m for r in df.select(F.date_trunc("minute", "ts").alias("m")).distinct().collect())):
        df.where(F.date_trunc("minute", "ts") == F.lit(part)).coalesce(1).write.mode("append").parquet(f"{path}/{k:03d}")
    stream = f(spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path))
    name = "out_" + str(abs(hash(path)))
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    return [tuple(r) for r in spark.sql(f"select * from {name}").collect()]


def readings(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)), 4.0 * i + float(rng.uniform(0, 3)), float(rng.uniform(-60, 0))) for i in range(80)]
    return spark.createDataFrame(rows, "event_id long, device_id long, s double, peak_db double").select("event_id", "device_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), "peak_db")


def test_streams_give_what_their_batch_twins_give(spark, tmp_path):
    df = readings(spark)
    plain = lambda d: sorted(tuple(r) for r in d.collect())
    got = played(spark, df, lambda s: jobs.level_takes(s, -20.0, "9 seconds", "1 second"), str(tmp_path / "takes"))
    want = plain(jobs.session_takes(df, -20.0, "9 seconds"))
    assert set(got) <= set(want) and len(got) > len(want) / 2  # sessions that are still open are not given out
    got = played(spark, df, lambda s: jobs.chunk_peaks(s, "20 seconds", "1 second"), str(tmp_path / "peaks"))
    assert got and set(got) <= set(plain(jobs.chunk_peaks(df, "20 seconds")))
    first = catalog.first_of_bursts(df, "device_id", 12).select("device_id", "event_id", "ts")
    assert sorted(played(spark, df, lambda s: jobs.debounce(s, "device_id", 12), str(tmp_path / "bursts"))) == plain(first)
    states = df.select(F.col("device_id").alias("job_id"), F.col("event_id").cast("string").alias("status"), "ts")
    last = {}
    for job, status, ts in played(spark, states, jobs.latest_status, str(tmp_path / "jobs"), "update"):
        last[job] = (job, status, ts)
    assert sorted(last.values()) == plain(jobs.latest_status(states))
    levels = {}
    for device, value, n in played(spark, df, jobs.smooth_levels, str(tmp_path / "levels"), "update"):
        levels[device] = max(levels.get(device, (0, 0)), (n, value))
    assert {k: (n, round(v, 9)) for k, (n, v) in levels.items()} == {r.device_id: (r.readings, round(r.smoothed_db, 9)) for r in signal.smooth(df).collect()}


def test_names_of_recordings(spark):
    from soundframe.operators import naming

    label = "array<struct<label:string,confidence:double>>"
    rows = [
        (1, "/r/a.wav", [("kick", 0.9), ("loop", 0.3), ("x", 0.1)], None, None, 0.2, 300.0, 0.1, 0.4, 0.0, 119.6, "Am"),
        (2, "/r/b.wav", None, "the quick brown fox jumps", None, 0.1, 1000.0, 0.1, 2.0, 0.0, None, None),
        (3, "/r/c.wav", [("speech", 0.8)], "hello world again", "world-anthem", 0.1, 1000.0, 0.1, 2.0, 0.0, None, "F# m"),
        (4, "/r/d.wav", [("kick", 0.1)], None, None, 0.1, 400.0, 0.01, 2.0, 0.0, 0.0, None),
        (5, "/r/e.wav", None, "unheard words here", None, None, None, None, None, None, None, "?"),
    ]
    df = spark.createDataFrame(rows, f"id long, path string, labels {label}, transcript string, refined string, rms double, centroid double, zcr double, dur_s double, tempo double, bpm double, key string")
    got = {r.id: r for r in naming.name_recordings(df).collect()}
    assert got[1].method == "labels" and got[1].stem.endswith("-kick_120bpm_Am") and got[1].tags == ["kick", "loop"]
    assert (got[2].method, got[2].stem, got[2].tags) == ("transcription", "quick-brown-fox", ["vocal"])
    assert (got[3].method, got[3].stem, got[3].tags, got[3].alternative) == ("llm", "world-anthem_Fm", ["speech"], "hello-world-again")
    assert got[4].method == "heuristic" and got[4].stem.endswith("-bass") and got[5].method == "seed" and got[5].tags == []


def test_notes_and_purposes_of_pairs(spark):
    clip = "id long, key string, bpm double, spectral_centroid double, spectral_bandwidth double, crest_factor double"
    df = spark.createDataFrame([(1, "Am", 120.0, 300.0, 100.0, 14.0), (2, "C", 60.0, 5000.0, 100.0, 5.0), (3, None, None, None, None, None)], clip)
    got = {r.id: r for r in catalog.compatible(df.where("id = 1"), df, notes=True).collect()}
    assert got[2].notes == ["relative key", "related tempo", "well apart in frequency", "one punchy, one sustained"] and got[3].notes == [] and abs(got[3].score - 0.5) < 1e-9
    melodic = catalog.compatible(df.where("id = 1"), df, parts=catalog.PURPOSES["melodic"]).where("id = 2").first()
    assert abs(melodic.score - (0.95 + 0.9) / 2) < 1e-9


def test_places_in_large_groups(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, 1).alias("g"), (F.col("id") * 37 % 101).alias("v")).repartition(7)
    got = sorted((r.g or 0, r.place, r.id) for r in catalog.places(df, ["g"], [F.col("v"), F.col("id")], "place").collect())
    want = sorted((g, p + 1, i) for g in (0, 1) for p, (_, i) in enumerate(sorted((i * 37 % 101, i) for i in range(500) if (i % 3 > 0) == bool(g))))
    assert got == want


def test_presets_and_upkeep(spark):
    p = spark.createDataFrame([(1, "b", 2, True), (2, "a", 2, False), (3, "c", 1, False)], "id long, name string, sort_order int, is_system boolean")
    assert [r.id for r in catalog.ordered_presets(p).collect()] == [3, 2, 1]
    assert sorted(r.id for r in maintain.remove_presets(p, p.where("id < 3").select("id")).collect()) == [1, 3]
    s = spark.createDataFrame([(1, "x"), (2, None)], "id long, sample_type string")
    assert maintain.touched(s, s.where("id = 2").select("id"), sample_type="y") == 1 and maintain.touched(s, s.select("id")) == 0
    with pytest.raises(ValueError):
        catalog.apply_preset(s, None, spark.createDataFrame([("a", "{}")], "name string, filters string"), "b")


def test_embeddings_from_blobs(spark):
    x = np.array([0.0, -1.5, 3.25e-40, 1e30, 1 / 3], "<f4")
    df = spark.createDataFrame([(1, bytearray(x.tobytes() + b"ab")), (2, None), (3, bytearray(b""))], "sample_id long, blob binary")
    got = {r.sample_id: r.embedding for r in audio.embeddings_from_blob(df).collect()}
    assert np.allclose(np.array(got[1], "f4"), x, rtol=1e-6) and got[2] is None and got[3] == []


def test_neighbours_within_radius(spark):
    rng = np.random.default_rng(1)
    pts = [(i, *map(float, p)) for i, p in enumerate(rng.uniform(-6, 6, (80, 3)))]
    df = spark.createDataFrame(pts, "id long, x double, y double, z double")
    got = {(r.a_id, r.id) for r in edges.radius_neighbours(df).collect()}
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] != b[0] and sum((p - q) ** 2 for p, q in zip(a[1:], b[1:])) <= 9}
    assert got == want


def test_tables_are_replaced_by_folder(spark, tmp_path):
    from soundframe.sources import tables

    df = spark.range(10).select("id", (F.col("id") % 3).alias("k"))
    tables.save(df, str(tmp_path), "t", ("k",))
    tables.save(df.where("k = 1").select((F.col("id") + 100).alias("id"), "k"), str(tmp_path), "t", ("k",))
    got = sorted((r.id, r.k) for r in tables.load(spark, str(tmp_path), "t").collect())
    assert got == sorted([(i, i % 3) for i in range(10) if i % 3 != 1] + [(i + 100, 1) for i in range(10) if i % 3 == 1])
