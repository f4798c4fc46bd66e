"""WAV files by byte ranges, ids of large tables, silence cuts and presets."""

import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundframe.operators import catalog, maintain, signal
from soundframe.sources import audio, wav


def head(size, channels=1, rate=8000, bits=16, kind=1, extra=b""):
    fmt = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    if kind == wav.EXTENDED:
        fmt += struct.pack("<HHIH", 22, bits, 0, 3) + b"x" * 14
    return b"RIFF" + struct.pack("<I", 36 + len(extra) + min(size, 2**31)) + b"WAVE" + extra + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", size)


def encoded(x, bits, kind):
    """Frames of x (frames, channels) as a file's bytes."""
    if kind != 1:
        return x.astype(f"<f{bits // 8}").tobytes()
    if bits == 8:
        return np.round(x * 127 + 128).astype(np.uint8).tobytes()
    if bits == 24:
        return b"".join(int(v).to_bytes(3, "little", signed=True) for v in np.round(x * (2**23 - 1)).ravel())
    return np.round(x * (2 ** (bits - 1) - 1)).astype(f"<i{bits // 8}").tobytes()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("sounds"), np.random.default_rng(1)
    sounds = {}
    for bits, kind in ((8, 1), (16, 1), (24, 1), (32, 1), (32, 3), (64, 3), (32, wav.EXTENDED)):
        for channels in (1, 3):
            x = rng.uniform(-0.9, 0.9, (2500, channels))
            body = encoded(x, bits, kind)
            name = f"k{kind}b{bits}c{channels}.wav"
            (root / name).write_bytes(head(len(body), channels, 8000, bits, kind, b"LIST" + struct.pack("<I", 301) + b"y" * 302 if bits == 16 else b"") + body + b"tail")
            sounds[name] = x.mean(1)
    (root / "open.wav").write_bytes(head(wav.UNKNOWN) + b"\0\0" * 1500)  # the size is not known
    (root / "cut.wav").write_bytes(head(9000) + b"\0\0" * 100 + b"\0")  # fewer bytes than the header says
    (root / "nodata.wav").write_bytes(head(0))
    (root / "nofmt.wav").write_bytes(b"RIFF" + struct.pack("<I", 60) + b"WAVE" + b"data" + struct.pack("<I", 40) + b"z" * 40)
    (root / "junk.wav").write_bytes(b"j" * 100)
    (root / "deep").mkdir()
    (root / "deep" / "short.WAV").write_bytes(b"RIFF")
    return root, sounds | {"open.wav": np.zeros(1500), "cut.wav": np.zeros(100)}


def joined(blocks):
    out = {}
    for r in sorted(blocks.collect(), key=lambda r: (r.path, r.block_idx)):
        assert r.start_sample == len(out.setdefault(r.path.rpartition("/")[2], []))
        out[r.path.rpartition("/")[2]] += r.pcm
    return out


def test_blocks_by_ranges(spark, folder):
    root, sounds = folder
    files = audio.scan_audio(spark, str(root))
    wav.register(spark)
    read = spark.read.format("wav").option("block", 700).option("split", 5000).load(str(root))
    assert read.rdd.getNumPartitions() > 20
    for got in (joined(wav.decode_wav_blocks(files, 700, 5000)), joined(read)):
        assert set(got) == set(sounds)
        for name, x in sounds.items():
            assert len(got[name]) == len(x) and np.allclose(got[name], x, atol=0.02 if "b8" in name else 1e-4), name
    assert wav.decode_wav_blocks(files.limit(0)).count() == 0


def test_headers_alone(spark, folder):
    root, _ = folder
    files = audio.scan_audio(spark, str(root))
    info = {r.path.rpartition("/")[2]: r for r in wav.wav_info(files).collect()}
    assert (info["k1b24c3.wav"].channels, info["k1b24c3.wav"].sample_rate, info["k1b24c3.wav"].bit_depth) == (3, 8000, 24)
    assert all(abs(info[f"k1b{b}c1.wav"].duration - 2500 / 8000) < 1e-9 for b in (8, 16, 24, 32)) and info["nofmt.wav"].duration is None
    assert "content" not in wav.wav_info(files)._jdf.queryExecution().executedPlan().toString()
    status = {r.path.rpartition("/")[2]: r.status for r in wav.orphans(files, files.where("path like '%b8c1%'")).collect()}
    assert {n for n, s in status.items() if s == "invalid"} == {"nofmt.wav", "junk.wav", "short.WAV"} and "k1b8c1.wav" not in status


def test_a_recording_of_three_gigabytes(spark, tmp_path):
    """A sparse file: its blocks are decoded by many tasks, the last ones too, and its header costs nothing."""
    path, frames = tmp_path / "long.wav", 94_000_000
    first = head(frames * 32, 8, 48000, 32, 3)
    with open(path, "wb") as f:
        f.write(first)
        f.truncate(len(first) + frames * 32)
        f.seek(len(first) + (frames - 1) * 32)
        f.write(np.ones(8, "<f4").tobytes())
    files = audio.scan_audio(spark, str(path))
    began = time.time()
    assert abs(wav.wav_info(files).first().duration - frames / 48000) < 1e-6 and time.time() - began < 20
    b = wav.decode_wav_blocks(files).select("block_idx", F.size("pcm").alias("n"), F.element_at("pcm", -1).alias("last"), F.spark_partition_id().alias("task"))
    r = b.agg(F.sum("n").alias("n"), F.max("block_idx").alias("idx"), F.count_distinct("task").alias("tasks"), F.max_by("last", "block_idx").alias("last"), F.count("*").alias("rows")).first()
    assert (r.n, r.idx, r.rows, r.last) == (frames, -(-frames // wav.BLOCK) - 1, -(-frames // wav.BLOCK), 1.0) and r.tasks > 16


@pytest.mark.parametrize("rows", [200_000, 1_500_000])
def test_ids_of_many_rows(spark, rows):
    """Every new row is there once, under ids that are dense, whatever columns come along."""
    files = spark.range(rows, numPartitions=6).select(F.concat(F.lit("/f/"), F.md5(F.col("id").cast("string"))).alias("path"), (F.col("id") % 977).alias("length"))
    known = spark.createDataFrame([(41, "/old.wav")], "id long, path string")

    def dense(new, first=42, n=rows):
        r = new.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count_distinct("path").alias("paths")).first()
        assert tuple(r) == (n, n, first, first + n - 1, n)

    out = maintain.ingest(known, files)
    assert out.columns == ["path", "length", "id", "source_type"]
    dense(out)
    if rows < 1_000_000:
        ordered = out.orderBy("id").select("path", "length").limit(500).collect()
        assert [r.path for r in ordered] == sorted(r.path for r in ordered)
        samples = known.withColumns({"pack_id": F.lit(1).cast("long"), "source_type": F.lit("imported"), "duration": F.lit(9.0)})
        tags = spark.createDataFrame([(41, "session:1")], "sample_id long, tag string")
        stems = files.select(F.lit(41).cast("long").alias("parent_id"), F.lit("bass").alias("role"), "path")
        s, t = maintain.register_stems(samples, tags, stems)
        dense(s.where("source_type = 'stem'"))
        assert t.where("tag = 'parent:41'").select("sample_id").distinct().count() == rows
        jobs = spark.createDataFrame([], "id long, sample_id long, job_type string, priority int, status string, created_at timestamp")
        rec = files.select("path", F.lit(9.0).alias("duration"), F.array(F.lit("a")).alias("tags"), F.array(F.lit("b")).alias("model_tags"), F.lit("session:1").alias("session_tag"), F.lit(True).alias("stems"))
        s, _, j = maintain.save_recordings(samples, tags, jobs, rec, 7, F.current_timestamp())
        dense(s.where("source_type = 'recorded'"))
        assert j.groupBy("job_type").agg(F.count_distinct("sample_id").alias("n")).where(F.col("n") == rows).count() == 2
        parts = spark.range(rows, numPartitions=6).select(F.lit(41).cast("long").alias("clip_id"), F.col("id").cast("int").alias("part"), F.col("id").alias("start"), (F.col("id") + 5).alias("end"))
        s, _ = maintain.split_clips(samples, tags, parts, 8.0)
        s = s.where("source_type = 'recorded'")
        assert s.count() == s.select("id").distinct().count() == rows


def silence_by_hand(x, frame, hop, threshold_db, silence, least):
    quiet = [np.sqrt(np.mean(x[i : i + frame] ** 2)) < 10 ** (threshold_db / 20) for i in range(0, len(x) - frame + 1, hop)]
    cuts, begin, start = [], None, 0
    for k, q in enumerate(quiet):
        if q and begin is None:
            begin = k
        if not q and begin is not None:
            if k - begin >= silence:
                cuts.append((start, begin * hop))
                start = k * hop
            begin = None
    found = [(a, b) for a, b in [*cuts, (start, len(x))] if b > a and b - a >= least]
    return found or ([(0, len(x))] if len(x) >= max(least, 1) else [])


def test_silence_at_all_places(spark):
    loud, still = np.ones(640) * 0.5, np.zeros(640)
    shapes = {"tail": [loud, still], "head": [still, loud], "mid": [loud, still, loud], "silent": [still, still], "loud": [loud], "short": [loud[:90]], "tiny": [loud[:300]], "gaps": [loud, still, loud[:64], still, loud, still[:64], loud], "flick": [still, loud[:70], still]}
    clips = {k: np.concatenate(v) for k, v in shapes.items()}
    b = spark.createDataFrame([(k, i // 64, x[i : i + 64].tolist()) for k, x in clips.items() for i in range(0, len(x), 64)], "clip_id string, block long, pcm array<double>")
    got = {}
    for r in signal.silence_segments(signal.frame_levels(signal.frames(b, 64, 32, 64, False)), signal.lengths(b), 32, -40.0, 4, 100).orderBy("clip_id", "part").collect():
        assert r.part == len(got.setdefault(r.clip_id, []))
        got[r.clip_id].append((r.start, r.end))
    want = {k: silence_by_hand(x, 64, 32, -40.0, 4, 100) for k, x in clips.items()}
    assert got == {k: v for k, v in want.items() if v} and want["tail"] == [(0, 1280)] and want["silent"] == [(0, 1280)] and "short" not in got


def test_backslashes_in_a_search(spark):
    df = spark.createDataFrame([(1, "/a\\b_c.wav"), (2, "/ab.wav"), (3, "/A\\Bxc.wav")], "id long, path string")
    found = lambda q: sorted(r.id for r in catalog.search(df, None, query=q).collect())
    assert found("a\\b") == [1, 3] and found("\\") == [1, 3] and found("b_c") == [1, 3] and found("a\\\\b") == [] and found("b.w") == [2]
