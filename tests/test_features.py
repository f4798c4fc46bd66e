"""Frames, tones, tempo, loops, splits and vectors against plain numpy, with blocks of several sizes and short tails."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundframe.operators import features as T
from soundframe.operators import signal as S
from soundframe.sources import audio
from soundframe.sources import wav as files_of


def clips(spark, signals, size):
    rows = [(c, i // size, x[i : i + size].tolist()) for c, x in signals.items() for i in range(0, len(x), size)]
    return spark.createDataFrame(rows, "clip_id string, block long, pcm array<double>").repartition(3)


def plain_frames(x, n_fft, hop, center=True):
    x = np.pad(x, n_fft // 2) if center else x
    return [x[i : i + n_fft] for i in range(0, len(x) - n_fft + 1, hop)]


@pytest.mark.parametrize("size,n_fft,hop,center", [(64, 64, 32, True), (50, 128, 32, True), (1000, 128, 100, True), (37, 64, 48, False), (64, 256, 16, False)])
def test_frames(spark, size, n_fft, hop, center):
    rng = np.random.default_rng(2)
    signals = {f"c{n}": rng.normal(size=n) for n in (1, 5, 63, 64, 65, 200, 1000, 1037)}
    got = {}
    for r in S.frames(clips(spark, signals, size), n_fft, hop, size, center).collect():
        got[r.clip_id, r.frame] = r.pcm
    want = {(c, i): f for c, x in signals.items() for i, f in enumerate(plain_frames(x, n_fft, hop, center))}
    assert set(got) == set(want) and all(np.allclose(got[k], v) for k, v in want.items())


def test_windows():
    for kind in ("hann", "hamming", "blackman", "rect"):
        w = S.window(kind, 9)
        assert np.allclose(w, w[::-1]) and abs(w[4] - 1) < 1e-9
    assert abs(S.window("hamming", 9)[0] - 0.08) < 1e-9


def wav(x, rate, extra=b""):
    body = (x * 32767).astype("<i2").tobytes()
    chunks = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + extra + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def test_from_files_to_features(spark, tmp_path):
    rate = 22050
    t = np.arange(rate * 2) / rate
    (tmp_path / "a.wav").write_bytes(wav(0.5 * np.sin(2 * np.pi * 440 * t), rate, b"LIST" + struct.pack("<I", 200) + b"x" * 200))
    (tmp_path / "b.wav").write_bytes(wav(0.5 * np.sign(np.sin(2 * np.pi * 2000 * t[:30001])), rate))
    files = audio.scan_audio(spark, str(tmp_path))
    info = {r.path[-5:]: r for r in files_of.wav_info(files).collect()}
    assert abs(info["a.wav"].duration - 2) < 1e-9 and (info["a.wav"].sample_rate, info["a.wav"].channels, info["a.wav"].bit_depth) == (rate, 1, 16)
    b = S.clip_blocks(files_of.decode_wav_blocks(files, 5000)).select(F.substring("clip_id", -5, 5).alias("clip_id"), "block", "pcm")
    got = {r.clip_id: r for r in T.analyze(b, rate, 5000).collect()}
    assert abs(got["a.wav"].peak_db + 6.02) < 0.1 and abs(got["a.wav"].crest_factor - 3.01) < 0.1 and 400 < got["a.wav"].centroid < 600 and got["a.wav"].key == "A"
    assert got["b.wav"].errors == [] and 2000 < got["b.wav"].centroid < 6000
    v = {r.clip_id: np.array(r.v) for r in T.clip_vectors(b, rate, 5000).collect()}
    assert all(len(x) == 48 and abs(np.linalg.norm(x) - 1) < 1e-9 for x in v.values())
    again = {r.clip_id: np.array(r.v) for r in T.clip_vectors(S.clip_blocks(files_of.decode_wav_blocks(files, 7001)).select(F.substring("clip_id", -5, 5).alias("clip_id"), "block", "pcm"), rate, 7001).collect()}
    assert all(np.allclose(v[k], again[k], atol=1e-6) for k in v)
    names = {r.clip_id: r for r in T.naming_features(b, rate, 5000).collect()}
    assert abs(names["a.wav"].rms - 0.5 / np.sqrt(2)) < 0.01 and abs(names["a.wav"].dur_s - 2) < 1e-6 and 0.03 < names["a.wav"].zcr < 0.05


def clicks(rate, seconds, every, start=0.25):
    x = np.zeros(int(rate * seconds))
    for t in np.arange(start, seconds, every):
        x[int(t * rate) : int(t * rate) + 200] = np.hanning(200) * 0.9
    return x


def test_tempo_beats_and_onsets(spark):
    rate = 22050
    b = clips(spark, {"fast": clicks(rate, 8, 0.5), "slow": clicks(rate, 8, 0.8), "tiny": np.zeros(900)}, 4096)
    env = S.onset_envelope(S.analysed(b, {}, 2048, 512, 4096, rise=True))
    bpm = {r.clip_id: r for r in T.tempo(env, rate / 512).collect()}
    assert set(bpm) == {"fast", "slow"} and abs(bpm["fast"].bpm - 120) < 6 and abs(bpm["slow"].bpm - 75) < 4 and 0 < bpm["fast"].confidence <= 1
    at = sorted(r.frame for r in T.beats(env, T.tempo(env, rate / 512), rate / 512).where("clip_id = 'fast'").collect())
    assert 14 <= len(at) <= 17 and np.allclose(np.diff(at) * 512 / rate, 0.5, atol=0.06)
    on = sorted(r.frame for r in S.onsets(env, gap=2, backtrack=True).where("clip_id = 'slow'").collect())
    assert 9 <= len(on) <= 11 and np.allclose(np.diff(on) * 512 / rate, 0.8, atol=0.08)
    e = {(r.clip_id, r.frame): r.env for r in env.collect()}
    for peak, back in zip(sorted(r.frame for r in S.onsets(env, gap=2).where("clip_id = 'slow'").collect()), on):
        low = peak
        for i in range(peak - 1, max(peak - 11, -1), -1):
            low = i if e["slow", i] <= e["slow", low] else low
            if i > 0 and e["slow", i - 1] > e["slow", i]:
                break
        assert back == low


def test_key_of_a_chord(spark):
    rate = 22050
    t = np.arange(rate * 2) / rate
    chord = lambda *fs: sum(np.sin(2 * np.pi * f * t) for f in fs) / len(fs)
    b = clips(spark, {"c": chord(261.63, 329.63, 392.0, 523.25), "am": chord(220, 261.63, 329.63, 440), "none": np.zeros(20000)}, 8000)
    c = T.chroma(S.analysed(b, T.chroma_column(4096, rate), 4096, 512, 8000))
    got = {r.clip_id: r for r in T.keys(c).collect()}
    assert (got["c"].key, got["c"].mode) == ("C", "major") and (got["am"].key, got["am"].mode) == ("A", "minor")
    assert got["c"].confidence > 0.3 and len(got["c"].alternates) == 3 and got["none"].confidence == 0.5
    assert all(len(r.chroma) == 12 and (r.clip_id == "none" or abs(sum(r.chroma) - 1) < 1e-9) for r in c.collect())


def test_loops(spark):
    rate = 8000
    t = np.arange(rate * 2) / rate
    steady, fading = np.sin(2 * np.pi * 100 * t), np.sin(2 * np.pi * 100 * t) * np.linspace(1, 0.001, len(t))
    got = {r.clip_id: r for r in T.loop_quality(clips(spark, {"steady": steady, "fading": fading, "short": steady[:500]}, 3000), rate, 3000, n_fft=1024).collect()}
    assert set(got) == {"steady", "fading"} and got["steady"].quality > 0.9 and got["steady"].is_loopable and got["fading"].amplitude < 0.3
    start, end, aligned, level, alike = T.loop_parts(steady, steady, len(steady), 400, 1024, 1024)
    assert (got["steady"].loop_start, got["steady"].loop_end) == (start, end) and aligned and abs(got["steady"].amplitude - level) < 1e-9 and abs(got["steady"].spectrum - alike) < 1e-9


def test_displays(spark):
    rate, rng = 8000, np.random.default_rng(3)
    x = rng.normal(size=5003) * 0.3
    b = clips(spark, {"x": x, "few": x[:7]}, 640)
    at = sorted((r.bar, r.peak, r.centroid) for r in T.bars(b, 10, rate, 640).where("clip_id = 'x'").collect())
    for k, (bar, peak, centroid) in enumerate(at):
        part = x[k * 500 : (k + 1) * 500 if k < 9 else None]
        assert bar == k and abs(peak - np.abs(part).max()) < 1e-12 and abs(centroid - T.magnitude_centroid(part[:4096], rate)) < 1e-6
    assert [r.centroid for r in T.bars(b, 10, rate, 640).where("clip_id = 'few'").collect()] == [1000.0] * 7
    for scale, height in (("mel", 20), ("linear", 33), ("linear", 20)):
        v = T.spectrogram(b.where("clip_id = 'x'"), rate, 30, height, 640, 64, scale).orderBy("col").collect()
        assert [r.col for r in v] == list(range(30)) and all(len(r.v) == height and min(r.v) >= 0 and max(r.v) <= 1 for r in v)
    w = sorted((r.bar, r.peak, r.centroid) for r in T.frequency_waveform(b.where("clip_id = 'x'"), rate, 25, 640).collect())
    frames = [np.abs(np.fft.rfft(f * S.window("hann", 1024))) for f in plain_frames(x, 1024, 5003 // 25)]
    c = np.array([(m * np.arange(len(m)) * rate / 1024).sum() / m.sum() for m in frames])
    want = np.interp(np.arange(25) * (len(c) - 1) / 24, np.arange(len(c)), c)
    assert np.allclose([r[2] for r in w], want) and np.allclose([r[1] for r in w], [np.abs(x[i * 201 : (i + 1) * 201]).max() if i * 201 < len(x) else 0 for i in range(25)])
    assert len(T.log_spectrum(x[:2048], 64)) == 64 and np.argmax(T.log_spectrum(np.sin(2 * np.pi * 1000 * np.arange(2048) / rate), 64)) == int(np.sqrt(256 / 1024) * 64)


def test_splits(spark):
    rate = 8000
    t = np.arange(rate) / rate
    low, high = np.sin(2 * np.pi * 200 * t), np.sign(np.sin(2 * np.pi * 1500 * t)) * 0.6
    b = clips(spark, {"two": np.r_[low, high], "three": np.r_[low, high, low], "short": low[:100]}, 4000)
    f = T.step_features(b, rate, 512, 256, 4000, 40)
    n = S.lengths(b)
    parts = lambda points: {c: sorted((r.start, r.end) for r in T.chunks(points, n, 256).where(f"clip_id = '{c}'").collect()) for c in ("two", "three", "short")}
    got = parts(T.n_segments(f, 3, 5))
    assert len(got["three"]) == 3 and abs(got["three"][0][1] - rate) < 600 and abs(got["three"][1][1] - 2 * rate) < 600 and got["short"] == [(0, 100)]
    free = parts(T.change_points(f, 10))
    assert len(free["two"]) >= 2 and any(abs(e - rate) < 600 for _, e in free["two"])
    x = np.array([r.f for r in f.where("clip_id = 'two'").orderBy("frame").collect()])
    cost = lambda a: ((a - a.mean(0)) ** 2).sum()
    best = max(range(5, len(x) - 4), key=lambda k: cost(x) - cost(x[:k]) - cost(x[k:]))
    assert [r.frame for r in T.n_segments(f, 2, 5).where("clip_id = 'two'").collect()] == [best]
    grid = [(r.start, r.end) for r in T.beat_chunks(spark.createDataFrame([("m", 64 * 4000)], "clip_id string, len long"), F.lit(120.0), rate, 4, 4).orderBy("part").collect()]
    assert grid == [(0, 64000), (64000, 128000), (128000, 192000), (192000, 256000)]
    whole = T.cut(b, T.chunks(T.n_segments(f, 3, 5), n, 256).where("clip_id = 'three'"), 4000).orderBy("clip_id", "block").collect()
    assert np.allclose(np.concatenate([r.pcm for r in whole]), np.r_[low, high, low])


def test_smoothing_looks_back_far_enough(spark):
    rng = np.random.default_rng(5)
    xs = rng.uniform(-60, 0, 3000)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(xs)], "device_id long, event_id long, peak_db double").withColumn("ts", F.timestamp_seconds("event_id"))
    a = -96.0
    for x in xs:
        a += (x - a) * (0.5 if x > a else 0.1)
    r = S.smooth(df).first()
    assert abs(r.smoothed_db - a) < 1e-9 and r.readings == 3000


@pytest.mark.parametrize("attack,decay", [(0.5, 0.1), (0.4, 0.15), (0.01, 0.9), (1.0, 0.001)])
def test_smoothing_of_each_reading(spark, attack, decay):
    """Every reading's value is that of a walk over all before it, however the readings are cut, with ties, gaps and slow rates."""
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for device, n in ((1, 1), (2, 700), (3, 64), (4, 65)):
        y = -96.0
        for i in range(n):
            x = None if rng.random() < 0.05 else float(rng.choice([-60.0, -20.0, -96.0, rng.uniform(-90, 0)]))
            y += (x - y) * (attack if x > y else decay) if x is not None else 0
            rows.append((device, i, i // 3, x))
            want[device, i] = y
    df = spark.createDataFrame(rows, "device_id long, event_id long, s long, x double").withColumn("ts", F.timestamp_seconds("s")).repartition(5)
    got = {(r.device_id, r.event_id): r.smoothed_x for r in S.smoothed(df, {"x": (attack, decay)}, size=64).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    lo, hi = -96.0, 0.0
    xs = [x for *_, x in rows[:40] if x is not None]
    u, v = S.smoothing_map(xs, attack, decay, lo, hi)
    for y in np.linspace(lo, hi, 50):
        z = y
        for x in xs:
            z += (x - z) * (attack if x > z else decay)
        assert abs(np.interp(y, u, v) - z) < 1e-9


def beats_by_walking(e, period, strong=0.3):
    found, due = [], int(np.argmax(e > strong))
    while due < len(e):
        lo, hi = max(due - period // 4, 0), min(due + period // 4, len(e) - 1)
        near = lo + int(np.argmax(e[lo : hi + 1]))
        found.append(near if e[near] > e[due] else due)
        due = found[-1] + period
    return found


@pytest.mark.parametrize("size", [8, 40, 4096])
def test_beats_in_blocks(spark, size):
    rng = np.random.default_rng(size)
    envs = {f"c{k}": np.round(rng.random(n) ** 3, 1 + k % 3) for k, n in enumerate((1, 3, 8, 9, 17, 40, 41, 200, 333, 500, 77, 1000))}
    envs |= {"still": np.zeros(300), "late": np.r_[np.zeros(170), 1.0, rng.random(60)], "end": np.r_[np.zeros(99), 1.0]}
    bpm = {c: float(rng.choice([60, 75, 120, 200, 33])) for c in envs}
    env = spark.createDataFrame([(c, i, float(v)) for c, x in envs.items() for i, v in enumerate(x)], "clip_id string, frame long, env double").repartition(4)
    tempos = spark.createDataFrame(list(bpm.items()), "clip_id string, bpm double")
    got = {}
    for r in T.beats(env, tempos, 20.0, size=size).collect():
        got.setdefault(r.clip_id, []).append(r.frame)
    assert {c: sorted(x) for c, x in got.items()} == {c: beats_by_walking(x, T.lag_of(bpm[c], 20.0)) for c, x in envs.items()}


@pytest.mark.parametrize("size,n_fft,hop,center", [(64, 64, 32, True), (50, 128, 32, True), (1000, 128, 100, True), (37, 64, 48, False), (64, 256, 16, False), (4000, 64, 7, True), (40, 32, 90, False)])
def test_frames_analysed_in_blocks(spark, size, n_fft, hop, center):
    """Levels, tones, bands and flux are those of plain frames, wherever blocks are cut."""
    rng, rate = np.random.default_rng(6), 8000
    signals = {f"c{n}": rng.normal(size=n) * (rng.random(n) < 0.7) for n in (1, 5, 63, 64, 65, 200, 1000, 1037)} | {"still": np.zeros(300)}
    columns = S.LEVEL | S.tones(rate / n_fft) | T.mel_column(n_fft, rate, 6) | T.chroma_column(n_fft, rate)
    got = {(r.clip_id, r.frame): r for r in S.analysed(clips(spark, signals, size), columns, n_fft, hop, size, center, rise=True).collect()}
    count = 0
    for c, x in signals.items():
        frames = plain_frames(x, n_fft, hop, center)
        power = [np.abs(np.fft.rfft(f * S.window("hann", n_fft))) ** 2 for f in frames]
        count += len(frames)
        for i, (f, p) in enumerate(zip(frames, power)):
            r, k = got[c, i], np.arange(len(p)) * rate / n_fft
            assert abs(r.rms - np.sqrt(np.mean(f * f))) < 1e-12 and abs(r.m0 - p.sum()) < 1e-9 and np.allclose(r.mel, T.mel_weights(6, n_fft, rate) @ p) and np.allclose(r.chroma, p @ T.pitch_classes(n_fft, rate))
            assert abs(r.centroid - ((p * k).sum() / p.sum() if p.sum() > 0 else 0)) < 1e-6
            assert r.rise is None if i == len(frames) - 1 else abs(r.rise - np.maximum(power[i + 1] - p, 0).sum()) < 1e-9 * max(1, p.sum())
    assert len(got) == count


def test_autocorrelation_in_blocks(spark):
    rng = np.random.default_rng(7)
    clips_of = {"a": rng.random(1000), "b": rng.random(30), "c": np.zeros(50), "d": np.r_[np.zeros(90), 1.0]}
    env = spark.createDataFrame([(c, i, float(v)) for c, x in clips_of.items() for i, v in enumerate(x)], "clip_id string, frame long, env double").repartition(4)
    for size in (16, 97, 4096):
        got = {(r.clip_id, r.lag): r.r for r in S.tempo_lags(env, 3, 40, size).collect()}
        assert len(got) == 4 * 38
        for (c, lag), r in got.items():
            x = clips_of[c]
            assert r is None if not x.any() else abs(r - (x[:-lag] * x[lag:]).sum() / (x * x).sum()) < 1e-9 if lag < len(x) else abs(r) < 1e-9


def test_places_by_counting(spark):
    """Values by their place, with ties, tiny and huge numbers, one value and none."""
    rng = np.random.default_rng(8)
    clips_of = {"a": rng.random(500), "ties": rng.choice([0.25, 0.5, 0.75], 90), "one": np.array([3.5]), "far": np.array([5e-324, 1e-300, 1e300, 1.7e308, 2.0]), "none": np.zeros(4), "same": np.full(40, 0.1)}
    df = spark.createDataFrame([(c, float(v)) for c, x in clips_of.items() for v in x], "clip_id string, rms double").repartition(5)
    ask = {"first": lambda n: F.lit(1), "mid": lambda n: F.floor(n / 2) + 1, "last": lambda n: n}
    got, few = ({r.clip_id: (r["first"], r["mid"], r["last"]) for r in S.ranked(df, "rms", ask, bins).collect()} for bins in (1 << 16, 1 << 10))
    want = {c: (np.sort(x)[0], np.sort(x)[len(x) // 2], np.sort(x)[-1]) for c, x in clips_of.items() if x.any()}
    assert got == want == few


@pytest.mark.parametrize("size", [7, 64, 4096])
def test_segments_by_sums_of_blocks(spark, size):
    """Splits are those that a search over all places finds, however frames are cut into blocks."""
    rng = np.random.default_rng(12)
    clips_of = {f"c{n}": np.cumsum(rng.normal(size=(n, 2)) * (rng.random((n, 1)) < 0.1), 0) + rng.normal(size=(n, 2)) * 0.1 + 50 for n in (5, 8, 30, 99, 200)}
    f = spark.createDataFrame([(c, i, v.tolist()) for c, x in clips_of.items() for i, v in enumerate(x)], "clip_id string, frame long, f array<double>").repartition(3)
    got = {}
    for r in T.n_segments(f, 4, 4, size).collect():
        got.setdefault(r.clip_id, set()).add(r.frame)
    cost = lambda x: ((x - x.mean(0)) ** 2).sum()
    want = {}
    for c, x in clips_of.items():
        parts = [(0, len(x))] if len(x) >= 8 else []
        for _ in range(3):
            options = [(cost(x[a:b]) - cost(x[a:k]) - cost(x[k:b]), -k, a, b) for a, b in parts for k in range(a + 4, b - 3)]
            if options:
                _, k, a, b = max(options)
                parts = [p for p in parts if p != (a, b)] + [(a, -k), (-k, b)]
                want.setdefault(c, set()).add(-k)
    assert got == want
