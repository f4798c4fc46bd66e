"""Mel bands, chroma, keys, tempo, beats, loops, displays and clip vectors, from the blocks and frames of signal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundframe.operators import signal as S
from soundframe.operators.stored import stored

#: The Krumhansl-Kessler weights of pitch classes from the tonic, and the names of the twelve tonics.
MAJOR_WEIGHTS = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR_WEIGHTS = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
TONICS = ["C", "C#", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B"]


def mel_weights(n_mels: int, n_fft: int, rate: float, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Triangular bands, evenly spaced in mel (HTK), as a matrix with a row per band and a column per bin."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(to_mel(low), to_mel(rate / 2 if high is None else high), n_mels + 2) / 2595) - 1) * n_fft / rate
    left, mid, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    k = np.arange(n_fft // 2 + 1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        up, down = (k - left) / (mid - left), (right - k) / (right - mid)
    return np.where((k >= left) & (k <= mid) & (mid > left), up, np.where((k > mid) & (k <= right) & (right > mid), down, 0.0))


def mel(power: DataFrame, n_fft: int, rate: float, n_mels: int = 128, low: float = 0.0, high: float | None = None) -> DataFrame:
    w = mel_weights(n_mels, n_fft, rate, low, high).T
    return S.kernel(power, "power", lambda p: p @ w, "mel")


def cosines(x: np.ndarray, n: int) -> np.ndarray:
    """Orthonormal cosine transform (type II) of the log bands, its first n coefficients."""
    m = x.shape[1]
    basis = np.cos(np.pi / m * (np.arange(m)[:, None] + 0.5) * np.arange(n)[None, :]) * np.where(np.arange(n) == 0, np.sqrt(1 / m), np.sqrt(2 / m))
    return np.log(x + 1e-10) @ basis


def mfcc(mel: DataFrame, n: int = 13) -> DataFrame:
    return S.kernel(mel, "mel", lambda x: cosines(x, n), "mfcc")


def mel_column(n_fft: int, rate: float, n_mels: int = 128) -> S.Columns:
    w = mel_weights(n_mels, n_fft, rate).T
    return {"mel": ("array<double>", lambda _, p: p @ w)}


def mfcc_column(n_fft: int, rate: float, n_mels: int = 128, n: int = 13) -> S.Columns:
    w = mel_weights(n_mels, n_fft, rate).T
    return {"mfcc": ("array<double>", lambda _, p: cosines(p @ w, n))}


def chroma_column(n_fft: int, rate: float) -> S.Columns:
    to = pitch_classes(n_fft, rate)
    return {"chroma": ("array<double>", lambda _, p: p @ to)}


def array_stats(df: DataFrame, column: str, n: int) -> DataFrame:
    """(clip_id, mean, std): per clip and place of an array of n numbers, the population's deviation."""
    return df.groupBy("clip_id").agg(F.array(*[F.avg(F.col(column)[k]) for k in range(n)]).alias("mean"), F.array(*[F.stddev_pop(F.col(column)[k]) for k in range(n)]).alias("std"))


def pitch_classes(n_fft: int, rate: float) -> np.ndarray:
    """A column per pitch class: 1 for the bins that belong to it."""
    freq = np.arange(n_fft // 2 + 1) * rate / n_fft
    with np.errstate(divide="ignore"):
        midi = 12 * np.log2(freq / 440) + 69
    used = (midi >= 0) & (midi <= 127)
    to = np.zeros((len(freq), 12))
    to[np.flatnonzero(used), np.floor(midi[used] + 0.5).astype(int) % 12] = 1
    return to


def chroma(frames: DataFrame) -> DataFrame:
    """(clip_id, chroma): mean power of the twelve pitch classes of analysed frames, as shares of their sum."""
    means = array_stats(frames, "chroma", 12)
    sum_ = S.total(F.col("mean"))
    return means.select("clip_id", F.when(sum_ > 0, F.transform("mean", lambda x: x / F.nullif(sum_, F.lit(0.0)))).otherwise(F.col("mean")).alias("chroma"))


def correlation(x: Column, y: list[float]) -> Column:
    """Pearson's, 0 where x has no variance."""
    d = np.array(y) - np.mean(y)
    mean = S.total(x) / len(y)
    cov = S.total(F.zip_with(x, F.array(*map(F.lit, d.tolist())), lambda a, b: a * b))
    var = F.get(F.transform(F.array(mean), lambda m: S.total(F.transform(x, lambda a: (a - m) * (a - m)))), F.lit(0))
    return F.when(var > 0, cov / F.sqrt(F.when(var > 0, var) * float((d * d).sum()))).otherwise(0.0)


def keys(chroma: DataFrame, alternates: int = 3) -> DataFrame:
    """(clip_id, key, mode, confidence, alternates): the best of 24 rotated profiles by correlation r, confidence (r + 1) / 2."""
    turned = [(TONICS[k], mode, [w[(i - k) % 12] for i in range(12)]) for mode, w in (("major", MAJOR_WEIGHTS), ("minor", MINOR_WEIGHTS)) for k in range(12)]
    each = F.array(*[F.struct((-correlation(F.col("chroma"), w)).alias("minus"), F.lit(i).alias("i"), F.lit(k).alias("key"), F.lit(mode).alias("mode")) for i, (k, mode, w) in enumerate(turned)])
    c = chroma.select("clip_id", F.slice(F.array_sort(each), 1, 1 + alternates).alias("best"))
    fields = lambda b: F.struct(b.key.alias("key"), b.mode.alias("mode"), ((1 - b.minus) / 2).alias("confidence"))
    top = fields(F.col("best")[0])
    return c.select("clip_id", top["key"].alias("key"), top["mode"].alias("mode"), top["confidence"].alias("confidence"), F.transform(F.slice("best", 2, alternates), fields).alias("alternates"))


def lag_of(bpm: float, per_second: float) -> int:
    return int(60 / bpm * per_second + 0.5)


def tempo(env: DataFrame, per_second: float, slowest: float = 60.0, fastest: float = 200.0, prior: float = 120.0, sigma: float = 40.0, least: int = 10) -> DataFrame:
    """(clip_id, bpm, confidence) from the onset envelope (per_second frames a second).

    The lag with the largest autocorrelation times a Gaussian prior around `prior` wins, against the shortest lag's autocorrelation
    without prior; confidence is the winner's autocorrelation in [0, 1]. Clips of fewer than `least` frames are left out; where no lag
    fits, the prior is the answer with confidence 0.
    """
    first, last = max(lag_of(fastest, per_second), 1), lag_of(slowest, per_second)
    n = env.groupBy("clip_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    r = S.tempo_lags(env, first, last).join(n, "clip_id").where((F.col("lag") < F.col("n")) & (F.lit(first) < F.least(F.lit(last), F.col("n") - 1)))
    r = r.withColumns({"r": F.coalesce("r", F.lit(0.0)), "bpm": F.lit(60.0 * per_second) / F.col("lag")})
    r = r.withColumn("w", F.col("r") * F.exp(-(F.col("bpm") - prior) * (F.col("bpm") - prior) / (2 * sigma * sigma)))
    start = F.struct(F.max(F.when(F.col("lag") == first, F.col("r"))).alias("w"), F.lit(0).alias("tie"), F.max(F.when(F.col("lag") == first, F.struct("bpm", "r"))).alias("x"))
    best = F.max(F.struct("w", (-F.col("lag")).alias("tie"), F.struct("bpm", "r").alias("x")))
    found = r.groupBy("clip_id").agg(F.greatest(start, best).alias("b")).select("clip_id", F.col("b.x.bpm").alias("bpm"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("b.x.r"))).alias("confidence"))
    return n.select("clip_id").join(found, "clip_id", "left").select("clip_id", F.coalesce("bpm", F.lit(prior)).alias("bpm"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def due_beats(x: np.ndarray, block: int, own: int, period: int, size: int) -> tuple[int, int, np.ndarray]:
    """(lo, hi, found): the beat for each frame from lo to hi - 1 that one may be due at.

    A block (own frames of x, which reaches half a period further) takes the dues whose neighbourhood begins in it, that is those a quarter
    period behind its own frames; the first block also those before.
    """
    near, at = period // 4, block * size
    lo, hi = 0 if block == 0 else at + near, min(at + own + near, at + len(x))
    due = np.arange(lo, hi)
    if not len(due):
        return lo, lo, due
    wide = np.concatenate([np.full(near, -np.inf), x, np.full(2 * near + 1, -np.inf)])
    best = due - near + np.lib.stride_tricks.sliding_window_view(wide, 2 * near + 1)[due - at].argmax(1)
    return lo, hi, np.where(x[best - at] > x[due - at], best, due)


def beats(env: DataFrame, tempos: DataFrame, per_second: float, strong: float = 0.3, size: int = 4096) -> DataFrame:
    """(clip_id, frame): from the first strong frame on (else frame 0), the strongest frame within a quarter period of where a beat is due.

    Each beat depends on the one before, but all that a stretch of frames needs of those before it is where its first beat is due. So for each
    block a table says, for every place where that may be, where the next one is due behind the block; the tables (a number for each frame
    of a period and a quarter) are followed from block to block, and then all blocks are walked at once.
    """
    t = tempos.where("bpm > 0").select("clip_id", F.floor(60 / F.col("bpm") * per_second + 0.5).cast("int").alias("period")).where("period > 0")
    reach = (t.agg(F.max("period")).first()[0] or 0) // 4
    b = S.with_halo(S.env_blocks(env, size), 2 * reach, size).join(t, "clip_id")
    b = stored(b.select("clip_id", "block", "pcm", "own", "period"))
    kind = dict(b.dtypes)["clip_id"]

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (block, own, period) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 3, 4)), strict=True)):
                x = batch.column(2)[i].values.to_numpy(zero_copy_only=False)
                lo, hi, found = due_beats(x, block, own, period, size)
                leave = np.append(found + period, 0)  # where the next beat is due after one due at each frame
                while (inside := leave[:-1] < hi).any():
                    leave[:-1][inside] = leave[leave[:-1][inside] - lo]
                loud = np.flatnonzero(x[lo - block * size : hi - block * size] > strong)
                start = int(loud[0]) if len(loud) else 0 if block == 0 and len(found) else None
                rows.append((block, lo, hi, bool(len(loud)), None if start is None else lo + start, None if start is None else int(leave[start]), leave[: min(period + period // 4 + 1, hi - lo)].tolist()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=["clip_id", "block", "lo", "hi", "loud", "start", "out", "leave"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, blocks in enumerate(batch.column(1).to_pylist()):
                entries, due = [], None
                begin = next((k for k, r in enumerate(blocks) if r["loud"]), 0)
                for k in range(begin, len(blocks)):
                    r = blocks[k]
                    here = r["start"] if k == begin else due
                    if here is not None and here < r["hi"]:
                        entries.append((r["block"], here))
                        due = r["out"] if k == begin else r["leave"][here - r["lo"]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).take(pa.array([0] * len(entries), pa.int64())), pa.array([e[0] for e in entries], pa.int64()), pa.array([e[1] for e in entries], pa.int64())], names=["clip_id", "block", "due"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (block, own, period, due) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 3, 4, 5)), strict=True)):
                lo, hi, found = due_beats(batch.column(2)[i].values.to_numpy(zero_copy_only=False), block, own, period, size)
                at = []
                while due < hi:
                    at.append(int(found[due - lo]))
                    due = at[-1] + period
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).take(pa.array([0] * len(at), pa.int64())), pa.array(at, pa.int64())], names=["clip_id", "frame"])

    made = b.mapInArrow(tables, f"clip_id {kind}, block long, lo long, hi long, loud boolean, start long, out long, leave array<long>")
    ordered = made.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("block", "lo", "hi", "loud", "start", "out", "leave"))).alias("t"))
    entries = ordered.mapInArrow(follow, f"clip_id {kind}, block long, due long")
    return b.join(entries, ["clip_id", "block"]).select("clip_id", "block", "pcm", "own", "period", "due").mapInArrow(walk, f"clip_id {kind}, frame long")


def edges(blocks: DataFrame, reach: Column, size: int) -> DataFrame:
    """(clip_id, len, head, tail): the first and last `reach` samples of each clip (reach may use len)."""
    b = blocks.join(S.lengths(blocks).withColumn("reach", reach.cast("int")), "clip_id").withColumn("at", F.col("block") * size)
    near = b.where((F.col("at") < F.col("reach")) | (F.col("at") + F.size("pcm") > F.col("len") - F.col("reach")))
    joined = lambda t: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(t, F.struct("at", "pcm")))), lambda x: x.pcm))
    g = near.groupBy("clip_id", "len", "reach").agg(joined(F.col("at") < F.col("reach")).alias("h"), joined(F.col("at") + F.size("pcm") > F.col("len") - F.col("reach")).alias("t"))
    return g.select("clip_id", "len", F.slice("h", F.lit(1), F.least("reach", F.size("h"))).alias("head"), F.slice("t", F.greatest(F.size("t") - F.col("reach"), F.lit(0)) + 1, F.col("reach")).alias("tail"))


def loop_parts(head: np.ndarray, tail: np.ndarray, n: int, search: int, boundary: int, n_fft: int) -> tuple[int, int, bool, float, float]:
    """Loop start and end, whether both are zero crossings, and how alike level and spectrum are on both sides."""
    shift = n - len(tail)
    crossings = lambda x: np.flatnonzero((x[:-1] >= 0) != (x[1:] >= 0))
    first, last = crossings(head[:search]), crossings(tail[len(tail) - search :]) + n - search
    aligned = bool(len(first) and len(last))
    start, end = (int(first[0]), int(last[-1])) if aligned else (0, n - 1)
    border = min(boundary, n // 4)
    a = np.abs(head[start : start + border]).sum() / border
    b = np.abs(tail[max(end - border, 0) - shift : end + 1 - shift]).sum() / border
    level = min(a, b) / max(a, b) if a > 0 and b > 0 else float(a == b)
    if min(start + n_fft, n) - start < n_fft or end - max(end - n_fft, 0) < n_fft:
        return start, end, aligned, level, 0.5

    def spectrum(x: np.ndarray) -> np.ndarray:
        x = np.pad(x, n_fft // 2)
        return np.mean([np.abs(np.fft.rfft(x[i : i + n_fft] * S.window("hann", n_fft))) ** 2 for i in range(0, len(x) - n_fft + 1, n_fft)], 0)

    p, q = spectrum(head[start : start + n_fft]), spectrum(tail[end - n_fft - shift : end + 1 - shift])
    norm = np.linalg.norm(p) * np.linalg.norm(q)
    return start, end, aligned, level, float(np.clip(p @ q / norm, 0, 1)) if norm > 0 else 0.0


def loop_quality(blocks: DataFrame, rate: float, size: int = S.BLOCK, search_s: float = 0.05, boundary: int = 1024, n_fft: int = 2048, enough: float = 0.7) -> DataFrame:
    """(clip_id, loop_start, loop_end, aligned, amplitude, spectrum, quality, is_loopable); clips under two boundaries are left out.

    Only the two ends of a clip, of bounded length, meet. quality: .5 spectrum, .3 amplitude and .2 for zero crossings (half without).
    """
    search = F.least(F.lit(int(search_s * rate)).cast("long"), F.floor(F.col("len") / 4))
    b = edges(blocks, F.least(search + max(n_fft, boundary) + 2, F.col("len")), size).where(F.col("len") >= 2 * boundary)
    kind = dict(b.dtypes)["clip_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, head, tail in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                n = n.as_py()
                rows.append(loop_parts(head.values.to_numpy(), tail.values.to_numpy(), n, min(int(search_s * rate), n // 4), boundary, n_fft))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.float64())
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["clip_id", "loop_start", "loop_end", "aligned", "amplitude", "spectrum"])

    f = b.mapInArrow(run, f"clip_id {kind}, loop_start long, loop_end long, aligned boolean, amplitude double, spectrum double")
    f = f.withColumn("quality", 0.5 * F.col("spectrum") + 0.3 * F.col("amplitude") + F.when(F.col("aligned"), 0.2).otherwise(0.1))
    return f.withColumn("is_loopable", F.col("quality") >= enough)


def resample(blocks: DataFrame, rate: float, to: float, size: int = S.BLOCK) -> DataFrame:
    """(clip_id, n, x): samples at another rate, linear between neighbours; each is made in the block its left neighbour lies in."""
    ratio = rate / to
    b = S.with_halo(blocks, 1, size).withColumn("at", F.col("block") * size).join(S.lengths(blocks), "clip_id")
    lo, hi = F.ceil(F.col("at") / ratio), F.least(F.ceil((F.col("at") + F.col("own")) / ratio), F.floor(F.col("len") / ratio)) - 1
    place = lambda n: F.floor(n * F.lit(ratio)) - F.col("at")
    part = lambda n: n * F.lit(ratio) - F.floor(n * F.lit(ratio))
    left, right = (lambda n: F.get("pcm", place(n).cast("int"))), (lambda n: F.get("pcm", place(n).cast("int") + 1))
    value = lambda n: F.coalesce(left(n) * (1 - part(n)) + right(n) * part(n), left(n))
    b = b.withColumns({"lo": lo, "hi": hi}).where("lo <= hi")
    return b.select("clip_id", F.explode(F.transform(F.sequence("lo", "hi"), lambda n: F.struct(n.alias("n"), value(n).alias("x")))).alias("s")).select("clip_id", "s.*")


def downsample(blocks: DataFrame, target: int, size: int = S.BLOCK) -> DataFrame:
    """(clip_id, i, x): every (len / target)-th sample, rounded down; clips of up to target samples whole."""
    n = S.lengths(blocks).withColumn("step", F.when(F.col("len") <= target, 1.0).otherwise(F.col("len") / target))
    b = blocks.join(n, "clip_id").withColumn("at", F.col("block") * size)
    lo, hi = F.ceil(F.col("at") / F.col("step")), F.least(F.ceil((F.col("at") + F.size("pcm")) / F.col("step")), F.least(F.lit(target).cast("long"), F.col("len"))) - 1
    # a place may fall below the block by rounding: floor decides
    pick = lambda i: F.floor(i * F.col("step")) - F.col("at")
    b = b.withColumns({"lo": F.greatest(lo - 1, F.lit(0)), "hi": hi}).where("lo <= hi")
    x = b.select("clip_id", F.size("pcm").alias("own"), F.explode(F.transform(F.sequence("lo", "hi"), lambda i: F.struct(i.alias("i"), pick(i).alias("k"), F.get("pcm", F.greatest(pick(i), F.lit(0)).cast("int")).alias("x")))).alias("s"))
    return x.where("s.k >= 0 and s.k < own").select("clip_id", "s.i", "s.x")


def log_spectrum(x: np.ndarray, bins: int) -> np.ndarray:
    """Magnitudes over the transform's size, largest of each of bins quadratically growing ranges."""
    n = 1 << max(len(x) - 1, 0).bit_length()
    half = n // 2
    m = np.abs(np.fft.fft(x * S.window("hann", len(x)), n))[:half] / n if len(x) else np.zeros(0)
    if half <= bins:
        return np.pad(m, (0, bins - half))
    edge = ((np.arange(bins + 1) / bins) ** 2 * half).astype(int)
    lo = np.minimum(edge[:-1], half - 1)
    hi = np.minimum(np.maximum(edge[1:], lo + 1), half)
    return np.array([m[a:b].max() for a, b in zip(lo, hi, strict=True)])


def magnitude_centroid(x: np.ndarray, rate: float) -> float:
    n = 1 << max(len(x) - 1, 0).bit_length()
    m = np.abs(np.fft.fft(x * S.window("hann", len(x)), n))[1 : n // 2] if len(x) else np.zeros(0)
    return float((m * np.arange(1, len(m) + 1)).sum() * rate / n / m.sum()) if m.sum() > 1e-10 else 0.0


def per_array(rows: DataFrame, column: str, f, out: str, kind: str) -> DataFrame:
    """rows with column, arrays of any length, replaced by out = f(array), a number or an array."""
    at, names = rows.columns.index(column), [out if c == column else c for c in rows.columns]
    arrow = pa.list_(pa.float64()) if kind.startswith("array") else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([f(v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.zeros(0)) for v in b.column(at)], arrow)
            yield pa.RecordBatch.from_arrays([made if k == at else c for k, c in enumerate(b.columns)], names=names)

    return rows.mapInArrow(run, ", ".join(f"`{out if c == column else c}` {kind if c == column else k}" for c, k in rows.dtypes))


def cut(blocks: DataFrame, parts: DataFrame, size: int = S.BLOCK) -> DataFrame:
    """Blocks of parts (clip_id, part, start, end in samples) of clips: clip_id is then the struct (clip_id, part), numbering starts anew."""
    at = F.col("block") * size
    b = blocks.join(parts, "clip_id").where((at < F.col("end")) & (at + F.size("pcm") > F.col("start")))
    lo, hi = F.greatest(at, F.col("start")) - F.col("start"), F.least(at + F.size("pcm"), F.col("end")) - F.col("start")
    b = b.select(F.struct("clip_id", "part").alias("clip_id"), "pcm", (at - F.col("start")).alias("shift"), lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(F.floor(lo / size), F.floor((hi - 1) / size))).alias("block"))
    begin, stop = F.greatest("lo", F.col("block") * size), F.least("hi", (F.col("block") + 1) * size)
    piece = F.slice("pcm", (begin - F.col("shift")).cast("int") + 1, (stop - begin).cast("int"))
    g = b.groupBy("clip_id", "block").agg(F.array_sort(F.collect_list(F.struct(begin.alias("begin"), piece.alias("piece")))).alias("p"))
    return g.select("clip_id", "block", F.flatten(F.transform("p", lambda x: x.piece)).alias("pcm"))


def bars(blocks: DataFrame, count: int, rate: float, size: int = S.BLOCK, most: int = 4096) -> DataFrame:
    """(clip_id, bar, peak, centroid): equal stretches of a recording, the last with the rest; the centroid of `most` samples each.

    A recording of fewer samples than bars has a bar per sample, with a centroid of 1000.
    """
    n = S.lengths(blocks).withColumn("step", F.greatest(F.floor(F.col("len") / count), F.lit(1)))
    peaks = S.peaks_by(blocks.join(n, "clip_id"), "step", size, F.lit(count - 1).cast("long"))
    k = F.explode(F.sequence(F.lit(0), F.least(F.lit(count).cast("long"), F.col("len")).cast("int") - 1)).alias("part")
    parts = n.where(F.col("len") >= count).select("clip_id", "len", "step", k)
    stop = F.when(F.col("part") == count - 1, F.col("len")).otherwise((F.col("part") + 1) * F.col("step"))
    parts = parts.select("clip_id", "part", (F.col("part") * F.col("step")).alias("start"), F.least(stop, F.col("part") * F.col("step") + most).alias("end"))
    c = per_array(cut_heads(blocks, parts, size), "pcm", lambda x: magnitude_centroid(x, rate), "centroid", "double").select("clip_id.clip_id", F.col("clip_id.part").alias("bar"), "centroid")
    return peaks.join(c, ["clip_id", "bar"], "left").select("clip_id", "bar", "peak", F.coalesce("centroid", F.lit(1000.0)).alias("centroid"))


def cut_heads(blocks: DataFrame, parts: DataFrame, size: int) -> DataFrame:
    """(clip_id, pcm) of short parts, each whole."""
    c = cut(blocks, parts, size)
    g = c.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("block", "pcm"))).alias("p"))
    return g.select("clip_id", F.flatten(F.transform("p", lambda x: x.pcm)).alias("pcm"))


def recut(blocks: DataFrame, to: int, size: int = S.BLOCK) -> DataFrame:
    """Blocks of `to` samples in place of blocks of size; a clip's last one may be shorter. A row meets only those that it overlaps."""
    b = blocks.where(F.size("pcm") > 0).select("clip_id", "pcm", (F.col("block") * size).alias("at"), F.explode(F.sequence(F.expr(f"block * {size} div {to}"), F.expr(f"(block * {size} + size(pcm) - 1) div {to}"))).alias("block"))
    end = F.col("at") + F.size("pcm")
    first = F.greatest("at", F.col("block") * to)
    piece = F.slice("pcm", (first - F.col("at")).cast("int") + 1, (F.least(end, (F.col("block") + 1) * to) - first).cast("int"))
    g = b.groupBy("clip_id", "block").agg(F.array_sort(F.collect_list(F.struct(first.alias("first"), piece.alias("piece")))).alias("p"))
    return g.select("clip_id", "block", F.flatten(F.transform("p", lambda x: x.piece)).alias("pcm"))


def recording_chunks(blocks: DataFrame, rate: float, chunk: int = 2048, size: int = S.BLOCK) -> DataFrame:
    """(clip_id, chunk, peak, centroid): the largest absolute sample and the centroid of every full chunk of a recording."""
    c = S.reduced(recut(blocks, chunk, size), {"peak": lambda x: np.abs(x).max(), "centroid": lambda x: magnitude_centroid(x, rate)})
    return c.where(F.col("n") == chunk).select("clip_id", F.col("block").alias("chunk"), "peak", "centroid")


def chunk_bars(chunks: DataFrame, bars: int) -> DataFrame:
    """(clip_id, bar, peak, centroid) from chunks (clip_id, chunk, peak, centroid): as they are if there are no more than bars of them, else
    the largest peak and the mean centroid of bars that share them evenly."""
    n = chunks.groupBy("clip_id").agg((F.max("chunk") + 1).alias("n"))
    per = F.col("n") / F.lit(float(bars))
    edge = lambda b: F.floor(b * per)
    guess = F.floor(F.col("chunk") / per)
    inside = lambda b: (b >= 0) & (b < bars) & (edge(b) <= F.col("chunk")) & (F.col("chunk") < edge(b + 1))
    bar = F.when(F.col("n") <= bars, F.col("chunk")).otherwise(F.get(F.filter(F.array(guess - 1, guess, guess + 1), inside), F.lit(0)))
    b = chunks.join(n, "clip_id").withColumn("bar", bar).where("bar is not null")
    return b.groupBy("clip_id", F.col("bar").cast("int").alias("bar")).agg(F.max("peak").alias("peak"), F.avg("centroid").alias("centroid"))


def between(frames: DataFrame, width: int, value: str) -> DataFrame:
    """(clip_id, col, value): arrays or numbers of a clip's frames, linear between neighbours, at width evenly spaced places.

    Each place is made by the frame at its left, which looks at the next one only.
    """
    w = Window.partitionBy("clip_id").orderBy("frame")
    n = frames.groupBy("clip_id").agg(F.count("*").alias("frames"))
    f = frames.select("clip_id", "frame", value, F.lead(value).over(w).alias("_next")).join(n, "clip_id")
    step = (F.col("frames") - 1) / max(width - 1, 1)
    i = F.filter(F.sequence(F.floor(F.when(step > 0, F.col("frame") / F.when(step > 0, step)).otherwise(0.0)).cast("int"), F.least(F.lit(width - 1), F.ceil(F.when(step > 0, (F.col("frame") + 1) / F.when(step > 0, step)).otherwise(float(width - 1))).cast("int"))), lambda i: F.floor(i * step) == F.col("frame"))
    f = f.where(F.col("frame") < F.col("frames")).withColumn("step", step).select("*", F.explode(i).alias("col"))
    part = F.col("col") * F.col("step") - F.floor(F.col("col") * F.col("step"))
    mix = lambda a, b, p: F.when(b.isNull(), a).otherwise(a * (1 - p) + b * p)
    if dict(frames.dtypes)[value].startswith("array"):
        made = F.when(F.col("_next").isNull(), F.col(value)).otherwise(F.zip_with(value, "_next", lambda a, b: a * (1 - part) + b * part))
    else:
        made = mix(F.col(value), F.col("_next"), part)
    return f.select("clip_id", "col", made.alias(value))


def clip_hop(blocks: DataFrame, hop: Column) -> DataFrame:
    """blocks with a hop that depends on each clip's len."""
    return blocks.join(S.lengths(blocks).select("clip_id", hop.cast("long").alias("hop")), "clip_id")


def frequency_waveform(blocks: DataFrame, rate: float, width: int, size: int = S.BLOCK, n_fft: int = 1024) -> DataFrame:
    """(clip_id, bar, peak, centroid): the waveform with the magnitude centroid, taken every len / width samples, at each bar."""
    b = clip_hop(blocks, F.greatest(F.floor(F.col("len") / width), F.lit(1)))

    def centre(_, p: np.ndarray) -> np.ndarray:
        m = np.sqrt(p)
        t = m.sum(1)
        return np.where(t > 1e-10, m @ (np.arange(m.shape[1]) * rate / n_fft) / np.where(t > 1e-10, t, 1), 0.0)

    p = S.analysed(b, {"centroid": ("double", centre)}, n_fft, "hop", size)
    c = between(p, width, "centroid").withColumnRenamed("col", "bar")
    return S.waveform(blocks, width, size).join(c, ["clip_id", "bar"], "left").select("clip_id", "bar", "peak", F.coalesce("centroid", F.lit(0.0)).alias("centroid"))


def spectrogram(blocks: DataFrame, rate: float, width: int, height: int, size: int = S.BLOCK, n_fft: int = 2048, scale: str = "mel", top_db: float = 80.0) -> DataFrame:
    """(clip_id, col, v): a picture of width columns, each an array of height values in [0, 1] from the lowest band or bin up."""
    b = clip_hop(blocks, F.when(F.col("len") > width, F.greatest(F.floor(F.col("len") / width), F.lit(1))).otherwise(512))
    # decibels are taken where the spectra are made; what the clip's largest adds to all of them is subtracted afterwards
    bands = mel_weights(height, n_fft, rate).T if scale == "mel" else None
    db = lambda x: 10 * np.log10(np.maximum(x, 1e-10))
    p = S.analysed(b, {"v": ("array<double>", lambda _, p: db(p if bands is None else p @ bands))}, n_fft, "hop", size)
    top = p.groupBy("clip_id").agg(F.max(F.array_max("v")).alias("top"))
    ref = F.greatest(F.col("top"), F.lit(-100.0))
    db = p.join(top, "clip_id").select("clip_id", "frame", F.transform("v", lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - ref + top_db) / top_db))).alias("v"))
    out = between(db, width, "v")
    if scale == "mel" or height == n_fft // 2 + 1:
        return out
    at = np.arange(height) * (n_fft // 2) / max(height - 1, 1)
    lower = np.minimum(at.astype(int), n_fft // 2)
    rows = F.array(*[F.struct(F.lit(int(i)).alias("i"), F.lit(float(a - i)).alias("f")) for a, i in zip(at, lower, strict=True)])
    pick = lambda r: F.coalesce(F.get("v", r.i) * (1 - r.f) + F.get("v", r.i + 1) * r.f, F.get("v", r.i))
    return out.select("clip_id", "col", F.transform(rows, pick).alias("v"))


def eighths(blocks: DataFrame) -> DataFrame:
    n = S.lengths(blocks).withColumn("step", F.floor(F.col("len") / 8)).where("step > 0")
    return n.select("clip_id", "step", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("part")).select("clip_id", "part", (F.col("part") * F.col("step")).alias("start"), ((F.col("part") + 1) * F.col("step")).alias("end"))


def clip_vectors(blocks: DataFrame, rate: float, size: int = S.BLOCK, n_fft: int = 2048, hop: int = 512, n_mels: int = 128) -> DataFrame:
    """(clip_id, v): 48 numbers of unit length: 13 MFCC means, 13 deviations, 4 spectral means, 8 levels and 8 centroids of eighths,
    zero crossings and crest, each brought to about [0, 1]."""
    step = rate / n_fft
    p = S.analysed(blocks, S.tones(step) | mfcc_column(n_fft, rate, n_mels), n_fft, hop, size)
    m = array_stats(p, "mfcc", 13)
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    s = S.spectral(p).select("clip_id", F.array(unit(F.col("centroid") / 10000), unit(F.col("rolloff") / 20000), unit(F.col("bandwidth") / 5000), unit(F.col("flatness"))).alias("s"))
    part = cut(blocks, eighths(blocks), size)
    level = part.groupBy("clip_id").agg(unit(2 * F.sqrt(F.sum(S.total(F.transform("pcm", lambda x: x * x))) / F.sum(F.size("pcm")))).alias("level"), F.sum(F.size("pcm")).alias("n"))
    tone = S.analysed(part, {"centroid": S.tones(step)["centroid"]}, n_fft, hop, size).groupBy("clip_id").agg(unit(F.avg("centroid") / 10000).alias("tone"))
    e = level.join(tone, "clip_id", "left").select("clip_id.clip_id", "clip_id.part", "level", F.when(F.col("n") < n_fft, 0.5).otherwise(F.coalesce("tone", F.lit(0.5))).alias("tone"))
    e = e.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("part", "level", "tone"))).alias("e"))
    z = S.zero_crossing_rate(blocks).join(S.quality(blocks).select("clip_id", "crest_factor"), "clip_id").select("clip_id", F.array(unit(F.coalesce("zcr", F.lit(0.0))), unit((F.col("crest_factor") + 20) / 40)).alias("z"))
    j = m.join(s, "clip_id").join(z, "clip_id").join(e, "clip_id", "left")
    eight = lambda f, none: F.coalesce(F.transform("e", f), F.array_repeat(F.lit(none), 8))
    v = j.select("clip_id", F.concat("mean", "std", "s", eight(lambda x: x.level, 0.0), eight(lambda x: x.tone, 0.5), "z").alias("v"))
    norm = F.sqrt(S.total(F.transform("v", lambda x: x * x)))
    return v.withColumn("norm", norm).select("clip_id", F.when(F.col("norm") > 1e-6, F.transform("v", lambda x: x / F.nullif("norm", F.lit(0.0)))).otherwise(F.col("v")).alias("v"))


def spectral_bundle(blocks: DataFrame, rate: float, size: int = S.BLOCK, n_fft: int = 2048, hop: int = 512, n_mels: int = 128, n: int = 13) -> DataFrame:
    """(clip_id, centroid, rolloff, flatness, bandwidth, zcr, mfcc): all spectral means of each clip."""
    p = S.analysed(blocks, S.tones(rate / n_fft) | mfcc_column(n_fft, rate, n_mels, n), n_fft, hop, size)
    m = array_stats(p, "mfcc", n).select("clip_id", F.col("mean").alias("mfcc"))
    return S.spectral(p).join(S.zero_crossing_rate(blocks), "clip_id").join(m, "clip_id")


def embed_missing(samples: DataFrame, embeddings: DataFrame, blocks: DataFrame, rate: float, version: int, size: int = S.BLOCK, n_fft: int = 2048, hop: int = 512, n_mels: int = 128) -> tuple[DataFrame, DataFrame]:
    """(embeddings, failed): embeddings (id, v, version) with vectors of the samples that have none, and the ids of those without sound.

    blocks: clip_id is the sample's id.
    """
    todo = samples.select("id").join(embeddings.select("id"), "id", "left_anti")
    wanted = blocks.join(todo.select(F.col("id").alias("clip_id")), "clip_id", "left_semi")
    new = clip_vectors(wanted, rate, size, n_fft, hop, n_mels).select(F.col("clip_id").alias("id"), "v", F.lit(version).alias("version"))
    return embeddings.unionByName(new.select(embeddings.columns)), todo.join(new.select("id"), "id", "left_anti")


def analyze(blocks: DataFrame, rate: float, size: int = S.BLOCK, n_fft: int = 2048, hop: int = 512, key_fft: int = 4096) -> DataFrame:
    """One row per clip: bpm, key (tonic), mode, quality and spectral columns, and errors, the steps that gave nothing.

    Frames are cut and transformed once (twice where the key takes a longer transform), and everything is made from their numbers.
    """
    one = key_fft == n_fft
    p = S.analysed(blocks, S.tones(rate / n_fft) | (chroma_column(n_fft, rate) if one else {}), n_fft, hop, size, rise=True)
    k = p if one else S.analysed(blocks, chroma_column(key_fft, rate), key_fft, hop, size)
    parts = {
        "bpm": tempo(S.onset_envelope(p), rate / hop).select("clip_id", "bpm", F.col("confidence").alias("bpm_confidence")),
        "key": keys(chroma(k)).select("clip_id", "key", "mode", F.col("confidence").alias("key_confidence")),
        "quality": S.quality(blocks),
        "spectral": S.spectral(p),
    }
    out = blocks.select("clip_id").distinct()
    for name, part in parts.items():
        out = out.join(part.withColumn(f"_{name}", F.lit(True)), "clip_id", "left")
    errors = F.array_compact(F.array(*[F.when(F.col(f"_{n}").isNull(), n) for n in parts]))
    return out.withColumn("errors", errors).drop(*[f"_{n}" for n in parts])


def naming_features(blocks: DataFrame, rate: float, size: int = S.BLOCK, seconds: float = 6.0, n_fft: int = 2048, hop: int = 512) -> DataFrame:
    """(clip_id, rms, centroid, zcr, dur_s, tempo) of the first seconds; clips under a quarter second or 1e-4 in level are left out."""
    n = S.lengths(blocks)
    head = cut(blocks, n.select("clip_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("start"), F.least(F.col("len"), F.lit(int(seconds * rate)).cast("long")).alias("end")), size)
    head = head.select("clip_id.clip_id", "block", "pcm")
    level = head.groupBy("clip_id").agg(F.sqrt(F.sum(S.total(F.transform("pcm", lambda x: x * x))) / F.sum(F.size("pcm"))).alias("rms"), F.sum(F.size("pcm")).alias("n"))
    level = level.where((F.col("n") >= 0.25 * rate) & (F.col("rms") >= 1e-4))
    p = S.analysed(head, {"centroid": S.tones(rate / n_fft)["centroid"]}, n_fft, hop, size, rise=True)
    tone = p.groupBy("clip_id").agg(F.avg("centroid").alias("centroid"))
    t = tempo(S.onset_envelope(p), rate / hop).select("clip_id", F.col("bpm").alias("tempo"))
    j = level.join(tone, "clip_id", "left").join(S.zero_crossing_rate(head), "clip_id", "left").join(t, "clip_id", "left").join(n, "clip_id")
    return j.select("clip_id", "rms", "centroid", "zcr", (F.col("len") / rate).alias("dur_s"), "tempo")


def step_features(blocks: DataFrame, rate: float, n_fft: int = 2048, hop: int = 512, size: int = S.BLOCK, n_mels: int = 128, n: int = 13) -> DataFrame:
    """(clip_id, frame, f): n MFCC and the centroid over 10000 Hz of each frame."""
    both = mfcc_column(n_fft, rate, n_mels, n)["mfcc"][1], S.tones(rate / n_fft)["centroid"][1]
    return S.analysed(blocks, {"f": ("array<double>", lambda x, p: np.column_stack([both[0](x, p), both[1](x, p) / 10000]))}, n_fft, hop, size)


def change_points(features: DataFrame, least: int) -> DataFrame:
    """(clip_id, frame): local maxima of the step between neighbours above mean + 1.5 deviations, at least `least` frames apart.

    The first is also measured from frame 0; clips of under 2 * least frames have none. Steps are numbers; only peaks are folded.
    """
    w = Window.partitionBy("clip_id").orderBy("frame")
    d = F.sqrt(S.total(F.zip_with("f", F.lag("f").over(w), lambda a, b: (a - b) * (a - b))))
    s = features.select("clip_id", "frame", F.coalesce(d, F.lit(0.0)).alias("d"))
    g = s.groupBy("clip_id").agg((F.avg("d") + 1.5 * F.stddev_pop("d")).alias("limit"), F.count("*").alias("n")).where(F.col("n") >= 2 * least)
    peaks = s.withColumns({"p": F.lag("d").over(w), "q": F.lead("d").over(w)}).join(g, "clip_id").where((F.col("d") > F.col("p")) & (F.col("d") > F.col("q")) & (F.col("d") > F.col("limit")))
    return S.spaced(peaks.select("clip_id", F.col("frame").cast("long").alias("frame"), F.col("frame").cast("long").alias("out")), least, 0)


def running_blocks(features: DataFrame, size: int) -> DataFrame:
    """(clip_id, block, sums): for each block of frames the sums of the centred features of all frames before each of its frames.

    Blocks are summed first; only these sums, one row a block, are added up along a clip, and frames get what stands before their block.
    """
    kind = dict(features.dtypes)["clip_id"]
    g = features.groupBy("clip_id", F.floor(F.col("frame") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("frame", "f"))).alias("r"))
    g = stored(g.select("clip_id", "block", F.size("r").alias("count"), F.flatten(F.transform("r", lambda x: x.f)).alias("x")))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [x.values.to_numpy(zero_copy_only=False).reshape(n, -1).sum(0) for x, n in zip(b.column(3), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(s, pa.list_(pa.float64()))], names=["clip_id", "block", "count", "s"])

    sums = g.mapInArrow(add, f"clip_id {kind}, block long, count int, s array<double>")
    before = Window.partitionBy("clip_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    plus = lambda a: F.aggregate(a, F.array().cast("array<double>"), lambda t, v: F.when(F.size(t) == 0, v).otherwise(F.zip_with(t, v, lambda p, q: p + q)))
    whole = sums.groupBy("clip_id").agg(F.sum("count").alias("n")).join(sums.groupBy("clip_id").agg(plus(F.collect_list("s")).alias("total")), "clip_id")
    ahead = sums.select("clip_id", "block", plus(F.collect_list("s").over(before)).alias("ahead"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, (block, count, n) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 4)), strict=True)):
                x = b.column(3)[i].values.to_numpy(zero_copy_only=False).reshape(count, -1)
                mean = b.column(5)[i].values.to_numpy(zero_copy_only=False) / n
                ahead = b.column(6)[i].values.to_numpy(zero_copy_only=False)
                start = ahead - mean * (block * size) if len(ahead) else np.zeros(x.shape[1])
                out.append((start + np.vstack([np.zeros(x.shape[1]), np.cumsum(x - mean, 0)[:-1]])).ravel())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column(4), pa.array(out, pa.list_(pa.float64()))], names=["clip_id", "block", "count", "n", "sums"])

    j = g.join(whole, "clip_id").join(ahead, ["clip_id", "block"])
    return stored(j.select("clip_id", "block", "count", "x", "n", "total", "ahead").mapInArrow(run, f"clip_id {kind}, block long, count int, n long, sums array<double>"))


def n_segments(features: DataFrame, n: int, least: int, size: int = 4096) -> DataFrame:
    """(clip_id, frame): the n - 1 splits that lower the summed variance most, one a round, each in the part where it helps most.

    Sums before every frame are made once (`running_blocks`), and a part's cost follows from those at its ends. So a round is one pass in
    which each block scores all its frames and gives its best, and an aggregate of these; parts stay in a small table.
    """
    kind = dict(features.dtypes)["clip_id"]
    c = running_blocks(features, size)
    parts = c.where(F.col("n") >= 2 * least).groupBy("clip_id").agg(F.max("n").alias("end")).select("clip_id", F.lit(0).cast("long").alias("start"), "end", F.lit(None).cast("array<double>").alias("at_start"), F.lit(None).cast("array<double>").alias("at_end"))
    shape = f"clip_id {kind}, start long, end long, frame long, gain double, sums array<double>"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, (block, count, parts) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 4)), strict=True)):
                sums = b.column(3)[i].values.to_numpy(zero_copy_only=False).reshape(count, -1)
                frame = block * size + np.arange(count)
                zero, best = np.zeros(sums.shape[1]), None
                for p in parts:
                    fits = np.flatnonzero((frame - p["start"] >= least) & (p["end"] - frame >= least))
                    if not len(fits):
                        continue
                    a, z = (zero if p[k] is None else np.array(p[k]) for k in ("at_start", "at_end"))
                    left, right = sums[fits] - a, z - sums[fits]
                    gain = (left**2).sum(1) / (frame[fits] - p["start"]) + (right**2).sum(1) / (p["end"] - frame[fits]) - ((z - a) ** 2).sum() / (p["end"] - p["start"])
                    k = int(np.argmax(np.round(gain, 9)))
                    found = (round(float(gain[k]), 9), -int(frame[fits[k]]), p["start"], p["end"], sums[fits[k]].tolist())
                    best = found if best is None or found[:2] > best[:2] else best
                rows.append(best)
            keep = [i for i, r in enumerate(rows) if r is not None]
            take = [rows[i] for i in keep]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([r[2] for r in take], pa.int64()), pa.array([r[3] for r in take], pa.int64()), pa.array([-r[1] for r in take], pa.int64()), pa.array([r[0] for r in take], pa.float64()), pa.array([r[4] for r in take], pa.list_(pa.float64()))], names=["clip_id", "start", "end", "frame", "gain", "sums"])

    found = None
    for _ in range(n - 1):
        listed = parts.groupBy("clip_id").agg(F.collect_list(F.struct("start", "end", "at_start", "at_end")).alias("parts"))  # at most n
        each = c.select("clip_id", "block", "count", "sums").join(listed, "clip_id").mapInArrow(score, shape)
        best = each.groupBy("clip_id").agg(F.max_by(F.struct("start", "end", "frame", "sums"), F.struct("gain", (-F.col("frame")).alias("early"))).alias("b"))
        split = stored(best.select("clip_id", F.col("b.start").alias("s"), F.col("b.frame").alias("frame"), F.col("b.sums").alias("sums")))
        here = F.col("s") == F.col("start")
        two = F.array(F.struct("start", F.col("frame").alias("end"), "at_start", F.col("sums").alias("at_end")), F.struct(F.col("frame").alias("start"), "end", F.col("sums").alias("at_start"), "at_end"))
        one = F.array(F.struct("start", "end", "at_start", "at_end"))
        parts = stored(parts.join(split, "clip_id", "left").select("clip_id", F.explode(F.when(here, two).otherwise(one)).alias("p")).select("clip_id", "p.*"))
        found = split.select("clip_id", "frame") if found is None else found.unionByName(split.select("clip_id", "frame"))
    return found if found is not None else parts.select("clip_id", F.col("start").alias("frame")).limit(0)


def chunks(points: DataFrame, lengths: DataFrame, hop: int) -> DataFrame:
    """(clip_id, part, start, end) in samples: clips cut at frames; clips without points stay whole."""
    cuts = points.join(lengths, "clip_id").groupBy("clip_id").agg(F.array_sort(F.collect_set(F.least(F.col("frame") * hop, F.col("len")))).alias("at"))
    at = F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), F.coalesce("at", F.array().cast("array<bigint>")), F.array("len")))
    j = lengths.where("len > 0").join(cuts, "clip_id", "left").select("clip_id", at.alias("at"))
    return j.select("clip_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("at") - 1), lambda i: F.struct(F.get("at", i - 1).alias("start"), F.get("at", i).alias("end")))).alias("part", "s")).select("clip_id", "part", "s.*")


def beat_chunks(lengths: DataFrame, bpm: Column, rate: float, bars: int = 4, beats: int = 4) -> DataFrame:
    """(clip_id, part, start, end): a chunk every bars * beats beats of a steady grid; clips of fewer than two beats stay whole."""
    per = bars * beats
    g = lengths.where("len > 0").withColumn("p", F.when(bpm > 0, F.floor(60 / F.when(bpm > 0, bpm) * rate)).otherwise(0))
    g = g.withColumn("n", F.when(F.col("p") > 0, F.ceil(F.col("len") / F.nullif("p", F.lit(0).cast("long")))).otherwise(0))
    stop = lambda i: F.when(F.least(i + per, F.col("n") - 1) + 1 < F.col("n"), F.least(i + per, F.col("n") - 1) * F.col("p")).otherwise(F.col("len"))
    grid = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(per).cast("long")), lambda i: F.struct((i * F.col("p")).alias("start"), stop(i).alias("end")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("len").alias("end")))
    return g.select("clip_id", F.posexplode(F.when(F.col("n") < 2, whole).otherwise(grid)).alias("part", "s")).select("clip_id", "part", "s.*")
