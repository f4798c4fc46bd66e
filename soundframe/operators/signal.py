"""Signal jobs over blocks and frames. A long recording is many independent rows: only per-frame numbers meet by clip."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundframe.operators.catalog import pack, places
from soundframe.operators.stored import stored

#: Samples of a frame and between frames, and samples of a block, unless said otherwise.
N_FFT, HOP, BLOCK = 2048, 512, 65536


def window(kind: str, n: int) -> np.ndarray:
    """Symmetric coefficients (denominator n - 1)."""
    t = 2 * np.pi * np.arange(n) / max(n - 1, 1)
    table = {"hann": 0.5 - 0.5 * np.cos(t), "hamming": 0.54 - 0.46 * np.cos(t), "blackman": 0.42 - 0.5 * np.cos(t) + 0.08 * np.cos(2 * t), "rect": np.ones(n)}
    return table[kind]


def blocks(signal: DataFrame) -> DataFrame:
    """(clip_id, block, pcm): blocks numbered in order within each clip, by range partitions, so that a long clip is many tasks."""
    return places(signal, ["clip_id"], [F.col("vec_id")], "place").select("clip_id", (F.col("place") - 1).alias("block"), "pcm")


def clip_blocks(decoded: DataFrame) -> DataFrame:
    """(clip_id, block, pcm, rate) of decoded WAV blocks; clip_id is the path."""
    return decoded.select(F.col("path").alias("clip_id"), F.col("block_idx").alias("block"), F.col("pcm").cast("array<double>").alias("pcm"), F.col("sample_rate").alias("rate"))


def lengths(blocks: DataFrame) -> DataFrame:
    """(clip_id, len): samples of each clip."""
    return blocks.groupBy("clip_id").agg(F.sum(F.size("pcm")).alias("len"))


def with_halo(blocks: DataFrame, extra: int, size: int, *keep: str) -> DataFrame:
    """blocks with pcm reaching extra samples into the blocks behind (fewer at a clip's end), and own, the block's own samples.

    Every block sends its head to the blocks before; what belongs together meets by (clip, block), so long clips are many groups.
    """
    reach = -(-extra // size)
    head = lambda d: F.struct((F.col("block") - d).alias("block"), F.lit(d).alias("d"), (F.slice("pcm", 1, min(extra - (d - 1) * size, size)) if d else F.col("pcm")).alias("piece"))
    sent = blocks.select("clip_id", *keep, F.explode(F.array(*[head(d) for d in range(reach + 1)])).alias("h")).select("clip_id", *keep, "h.*").where("block >= 0")
    own = F.max(F.when(F.col("d") == 0, F.size("piece"))).alias("own")
    g = sent.groupBy("clip_id", "block").agg(F.array_sort(F.collect_list(F.struct("d", "piece"))).alias("p"), own, *[F.max(k).alias(k) for k in keep])
    return g.select("clip_id", "block", F.flatten(F.transform("p", lambda x: x.piece)).alias("pcm"), "own", *keep)


def frames(blocks: DataFrame, n_fft: int = N_FFT, hop=HOP, size: int = BLOCK, center: bool = True) -> DataFrame:
    """(clip_id, frame, pcm): frames of n_fft samples every hop (a number or a column's name), zeros beyond both ends.

    All blocks of a clip but the last have size samples. A frame is cut in the block where it begins; with center, frame 0 is
    centred on the first sample. A clip has 1 + (len + padding - n_fft) // hop frames; one that is too short has none.
    """
    pad = n_fft // 2 if center else 0
    step = F.col(hop) if isinstance(hop, str) else F.lit(hop)
    b = with_halo(blocks, n_fft - 1, size, *[hop] * isinstance(hop, str)).withColumn("at", F.col("block") * size)
    first = F.when(F.col("block") == 0, F.lit(0).cast("long")).otherwise(F.ceil((F.col("at") + pad) / step))
    ends = F.size("pcm") < F.col("own") + n_fft - 1  # the clip's end is in sight
    last = F.floor((F.col("at") + F.col("own") - 1 + pad) / step)
    room = F.col("at") + F.size("pcm") + 2 * pad - n_fft
    last = F.when(ends, F.when(room < 0, F.lit(-1).cast("long")).otherwise(F.least(last, F.floor(room / step)))).otherwise(last)
    b = b.withColumns({"first": first, "last": last}).where("first <= last")
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))

    def cut(f: Column) -> Column:
        begin = f * step - pad - F.col("at")
        left = F.greatest(-begin, F.lit(0))
        body = F.slice("pcm", F.greatest(begin, F.lit(0)).cast("int") + 1, (F.lit(n_fft) - left).cast("int"))
        right = F.lit(n_fft) - left - F.greatest(F.lit(0), F.least(F.lit(n_fft) - left, F.size("pcm") - F.greatest(begin, F.lit(0))))
        return F.struct(f.alias("frame"), F.concat(zeros(left), body, zeros(right)).alias("pcm"))

    return b.select("clip_id", F.explode(F.transform(F.sequence("first", "last"), cut)).alias("f")).select("clip_id", "f.*")


def kernel(rows: DataFrame, column: str, f, out: str) -> DataFrame:
    """rows with column, arrays of one length, replaced by out: f turns a matrix with a row per array into another."""
    at, names = rows.columns.index(column), [out if c == column else c for c in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                y = np.ascontiguousarray(f(x), np.float64)
                made = pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), y.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([made if k == at else c for k, c in enumerate(b.columns)], names=names)

    kinds = [(out, "array<double>") if c == column else (c, k) for c, k in rows.dtypes]
    return rows.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds))


def power(frames: DataFrame, kind: str = "hann") -> DataFrame:
    """(clip_id, frame, power): power spectrum of each frame, a batch of frames at a time."""
    return kernel(frames.select("clip_id", "frame", "pcm"), "pcm", lambda x: np.abs(np.fft.rfft(x * window(kind, x.shape[1]))) ** 2, "power")


#: Columns of a frame: f(samples, power) gives a number or an array a frame, from a matrix with a row a frame each.
Columns = dict[str, tuple[str, Callable[[np.ndarray, np.ndarray], np.ndarray]]]
#: Frames that are transformed at once.
FRAMES = 256


def tones(step: float) -> Columns:
    """Centroid, roll-off, flatness, and the power and its first two moments over frequency (step: Hz between bins)."""
    at = lambda p: np.arange(p.shape[1]) * step

    def centre(_, p: np.ndarray) -> np.ndarray:
        t = p.sum(1)
        return np.where(t > 0, p @ at(p) / np.where(t > 0, t, 1), 0.0)

    def roll(_, p: np.ndarray, share: float = 0.85) -> np.ndarray:
        up = np.cumsum(p, 1)
        return np.where(up[:, -1] > 0, np.minimum((up < share * up[:, -1:]).sum(1), p.shape[1] - 1) * step, 0.0)

    def flat(_, p: np.ndarray) -> np.ndarray:
        q = np.maximum(p, 1e-10)
        return np.minimum(1.0, np.exp(np.log(q).mean(1)) / q.mean(1))

    return {"centroid": ("double", centre), "rolloff": ("double", roll), "flatness": ("double", flat), "m0": ("double", lambda _, p: p.sum(1)), "m1": ("double", lambda _, p: p @ at(p)), "m2": ("double", lambda _, p: p @ at(p) ** 2)}


LEVEL: Columns = {"rms": ("double", lambda x, _: np.sqrt((x * x).mean(1)))}
#: The positive flux from a frame into the next one; NULL for a clip's last frame. It is made from two neighbouring spectra.
RISE = "rise"


def analysed(blocks: DataFrame, columns: Columns, n_fft: int = N_FFT, hop=HOP, size: int = BLOCK, center: bool = True, rise: bool = False, kind: str = "hann") -> DataFrame:
    """(clip_id, frame, *columns): numbers of the frames of `frames`, made where the block lies, so that no frame or spectrum leaves its task.

    A block gets the samples of its last frame from the blocks behind, with rise (adds `rise`) those of one frame more. A batch of
    frames is cut, transformed and reduced as one matrix. Stored, as what follows reads it more than once.
    """
    extra, pad = n_fft - 1, n_fft // 2 if center else 0
    per_clip = isinstance(hop, str)
    if rise:  # room for the next frame; where the hop is a column, for any hop up to a frame
        extra += n_fft if per_clip else hop
    b = with_halo(blocks, extra, size, *[hop] * per_clip)
    b = b.select("clip_id", "block", "pcm", "own", *[hop] * per_clip)
    clip = dict(b.dtypes)["clip_id"]
    names = [*columns, *[RISE] * rise]
    kinds = [k for k, _ in columns.values()] + ["double"] * rise

    def of_block(x: np.ndarray, block: int, own: int, step: int) -> Iterator[tuple[int, list[np.ndarray]]]:
        at, w = block * size, window(kind, n_fft)
        first, last = (0 if block == 0 else -(-(at + pad) // step)), (at + own - 1 + pad) // step
        final = None
        if len(x) < own + extra:  # the clip's end is in sight
            room = at + len(x) + 2 * pad - n_fft
            final = room // step if room >= 0 else -1
            last = min(last, final)
        if first > last:
            return
        left = max(pad - at, 0)  # zeros before the clip
        begin = first * step - pad - at + left
        behind = begin + (last + 1 - first) * step + n_fft - left - len(x)
        padded = np.concatenate([np.zeros(left), x, np.zeros(max(behind, 0))])
        views = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[begin::step]
        for k in range(0, last - first + 1, FRAMES):
            here = min(FRAMES, last - first + 1 - k)
            more = rise and (final is None or first + k + here <= final)
            cut = views[k : k + here + more]
            p = np.abs(np.fft.rfft(cut * w)) ** 2
            out = [np.asarray(f(cut[:here], p[:here]), np.float64) for _, f in columns.values()]
            if rise:
                up = np.maximum(p[1:] - p[:-1], 0).sum(1)
                out.append(np.append(up, np.nan) if not more else up)
            yield first + k, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, frame, made = [], [], [[] for _ in names]
            values, offsets = b.column(2).values.to_numpy(zero_copy_only=False), np.asarray(b.column(2).offsets)
            steps = b.column(4).to_pylist() if per_clip else [hop] * b.num_rows
            for i, (block, own, step) in enumerate(zip(b.column(1).to_pylist(), b.column(3).to_pylist(), steps, strict=True)):
                for f, out in of_block(values[offsets[i] : offsets[i + 1]], block, own, int(step)):
                    who.append(np.full(len(out[0]), i))
                    frame.append(np.arange(f, f + len(out[0])))
                    for column, x in zip(made, out, strict=True):
                        column.append(x)
            if not who:
                continue
            arrays = []
            for name, k, xs in zip(names, kinds, made, strict=True):
                x = np.concatenate(xs)
                if k == "double":
                    arrays.append(pa.array(x, mask=np.isnan(x) if name == RISE else None))
                else:
                    arrays.append(pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel())))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(who))), pa.array(np.concatenate(frame)), *arrays], names=["clip_id", "frame", *names])

    return stored(b.mapInArrow(run, f"clip_id {clip}, frame long, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))))


def power_db(p: Column, ref: float | Column = 1.0, top_db: float = 80.0) -> Column:
    """Decibels of a power over ref squared, -top_db at least; both are at least 1e-10."""
    ref = F.lit(ref) if isinstance(ref, float) else ref
    return F.greatest(10 * F.log10(F.greatest(p, F.lit(1e-10)) / F.greatest(ref * ref, F.lit(1e-10))), F.lit(-top_db))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def centroid(p: Column, step: float) -> Column:
    """Power-weighted mean frequency (step: Hz between bins); 0 for a silent frame."""
    return F.when(total(p) > 0, total(F.transform(p, lambda x, i: x * (i * step))) / F.nullif(total(p), F.lit(0.0))).otherwise(0.0)


def rolloff(p: Column, step: float, share: float = 0.85) -> Column:
    """Frequency of the first bin up to which the share of the power lies."""
    some = lambda t: F.aggregate(p, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.struct((a.s + x).alias("s"), (a.n + F.when(a.s + x < share * t, 1).otherwise(0)).alias("n")), lambda a: a.n)
    return F.get(F.transform(F.array(total(p)), lambda t: F.when(t > 0, F.least(some(t), F.size(p) - 1) * step).otherwise(0.0)), F.lit(0))


def flatness(p: Column) -> Column:
    q = F.transform(p, lambda x: F.greatest(x, F.lit(1e-10)))
    return F.least(F.lit(1.0), F.exp(total(F.transform(q, lambda x: F.ln(x))) / F.size(q)) / (total(q) / F.size(q)))


def spectral(frames: DataFrame) -> DataFrame:
    """Clip means of the tones of analysed frames, and of their bandwidth around the clip's centroid."""
    means = frames.groupBy("clip_id").agg(*[F.avg(c).alias(c) for c in ("centroid", "rolloff", "flatness")])
    c, t = F.col("c"), F.nullif("m0", F.lit(0.0))
    wide = F.sqrt(F.greatest(F.col("m2") / t - 2 * c * F.col("m1") / t + c * c, F.lit(0.0)))
    w = frames.select("clip_id", "m0", "m1", "m2").join(means.select("clip_id", F.col("centroid").alias("c")), "clip_id")
    return means.join(w.groupBy("clip_id").agg(F.avg(F.coalesce(wide, F.lit(0.0))).alias("bandwidth")), "clip_id")


def reduced(blocks: DataFrame, columns: dict[str, Callable[[np.ndarray], float]]) -> DataFrame:
    """(clip_id, block, n, *columns): each block's samples reduced to numbers (NULL for a block without samples); n is how many it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, offsets = b.column(2).values.to_numpy(zero_copy_only=False), np.asarray(b.column(2).offsets)
            parts = [values[i:j] for i, j in zip(offsets, offsets[1:], strict=False)]
            made = [pa.array([float(f(x)) if len(x) else None for x in parts], pa.float64()) for f in columns.values()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(offsets).astype(np.int64)), *made], names=["clip_id", "block", "n", *columns])

    b = blocks.select("clip_id", "block", F.coalesce(F.col("pcm").cast("array<double>"), F.array().cast("array<double>")).alias("pcm"))
    kinds = dict(b.dtypes)
    return b.mapInArrow(run, f"clip_id {kinds['clip_id']}, block {kinds['block']}, n long, " + ", ".join(f"{c} double" for c in columns))


def quality(blocks: DataFrame, clip: float = 0.99) -> DataFrame:
    """DC offset, level, peak and crest of the centred signal, share of clipped samples of the raw one.

    Blocks are reduced inside their rows (sums, extremes) before clips are aggregated.
    """
    per = reduced(blocks, {"s": np.sum, "ss": lambda x: x @ x, "lo": np.min, "hi": np.max, "c": lambda x: np.count_nonzero(np.abs(x) >= clip)})
    g = per.groupBy("clip_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("c").alias("c")).where("n > 0")
    mean = F.col("s") / F.col("n")
    rms, peak = F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean * mean)), F.greatest(F.col("hi") - mean, mean - F.col("lo"))
    db = lambda x: F.when(x > 0, F.greatest(F.lit(-120.0), 20 * F.log10(F.when(x > 0, x)))).otherwise(-120.0)
    return g.select("clip_id", mean.alias("dc_offset"), db(rms).alias("rms_db"), db(peak).alias("peak_db"), (db(peak) - db(rms)).alias("crest_factor"), (F.col("c") / F.col("n")).alias("clip_ratio"), (F.col("c") / F.col("n") > 0.0001).alias("clipping_detected"))


def zero_crossing_rate(blocks: DataFrame) -> DataFrame:
    """Sign changes per step (0 counts as positive), inside blocks and across their borders."""
    w = Window.partitionBy("clip_id").orderBy("block")
    b = reduced(blocks, {"inner": lambda x: np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)), "head": lambda x: x[0], "tail": lambda x: x[-1]}).where("n > 0")
    b = b.withColumn("last", F.lag("tail").over(w))
    edge = F.when(F.col("last").isNotNull() & ((F.col("last") >= 0) != (F.col("head") >= 0)), 1).otherwise(0)
    return b.groupBy("clip_id").agg((F.sum(F.col("inner") + edge) / F.nullif(F.sum("n") - 1, F.lit(0))).alias("zcr"))


def frame_levels(frames: DataFrame) -> DataFrame:
    return frames.select("clip_id", "frame", F.sqrt(total(F.transform("pcm", lambda x: x * x)) / F.size("pcm")).alias("rms"))


def ranked(levels: DataFrame, value: str, places: dict[str, Callable[[Column], Column]], bins: int = 1 << 16) -> DataFrame:
    """(clip_id, *places): values by their place from 1 in each clip's order, found by counting; places maps a count to a place.

    A place is known to lie in a range of the values' bit patterns, which are in the order of the values (positive ones). Each round counts
    the values of the range in `bins` equal parts and goes on in the part that holds the place, until one pattern is left (four rounds).
    A round is one aggregate of a number a row; no clip's values are sorted or gathered.
    """
    kind = dict(levels.dtypes)["clip_id"]
    v = levels.where(F.col(value) > 0).select("clip_id", F.col(value).alias("_v"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x.view(np.int64))], names=["clip_id", "bits"])

    v = stored(v.mapInArrow(patterns, f"clip_id {kind}, bits long"))
    n = v.groupBy("clip_id").agg(F.count("*").alias("n"))
    find = n.select("clip_id", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), f(F.col("n")).cast("long").alias("place")) for k, f in places.items()])).alias("p")).select("clip_id", "p.*", F.lit(0).cast("long").alias("low"))
    span, width = (1 << 63) - 1, 1 << 63
    while width > 1:
        width = max(width // bins, 1)
        ranges = find.select("clip_id", "low").distinct()  # at most one for each place of a clip
        j = v.join(ranges, "clip_id").where((F.col("bits") >= F.col("low")) & (F.col("bits") - F.col("low") < span))
        counts = j.groupBy("clip_id", "low", F.expr(f"(bits - low) div {width}L").alias("bin")).agg(F.count("*").alias("c"))
        w = Window.partitionBy("clip_id", "low").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most `bins` rows
        counts = counts.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
        hit = find.join(counts, ["clip_id", "low"]).where((F.col("place") > F.col("before")) & (F.col("place") <= F.col("before") + F.col("c")))
        find = stored(hit.select("clip_id", "name", (F.col("place") - F.col("before")).alias("place"), (F.col("low") + F.col("bin") * F.lit(width).cast("long")).alias("low")))
        span = width

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(b.column(2).to_numpy().view(np.float64))], names=["clip_id", "name", "x"])

    x = find.select("clip_id", "name", "low").mapInArrow(numbers, f"clip_id {kind}, name string, x double")
    return x.groupBy("clip_id").agg(*[F.max(F.when(F.col("name") == k, F.col("x"))).alias(k) for k in places])


def dynamic_range(levels: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """dB between the percentiles of non-zero frame levels, by truncated index (no interpolation)."""
    at = lambda p: lambda n: F.least(F.floor(n * p) + 1, n)
    r = ranked(levels, "rms", {"low": at(low), "high": at(high)})
    return r.select("clip_id", (20 * F.log10(F.col("high") / F.col("low"))).alias("dynamic_range"))


def onset_envelope(frames: DataFrame) -> DataFrame:
    """(clip_id, frame, env): positive flux into each frame over the clip's largest, from frames analysed with rise; 0 for the first frame."""
    f = frames.where("rise is not null").select("clip_id", (F.col("frame") + 1).alias("frame"), F.col("rise").alias("flux"))
    f = f.unionByName(frames.where("frame = 0").select("clip_id", "frame", F.lit(0.0).alias("flux")))
    top = frames.groupBy("clip_id").agg(F.max("rise").alias("top"))
    return f.join(top, "clip_id").select("clip_id", "frame", F.when(F.col("top") > 0, F.col("flux") / F.nullif("top", F.lit(0.0))).otherwise(0.0).alias("env"))


def onsets(env: DataFrame, threshold: float = 0.1, gap: int = 1, backtrack: bool = False) -> DataFrame:
    """Local maxima over the threshold at least gap frames after the last kept one.

    backtrack: each is moved back to the local minimum before it, ten frames at most, while the envelope does not rise.
    """
    w = Window.partitionBy("clip_id").orderBy("frame")
    before = F.reverse(F.collect_list("env").over(w.rowsBetween(-11, -1)))
    peaks = env.withColumns({"p": F.lag("env").over(w), "q": F.lead("env").over(w)} | ({"before": before} if backtrack else {})).where((F.col("env") > threshold) & (F.col("env") > F.col("p")) & (F.col("env") >= F.col("q")))
    back = F.lit(0)
    if backtrack:  # steps back to the lowest of the frames that are reached before the envelope rises again
        state = F.struct(F.col("env").alias("low"), F.lit(0).alias("at"), F.lit(False).alias("stop"))
        step = lambda a, i: F.struct(F.when(~a.stop & (F.get("before", i) <= a.low), F.get("before", i)).otherwise(a.low).alias("low"), F.when(~a.stop & (F.get("before", i) <= a.low), i + 1).otherwise(a["at"]).alias("at"), (a.stop | F.coalesce(F.get("before", i + 1) > F.get("before", i), F.lit(False))).alias("stop"))
        count = F.least(F.lit(10), F.size("before"))
        back = F.when(count > 0, F.aggregate(F.sequence(F.lit(0), count - 1), state, step, lambda a: a["at"])).otherwise(0)
    return spaced(peaks.select("clip_id", F.col("frame").cast("long").alias("frame"), (F.col("frame") - back).cast("long").alias("out")), gap)


def spaced(peaks: DataFrame, gap: int, first: int | None = None) -> DataFrame:
    """(clip_id, frame): out of the peaks (clip_id, frame, out) that are at least gap frames behind the last kept one (at first: behind frame `first`).

    Only peaks meet by clip, in order, and are walked once.
    """
    kind = dict(peaks.dtypes)["clip_id"]
    g = peaks.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("frame", "out"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = b.column(1)[i].values
                last, kept = first, []
                for frame, out in zip(rows.field(0).to_pylist(), rows.field(1).to_pylist(), strict=True):
                    if last is None or frame - last >= gap:
                        last = frame
                        kept.append(out)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1).take(pa.array([0] * len(kept), pa.int64())), pa.array(kept, pa.int64())], names=["clip_id", "frame"])

    return g.mapInArrow(run, f"clip_id {kind}, frame long")


def env_blocks(env: DataFrame, size: int) -> DataFrame:
    """(clip_id, block, pcm): the envelope in blocks of size frames, in order."""
    g = env.groupBy("clip_id", F.floor(F.col("frame") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("frame", "env"))).alias("e"))
    return g.select("clip_id", "block", F.transform("e", lambda x: x.env).alias("pcm"))


def tempo_lags(env: DataFrame, first: int, last: int, size: int = 4096) -> DataFrame:
    """(clip_id, lag, r): autocorrelation of each clip's envelope at lags first to last, over its power (NULL if that is 0).

    Each block of size frames gets `last` frames of those behind and is multiplied with itself in the frequency domain, which gives the
    sums of all lags at once; the blocks' sums are added up. Rounded to 12 digits, so that the transform breaks no ties.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = []
            for x, own in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                x = x.values.to_numpy(zero_copy_only=False)
                n = 1 << int(len(x) + own + last).bit_length()
                r = np.fft.irfft(np.conj(np.fft.rfft(x[:own], n)) * np.fft.rfft(x, n), n)
                sums.append(np.append((x[:own] ** 2).sum(), r[first : last + 1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, pa.list_(pa.float64()))], names=["clip_id", "sums"])

    b = with_halo(env_blocks(env, size), last, size).select("clip_id", "pcm", "own")
    each = b.mapInArrow(run, f"clip_id {dict(b.dtypes)['clip_id']}, sums array<double>")
    s = each.groupBy("clip_id").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(last - first + 2)])
    ratio = lambda k: F.round(F.col(f"s{k}") / F.nullif("s0", F.lit(0.0)), 12)
    return s.select("clip_id", F.explode(F.array(*[F.struct(F.lit(first + k).alias("lag"), ratio(k + 1).alias("r")) for k in range(last - first + 1)])).alias("x")).select("clip_id", "x.*")


def peaks_by(blocks: DataFrame, step: str, size: int, last: Column | None = None) -> DataFrame:
    """(clip_id, bar, peak): the largest absolute sample of stretches of `step` samples (a column); bars after last join it."""
    at = F.col("block") * size
    b = blocks.select("clip_id", "pcm", at.alias("at"), F.col(step).alias("step"), F.floor(at / F.col(step)).alias("lo"), F.floor((at + F.size("pcm") - 1) / F.col(step)).alias("hi"))
    top = lambda k: F.array_max(F.transform(F.slice("pcm", F.greatest(k * F.col("step") - F.col("at"), F.lit(0)).cast("int") + 1, ((k + 1) * F.col("step") - F.greatest(k * F.col("step"), F.col("at"))).cast("int")), lambda x: F.abs(x)))
    bars = b.where("hi >= lo").select("clip_id", F.explode(F.transform(F.sequence("lo", "hi"), lambda k: F.struct(k.alias("bar"), top(k).alias("peak")))).alias("x")).select("clip_id", "x.*")
    if last is not None:
        bars = bars.withColumn("bar", F.least("bar", last))
    return bars.groupBy("clip_id", F.col("bar").cast("int").alias("bar")).agg(F.max("peak").alias("peak"))


def waveform(blocks: DataFrame, width: int, size: int = BLOCK) -> DataFrame:
    """Absolute peaks of width equal stretches (0 where there is nothing), reduced inside the blocks."""
    n = lengths(blocks).withColumn("step", F.ceil(F.col("len") / width))
    peaks = peaks_by(blocks.join(n, "clip_id"), "step", size)
    bars = n.select("clip_id", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("bar"))
    return bars.join(peaks, ["clip_id", "bar"], "left").select("clip_id", "bar", F.coalesce("peak", F.lit(0.0)).alias("peak"))


def silence_segments(levels: DataFrame, lengths: DataFrame, hop: int, threshold_db: float, silence: int, least: int) -> DataFrame:
    """(clip_id, part, start, end) in samples: clips cut at silences of `silence` frames or more that sound follows.

    levels: frames that are not centred, hop samples apart; lengths: (clip_id, len). What stands before the first such silence, between
    two, and behind the last to the clip's end is a part, if it has `least` samples; a clip without parts is one part if it is as long.
    """
    w = Window.partitionBy("clip_id").orderBy("frame")
    f = levels.select("clip_id", "frame", (F.col("rms") < 10 ** (threshold_db / 20)).alias("quiet"))
    turns = f.withColumn("p", F.lag("quiet").over(w)).where(F.col("p").isNull() | (F.col("p") != F.col("quiet")))
    runs = turns.select("clip_id", "quiet", F.col("frame").alias("a"), F.lead("frame").over(w).alias("b"))
    cuts = runs.where(F.col("quiet") & (F.col("b") - F.col("a") >= silence)).select("clip_id", (F.col("a") * hop).alias("a"), (F.col("b") * hop).alias("b"))
    inner = cuts.select("clip_id", F.coalesce(F.lag("b").over(Window.partitionBy("clip_id").orderBy("a")), F.lit(0).cast("long")).alias("start"), F.col("a").alias("end"))
    last = lengths.join(cuts.groupBy("clip_id").agg(F.max("b").alias("b")), "clip_id", "left").select("clip_id", F.coalesce("b", F.lit(0).cast("long")).alias("start"), F.col("len").alias("end"))
    found = inner.unionByName(last).where((F.col("end") > F.col("start")) & (F.col("end") - F.col("start") >= least))
    whole = lengths.where(F.col("len") >= F.greatest(F.lit(least), F.lit(1))).join(found.select("clip_id"), "clip_id", "left_anti").select("clip_id", F.lit(0).cast("long").alias("start"), F.col("len").alias("end"))
    place = F.row_number().over(Window.partitionBy("clip_id").orderBy("start")) - 1
    return found.unionByName(whole).select("clip_id", place.alias("part"), "start", "end")


def channel_levels(blocks: DataFrame, channels: int = 2, size: int = BLOCK) -> DataFrame:
    """RMS and peak in dB (-96 at least) of each channel of interleaved samples, summed inside the blocks."""
    db = lambda x: F.when(x > 0, F.greatest(F.lit(-96.0), 20 * F.log10(F.when(x > 0, x)))).otherwise(-96.0)
    own = lambda c: F.filter("pcm", lambda x, i: F.pmod(F.col("block") * size + i, F.lit(channels)) == c)
    one = lambda c: F.struct(F.lit(c).alias("channel"), F.size(own(c)).alias("n"), total(F.transform(own(c), lambda x: x * x)).alias("ss"), F.array_max(F.transform(own(c), lambda x: F.abs(x))).alias("top"))
    per = blocks.select("clip_id", F.explode(F.array(*[one(c) for c in range(channels)])).alias("x")).select("clip_id", "x.*")
    g = per.groupBy("clip_id", "channel").agg(F.sum("n").alias("n"), F.sum("ss").alias("ss"), F.max("top").alias("top"))
    return g.where("n > 0").select("clip_id", "channel", db(F.sqrt(F.col("ss") / F.col("n"))).alias("rms_db"), db(F.col("top")).alias("peak_db"))


def takes(levels: DataFrame, threshold: float, silence_s: float) -> DataFrame:
    """Loud stretches per device: one ends when all readings for at least silence_s seconds were at or under the threshold."""
    w = Window.partitionBy("device_id").orderBy("ts", "event_id")
    l = levels.withColumn("loud", F.col("peak_db") > threshold)
    l = l.withColumn("island", F.sum(F.when(F.col("loud") != F.coalesce(F.lag("loud").over(w), ~F.col("loud")), 1).otherwise(0)).over(w))
    seconds = lambda c: F.unix_micros(c) / 1e6
    runs = l.groupBy("device_id", "island", "loud").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    runs = runs.withColumn("stop", ~F.col("loud") & (seconds(F.col("b")) - seconds(F.col("a")) >= silence_s))
    runs = runs.withColumn("take", F.sum(F.col("stop").cast("int")).over(Window.partitionBy("device_id").orderBy("island")))
    return runs.where("loud").groupBy("device_id", "take").agg(F.min("a").alias("started_at"), F.max("b").alias("ended_at"), F.sum("n").alias("loud_readings"))


def smoothing_map(xs: np.ndarray, attack: float, decay: float, lo: float, hi: float) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): what smoothing over xs makes of any value before them between lo and hi; linear between the points.

    Each reading maps the value before it by a broken line that rises everywhere (its bend is the reading); so do several in a row. The values
    draw together with each reading, so few bends lie between lo and hi, and after some hundred readings the line is flat.
    """
    u, v = [lo, hi], [lo, hi]
    for x in xs:
        if v[0] < x < v[-1]:
            k = bisect_left(v, x)
            if v[k] != x:
                u.insert(k, u[k - 1] + (u[k] - u[k - 1]) * (x - v[k - 1]) / (v[k] - v[k - 1]))
                v.insert(k, x)
        v = [y + (x - y) * (attack if x > y else decay) for y in v]
        if v[0] == v[-1]:
            u, v = [lo, hi], [v[0], v[0]]
    return np.array(u), np.array(v)


def smoothed(levels: DataFrame, rates: dict[str, tuple[float, float]], start: float = -96.0, size: int = 4096) -> DataFrame:
    """levels (device_id, ts, event_id, ...) with smoothed_<column> after each reading, for columns with a rate upwards and one downwards.

    A device's readings are cut into chunks in order of ts and event_id. Each chunk's effect on any value before it is worked out by
    itself (`smoothing_map`); these are applied one after the other, a few numbers a chunk; then each chunk is smoothed from its own first
    value. A device of any length is many tasks. NULL readings leave the value as it is.
    """
    kinds = dict(levels.dtypes)
    names, device = list(rates), kinds["device_id"]
    p = stored(pack(levels.select("device_id", F.struct("ts", "event_id").alias("at"), *names), "device_id", ["at", *names], size).select("device_id", "piece", "rows"))
    ends = levels.groupBy("device_id").agg(*[f(c).alias(f"{n}_{c}") for c in names for n, f in (("lo", F.min), ("hi", F.max))])
    ends = ends.select("device_id", *[F.coalesce(f(f"{n}_{c}", F.lit(start)), F.lit(start)).cast("double").alias(f"{n}_{c}") for c in names for n, f in (("lo", F.least), ("hi", F.greatest))])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = [[] for _ in names]
            for i in range(b.num_rows):
                for k, c in enumerate(names):
                    x = b.column(2)[i].values.field(c).to_numpy(zero_copy_only=False).astype(float)
                    u, v = smoothing_map(x[~np.isnan(x)].tolist(), *rates[c], b.column(3 + 2 * k)[i].as_py(), b.column(4 + 2 * k)[i].as_py())
                    lines[k].append(np.concatenate([u, v]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, pa.list_(pa.float64())) for x in lines]], names=["device_id", "piece", *names])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, chunks in enumerate(b.column(1).to_pylist()):
                state, out = [start] * len(names), []
                for chunk in chunks:
                    out.append((chunk["piece"], *state))
                    state = [float(np.interp(y, *np.split(np.array(chunk[c]), 2))) for y, c in zip(state, names, strict=True)]
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1).take(pa.array([0] * len(out), pa.int64())), pa.array(columns[0], pa.int64()), *[pa.array(c, pa.float64()) for c in columns[1:]]], names=["device_id", "piece", *names])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows, out = b.column(2)[i].values, []
                for k, c in enumerate(names):
                    (attack, decay), y, line = rates[c], b.column(3 + k)[i].as_py(), []
                    for x in rows.field(c).to_pylist():
                        if x is not None:
                            y += (x - y) * (attack if x > y else decay)
                        line.append(y)
                    out.append(pa.array(line, pa.float64()))
                at = rows.field("at")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1).take(pa.array([0] * len(rows), pa.int64())), at.field("ts"), at.field("event_id"), *out], names=["device_id", "ts", "event_id", *[f"smoothed_{c}" for c in names]])

    each = p.join(ends, "device_id").mapInArrow(maps, f"device_id {device}, piece long, " + ", ".join(f"{c} array<double>" for c in names))
    order = each.groupBy("device_id").agg(F.array_sort(F.collect_list(F.struct("piece", *names))).alias("chunks"))
    first = order.mapInArrow(follow, f"device_id {device}, piece long, " + ", ".join(f"{c} double" for c in names))
    shape = f"device_id {device}, ts {kinds['ts']}, event_id {kinds['event_id']}, " + ", ".join(f"smoothed_{c} double" for c in names)
    return p.join(first, ["device_id", "piece"]).select("device_id", "piece", "rows", *names).mapInArrow(walk, shape)


def smooth(levels: DataFrame, attack: float = 0.5, decay: float = 0.1, start: float = -96.0) -> DataFrame:
    """(device_id, smoothed_db, readings): the last smoothed peak of each device, and how many readings it has."""
    s = smoothed(levels, {"peak_db": (attack, decay)}, start)
    return s.groupBy("device_id").agg(F.max_by("smoothed_peak_db", F.struct("ts", "event_id")).alias("smoothed_db"), F.count("*").alias("readings"))
