"""Row-wise rules as column expressions: scores, acoustic tags, clip types and perceptual attributes. NULL inputs as stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The thresholds and weights in this module must match other tools that read the scores. Corners for clips by type:
CORNERS = {
    "kick": (-3, -2, 0), "snare": (-1, -1, 2), "hihat": (1, -1, -1), "hat": (1, -1, -1), "clap": (-2, 0, 1), "perc": (0, -0.5, -2), "bass": (-3, 1, -1), "synth": (2, 2, 1), "lead": (2, 2, 1),
    "pad": (3, 3, 0), "vocal": (1, 2, -2), "ambient": (3, 3, -3), "fx": (0, 1, 3), "loop": (-1, 3, 2), "noise": (2, 0, -3), "texture": (3, 1, -2),
}


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def linear(x: Column, lo: float, hi: float) -> Column:
    return clamp((x - lo) / (hi - lo))


def log_scaled(x: Column, lo: float, hi: float) -> Column:
    return clamp((F.ln(x) - F.ln(F.lit(lo))) / (F.ln(F.lit(hi)) - F.ln(F.lit(lo))))


def weighted_mean(parts: list[tuple[float, Column]], none: float) -> Column:
    """Mean of the parts that are not null; `none` if all are."""
    total = sum((F.coalesce(w * s, F.lit(0.0)) for w, s in parts), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), w).otherwise(0.0) for w, s in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight).otherwise(none)


def quality_score(rms: Column, crest: Column, clipping: Column, dynamics: Column) -> Column:
    """0-100 from level, crest, clipping and dynamic range; 50 if level and crest are both unknown."""
    off = F.abs(rms + 18) - 6
    level = F.when(off <= 0, 100.0).when(off > 0, F.greatest(F.lit(0.0), 100 - 5 * off))
    punch = F.when(crest < 6, F.greatest(F.lit(0.0), 100 - 10 * (6 - crest))).when(crest > 12, F.greatest(F.lit(0.0), 100 - 5 * (crest - 12))).when(crest.isNotNull(), 100.0)
    clean = F.when(clipping, 0.0).when(~clipping, 100.0)
    spread = F.when(dynamics >= 12, 100.0).when(dynamics >= 6, 50 + (dynamics - 6) / 6 * 50).when(dynamics.isNotNull(), dynamics / 6 * 50)
    return F.when(rms.isNull() & crest.isNull(), 50.0).otherwise(weighted_mean([(0.4, level), (0.3, punch), (0.2, clean), (0.1, spread)], 50.0))


def simple_quality(dynamics: Column, clipping: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), dynamics / 20 * 100) - F.when(clipping, 20.0).otherwise(0.0))


def loop_score(quality: Column, loopable: Column) -> Column:
    """quality is on 0-100 here."""
    return F.coalesce(clamp(quality, 0.0, 100.0), F.when(loopable, 75.0).when(~loopable, 25.0), F.lit(50.0))


def spectral_score(centroid: Column, flatness: Column) -> Column:
    off = F.abs(centroid - 3000)
    bright = F.when(off <= 2000, 100 - off / 2000 * 30).when(off > 2000, F.greatest(F.lit(0.0), 70 - (off - 2000) / 1000 * 20))
    flat = F.when(flatness < 0.3, 60 + flatness / 0.3 * 40).when(flatness <= 0.6, 100.0).when(flatness > 0.6, F.greatest(F.lit(50.0), 100 - (flatness - 0.6) * 100))
    return weighted_mean([(0.7, bright), (0.3, flat)], 50.0)


def usability_score(duration: Column, rate: Column) -> Column:
    length = F.when(duration < 0.1, duration / 0.1 * 50).when(duration <= 30, 100.0).when(duration > 30, F.greatest(F.lit(20.0), 100 - (duration - 30) / 60 * 50))
    fidelity = F.when(rate >= 44100, 100.0).when(rate >= 22050, 70.0).when(rate.isNotNull(), 30.0)
    return weighted_mean([(0.6, length), (0.4, fidelity)], 50.0)


def applicability(c=F.col) -> dict[str, Column]:
    """quality, loop_score, spectral, usability and total of a clip; the total is formed before the parts are rounded."""
    parts = {
        "quality": quality_score(c("rms_db"), c("crest_factor"), c("clipping_detected"), c("dynamic_range")),
        "loop_score": loop_score(c("loop_quality"), c("is_loopable")),
        "spectral": spectral_score(c("spectral_centroid"), c("spectral_flatness")),
        "usability": usability_score(c("duration"), c("sample_rate")),
    }
    total = 0.35 * parts["quality"] + 0.25 * parts["loop_score"] + 0.20 * parts["spectral"] + 0.20 * parts["usability"]
    return {k: F.round(F.round(v, 9), 1) for k, v in (parts | {"total": total}).items()}  # 59.4499... from float noise counts as 59.45


def ranged(x: Column, steps: list[tuple[float, str]], last: str) -> Column:
    out = None
    for below, name in steps:
        out = F.when(x < below, name) if out is None else out.when(x < below, name)
    return out.when(x.isNotNull(), last)


def three_way(x: Column, low: float, high: float, names: tuple[str, str, str]) -> Column:
    return F.when(x > high, names[2]).when(x < low, names[0]).when(x.isNotNull(), names[1])


def acoustic_tags(c=F.col, dark=1500.0, bright=4000.0, sustained=6.0, punchy=12.0, tonal=0.1, noisy=0.5, short=0.5, long=4.0) -> Column:
    """Tags in the order brightness, range, dynamics, tonality, duration, loopable."""
    centroid = c("spectral_centroid")
    tags = [
        three_way(centroid, dark, bright, ("dark", "neutral", "bright")),
        ranged(centroid, [(200, "sub"), (500, "low"), (2000, "mid"), (6000, "high")], "air"),
        three_way(c("crest_factor"), sustained, punchy, ("sustained", "balanced", "punchy")),
        three_way(c("spectral_flatness"), tonal, noisy, ("tonal", "mixed", "noisy")),
        three_way(c("duration"), short, long, ("short", "medium", "long")),
        F.when(c("is_loopable"), "loopable"),
    ]
    return F.array_compact(F.array(*tags))


def suggest_type(c=F.col) -> Column:
    """First rule that holds; NULL without centroid or crest. An unknown duration counts as 1 s."""
    hz, crest, dur, flat = c("spectral_centroid"), c("crest_factor"), F.coalesce(c("duration"), F.lit(1.0)), c("spectral_flatness")
    hit = F.when(hz < 300, "kick").when(hz > 5000, "hihat").when(hz > 2000, "snare").otherwise("perc")
    tonal = (dur > 1) & (crest < 8) & (F.coalesce(flat, F.lit(0.5)) < 0.2)
    out = F.when((dur < 0.5) & (crest > 10), hit).when(tonal, F.when(hz > 2000, "lead").otherwise("pad")).when((hz < 500) & (dur > 0.3), "bass")
    out = out.when(flat > 0.7, "fx").when(dur < 0.3, "oneshot").when(c("is_loopable"), "loop")
    return F.when(hz.isNotNull() & crest.isNotNull(), out)


def drum_type(c=F.col) -> Column:
    hz, flat, crest, dur = c("spectral_centroid"), c("spectral_flatness"), c("crest_factor"), c("duration")
    out = F.when((hz < 300) & (crest > 8), "kick").when((hz > 5000) & (flat > 0.3), F.when(dur < 0.2, "hihat").otherwise("cymbal"))
    out = out.when((hz > 1000) & (hz < 5000) & (flat > 0.2) & (flat < 0.6), "snare").when((hz > 2000) & (hz < 6000) & (flat > 0.4) & (crest < 10), "clap")
    out = out.when((hz > 200) & (hz < 1000) & (flat < 0.3) & (crest > 6), "tom").when((hz > 3000) & (dur < 0.1) & (crest > 12), "rim").otherwise("perc")
    known = hz.isNotNull() & flat.isNotNull() & crest.isNotNull() & dur.isNotNull()
    return F.when(known & (dur <= 1), out)


def perceptual(c=F.col) -> dict[str, Column]:
    """Eight attributes in [0, 1], NULL where the source is."""
    crest = linear(c("crest_factor"), 3, 20)
    return {
        "brightness": log_scaled(c("spectral_centroid"), 100, 8000),
        "energy": linear(c("rms_db"), -60, 0),
        "percussiveness": crest,
        "tonality": clamp(1 - c("spectral_flatness")),
        "complexity": linear(c("dynamic_range"), 0, 40),
        "attack": clamp(0.6 * crest + 0.4 * clamp(1 - c("duration") / 2)),
        "width": F.when(c("channels") >= 2, 0.7).when(c("channels").isNotNull(), 0.3),
        "regularity": F.coalesce(clamp(c("loop_quality")), F.when(c("is_loopable"), 0.7).when(~c("is_loopable"), 0.3)),
    }


def coverage(columns: list[Column]) -> Column:
    return sum((x.isNotNull().cast("int") for x in columns), F.lit(0))


def score_band(x: Column) -> Column:
    return F.when(x >= 70, "high").when(x >= 40, "medium").when(x.isNotNull(), "low")


def heuristic_tag(rms: Column, hz: Column, zcr: Column, dur: Column, tempo: Column) -> Column:
    hit = F.when((hz > 5000) | (zcr > 0.25), "hat").when(hz < 700, "kick").otherwise("perc")
    return F.when(dur < 0.6, hit).when((dur > 2.5) & (tempo > 60), "loop").when(hz < 500, "bass").when((hz > 3500) & (rms < 0.1), "texture").when((dur > 1.5) & (hz < 2000), "pad")


def speech_like(rms: Column, hz: Column, zcr: Column, dur: Column) -> Column:
    return (dur >= 0.5) & (rms >= 0.005) & hz.between(300, 4500) & zcr.between(0.03, 0.25)


def layout(index: Column, share: Column, c=F.col) -> dict[str, Column]:
    """x, y and z in +-5 from brightness, energy and percussiveness (unknown: the middle) where share of the attributes is half or more.

    Other clips lie around the corner of their type, spread by index (from 0) along golden angles.
    """
    known = perceptual(c)
    at = [(F.coalesce(known[a], F.lit(0.5)) * 2 - 1) * 5 for a in ("brightness", "energy", "percussiveness")]
    corner = F.try_element_at(F.create_map(*[x for k, v in CORNERS.items() for x in (F.lit(k), F.array(*[F.lit(float(p)) for p in v]))]), F.regexp_replace(F.lower(c("sample_type")), "[^a-z]", ""))
    angle = F.radians(F.pmod(index * 137.508, F.lit(360.0)))
    reach = 1.8 * (0.3 + F.pmod(index * 0.618, F.lit(1.0)) * 0.7)
    swing = [F.cos(angle) * reach, F.sin(angle) * reach * 0.6, F.sin(angle * 0.7) * reach]
    return {n: F.when(share >= 0.5, at[k]).otherwise(F.coalesce(F.get(corner, F.lit(k)), F.lit(0.0)) + swing[k]) for k, n in enumerate("xyz")}
