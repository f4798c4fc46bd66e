"""Names, paths and texts: column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word lists of our own for generated names.
ADJECTIVES = ["amber", "brisk", "calm", "dusty", "early", "faint", "gentle", "hollow", "icy", "jolly", "keen", "lucid"]
NOUNS = ["anchor", "beacon", "canyon", "delta", "ember", "fjord", "grove", "harbor", "island", "jetty", "knoll", "lagoon"]
MOODS = {
    "bright": ["sunny", "vivid", "shiny"], "dark": ["gloomy", "inky", "shaded"], "dense": ["massive", "packed", "solid"], "thin": ["airy", "sparse", "slight"], "sharp": ["edgy", "pointed", "raspy"],
    "smooth": ["silken", "sleek", "soft"], "short": ["brief", "quick", "snappy"], "long": ["endless", "slow", "stretched"], "neutral": ["plain", "even", "middling", "mild"],
}
STOP_WORDS = ["the", "and", "for", "are", "was", "this", "that", "with", "you", "they", "from", "have"]


def pick(words: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (number % len(words) + 1).cast("int"))


def stem_from_seed(seed: Column) -> Column:
    """adjective-noun from bytes 0 and 1 of the seed's md5."""
    byte = lambda k: F.conv(F.substring(F.md5(seed.cast("binary")), 2 * k + 1, 2), 16, 10).cast("int")
    return F.concat_ws("-", pick(ADJECTIVES, byte(0)), pick(NOUNS, byte(1)))


def fnv(seeds: list[bytes]) -> np.ndarray:
    """64-bit FNV-1a hashes, unsigned: all seeds step by step, those that have ended last."""
    sizes = np.array([len(s) for s in seeds], np.int64)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes, data = (np.cumsum(sizes) - sizes)[order], sizes[order], np.frombuffer(b"".join(seeds), np.uint8)
    h = np.full(len(seeds), 0xCBF29CE484222325, np.uint64)
    for i in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -i, "left"))  # seeds of more than i bytes
        h[:n] = (h[:n] ^ data[begin[:n] + i]) * np.uint64(0x100000001B3)
    out = np.empty_like(h)
    out[order] = h
    return out


def stem_fnv(seed: Column) -> Column:
    """adjective-noun from the 64-bit FNV-1a hash of the seed's bytes; NULL for NULL."""

    def stems(seeds: pd.Series) -> pd.Series:
        out, known = pd.Series([None] * len(seeds), dtype=object), seeds.notna().to_numpy()
        h = fnv([s.encode() for s in seeds[known]])
        first, second = np.array(ADJECTIVES, object)[(h % 12).astype(int)], np.array(NOUNS, object)[((h >> np.uint64(16)) % 12).astype(int)]
        out[known] = [f"{x}-{y}" for x, y in zip(first, second, strict=True)]
        return out

    return F.pandas_udf(stems, "string")(seed)


def mood_adjective(seed: Column, rms: Column, hz: Column, zcr: Column, dur: Column) -> Column:
    """A word from the pools of all buckets that the features fall into (else the neutral one), by byte 2 of the seed's md5."""
    pool = lambda name: F.array(*map(F.lit, MOODS[name]))
    none = F.array().cast("array<string>")
    pair = lambda x, low, high, below, above: F.when(x > high, pool(above)).when(x < low, pool(below)).otherwise(none)
    words = F.concat(pair(hz, 800, 3000, "dark", "bright"), pair(rms, 0.03, 0.15, "thin", "dense"), pair(zcr, 0.05, 0.2, "smooth", "sharp"), pair(dur, 0.6, 3.0, "short", "long"))
    words = F.when(F.size(words) > 0, words).otherwise(pool("neutral"))
    byte = F.conv(F.substring(F.md5(seed.cast("binary")), 5, 2), 16, 10).cast("int")
    return F.get(words, byte % F.size(words))


def transcript_stem(text: Column) -> Column:
    """First three words of letters only, three letters or more, no stop words; NULL if none is left."""
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"[^a-z]", ""))
    kept = F.slice(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS)), 1, 3)
    return F.nullif(F.array_join(kept, "-"), F.lit(""))


def sanitize_name(name: Column) -> Column:
    clean = F.trim(F.regexp_replace(name, r"[^A-Za-z0-9_-]+", "-"), F.lit("-"))
    return F.when(clean == "", "recording").otherwise(clean)


def sanitize_text(text: Column) -> Column:
    """A generated name: first line, lower case, ASCII letters and digits joined by single hyphens; NULL unless 3 to 60 long."""
    line = F.regexp_replace(F.lower(F.trim(F.split(F.trim(text), "\n")[0])), r"[\"'`*_]", "")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"\s+", "-"), r"[^a-z0-9-]", ""), r"-{2,}", "-")
    clean = F.trim(clean, F.lit("-"))
    return F.when(F.length(clean).between(3, 60), clean)


def timestamp_suffix(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"_(\d{8}_\d{6})$", 1), F.lit(""))


def renamed(path: Column, stem: Column) -> Column:
    """The path with another stem; folder, extension (wav if none) and a timestamp suffix stay."""
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    extension, old = F.regexp_extract(name, r"\.([^.]+)$", 1), F.regexp_replace(name, r"\.[^.]+$", "")
    stamp = timestamp_suffix(old)
    return F.concat(folder, stem, F.coalesce(F.concat(F.lit("_"), stamp), F.lit("")), F.lit("."), F.when(extension != "", extension).otherwise("wav"))


def detect_pack(path: Column, root: str) -> Column:
    """First directory under root, or root's own name for files that lie in it."""
    rest = F.split(F.substr(path, F.lit(len(root.rstrip("/")) + 2)), "/")
    return F.when(F.size(rest) > 1, rest[0]).otherwise(root.rstrip("/").rpartition("/")[2])


def parent_directory(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2))


def to_db(x: Column, floor: float) -> Column:
    return F.when(x > 0, F.greatest(F.lit(floor), 20 * F.log10(F.when(x > 0, x)))).otherwise(floor)


def hz_to_mel(hz: Column) -> Column:
    return 2595 * F.log10(1 + hz / 700)


def pitch_class(hz: Column) -> Column:
    return F.when(hz > 0, F.pmod(F.round(69 + 12 * F.log2(F.when(hz > 0, hz) / 440)), F.lit(12)).cast("int"))


def from_db(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def mel_to_hz(mel: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), mel / 2595) - 1)


def frame_seconds(frame: Column, rate: float, hop: int) -> Column:
    return frame * hop / rate


def seconds_frame(seconds: Column, rate: float, hop: int) -> Column:
    return F.floor(seconds * rate / hop)


def lag_bpm(lag: Column, rate: float, hop: int) -> Column:
    """0 for a lag of 0."""
    return F.when(lag > 0, 60 * rate / hop / F.nullif(lag, F.lit(0))).otherwise(0.0)


def bpm_lag(bpm: Column, rate: float, hop: int) -> Column:
    return F.round(60 / F.nullif(bpm, F.lit(0.0)) * rate / hop).cast("long")
