"""Keys, scales, tempo and the four parts of compatibility, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The circle of fifths, each major key's relative minor, and note names from C by semitone.
FIFTHS = ["C", "G", "D", "A", "E", "B", "F#", "Db", "Ab", "Eb", "Bb", "F"]
RELATIVE = ["Am", "Em", "Bm", "F#m", "C#m", "G#m", "D#m", "Bbm", "Fm", "Cm", "Gm", "Dm"]
SEMITONES = {"C": 0, "C#": 1, "Db": 1, "D": 2, "D#": 3, "Eb": 3, "E": 4, "F": 5, "F#": 6, "Gb": 6, "G": 7, "G#": 8, "Ab": 8, "A": 9, "A#": 10, "Bb": 10, "B": 11}
MAJOR, MINOR = [0, 2, 4, 5, 7, 9, 11], [0, 2, 3, 5, 7, 8, 10]
#: Tempo ratios that still fit.
RATIOS = [0.5, 2.0, 0.25, 4.0, 0.75, 1.5]
PATTERN = r"(?i)^([A-G][#b]?)\s*(m|min|minor)?$"


def lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def normalize_key(key: Column) -> Column:
    """A minor becomes Am, bb min becomes Bbm; text that is no key stays."""
    root, mode = F.regexp_extract(F.trim(key), PATTERN, 1), F.regexp_extract(F.trim(key), PATTERN, 2)
    named = F.concat(F.upper(F.substring(root, 1, 1)), F.substring(root, 2, 9), F.when(mode != "", "m").otherwise(""))
    return F.when(root != "", named).otherwise(key)


def relative_key(key: Column) -> Column:
    return F.try_element_at(lookup(dict(zip(FIFTHS, RELATIVE, strict=True)) | dict(zip(RELATIVE, FIFTHS, strict=True))), key)


def root_major(key: Column) -> Column:
    return F.coalesce(F.try_element_at(lookup(dict(zip(RELATIVE, FIFTHS, strict=True))), key), key)


def on_circle(key: Column) -> Column:
    """Place of the key's major root on the circle of fifths from 1; NULL if it is not on it."""
    return F.nullif(F.array_position(F.array(*map(F.lit, FIFTHS)), root_major(key)), F.lit(0).cast("bigint"))


def semitone(key: Column) -> Column:
    return F.try_element_at(lookup(SEMITONES), F.regexp_extract(key, r"^([A-G][#b]?)", 1))


def scale_degrees(root: int, minor: bool) -> list[int]:
    return sorted((root + d) % 12 for d in (MINOR if minor else MAJOR))


def key_facts(key: Column, prefix: str = "") -> dict[str, Column]:
    """What the key part compares, computed once per clip rather than once per pair."""
    k = normalize_key(key)
    return {f"{prefix}norm": k, f"{prefix}relative": relative_key(k), f"{prefix}place": on_circle(k)}


def key_part(a: str = "a_", b: str = "") -> Column:
    """From the key_facts of both clips."""
    x, y, d = F.col(f"{a}norm"), F.col(f"{b}norm"), F.abs(F.col(f"{a}place") - F.col(f"{b}place"))
    d = F.least(d, 12 - d)
    return F.when(x.isNull() | y.isNull(), 0.5).when(x == y, 1.0).when(F.col(f"{a}relative") == y, 0.95).when(d <= 1, 0.85).when(d <= 2, 0.7).otherwise(0.3)


def bpm_part(a: Column, b: Column, tolerance: float = 0.05) -> Column:
    """Relative to the source a; a tempo of 0 fits nothing."""
    off = lambda r: F.coalesce(F.abs(a - b * r) / F.nullif(a, F.lit(0.0)) <= tolerance, F.lit(False))
    near = off(RATIOS[0])
    for r in RATIOS[1:]:
        near = near | off(r)
    return F.when(a.isNull() | b.isNull(), 0.5).when(off(1.0), 1.0).when(near, 0.9).otherwise(0.2)


def frequency_part(ca: Column, wa: Column, cb: Column, wb: Column) -> Column:
    ha, hb = F.coalesce(wa, F.lit(1000.0)) / 2, F.coalesce(wb, F.lit(1000.0)) / 2
    overlap = F.greatest(F.lit(0.0), F.least(ca + ha, cb + hb) - F.greatest(ca - ha, cb - hb))
    span = F.greatest(ca + ha, cb + hb) - F.least(ca - ha, cb - hb)
    return F.when(ca.isNull() | cb.isNull(), 0.5).when(span > 0, 1 - 0.7 * overlap / F.nullif(span, F.lit(0.0))).otherwise(1.0)


def dynamics_part(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(a.isNull() | b.isNull(), 0.5).when(d > 6, 0.9).when((d < 3) & ((a + b) / 2 > 12), 0.5).otherwise(0.7)


def parse_key(key: Column) -> Column:
    """Struct (root, mode) of A, Am, a minor, C# maj and the like; NULL for a root that is no note. A lone M counts as minor."""
    t = F.trim(key)
    pattern = r"(?i)^([A-G][#b]?)\s*(m|min|minor|maj|major)?$"
    root = F.concat(F.upper(F.substring(F.regexp_extract(t, pattern, 1), 1, 1)), F.substring(F.regexp_extract(t, pattern, 1), 2, 9))
    mode = F.when(F.lower(F.regexp_extract(t, pattern, 2)).isin("m", "min", "minor"), "minor").otherwise("major")
    return F.when(F.try_element_at(lookup(SEMITONES), root).isNotNull(), F.struct(root.alias("root"), mode.alias("mode")))
