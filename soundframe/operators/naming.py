"""Names of recordings from what is known of them: labels, transcripts, features, or the file's own name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundframe.functions import rules, text

#: Labels that mean a voice.
VOCAL = ["vocal", "voice", "speech", "singing", "rap"]


def name_recordings(clips: DataFrame, sure: float = 0.3, likely: float = 0.2) -> DataFrame:
    """(id, stem, tags, method, alternative) of clips (id, path, labels array<struct<label,confidence>> best first, transcript, refined,
    rms, centroid, zcr, dur_s, tempo, bpm, key).

    In order: a refined transcript, the transcript's words (both only for clips that look or are labelled vocal), a sure label, the
    heuristic class, the words of the file's own name. Labels and classes get a mood adjective where the features are known. Tempo
    and key follow. alternative: the other name from the transcript, if there is one.
    """
    seed = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]+$", "")
    feature = [F.col(c) for c in ("rms", "centroid", "zcr", "dur_s")]
    known = F.col("rms").isNotNull()
    mood = text.mood_adjective(seed, *feature)
    top = F.get("labels", F.lit(0))
    labelled = F.coalesce(top.confidence >= sure, F.lit(False))
    vocal = labelled & top.label.isin(VOCAL)
    heard = known & (vocal | F.coalesce(rules.speech_like(*feature), F.lit(False)))
    plain = F.when(heard, text.transcript_stem(F.col("transcript")))
    refined = F.when(heard & F.col("transcript").isNotNull(), F.col("refined"))
    kind = F.when(known, rules.heuristic_tag(*feature, F.col("tempo")))
    with_mood = lambda word: F.when(known, F.concat_ws("-", mood, word)).otherwise(word)
    base = F.coalesce(refined, plain, F.when(labelled, with_mood(top.label)), F.when(kind.isNotNull(), F.concat_ws("-", mood, kind)), text.stem_from_seed(seed))
    method = F.when(refined.isNotNull(), "llm").when(plain.isNotNull(), "transcription").when(labelled, "labels").when(kind.isNotNull(), "heuristic").otherwise("seed")
    likely_tags = F.transform(F.filter(F.slice("labels", 1, 3), lambda x: x.confidence >= likely), lambda x: x.label)
    none = F.array().cast("array<string>")
    spoken = refined.isNotNull() | plain.isNotNull()
    tags = F.when(spoken & ~vocal, F.array(F.lit("vocal"))).when(labelled, likely_tags).when(kind.isNotNull(), F.array(kind)).otherwise(none)
    key = F.nullif(F.regexp_replace("key", r"[^\p{L}\p{N}-]", ""), F.lit(""))
    stem = F.concat_ws("_", base, F.when(F.col("bpm") > 0, F.concat(F.bround("bpm", 0).cast("int").cast("string"), F.lit("bpm"))), key)
    return clips.select("id", stem.alias("stem"), tags.alias("tags"), method.alias("method"), F.when(refined.isNotNull() & (refined != plain), plain).alias("alternative"))
