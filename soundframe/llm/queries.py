"""The queries of the numbered operators and of the pipeline, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from soundframe.llm import bpe, chat, decontaminate, importance, lm, minhash, periodic, quality, repeats, secrets, tokens, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": secrets.query_secrets,
        "op2_repeats": repeats.query_repeats,
        "op3_minhash": minhash.query_minhash,
        "op4_warc": warc.query_warc,
        "op5_decontaminate": decontaminate.query_decontaminate,
        "op6_quality": quality.query_quality,
        "op7_bpe": bpe.query_bpe,
        "op8_lm": lm.query_lm,
        "op9_chat": chat.query_chat,
        "op10_toxicity": toxicity.query_toxicity,
        "op11_importance": importance.query_importance,
        "op12_periodic": periodic.query_periodic,
        "op13_tokens": tokens.query_tokens,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash": minhash.SQL, "op4_warc": warc.SQL, "op5_decontaminate": decontaminate.SQL, "op6_quality": quality.SQL, "op9_chat": chat.SQL, "op11_importance": importance.SQL}
