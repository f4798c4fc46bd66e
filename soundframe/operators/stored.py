"""Cutting the lineage of what loops build up."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df from a checkpoint in spark.checkpoint.dir; where none is set, in the warehouse, or in a temporary folder on a single machine."""
    sc, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if not sc.getCheckpointDir():
        own = tempfile.mkdtemp(prefix="spark-") if sc.master.startswith("local[") else conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        sc.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or own)
    return df.checkpoint()
