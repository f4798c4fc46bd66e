"""The catalogue's tables as Parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, root: str, name: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(f"{root}/{name}")


def save(df: DataFrame, root: str, name: str, by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Writes a table; by names columns whose values become folders, so that filters on them read nothing else.

    With such columns only the folders that df has rows for are replaced.
    """
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*by) if by else w).parquet(f"{root}/{name}")
