"""Audio files: scans of folders and old embedding blobs. WAV files themselves are read by `sources.wav`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soundframe.operators.catalog import extension

#: File name endings that count as audio.
EXTENSIONS = ["wav", "aif", "aiff", "flac", "mp3", "ogg", "m4a"]


def scan_audio(spark: SparkSession, root: str, recursive: bool = True, content: bool = False) -> DataFrame:
    """Audio files under root; without content no file is opened."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    df = df.where(extension(F.col("path")).isin(EXTENSIONS))
    return df if content else df.drop("content")


def embeddings_from_blob(df: DataFrame, column: str = "blob") -> DataFrame:
    """Little-endian 32-bit floats of a binary column as an array, by built-in functions; bytes that fill no float are left out.

    Infinite values and those that are no number become NULL.
    """
    code = F.hex(column)

    def value(i: Column) -> Column:
        byte = lambda k: F.substr(code, 8 * i + 2 * k + 1, F.lit(2))
        bits = F.conv(F.concat(byte(3), byte(2), byte(1), byte(0)), 16, 10).cast("long")
        sign = F.when(bits >= 1 << 31, -1.0).otherwise(1.0)
        power, rest = F.shiftright(bits, 23).bitwiseAND(255), bits.bitwiseAND((1 << 23) - 1)
        normal = (1 + rest / float(1 << 23)) * F.pow(F.lit(2.0), power - 127)
        return (sign * F.when(power == 0, rest * 2.0**-149).when(power < 255, normal)).cast("float")

    n = F.floor(F.octet_length(column) / 4).cast("int")
    places = F.filter(F.sequence(F.lit(0), n), lambda i: i < n)
    return df.select("sample_id", F.when(F.col(column).isNotNull(), F.transform(places, value)).alias("embedding"))
