"""WAV files as ranges of bytes: headers cost a few reads, samples are cut into blocks before anything of them is read.

Files are opened where tasks run, through Arrow's file systems (file, hdfs, s3, gs paths), and only the bytes that a row names are
read. A recording of any length is many rows, dealt over all tasks; none of them holds a whole file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from soundframe.operators.catalog import extension

#: Samples of a block, and bytes that a task is given to read.
BLOCK, SPLIT = 65536, 64 << 20
#: Format codes of plain integers, floats, and of an extended header that names one of them.
INTEGER, FLOAT, EXTENDED = 1, 3, 0xFFFE
#: A data size of this value says that the size is unknown (files that grew beyond 4 GB): the data reach to the end.
UNKNOWN = 0xFFFFFFFF
FACTS = "path string, kind int, channels long, sample_rate long, bit_depth long, at long, size long"


@lru_cache(maxsize=64)
def file_system(prefix: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(prefix)[0]


def opened(path: str):
    """A file that can be read at any place, and how long it is."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        system, place = fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    else:
        host = rest.lstrip("/").partition("/")[0]
        system, place = file_system(f"{scheme}://{host}"), fs.FileSystem.from_uri(path)[1]
    f = system.open_input_file(place)
    return f, f.size()


def header(f, length: int) -> tuple[int, int, int, int, int, int] | None:
    """(format, channels, rate, bits, data offset, data size) by walking the chunks, of which only heads are read; None if it is no WAV."""
    if length < 44 or (head := f.read_at(12, 0))[:4] != b"RIFF" or head[8:] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= length:
        head = f.read_at(min(48, length - at), at)
        name, size = head[:4], struct.unpack_from("<I", head, 4)[0]
        if name == b"fmt " and size >= 16 and len(head) >= 24:
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", head, 8)
            fmt = (struct.unpack_from("<H", head, 32)[0] if kind == EXTENDED and size >= 40 and len(head) >= 34 else kind, channels, rate, bits)
        elif name == b"data" and fmt:
            rest = length - at - 8
            return *fmt, at + 8, rest if size == UNKNOWN else min(size, rest)
        at += 8 + size + size % 2
    return None


def decodable(kind: int, channels: int, bits: int) -> bool:
    return channels > 0 and (kind == INTEGER and bits in (8, 16, 24, 32) or kind == FLOAT and bits in (32, 64))


def decoded(raw: bytes, kind: int, channels: int, bits: int) -> np.ndarray:
    """Mono samples in [-1, 1] of whole frames: channels averaged, 8 bits recentred, integers scaled by 2^(bits - 1)."""
    width = bits // 8
    body = np.frombuffer(raw, np.uint8)
    if kind == FLOAT:
        x = body.view(f"<f{width}").astype(np.float64)
    elif bits == 8:
        x = (body.astype(np.float64) - 128) / 128
    elif bits == 24:
        b = body.reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8) >> 8) / 2.0**23
    else:
        x = body.view(f"<i{width}") / 2.0 ** (bits - 1)
    return x.reshape(-1, channels).mean(1)


def headers(files: DataFrame) -> DataFrame:
    """path and what its header says (NULLs for what is no WAV) of files (path); only heads of chunks are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                f, length = opened(path)
                with f:
                    rows.append(header(f, length) or (None,) * 6)
            kinds = (pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=["path", "kind", "channels", "sample_rate", "bit_depth", "at", "size"])

    return files.select("path").mapInArrow(run, FACTS)


def wav_info(files: DataFrame) -> DataFrame:
    """(path, channels, sample_rate, bit_depth, duration) of files (path); NULLs for what is no WAV. No samples are read."""
    frame = F.col("channels") * F.col("sample_rate") * F.floor(F.col("bit_depth") / 8)
    return headers(files).select("path", "channels", "sample_rate", "bit_depth", (F.col("size") / F.nullif(frame, F.lit(0).cast("long"))).alias("duration"))


def orphans(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """WAV files (path) whose path the catalogue lacks, each valid or, if its header can't be read, invalid."""
    lost = files.where(extension(F.col("path")) == "wav").join(catalogue.select("path"), "path", "left_anti")
    return headers(lost).select("path", F.when(F.col("at").isNotNull(), "valid").otherwise("invalid").alias("status"))


def ranges(facts: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per block of each file of headers: where its bytes begin and how many they are."""
    f = facts.where(F.col("at").isNotNull() & (F.col("channels") > 0) & (F.col("kind").isin(INTEGER) & F.col("bit_depth").isin(8, 16, 24, 32) | F.col("kind").isin(FLOAT) & F.col("bit_depth").isin(32, 64)))
    f = f.withColumn("width", F.col("channels") * F.floor(F.col("bit_depth") / 8)).withColumn("frames", F.floor(F.col("size") / F.col("width"))).where("frames > 0")
    f = f.withColumn("block_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("frames") - 1) / block))))
    first = F.col("block_idx") * block
    return f.select("path", "block_idx", "kind", "channels", F.col("sample_rate").cast("int").alias("sample_rate"), "bit_depth", (F.col("at") + first * F.col("width")).alias("at"), (F.least(F.lit(block).cast("long"), F.col("frames") - first) * F.col("width")).alias("bytes"))


BLOCKS = "path string, block_idx long, start_sample long, sample_rate int, pcm array<float>"


def blocks_of(rows, block: int) -> Iterator[pa.RecordBatch]:
    """Decoded blocks of rows (path, block_idx, kind, channels, rate, bits, at, bytes); a file stays open while its rows follow each other."""
    last, f = None, None
    try:
        for path, idx, kind, channels, rate, bits, at, size in rows:
            if path != last:
                if f is not None:
                    f.close()
                (f, _), last = opened(path), path
            x = decoded(f.read_at(size, at), kind, channels, bits).astype(np.float32)
            pcm = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([idx], pa.int64()), pa.array([idx * block], pa.int64()), pa.array([rate], pa.int32()), pcm], names=["path", "block_idx", "start_sample", "sample_rate", "pcm"])
    finally:
        if f is not None:
            f.close()


def decode_wav_blocks(files: DataFrame, block: int = BLOCK, split: int = SPLIT) -> DataFrame:
    """(path, block_idx, start_sample, sample_rate, pcm) of files (path); what is no WAV gives no rows.

    Headers are read first, by all tasks. The blocks that they name are dealt over tasks of about `split` bytes each, so a long recording is
    shared out and a lost executor costs some of its ranges only.
    """
    r = ranges(headers(files), block)
    total = r.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(-(-2 * total // split), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from blocks_of((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)), block)

    # neighbouring blocks of a file stay together, so that each task reads ahead in few files
    run_of = F.floor(F.col("at") / split)
    return r.repartition(tasks, "path", run_of).sortWithinPartitions("path", "block_idx").mapInArrow(run, BLOCKS)


class WavPartition(InputPartition):
    """Blocks first to last - 1 of one file, and what its header says."""

    def __init__(self, path: str, facts: tuple, first: int, last: int):
        super().__init__(None)
        self.path, self.facts, self.first, self.last = path, facts, first, last

    def rows(self, block: int) -> Iterator[tuple]:
        kind, channels, rate, bits, at, size = self.facts
        width = channels * bits // 8
        for k in range(self.first, self.last):
            yield self.path, k, kind, channels, rate, bits, at + k * block * width, min(block, size // width - k * block) * width


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.block, self.split = options["path"], int(options.get("block", BLOCK)), int(options.get("split", SPLIT))

    def found(self) -> list[str]:
        place = "/" + self.path.removeprefix("file:").lstrip("/") if self.path.startswith(("/", "file:")) else self.path
        system, root = (fs.LocalFileSystem(), place) if place.startswith("/") else fs.FileSystem.from_uri(place)
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            return [self.path]
        prefix = self.path.removesuffix(root) if self.path.endswith(root) else ""
        return sorted(prefix + i.path for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and i.path.lower().endswith(".wav"))

    def partitions(self) -> list[WavPartition]:
        """Ranges of `split` bytes of each file, planned from the headers alone."""
        out = []
        for path in self.found():
            f, length = opened(path)
            with f:
                facts = header(f, length)
            if facts is None or not decodable(facts[0], facts[1], facts[3]):
                continue
            width = facts[1] * facts[3] // 8
            count, per = -(-(facts[5] // width) // self.block), max(self.split // (self.block * width), 1)
            out += [WavPartition(path, facts, i, min(i + per, count)) for i in range(0, count, per)]
        return out

    def read(self, partition: WavPartition) -> Iterator[pa.RecordBatch]:
        return blocks_of(partition.rows(self.block), self.block)


class WavSource(DataSource):
    """spark.read.format("wav").option("path", folder or file): the blocks of `decode_wav_blocks`.

    Files are listed and their headers read while the query is planned, so it is for folders of thousands of files; more are listed by
    `audio.scan_audio` and read by `decode_wav_blocks`, where tasks read the headers too. Options: block (samples), split (bytes a task).
    """

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format "wav" known to a session."""
    spark.dataSource.register(WavSource)
