"""Shared helpers of the training-data operators: scratch tables, Arrow text buffers, hashing and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words: space and 0x09-0x0D.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: One fixed random 64-bit value per byte.
BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Where none is set it lies in the warehouse, and only with a master of one machine, as in tests, in a temporary folder.
    """
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local["):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base or spark.conf.get('spark.sql.warehouse.dir') + '/_scratch'}/{name}-{uuid.uuid4().hex}"


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    return written_at(df, name)[0]


def delete(spark: SparkSession, path: str) -> None:
    """Removes a table of written_at that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with number, the row's place from 0 in that order: range partitions are counted, and each row adds its place in its own."""
    df = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    df = written(df, "numbered")
    part = F.shiftright("_m", 33)
    counts = df.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # a row per partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.join(F.broadcast(counts.select("_p", before.alias("_o"))), part == F.col("_p"))
    return df.withColumn("number", F.col("_o") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_o")


def free(df: DataFrame, name: str) -> str:
    """name, with underscores behind it where df has a column of that name (columns are told apart without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slot(columns: list[str], slots: int) -> Column:
    """A place from 1 to 32,768 * slots for the values of columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(slots * 32768)) + 1


def marked(wanted: DataFrame, keys: list[str], slots: int = 1024) -> Broadcast:
    """Bits of the keys of wanted, in slots bitmaps of 4 KB: 4 MB in all whatever the input."""
    at = F.bitmap_bucket_number("slot").alias("at")
    maps = wanted.select(slot(keys, slots).alias("slot")).groupBy(at).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()  # slots rows at most
    bits = np.zeros((slots, 4096), np.uint8)
    for row in maps:
        bits[row["at"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return wanted.sparkSession.sparkContext.broadcast(bits.reshape(-1))


def is_marked(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which of these places (see slot) are set in the bits of marked."""
    k = places - 1
    return (bits[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1


def maybe_in(df: DataFrame, bits: Broadcast, keys: list[str], slots: int = 1024) -> DataFrame:
    """df with maybe: false where the keys are surely not among those marked.

    A filter before a join: what is surely not asked for need not be shuffled. Up to some 30 million keys few others pass; with
    many more the bits fill up and the join behind it does the work.
    """

    def run(places: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for place in places:
            yield pd.Series(is_marked(bits.value, place.to_numpy()))

    return df.withColumn("maybe", F.pandas_udf(run, "boolean")(slot(keys, slots)))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its len + 1 offsets; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def pieces(off: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about limit bytes each, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 20)
            for name, base in (("up", BASE), ("down", INVERSE)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls.up, cls.down


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with n + 1 entries: (P[j] - P[i]) * BASE^-i, hashes bytes i to j whatever stands before them."""
    up, _ = Powers.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = Powers.get(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(bytes with A-Z lower-cased, starts, ends, len + 1 word offsets of the texts) of the words of consecutive texts."""
    lo, hi = int(off[0]), int(off[-1])
    low = LOWER[data[lo:hi]]
    inside = ~SPACE[low]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edges = (off[1:-1] - lo)[(off[1:-1] > lo) & (off[1:-1] < hi)]
    start[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return low, s, e, np.searchsorted(s, off - lo)


def span_hashes(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix(range_hash(prefix_hash(low), s, e) + (e - s).astype(np.uint64))


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased) of consecutive texts, and len + 1 word offsets of the texts."""
    low, s, e, woff = word_spans(data, off)
    return span_hashes(low, s, e), woff


def shingle_hashes(words: np.ndarray, woff: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles in text order and their offsets. A shorter text with words is one shingle."""
    n = np.diff(woff)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    soff = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n)), count)
    at = woff[:-1][text] + np.arange(soff[-1]) - soff[:-1][text]
    end = woff[1:][text]
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        here = at + k
        part = np.where(here < end, words[np.minimum(here, max(len(words) - 1, 0))], np.uint64(0)) if len(words) else h
        h = mix(h + part * np.uint64(2 * k + 3))
    return h, soff


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, root): the nodes of the edges (a, b) and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    lead = np.arange(len(nodes))
    while True:
        low = np.minimum(lead[x], lead[y])
        new = lead.copy()
        np.minimum.at(new, lead[x], low)
        np.minimum.at(new, lead[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == lead).all():
            return nodes, nodes[lead]
        lead = new


def stars(edges: Iterator[tuple[np.ndarray, np.ndarray]], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(u, v) with u > v: a task's edges united, every node pointing to the smallest one it reaches there.

    Edges are taken in lots of about limit and each lot is united with the stars so far, so a task holds its nodes, not its edges.
    """
    u, v, held, count = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def unite() -> tuple[np.ndarray, np.ndarray]:
        nodes, root = roots(np.concatenate([u, *(x for x, _ in held)]), np.concatenate([v, *(y for _, y in held)]))
        return nodes[nodes != root], root[nodes != root]

    for a, b in edges:
        held.append((np.asarray(a, np.int64), np.asarray(b, np.int64)))
        count += len(a)
        if count >= limit:
            u, v = unite()
            held, count = [], 0
    u, v = unite()
    for i in range(0, len(u), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(u[i : i + (1 << 16)]), pa.array(v[i : i + (1 << 16)])], names=["u", "v"])


def star_edges(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from stars((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows)

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of undirected edges (two long columns); component is the smallest node that can be reached.

    Edges point from the larger to the smaller node. In each round every node's targets are gathered (one for each task that held the
    node at most, since tasks unite their edges first), a node with several targets hooks them to the smallest, and every edge moves
    on to its target's own smallest target; it ends when neither changes anything, that is when all are stars. Edges of a hub meet
    in a join whose other side has one row a node, and each round is written to the shared folder; the one before is deleted.
    """
    a, b = edges.columns
    e, path = written_at(star_edges(edges.select(F.col(a).cast("long"), F.col(b).cast("long"))), "edges")
    while True:
        changed = Observation()
        # written, so that nothing stands between the join and its shuffles, and Spark can split a hub's edges
        p, below = written_at(e.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("targets")), "targets")
        up = p.select(F.col("u").alias("v"), F.col("m").alias("up"))
        moved = e.join(up, "v", "left").select("u", F.coalesce("up", "v").alias("v"), F.col("up").isNotNull().alias("moved"))
        hooked = p.where(F.size("targets") > 1).select(F.explode("targets").alias("u"), F.col("m").alias("v"), F.lit(True).alias("moved")).where("u <> v")
        new = moved.unionByName(hooked).observe(changed, F.max("moved").alias("moved")).select("u", "v")
        last = path
        e, path = written_at(star_edges(new), "edges")
        delete(edges.sparkSession, last)
        delete(edges.sparkSession, below)
        if not changed.get["moved"]:
            found = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))  # several tasks may have the same edge
            return found.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
