"""WARC archives and their capture index.

write_archives stores pages as WARC 1.1 files in a shared folder; read_archives streams the files back, checks each payload
against its digest and gives, per file, a run of captures sorted by URL key and timestamp. capture_history range-partitions the
runs and merges those of each range with a loser tree, from a file that the task writes as they come, so partitions in order hold
one globally ordered history; a URL with very many captures spreads over ranges, since timestamp and record id take part in the bounds.
"""

from __future__ import annotations

import base64
import hashlib
import io
import tempfile
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from soundframe.llm.common import read, scratch, written

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes that a file holds about, at most.
FILE_BYTES = 64 << 20
#: Captures in a range, and rows that a run keeps in memory while it is merged.
RANGE, CHUNK = 200_000, 256
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32(sha1_hex: Column) -> Column:
    """Upper-case base 32 of 40 hex digits: each five digits are 20 bits, four letters."""
    out = []
    for k in range(8):
        bits = F.conv(F.substring(sha1_hex, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(LETTERS), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def url_key(url: str | None) -> str:
    """Host labels reversed and comma-joined, then path and query: http://www.a.org/x?y becomes org,a)/x?y. Null gives ''."""
    if not url:
        return ""
    rest = url.strip().split("#", 1)[0].split("://", 1)[-1]
    cut = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:].lower() or "/"
    host = host.rpartition("@")[2].removeprefix("www.")
    name, _, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + path


def write_archives(pages: DataFrame, path: str, least: int = 0, file_bytes: int = FILE_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes one record per row of pages to WARC files (compressed) under path; a file holds about file_bytes.

    Of rows with equal payloads of at least `least` bytes the smallest id is a response, all others are revisits of it; a row
    repeated with that same id is a response again. A null payload is empty; a null id is never the smallest unless the payload
    has no other; a null URL leaves the target out. Payloads may be of any length (one larger than file_bytes has a file of about its
    size); an empty table writes no record; other columns are ignored, whatever their names. The record's date follows from the id.
    A revisit states the payload's length in a field of its own, WARC-Payload-Length, so that no reader has to look its response up.
    """
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.col(url_col), "[\r\n]", "").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    p = p.withColumns({"sha": F.sha1(F.col("payload").cast("binary")), "name": F.coalesce(F.col("id").cast("string"), F.lit("null"))})
    # what repeats is found on digests: a payload that thousands of pages share is never gathered under its digest
    facts = written(p.select("id", "name", "sha", F.octet_length("payload").alias("n")), "payload_facts")
    bytes_, rows = facts.agg(F.sum("n"), F.count("*")).first()
    size = (bytes_ or 0) + 500 * rows
    # as many as a shuffle has at least: with fewer, the planner would shuffle the payloads again for the join
    parts = max(-(-size // file_bytes), int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = written(facts.where(F.col("n") >= least).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null").select("sha", "first"), "first_of")
    again = facts.join(first, "sha").where(~F.col("id").eqNullSafe(F.col("first"))).select("name", "sha", "first").distinct()
    p = p.repartition(parts, "name", "sha").join(again.repartition(parts, "name", "sha"), ["name", "sha"], "left")
    revisit = F.col("first").isNotNull()
    end, date = "\r\n", F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.coalesce("id", F.lit(0)), F.lit(1_000_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c, F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.1{end}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(f"{end}WARC-Record-ID: "), urn(F.col("name")),
        F.coalesce(F.concat(F.lit(f"{end}WARC-Target-URI: "), F.col("url")), F.lit("")), F.lit(f"{end}WARC-Date: "), date, F.lit(f"{end}WARC-Payload-Digest: sha1:"), base32(F.col("sha")),
    )
    length = F.octet_length("payload")
    kept = F.concat(head, F.lit(f"{end}Content-Type: application/http;msgtype=response{end}Content-Length: "), (length + len(HTTP)).cast("string"), F.lit(end * 2 + HTTP), F.col("payload"))
    again = F.concat(head, F.lit(f"{end}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{end}WARC-Payload-Length: "), length.cast("string"), F.lit(f"{end}WARC-Refers-To: "), urn(F.col("first").cast("string")), F.lit(f"{end}Content-Length: 0{end * 2}"))
    # the two line ends that close each record are the writer's line separator
    p.select(F.when(revisit, again).otherwise(kept).alias("value")).write.option("lineSep", end * 2).option("compression", "gzip").text(path)


def records(raw: Iterable[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records of one uncompressed archive that comes in chunks. Broken archives raise ValueError."""
    data, at, source = b"", 0, iter(raw)
    more = True
    while True:
        while (cut := data.find(b"\r\n\r\n")) < 0 and more:
            chunk = next(source, None)
            more = chunk is not None
            data += chunk or b""
        if cut < 0:
            if data.strip():
                raise ValueError(f"an archive ends within a record's head at {at}")
            return
        lines = data[:cut].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = cut + 4 + int(headers["content-length"]) + 4
        got, parts = len(data), [data]
        while got < size and more:
            chunk = next(source, None)
            more = chunk is not None
            parts.append(chunk or b"")
            got += len(parts[-1])
        data = b"".join(parts) if len(parts) > 1 else data
        if data[size - 4 : size] != b"\r\n\r\n":
            raise ValueError(f"a record's length is wrong at {at}")
        yield at, headers, data[cut + 4 : size - 4]
        data, at = data[size:], at + size


def unzipped(content: bytes, chunk: int = 1 << 20) -> Iterator[bytes]:
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    source, engine = io.BytesIO(content), zlib.decompressobj(31)
    while block := source.read(chunk // 4):
        while block:
            yield engine.decompress(block)
            block = engine.unused_data
            if engine.eof:
                if not block:
                    break
                engine = zlib.decompressobj(31)
            else:
                block = b""


RUN = "run string, offset long, page_id long, record_type string, urlkey string, captured_at string, payload_digest string, payload_bytes long, refers_to long"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under path; the rows of a file form a run sorted by urlkey, captured_at and page_id.

    The length and digest of a response come from its payload and must agree with its head; a revisit has those its head states
    (length null where it states none). Broken archives raise ValueError; a folder of empty archives gives an empty result.
    """
    number = lambda x: int(v) if x and (v := x.removeprefix("<urn:page:").rstrip(">")) != "null" else None
    names = [x.split()[0] for x in RUN.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for at, head, block in records(unzipped(content.as_py())):
                    digest, size = head["warc-payload-digest"].removeprefix("sha1:"), int(head["warc-payload-length"]) if "warc-payload-length" in head else None
                    if head["warc-type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size = len(payload)
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"a payload differs from its digest: {where} at {at}")
                    rows.append((where.as_py().rpartition("/")[2], at, number(head["warc-record-id"]), head["warc-type"], url_key(head.get("warc-target-uri")), head["warc-date"], digest, size, number(head.get("warc-refers-to"))))
                rows.sort(key=capture_order)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RUN)


def capture_order(row: tuple) -> tuple:
    return row[4], row[5], row[2] is not None, row[2] or 0, row[0], row[1]


class LoserTree:
    """Merges k sorted iterables. Inner node n holds the run that lost there; the winner of all stands at node 0."""

    def __init__(self, runs: list[Iterable[tuple]], key):
        self.runs, self.key, self.k = [iter(r) for r in runs] or [iter(())], key, max(1, len(runs))
        self.rows = [next(r, None) for r in self.runs]
        self.keys = [None if r is None else key(r) for r in self.rows]
        self.node = [-1] * self.k
        for leaf in range(self.k):
            self.climb(leaf)

    def before(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or x < y or (x == y and a < b))

    def climb(self, leaf: int) -> None:
        """Plays leaf's head upwards; each node keeps the loser. An empty node (while building) keeps the first that comes."""
        winner, n = leaf, (leaf + self.k) // 2
        while n > 0:
            if self.node[n] < 0:
                self.node[n] = winner
                return
            if self.before(self.node[n], winner):
                winner, self.node[n] = self.node[n], winner
            n //= 2
        self.node[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (best := self.node[0]) >= 0 and self.keys[best] is not None:
            yield self.rows[best]
            self.rows[best] = next(self.runs[best], None)
            self.keys[best] = None if self.rows[best] is None else self.key(self.rows[best])
            self.climb(best)


class Spill:
    """The sorted runs of a range in one unnamed file, a run being a list of pieces of CHUNK rows. The file goes with the object."""

    def __init__(self, schema: pa.Schema, key):
        self.file, self.schema, self.key = tempfile.TemporaryFile(), schema, key
        self.runs: list[list[tuple[int, int]]] = []
        self.name, self.last = None, None

    def add(self, batch: pa.RecordBatch) -> None:
        """Goes on with the run that the batch before ended in; a new one begins where the run's name changes or the order breaks."""
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        begin = 0
        for i, row in enumerate(rows):
            now = self.key(row)
            if row[0] != self.name or now < self.last or i - begin == CHUNK:
                self.put(batch, begin, i)
                begin = i
                if row[0] != self.name or now < self.last:
                    self.runs.append([])
            self.name, self.last = row[0], now
        self.put(batch, begin, len(rows))

    def put(self, batch: pa.RecordBatch, begin: int, end: int) -> None:
        if end > begin:
            raw = batch.slice(begin, end - begin).serialize()
            self.runs[-1].append((self.file.tell(), raw.size))
            self.file.write(raw)

    def read(self, run: list[tuple[int, int]]) -> Iterator[tuple]:
        for at, size in run:
            self.file.seek(at)
            piece = pa.ipc.read_record_batch(pa.py_buffer(self.file.read(size)), self.schema)
            yield from zip(*(c.to_pylist() for c in piece.columns), strict=True)

    def merged(self) -> Iterator[tuple]:
        return iter(LoserTree([self.read(r) for r in self.runs], self.key))


def capture_history(runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """runs in the global order of urlkey, captured_at and page_id (null first), with index_partition and index_position to say so.

    ranges: number of range partitions; by default one per RANGE captures. A task writes the runs that reach it to a file as they
    come and merges them from there, CHUNK rows of each in memory. Rows that repeat all stay; an empty table gives an empty result.
    """
    ranges = ranges or max(1, -(-runs.count() // RANGE))
    placed = runs.repartitionByRange(ranges, "urlkey", "captured_at", "page_id", "run", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spill = None
        for batch in batches:
            spill = spill or Spill(batch.schema, capture_order)
            spill.add(batch)
        if spill is None:
            return
        part, merged, n = TaskContext.get().partitionId(), spill.merged(), 0
        while block := list(islice(merged, 10_000)):
            columns = [pa.array(c, t) for c, t in zip(zip(*block, strict=True), spill.schema.types, strict=True)]
            more = [pa.array([part] * len(block), pa.int32()), pa.array(range(n, n + len(block)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + more, names=[*spill.schema.names, "index_partition", "index_position"])
            n += len(block)

    return placed.mapInArrow(run, RUN + ", index_partition int, index_position long")


def numbered(history: DataFrame) -> DataFrame:
    """capture_history's rows with place, their number in the whole history from 0."""
    history = written(history, "history")
    counts = history.groupBy("index_partition").agg(F.count("*").alias("n"))  # a row per range
    before = F.coalesce(F.sum("n").over(Window.orderBy("index_partition").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return history.join(F.broadcast(counts.select("index_partition", before.alias("before"))), "index_partition").select(*history.columns, (F.col("before") + F.col("index_position")).alias("place"))


def query_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archives")
    write_archives(read(spark, sf_dir, "pages"), path)
    history = numbered(capture_history(written(read_archives(spark, path), "runs")))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured_at", "place")


_base32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(sha, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31 AS INT) + 1, 1)), '')"
SQL = rf"""
WITH p AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[\r\n]', '', 'g') AS url, coalesce(html, '') AS html FROM pages),
h AS (SELECT *, sha1(html) AS sha, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^.*?://', '') AS rest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first, lower(regexp_extract(rest, '^[^/?]*')) AS hp, lower(substr(rest, length(regexp_extract(rest, '^[^/?]*')) + 1)) AS path FROM h),
k AS (SELECT *, regexp_replace(regexp_replace(hp, '^.*@', ''), '^www[.]', '') AS host FROM f),
u AS (SELECT *, CASE WHEN url = '' THEN '' ELSE array_to_string(list_reverse(string_split(split_part(host, ':', 1), '.')), ',') || CASE WHEN regexp_extract(host, ':(.*)$', 1) IN ('', '80', '443') THEN '' ELSE ':' || regexp_extract(host, ':(.*)$', 1) END || ')' || CASE WHEN path = '' THEN '/' ELSE path END END AS urlkey FROM k),
c AS (SELECT *, strftime(make_timestamp((1700000000 + page_id % 1000000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at FROM u)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_base32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to, urlkey, captured_at, row_number() OVER (ORDER BY urlkey, captured_at, page_id) - 1 AS place FROM c
"""
