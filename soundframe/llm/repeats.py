"""Removal of long repeated byte strings with run-length compressed suffix indexes.

A byte is removed if a string of LENGTH bytes that covers it starts anywhere else too. Equal strings are brought together
first: every window of LENGTH bytes names one anchor, the GRAM bytes in it whose hash is smallest (leftmost of equals), so equal
windows name equal anchors at equal distances, and each window belongs to one anchor only. The bytes of an anchor's windows are
its context.

* Anchors that occur once are dropped. Contexts that are equal as a whole are repeated as a whole (counted, never gathered).
* Other contexts that share an anchor are indexed together, in units of about UNIT bytes: a run-length compressed
  Burrows-Wheeler transform with the suffixes sampled at run ends. Matches are measured at the borders between runs only; streaming
  over the text in order gives every other position's length from the one before (it falls by one): the matching statistics of the
  unit within itself. Starts whose match reaches LENGTH are marked.
* An anchor with over CROWD different contexts is split before that: windows that begin nearer and farther from the anchor
  part, each half keyed by all bytes that its windows share, again and again while a group is too large. Equal halves are
  counted as before, so each round leaves few contexts, and no group of any size meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundframe.llm.common import Powers, is_marked, marked, maybe_in, mix, pieces, prefix_hash, range_hash, read, slot, text_buffer, written

LENGTH, GRAM = 400, 64
CROWD, UNIT = 1000, 1 << 19
LONG = 1 << 21
PIECE = 1 << 18  # bytes of text that are hashed at once: some fifty times as much is held meanwhile
BATCH_BYTES = 1 << 22  # that a task hands to Python at once: Spark's 64 MB would be whole row groups, which both sides hold
STEP = 1 << 16  # borders between runs that are measured at once
PLACE = np.uint64((1 << 26) - 1)
MARK = 255  # no byte of UTF-8


def anchors_of(data: np.ndarray, bounds: np.ndarray, first: np.ndarray, last: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(part, place, near, far, anchor hash, context hash) of the anchors of parts between bounds.

    Windows of part k start at first[k] up to last[k] (exclusive), relative to the part. An anchor's windows start near to far
    bytes before its place.
    """
    n, span = len(data), length - gram
    starts = np.zeros(max(n - length + 1, 0) + 1, np.int32)
    ok = last > first
    np.add.at(starts, bounds[:-1][ok] + first[ok], 1)
    np.add.at(starts, bounds[:-1][ok] + last[ok], -1)
    at = np.flatnonzero(np.cumsum(starts[:-1]) > 0) if ok.any() else np.zeros(0, np.int64)
    if not len(at):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    prefix = prefix_hash(data)
    _, down = Powers.get(n + 1)
    grams = mix((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])
    low = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= span + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = span + 1 - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    place = (low[at] & PLACE).astype(np.int64)
    new = np.r_[True, place[1:] != place[:-1]]
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(at)] - 1
    place, begin, end = place[head], at[head], at[tail]
    context = mix(range_hash(prefix, begin, end + length) + (place - begin).astype(np.uint64) * np.uint64(31) + (end - begin).astype(np.uint64))
    return np.searchsorted(bounds, place, "right") - 1, place, place - end, place - begin, grams[place], context


def parts(off: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, rows, bounds, first, last): stretches of the buffer to work on. Texts over LONG bytes come in overlapping parts."""
    for i, j in pieces(off, PIECE):
        size = np.diff(off[i : j + 1])
        if j - i > 1 or size[0] <= LONG:
            yield int(off[i]), int(off[j]), np.arange(i, j), off[i : j + 1] - off[i], np.zeros(j - i, np.int64), np.maximum(size - length + 1, 0)
            continue
        for c in range(0, int(size[0]) - length + 1, LONG):
            end = min(c + LONG, int(size[0]) - length + 1)
            lo, hi = c, min(int(size[0]), end + length - 1)
            yield int(off[i]) + lo, int(off[i]) + hi, np.array([i]), np.array([0, hi - lo]), np.array([0]), np.array([end - c])


def keyed(docs: DataFrame) -> DataFrame:
    """Adds k1 and k2, which name a row by id and text; rows that repeat both are the same for all that follows."""
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def anchors(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffer(batch.column(2))
            k1, k2 = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for lo, hi, rows, bounds, first, last in parts(off, length):
                part, place, near, far, anchor, context = anchors_of(data[lo:hi], bounds, first, last, length, min(GRAM, length))
                row = rows[part]
                at = place + lo - off[row]
                columns = [k1[row], k2[row], at.astype(np.int32), near.astype(np.int32), far.astype(np.int32), anchor.view(np.int64), context.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k1", "k2", "at", "near", "far", "anchor", "context"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, at int, near int, far int, anchor long, context long")


def contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The context bytes of wanted anchors (k1, k2, at, near, far, anchor, known, m)."""
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "near", "far", "anchor", "known", "m")).alias("list"))
    asked = maybe_in(docs, marked(wanted, ["k1", "k2"]), ["k1", "k2"]).where("maybe").drop("maybe")
    joined = asked.dropDuplicates(["k1", "k2"]).join(lists, ["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffer(batch.column(2))
            lists = batch.column(3)
            items = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            at, near, far = (np.asarray(items.field(k)).astype(np.int64) for k in range(3))
            for i, j in pieces(np.concatenate([[0], np.cumsum(far - near + length)]), 1 << 22):
                begin, end = off[row[i:j]] + (at - far)[i:j], off[row[i:j]] + (at - near)[i:j] + length
                raw = pa.array([data[b:e].tobytes() for b, e in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())
                columns = [batch.column(0).take(pa.array(row[i:j])), batch.column(1).take(pa.array(row[i:j])), *(items.field(k).slice(i, j - i) for k in range(6)), raw]
                yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "at", "near", "far", "key", "known", "m", "bytes"])

    return joined.select("k1", "k2", "text", "list").mapInArrow(run, "k1 long, k2 long, at int, near int, far int, key long, known boolean, m long, bytes binary")


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array by doubling, from eight bytes on; only suffixes that are still tied are sorted again. Places are 32 bits wide."""
    n = len(s)
    padded = np.concatenate([s, np.zeros(8, np.uint8)])
    key = padded[:n].astype(np.uint64)
    for k in range(1, 8):
        key <<= np.uint64(8)
        key |= padded[k : k + n]
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    del key
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
    h = 8
    while not new.all():
        tied = np.flatnonzero(~new | ~np.r_[new[1:], True]).astype(np.int32)  # places in the order
        rows = order[tied]
        key = np.where(rows < n - h, rank[np.minimum(rows, n - 1 - h) + h] + 1, 0).astype(np.uint64) if h < n else np.zeros(len(rows), np.uint64)
        key |= rank[rows].astype(np.uint64) << np.uint64(32)
        again = np.argsort(key)
        rows, key = rows[again], key[again]
        del again
        order[tied] = rows
        fresh = np.r_[True, key[1:] != key[:-1]]
        del key
        new[tied] = fresh
        rank[rows] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied), dtype=np.int32), np.int32(0)))]
        h *= 2
    return order


class RunIndex:
    """A run-length compressed Burrows-Wheeler transform of a text with the suffixes sampled at the ends of its runs.

    letters and lengths: the runs; heads and tails: where in the text the suffixes of each run's first and last row begin. The suffix
    array that it is built from is not kept: all that follows costs as much as there are runs, but for one pass over the text.
    """

    def __init__(self, text: np.ndarray):
        order = suffix_array(text)
        last = text[order - 1]
        change = np.r_[True, last[1:] != last[:-1]]
        whole = int(np.flatnonzero(order == 0)[0])  # nothing stands before the whole text: a run of its own
        change[whole : whole + 2] = True
        first = np.flatnonzero(change)
        self.letters, self.lengths = last[first], np.diff(np.r_[first, len(text)])
        self.heads, self.tails = order[first], order[np.r_[first[1:], len(text)] - 1]
        del order, last, change, first
        self.prefix, self.n = prefix_hash(text), len(text)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes a and b, by halving over range hashes."""
        low = np.zeros(len(a), np.int32)
        high = (self.n - np.maximum(a, b)).astype(np.int32)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = range_hash(self.prefix, a, a + mid) == range_hash(self.prefix, b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def stream(self, at: np.ndarray, measured: np.ndarray) -> np.ndarray:
        """All positions' lengths from those measured at some: elsewhere a length is that of the position before less one."""
        reach, known = np.zeros(self.n, np.int32), np.zeros(self.n, np.int32)
        reach[at], known[at] = at + measured, at
        reach = reach[np.maximum.accumulate(known, out=known)]
        return np.maximum(reach - np.arange(self.n, dtype=np.int32), 0)

    def statistics(self) -> np.ndarray:
        """Matching statistics of the text within itself: for each position the longest match with a suffix that begins elsewhere.

        That is with the suffix one row above or below. The first is measured where a run begins, the second where one ends, which is
        one comparison for each border between runs; within a run the letter before both suffixes is the same, so lengths follow.
        """
        border = np.zeros(len(self.heads) + 1, np.int32)  # none before the first run and after the last one
        for k in range(1, len(self.heads), STEP):
            border[k : min(k + STEP, len(self.heads))] = self.common(self.heads[k : k + STEP], self.tails[k - 1 : min(k + STEP, len(self.heads)) - 1])
        return np.maximum(self.stream(self.heads, border[:-1]), self.stream(self.tails, border[1:]))


def repeated_starts(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text: which of its starts of length-byte strings are starts of an equal string elsewhere in the texts."""
    data = np.frombuffer(bytes([MARK]).join(texts) + bytes([MARK]), np.uint8)
    sizes = np.array([len(t) for t in texts])
    begin = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    found = RunIndex(data).statistics() >= length  # a string that lies within a text holds no mark, and neither do those equal to it
    return [found[b : b + max(n - length + 1, 0)] for b, n in zip(begin.tolist(), sizes.tolist(), strict=True)]


def indexed_marks(rows: DataFrame, length: int) -> DataFrame:
    """(k1, k2, begin, end): first and last marked starts found by the run-length indexes of rows, grouped by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: list[tuple]) -> pa.RecordBatch:
            out = []
            marks = repeated_starts([h[6] for h in held], length)
            for (_, k1, k2, at, far, known, _), m in zip(held, marks, strict=True):
                if not known and m.any():
                    edge = np.flatnonzero(np.diff(np.r_[0, m.view(np.int8), 0]))
                    out += [(k1, k2, at - far + b, at - far + e - 1) for b, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["k1", "k2", "begin", "end"])

        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= UNIT and row[0] != held[-1][0]:
                    yield found(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield found(held)

    return rows.select("key", "k1", "k2", "at", "far", "known", "bytes").repartition("key").sortWithinPartitions("key").mapInArrow(run, "k1 long, k2 long, begin int, end int")


def halves(rows: DataFrame, lo: int, hi: int, length: int) -> DataFrame:
    """Rows of crowded groups with windows lo to hi bytes before the anchor, as rows of the two halves under new keys."""
    mid = (lo + hi) // 2
    both = []
    for a, b in ((lo, mid), (mid + 1, hi)):
        near, far = F.greatest("near", F.lit(a)), F.least("far", F.lit(b))
        r = rows.where((near <= far) & (F.lit(a) <= F.lit(b)))
        shared = F.expr(f"substring(bytes, far - {a} + 1, {a + length - b})")
        hull = F.expr(f"substring(bytes, far - least(far, {b}) + 1, least(far, {b}) - greatest(near, {a}) + {length})")
        both.append(r.select("k1", "k2", "at", near.alias("near"), far.alias("far"), F.xxhash64("key", F.lit(a), F.lit(b), shared).alias("key"), "known", hull.alias("bytes"), F.lit(a).alias("lo"), F.lit(b).alias("hi")))
    return both[0].unionByName(both[1])


def settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts equal contexts of each key: (marks of those that occur twice, one row for each different one with m per key)."""
    same = ["key", "near", "far", "h"]
    rows = rows.withColumn("h", F.xxhash64("bytes"))
    counts = rows.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "at")).alias("rep"))
    marks = rows.where("not known").join(counts.where("n > 1").select(*same), same, "left_semi").select("k1", "k2", (F.col("at") - F.col("far")).alias("begin"), (F.col("at") - F.col("near")).alias("end"))
    left = rows.join(counts.select(*same, "n", F.col("rep.k1").alias("k1"), F.col("rep.k2").alias("k2"), F.col("rep.at").alias("at")), [*same, "k1", "k2", "at"]).dropDuplicates([*same])
    left = left.withColumn("known", F.col("known") | (F.col("n") > 1)).drop("h", "n")
    groups = left.groupBy("key").agg(F.count("*").alias("m"), F.bool_and("known").alias("all_known")).where("m > 1 and not all_known").select("key", "m")
    return marks, left.join(groups, "key")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, begin, end): starts from begin to end of strings of length bytes that also start elsewhere. docs is keyed."""
    gram = min(GRAM, length)
    found = written(anchors(docs, length), "anchors")
    twice = found.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("context") != F.max("context")).alias("several")).where("n > 1").select("anchor", "several")
    # written, so that nothing stands between the join and its shuffles, and Spark can split a hot anchor's rows
    found = written(found.join(written(twice, "twice"), "anchor"), "anchors")

    counts = written(found.groupBy("anchor", "context", "several").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "at", "near", "far")).alias("rep")), "counts")
    marks = [found.join(counts.where("n > 1").select("anchor", "context"), ["anchor", "context"], "left_semi").select("k1", "k2", (F.col("at") - F.col("far")).alias("begin"), (F.col("at") - F.col("near")).alias("end"))]

    different = counts.where("several").select("rep.*", "anchor", (F.col("n") > 1).alias("known"))
    groups = different.groupBy("anchor").agg(F.count("*").alias("m"), F.bool_and("known").alias("all_known")).where("m > 1 and not all_known").select("anchor", "m")
    rows = written(contexts(docs, different.join(groups, "anchor"), length), "contexts")

    ready = [rows.where(F.col("m") <= CROWD)]
    crowded = rows.where(F.col("m") > CROWD).withColumns({"lo": F.lit(0), "hi": F.lit(length - gram)})
    while True:
        ranges = [(r.lo, r.hi) for r in crowded.select("lo", "hi").distinct().collect()]  # at most one for each window of an anchor
        if not ranges:
            break
        split = None
        for lo, hi in ranges:
            part = halves(crowded.where((F.col("lo") == lo) & (F.col("hi") == hi)), lo, hi, length)
            split = part if split is None else split.unionByName(part)
        split = written(split, "halves")
        more, left = settle(split)
        left = written(left, "halves")
        marks.append(written(more, "marks"))
        ready.append(left.where(F.col("m") <= CROWD).select(rows.columns))
        crowded = left.where((F.col("m") > CROWD) & (F.col("lo") < F.col("hi")))
    for r in ready:
        marks.append(indexed_marks(r, length))
    out = marks[0]
    for m in marks[1:]:
        out = out.unionByName(m)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, removed, kept) per row of docs: removed byte spans (start, end) in order, kept the bytes that are left.

    A null text is empty; texts under length bytes lose nothing; rows that repeat id and text lose what both hold; null ids are
    ids like others; other columns are ignored; an empty table gives an empty result. kept is bytes, as a cut may split a letter.
    Sets the session's bytes of an Arrow batch, for what it runs itself and for the write of what it returns; the result doesn't depend on it.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    docs = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    spans = written(repeated_spans(docs, length), "spans")
    bits = marked(spans, ["k1", "k2"])
    lists = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "end")).alias("starts"))  # rows that repeat have the same spans, once
    asked = maybe_in(docs, bits, ["k1", "k2"]).where("maybe").join(lists, ["k1", "k2"], "left").select("doc_id", "text", "starts", F.lit(0).cast("long").alias("place"))
    # all others are not shuffled; the step below tells them by their place, so that no task has a second Python worker for that
    rest = docs.select("doc_id", "text", F.lit(None).cast("array<struct<begin:int,end:int>>").alias("starts"), slot(["k1", "k2"], 1024).alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            place = np.asarray(batch.column(3))
            taken = (place > 0) & is_marked(bits.value, np.maximum(place, 1))  # rows that come by the join
            if taken.any():
                batch = batch.filter(pa.array(~taken))
            data, off = text_buffer(batch.column(1))
            starts = batch.column(2).to_pylist()
            for i, j in pieces(off, 1 << 22):
                removed, kept = [], []
                for k in range(i, j):
                    raw, cut, out, at = data[off[k] : off[k + 1]].tobytes(), [], [], 0
                    for s in sorted((x["begin"], x["end"] + length) for x in starts[k] or ()):
                        if cut and s[0] <= cut[-1][1]:
                            cut[-1][1] = max(cut[-1][1], s[1])
                        else:
                            cut.append([*s])
                    for s, e in cut:
                        out.append(raw[at:s])
                        at = e
                    kept.append(b"".join(out) + raw[at:])
                    removed.append([{"start": s, "end": e} for s, e in cut])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(off[i : j + 1])), pa.array(removed, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return asked.unionByName(rest).mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<start:int,end:int>>, kept binary")


def query_repeats(spark, sf_dir: str) -> DataFrame:
    r = remove_repeats(read(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
