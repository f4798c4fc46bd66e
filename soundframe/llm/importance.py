"""Importance resampling towards a target: documents whose hashed words look like the target's are drawn, without replacement.

* Runs of up to `ngrams` words are hashed into a fixed number of buckets, counted over all documents and over the target's texts. A
  bucket's gain is the logarithm of its share in the target over its share in the documents; gains are one array of whole numbers
  that tasks index (array-scored weights). A document's weight is the mean gain of its features, its score adds Gumbel noise of
  its id, so that the largest scores are a draw without replacement.
* The cutoff is found without sorting all scores. A quantile sketch brackets it, scores above and inside the bracket are counted
  exactly, a bracket that misses the cutoff is widened, and only its rows are sorted.
* Rows that are drawn get their rank from range partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundframe.llm.common import LOWER, numbered, pieces, read, text_buffer, written

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20
#: Relative error of the quantile sketch is one in this many.
ACCURACY = 10_000
#: Longer features are hashed one by one, the others byte by byte for all at once.
LONG = 48
#: Bytes of words: 0-9, a-z (after lower-casing) and all of non-ASCII letters.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def crc_table() -> np.ndarray:
    """CRC-32 steps of one byte (reflected polynomial 0xEDB88320)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = crc_table()


def crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch of bytes; stretches of one length and more go on together, the longest ones by themselves."""
    size = np.minimum(end - start, LONG + 1).astype(np.int8)
    order = np.argsort(-size, kind="stable")
    more = len(size) - np.cumsum(np.bincount(size, minlength=LONG + 2))  # more[k]: stretches of over k bytes
    at, c, long = start[order], np.full(len(size), 0xFFFFFFFF, np.uint32), int(more[LONG])
    for k in range(LONG):
        if more[k] == long:
            break
        x = c[long : more[k]]
        c[long : more[k]] = CRC[(x ^ data[at[long : more[k]] + k]) & np.uint32(0xFF)] ^ (x >> np.uint32(8))
    out = np.empty_like(c)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    for i in order[:long]:
        out[i] = crc32(data[start[i] : end[i]])
    return out


def features(data: np.ndarray, off: np.ndarray, ngrams: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, the text it is of, words of each text) of consecutive texts."""
    lo, hi = int(off[0]), int(off[-1])
    low, off = LOWER[data[lo:hi]], off - lo
    inside = INSIDE[low]
    # words end at a text's end; every word is followed by one space, so runs of words are stretches of one buffer
    begin = inside & ~np.concatenate([[False], inside[:-1]])[: len(inside)]
    inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(low))]
    begin[inner] = inside[inner]
    s = np.flatnonzero(begin)
    stop = ~inside
    stop_at = np.append(np.flatnonzero(stop), len(low))
    e = np.minimum(stop_at[np.searchsorted(stop_at, s)], off[np.searchsorted(off, s, "right")])
    woff = np.searchsorted(s, off)
    n = np.diff(woff)
    text = np.repeat(np.arange(len(n)), n)
    if ngrams > 1:
        size = e - s + 1
        to = np.concatenate([[0], np.cumsum(size)])
        packed = np.full(int(to[-1]), 32, np.uint8)
        at = np.repeat(s - to[:-1], size) + np.arange(len(packed))
        letter = np.ones(len(packed), bool)
        letter[to[1:] - 1] = False
        packed[letter] = low[at[letter]]
        low, s, e = packed, to[:-1], to[1:] - 1
    found, owner = [], []
    for k in range(ngrams):
        whole = np.flatnonzero(text[: len(text) - k] == text[k:]) if k else np.arange(len(text))
        found.append(crcs(low, s[whole], e[whole + k]) % np.uint32(buckets))
        owner.append(text[whole])
    return np.concatenate(found).astype(np.int64), np.concatenate(owner), n


def bucket_counts(docs: DataFrame, text_col: str = "text", ngrams: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts: counted in tasks, then added up; a row per bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(buckets, np.int64)
        for batch in batches:
            data, off = text_buffer(batch.column(0))
            for i, j in pieces(off):
                count += np.bincount(features(data, off[i : j + 1], ngrams, buckets)[0], minlength=buckets)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # at most `buckets` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the documents."""
    b = len(source)
    return np.floor(1000 * np.log((target + 1.0) * (source.sum() + b) / ((source + 1.0) * (target.sum() + b)))).astype(np.int64)


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of sha256('seed:id'); a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scores(docs: DataFrame, gain: np.ndarray, ngrams: int = 1, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain; 0 without features) and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for i, j in pieces(off):
                bucket, owner, words = features(data, off[i : j + 1], ngrams, len(gain))
                n = np.bincount(owner, minlength=j - i)
                weight = np.bincount(owner, weights=gain[bucket], minlength=j - i).astype(np.int64) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(words), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.select(F.col(id_col).alias("doc_id")).dtypes[0][1]
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def in_order() -> list[Column]:
    """Best score first, ties to the smaller id; rows that repeat an id by weight and features, so that every run agrees."""
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("weight")]


def bracket(scored: DataFrame, k: int, n: int, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """(low, high, above): the k-th largest of n scores lies in low..high, and `above` scores are larger than high.

    low and high come from a quantile sketch a little before and behind the k-th; exact counts of what lies outside show whether
    they hold. Where not, the side that fails moves out by twice as much, at last to the extreme.
    """
    share, slack = 1 - k / n, 2 / accuracy
    below = above = slack
    while True:
        marks = [max(share - below, 0.0), min(share + above, 1.0)]
        low, high = scored.agg(F.percentile_approx("score", marks, accuracy)).first()[0]
        if marks[0] == 0.0 or marks[1] == 1.0:
            least, most = scored.agg(F.min("score"), F.max("score")).first()
            low, high = least if marks[0] == 0.0 else low, most if marks[1] == 1.0 else high
        over, inside = scored.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if over < k <= over + inside:
            return low, high, over
        below, above = (below, 2 * above) if over >= k else (2 * below, above)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, ngrams: int = 1, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score of every row of docs, and rank: its place in the draw, null if it is not drawn.

    Of the rows with least_words or more, floor(percent / 100) of their number are drawn. Null and empty texts have no features, weight
    0 and a score, and are not drawn (with least_words above 0); null ids come last among ties and share one noise; repeated rows are
    drawn each by itself; texts and words may be of any length; other columns are ignored, whatever their names; an empty
    target weighs all buckets by the documents alone; an empty table gives an empty result.
    """
    gain = gains(bucket_counts(docs, text_col, ngrams, buckets), bucket_counts(target, target_col, ngrams, buckets))
    scored = written(scores(docs, gain, ngrams, id_col, text_col, seed), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    n = able.count()
    k = percent * n // 100
    none = F.lit(None).cast("long")
    if k == 0:
        return scored.drop("n_words").withColumn("rank", none)
    low, high, above = bracket(able, k, n)
    inside = numbered(able.where(F.col("score").between(low, high)), in_order())
    cut = inside.where(F.col("number") == k - above - 1).first()  # the k-th row, the last one to be drawn
    same_or_before = F.coalesce(F.col("doc_id") <= F.lit(cut["doc_id"]), F.lit(False)) if cut["doc_id"] is not None else F.lit(True)
    drawn = (F.col("n_words") >= least_words) & ((F.col("score") > cut["score"]) | ((F.col("score") == cut["score"]) & same_or_before))
    ranked = numbered(scored.where(drawn), in_order())  # repeated rows of the last id may be one or more too many
    ranked = ranked.withColumn("rank", F.when(F.col("number") < k, F.col("number") + 1)).drop("n_words", "number")
    return ranked.unionByName(scored.where(~drawn).drop("n_words").withColumn("rank", none))


def query_importance(spark, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_STEP = "list_reduce(list_prepend(c, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
dw AS (SELECT r, unnest(ws) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
step AS (SELECT list(v ORDER BY i) AS t FROM (SELECT c AS i, {_STEP} AS v FROM (SELECT unnest(range(256)) AS c))),
vocabulary AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
crc AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i : i + 1])::BIGINT)), lambda a, b: xor(a // 256, t[1 + xor(a, b) % 256]))) % 10000 AS bucket FROM vocabulary, step),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN crc USING (w) GROUP BY ALL),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN crc USING (w) GROUP BY ALL),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE)))::BIGINT AS g FROM s FULL JOIN t USING (bucket)),
weighed AS (SELECT r, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN crc USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN weighed USING (r)),
placed AS (SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank FROM placed
"""
