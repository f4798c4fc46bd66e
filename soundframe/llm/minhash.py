"""Near-duplicate documents by MinHash, with sequential Bayesian verification of the banded candidates.

1. Every document gets its set of word shingles (64-bit hashes) and a signature of HASHES minima; documents with equal sets
   become one class. 2. Bands of ROWS minima put classes into buckets; buckets with the same members are kept once. 3. Within a
   bucket, pairs are compared batch by batch: after each batch a pair is dropped as soon as the posterior probability (uniform
   prior) that its similarity reaches the threshold is below MISS. The rest of a bucket is kept as a spanning forest, never as
   all pairs. 4. The forests' connected components hold every link; inside each, survivors of the same sequential test are
   verified on their full sets, again as a forest, and the components of those exact links are the result.

Work comes in units of at most 2 * BLOCK documents: larger buckets and components are cut into blocks and every two blocks meet
in one unit. A pair at the threshold is missed by all bands with probability (1 - t^ROWS)^(HASHES / ROWS), 3e-7 as set, and by
each of the ten tests with at most about MISS.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundframe.llm.common import components, marked, maybe_in, pieces, read, shingle_hashes, stars, text_buffer, word_hashes, written

HASHES, ROWS, BATCH = 160, 4, 16
MISS = 1e-6
BLOCK = 1000
SHINGLE = 5
#: Similarity is compared as OVER * intersection >= UNDER * union.
OVER, UNDER = 100, 75

_rng = np.random.default_rng(11)
FACTOR = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
TERM = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def least_matches(t: float, miss: float = MISS) -> list[int]:
    """After 1, 2, ... batches: the fewest equal minima with which P(similarity >= t) is still miss or more."""
    out = []
    for k in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
        out.append(m)
    return out


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes per text, sorted, and their offsets."""
    h, soff = shingle_hashes(*word_hashes(data, off), size)
    text = np.repeat(np.arange(len(off) - 1), np.diff(soff))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[first], np.concatenate([[0], np.cumsum(np.bincount(text[first], minlength=len(off) - 1))]).astype(np.int64)


def signatures_of(sets: np.ndarray, soff: np.ndarray) -> np.ndarray:
    """The low 16 bits of each minimum: different minima agree in them once in 65,536 times, which only adds candidates."""
    full = np.flatnonzero(np.diff(soff))
    sig = np.zeros((len(soff) - 1, HASHES), np.uint16)
    if len(full):
        x, starts = (sets >> np.uint64(32)).astype(np.uint32), soff[:-1][full]
        for k in range(HASHES):
            sig[full, k] = np.minimum.reduceat(x * FACTOR[k] + TERM[k], starts) & np.uint32(0xFFFF)
    return sig


def binary_rows(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """A binary array of the byte ranges between offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def signatures(docs: DataFrame, size: int = SHINGLE, with_set: bool = False) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, sig) per row of docs (doc_id, text); set_a and set_b are digests of the whole set.

    with_set: docs also has component and m, which stay, and the result has items, the sorted set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for i, j in pieces(off):
                sets, soff = shingle_sets(data, off[i : j + 1], size)
                sig = signatures_of(sets, soff)
                total = np.concatenate([[0], np.cumsum(sets * np.uint64(0x9E3779B97F4A7C15) ^ (sets >> np.uint64(29)), dtype=np.uint64)])
                plain = np.concatenate([[0], np.cumsum(sets, dtype=np.uint64)])
                digest = [pa.array((x[soff[1:]] - x[soff[:-1]]).view(np.int64)) for x in (total.astype(np.uint64), plain.astype(np.uint64))]
                columns = [batch.column(0).slice(i, j - i), pa.array(np.diff(soff)), *digest, binary_rows(sig.view(np.uint8).reshape(-1), np.arange(j - i + 1) * HASHES * 2)]
                if with_set:
                    columns += [binary_rows(sets.view(np.uint8), soff * 8), batch.column(2).slice(i, j - i), batch.column(3).slice(i, j - i)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_a", "set_b", "sig", "items", "component", "m"][: len(columns)])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *["component", "m"] * with_set]
    return docs.select(*columns).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, sig binary" + ", items binary, component long, m long" * with_set)


def bands(sigs: DataFrame) -> DataFrame:
    """(bucket, doc_id): one row per document and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from soundframe.llm.common import mix

        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, HASHES // ROWS, ROWS).astype(np.uint64)
            h = np.arange(1, HASHES // ROWS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
            for r in range(ROWS):
                h = mix(h ^ sig[:, :, r])
            ids = np.repeat(np.asarray(batch.column(0)), h.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(ids)], names=["bucket", "doc_id"])

    return sigs.select("doc_id", "sig").mapInArrow(run, "bucket long, doc_id long")


def units(members: DataFrame, key: str, count: str) -> DataFrame:
    """Adds unit: groups of over BLOCK members are cut into blocks by hash, and each two blocks share a unit."""
    n = F.ceil(F.col(count) / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("doc_id"), n).cast("int")
    others = F.filter(F.sequence(F.lit(0), n - 1), lambda x: x != block)
    unit = F.when(n <= 1, F.array(F.xxhash64(key))).otherwise(F.transform(others, lambda x: F.xxhash64(F.col(key), F.least(x, block), F.greatest(x, block))))
    return members.withColumn("unit", F.explode(unit))


class Forest:
    """Labels of rows that links unite."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Unites pairs and returns those that were apart."""
        lead: dict[int, int] = {}

        def root(x: int) -> int:
            while x in lead:
                x = lead[x]
            return x

        used = []
        for i, j in pairs:
            a, b = root(int(self.label[i])), root(int(self.label[j]))
            if a != b:
                lead[max(a, b)] = min(a, b)
                used.append((i, j))
        if lead:
            moved = np.arange(len(self.label))
            for x in lead:
                moved[x] = root(x)
            self.label = moved[self.label]
        return used


def forest_edges(unit: np.ndarray, n: np.ndarray, sig: np.ndarray, items: list | None, least: list[int]) -> list[tuple[int, int]]:
    """Rows (i, j) of a spanning forest of each unit's surviving pairs. Rows are sorted by unit, then n.

    With items (the full sets) a pair must also pass the exact test.
    """
    forest, edges, d = Forest(len(unit)), [], 0
    active = np.arange(len(unit))
    while len(active):
        d += 1
        active = active[active + d < len(unit)]
        active = active[(unit[active + d] == unit[active]) & (OVER * n[active] >= UNDER * n[active + d])]
        i = active[forest.label[active] != forest.label[active + d]]
        if not len(i):
            if d & (d - 1) == 0 and len(active):  # units that are united have no more to find
                start = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
                one = np.minimum.reduceat(forest.label, start) == np.maximum.reduceat(forest.label, start)
                done = np.repeat(one, np.diff(np.r_[start, len(unit)]))
                active = active[~done[active]]
            continue
        for part in np.array_split(i, -(-len(i) // 20_000)):
            part = part[forest.label[part] != forest.label[part + d]]
            same = np.zeros(len(part), np.int32)
            for s, few in enumerate(least):
                cut = slice(s * BATCH, (s + 1) * BATCH)
                same += (sig[part, cut] == sig[part + d, cut]).sum(1, dtype=np.int32)
                keep = same >= few
                part, same = part[keep], same[keep]
            pairs = [(x, x + d) for x in part.tolist()]
            if items is not None:
                passed = []
                for x, y in pairs:
                    both = len(np.intersect1d(items[x], items[y], assume_unique=True))
                    if OVER * both >= UNDER * (n[x] + n[y] - both):
                        passed.append((x, y))
                pairs = passed
            edges += forest.link(pairs)
    return edges


def unit_forests(rows: DataFrame, exact: bool) -> DataFrame:
    """(u, v) links of the forests of rows (unit, doc_id, n_shingles, sig[, items]), united over the units of each task."""
    least = least_matches(UNDER / OVER)

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        def found(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            unit, ids, n = (np.asarray(t.column(c).combine_chunks()) for c in ("unit", "doc_id", "n_shingles"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            items = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()] if exact else None
            edges = np.array(forest_edges(unit, n, sig, items, least), np.int64).reshape(-1, 2)
            return ids[edges[:, 0]], ids[edges[:, 1]]

        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            unit = np.asarray(batch.column(0))
            cut = int(np.flatnonzero(unit == unit[-1])[0])
            if unit[0] != unit[-1]:  # the last unit may go on in the next batch
                yield found(pa.concat_tables([*held, t.slice(0, cut)]))
                held = [t.slice(cut)]
            elif held and held[-1].column("unit")[0].as_py() != int(unit[0]):
                yield found(pa.concat_tables(held))
                held = [t]
            else:
                held.append(t)
        if held:
            yield found(pa.concat_tables(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from stars(forests(batches))

    columns = ["unit", "doc_id", "n_shingles", "sig"] + ["items"] * exact
    return rows.select(*columns).repartition("unit").sortWithinPartitions("unit", "n_shingles", "doc_id").mapInArrow(run, "u long, v long")


def mostly_in(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs (doc_id, text) without most rows whose id is not in wanted: it loses none that is."""
    return maybe_in(docs.select("doc_id", F.col("text").cast("string").alias("text")), marked(wanted, ["doc_id"]), ["doc_id"]).where("maybe").drop("maybe")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs: its group of near-duplicates, named by the smallest id.

    Empty and null texts have no shingles and stand alone. A null id is never linked (component null, kept). Rows that repeat an
    id share its group and are all kept if it is (of texts that differ under one id, each counts for itself at first, and one of them in
    the exact step). Texts may be of any length. Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sigs = written(signatures(docs, size), "signatures")
    full = sigs.where("n_shingles > 0 and doc_id is not null")
    keys = ["n_shingles", "set_a", "set_b"]
    classes = written(full.groupBy(*keys).agg(F.min("doc_id").alias("rep")), "classes")
    rep = full.join(classes.select(*keys, F.col("rep").alias("doc_id")), [*keys, "doc_id"], "left_semi").dropDuplicates(["doc_id", *keys])
    rep = written(rep.select("doc_id", "n_shingles", "sig"), "representatives")

    rows = bands(rep)
    groups = rows.groupBy("bucket").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("doc_id")).alias("x")).where("m > 1")
    groups = groups.groupBy("m", "x").agg(F.min("bucket").alias("bucket"))
    members = rows.join(groups.select("bucket", "m"), "bucket")
    compared = units(members, "bucket", "m").select("unit", "doc_id").join(rep, "doc_id")
    near = components(unit_forests(compared, exact=False))

    near = written(near, "near")
    large = written(near.groupBy("component").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK), "large")  # only these are cut
    asked = written(near.join(large, "component", "left").select(F.col("node").alias("doc_id"), "component", F.coalesce("m", F.lit(1)).alias("m")), "candidates")
    texts = mostly_in(docs, asked).join(asked, "doc_id").dropDuplicates(["doc_id"])
    exact = unit_forests(units(signatures(texts, size, with_set=True), "component", "m"), exact=True)
    linked = components(exact)

    named = classes.join(linked, classes.rep == linked.node, "left").select(*keys, F.coalesce("component", "rep").alias("component_id"))
    s, c = sigs.select("doc_id", *keys).alias("s"), named.alias("c")
    out = s.join(c, (F.col("s.n_shingles") == F.col("c.n_shingles")) & (F.col("s.set_a") == F.col("c.set_a")) & (F.col("s.set_b") == F.col("c.set_b")) & F.col("s.doc_id").isNotNull() & (F.col("s.n_shingles") > 0), "left")
    component = F.coalesce("c.component_id", "s.doc_id")
    return out.select("s.doc_id", "s.n_shingles", component.alias("component_id"), F.col("s.doc_id").eqNullSafe(component).alias("kept"))


def query_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


#: Exact, by joining shingles: for small tables only.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
