"""Queries that once did less than the whole job, against SQL or plain Python without the cut."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from soundframe.functions import text
from soundframe.operators import catalog, edges, vectors
from soundframe.plans import queries, views
from soundframe.plans.all import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def test_all_pairs(spark, con):
    score = "(key_score + bpm_score + frequency_score + dynamics_score) / 4"
    want = con.sql(views.sql(views.SAMPLES, queries.COMPAT.replace("{where}", "a.id < b.id"), select=f"SELECT a_id, id, round({score}, 6) FROM pairs WHERE {score} >= 0.6")).fetchall()
    got = [(r.a_id, r.id, round(r.score, 6)) for r in edges.edges_above(views.samples(spark, SF), 0.6, piece=30).collect()]  # seven pieces of the 200 clips
    assert len(got) > 9000 and sorted(got) == sorted((a, b, round(s, 6)) for a, b, s in want)


def test_pairs_between_two_millionths(spark, tmp_path):
    """Clips of sf0.1 whose scores lie between two millionths (0.6459375, less a last bit) have those of the SQL, bit by bit."""
    c = duckdb.connect()
    c.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.1/part.parquet' WHERE p_partkey IN (1915, 13173, 8947, 11085, 3540, 5508)) TO '{tmp_path}/part.parquet'")
    c.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    got, want = sorted(map(tuple, QUERIES["compat_pairs"](spark, str(tmp_path)).collect())), sorted(c.sql(SQL["compat_pairs"]).fetchall())
    assert got == want and (1915, 13173, 0.645938) in got


def test_query_sets_above_the_broadcast_bound(spark, monkeypatch):
    few = sorted(map(tuple, QUERIES["compatible_to"](spark, SF).collect()))
    v = views.vectors(spark, SF)
    near = lambda limit: sorted((r.query_id, r.rank, r.id, round(r.similarity, 9)) for r in vectors.knn(v.where("id % 20 = 0"), v, 5, limit).collect())
    monkeypatch.setattr(catalog, "PAIR_BLOCK", 30)
    monkeypatch.setattr(catalog, "BROADCAST_ROWS", 1)
    assert len(few) == 40 and sorted(map(tuple, QUERIES["compatible_to"](spark, SF).collect())) == few
    assert near(2) == near(100_000)


def test_hashed_neighbours(spark):
    """Recall of 0.9 or more on vectors without structure, and few comparisons where neighbours are near."""
    import numpy as np

    v = views.vectors(spark, "/root/testdata/sf0.01")
    pairs = lambda df: {(r.query_id, r.id) for r in df.collect()}
    exact = pairs(vectors.knn(v.where("id % 50 = 0"), v, 10))
    assert len(exact & pairs(vectors.knn_lsh(v.where("id % 50 = 0"), v, 10, 64))) / len(exact) >= 0.9
    rng = np.random.default_rng(1)
    near = np.repeat(rng.normal(size=(100, 64)), 10, 0) + rng.normal(size=(1000, 64)) * 0.05
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(near)], "id long, v array<double>")
    exact, found = (pairs(f) for f in (vectors.knn(v.where("id % 50 = 0"), v, 9), vectors.knn_lsh(v.where("id % 50 = 0"), v, 1000, 64, tables=4, planes=16)))
    assert len(exact & found) / len(exact) >= 0.9 and len(found) < 0.1 * 20 * 1000


def awkward(spark, n=400):
    """Clips whose keys, tempos, bands and crests tie, lack or are odd."""
    rng = __import__("random").Random(3)
    pick = rng.choice
    rows = [(i * 3, pick([None, 0.0, 60.0, 120.0, 119.0, 240.0, 90.0, -5.0, 61.5]), pick([None, "Am", "C", "F#m", "c min", "H", "h?", "Bb", "A#", "Gm"]), pick([None, 100.0, 101.0, 900.0, 5000.0]), pick([None, 0.0, 50.0, 2000.0]), pick([None, 3.0, 9.5, 13.0, 20.0])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, bpm double, key string, spectral_centroid double, spectral_bandwidth double, crest_factor double").repartition(3)


@pytest.mark.parametrize("parts", ["all", "layering", "melodic"])
def test_top_edges_by_bounds(spark, parts):
    """The best partners are those of all pairs, whatever ties, lacks or odd values there are, and with few pairs scored."""
    clips, p = awkward(spark), catalog.PURPOSES[parts]
    got, work = edges.edges_and_work(clips, 6, 0.4, p, 7)
    want = {(r.a_id, r.id, r.score, r["rank"]) for r in catalog.compatible(clips, clips, 6, 0.4, p).collect()}
    assert {(r.a_id, r.id, r.score, r["rank"]) for r in got.collect()} == want and len(want) > 1500
    pairs = work.agg(F.sum("pairs")).first()[0]
    assert pairs < 400 * 400 and work.count() == work.select("cell", "piece", "target", "target_piece").distinct().count()
    assert edges.top_edges(clips.limit(0)).count() == 0 and edges.top_edges(clips.limit(1)).count() == 0
    assert edges.edges_above(clips.limit(0)).count() == 0


def test_partners_of_a_source_set(spark):
    """A source set gets the partners of all pairs, also where it is not among the clips."""
    clips = awkward(spark)
    for source in (clips.where("id % 7 = 0"), clips.where("id % 7 = 1").withColumn("id", F.col("id") + 10_000)):
        got, want = (sorted((r.a_id, r.id, r.score, r["rank"]) for r in df.collect()) for df in (edges.top_edges(clips, 5, 0.4, piece=20, source=source), catalog.compatible(source, clips, 5, 0.4)))
        assert got == want and len(want) > 200
    assert edges.top_edges(clips, source=clips.limit(0)).count() == 0


@pytest.mark.parametrize("some", [True, False])
def test_partners_of_a_larger_library(spark, some):
    """Six times the clips: the pairs that meet grow by less than half of that squared, for some clips and for all."""
    pairs = []
    for times in (1, 6):
        clips = views.samples(spark, "/root/testdata/sf0.01").withColumn("id", F.explode(F.array(*[F.col("id") + 2000 * i for i in range(times)])))
        pairs.append(edges.edges_and_work(clips, 5, piece=100, **({"source": clips.where("id % 50 = 0")} if some else {}))[1].agg(F.sum("pairs")).first()[0])
    assert pairs[1] < 18 * pairs[0]


def test_clips_are_done_with_the_first_of_cells(spark):
    """12,000 clips meet under 800 others each (1,004 when whole first pieces met whole pieces), and get the partners of all pairs."""
    clips = views.samples(spark, "/root/testdata/sf0.01").withColumn("id", F.explode(F.array(*[F.col("id") + 2000 * i for i in range(6)])))
    got, work = edges.edges_and_work(clips, 5)
    assert work.agg(F.sum("pairs")).first()[0] < 12_000 * 800
    some = "id % 600 = 0"
    want = {(r.a_id, r.id, r.score, r["rank"]) for r in catalog.compatible(clips.where(some), clips, 5).collect()}
    assert {(r.a_id, r.id, r.score, r["rank"]) for r in got.where("a_id % 600 = 0").collect()} == want and len(want) == 100


def test_units_run_over_batches():
    """Rows of a unit that come in several batches are one unit."""
    import numpy as np
    import pyarrow as pa

    rows = {"cell": [1, 1, 1, 2, 2, 2], "piece": [0, 0, 1, 1, 1, 1], "id": [5, 6, 7, 8, 9, 10]}
    for size in (1, 2, 4, 6):
        batches = pa.table(rows).to_batches(max_chunksize=size)
        assert [(u, v["id"].tolist()) for u, v in edges.units_of(iter(batches))] == [((1, 0), [5, 6]), ((1, 1), [7]), ((2, 1), [8, 9, 10])]
    assert list(edges.units_of(iter([pa.RecordBatch.from_pydict({n: np.zeros(0, np.int64) for n in rows})]))) == []


def test_bounds_hold(spark):
    """No pair of two cells scores more than their bound."""
    import numpy as np

    f = edges.celled(edges.facts(awkward(spark)))
    rows = f.toPandas()
    groups = {c: {n: g[n].to_numpy() for n in ("id", "key", "text", *edges.NUMBERS)} for c, g in rows.groupby("cell")}
    cells = {"key": np.array([g["key"][0] for g in groups.values()])} | {f"{n}_{m}": np.array([getattr(np, m)(g[n]) for g in groups.values()]) for n in edges.NUMBERS for m in ("min", "max")}
    bound = edges.bounds(cells, cells, catalog.PURPOSES["all"])
    for i, a in enumerate(groups.values()):
        for j, b in enumerate(groups.values()):
            assert edges.scores(a, b, catalog.PURPOSES["all"]).max() <= bound[i, j]


def test_neighbours_by_cells(spark):
    """Recall of 0.9 or more without structure, and with it by under a tenth of the pairs; one cell may hold a third of all."""
    import numpy as np

    pairs = lambda df: {(r.query_id, r.id) for r in df.collect()}
    v = views.vectors(spark, "/root/testdata/sf0.01")
    exact = pairs(vectors.knn(v.where("id % 50 = 0"), v, 10))
    assert len(exact & pairs(vectors.knn_cells(v.where("id % 50 = 0"), v, 10))) / len(exact) >= 0.9
    rng = np.random.default_rng(1)
    x = np.concatenate([np.repeat(rng.normal(size=(100, 16)), 20, 0), np.tile(rng.normal(size=16), (1000, 1))])
    x += rng.normal(size=x.shape) * 0.05
    v = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "id long, v array<double>").repartition(4)
    q = v.where("id % 50 = 7")
    exact, found = pairs(vectors.knn(q, v, 9)), pairs(vectors.knn_cells(q, v, 9))
    assert len(exact & found) / len(exact) >= 0.9
    u = x / np.linalg.norm(x, axis=1)[:, None]
    c = vectors.centres(u, int(np.sqrt(len(x))))
    probes, cell = vectors.probes_for(u, c, 9, 0.95), (u @ c.T).argmax(1)
    small = [i for i in range(7, 2000, 50)]
    looked = [(cell[None] == np.argsort(-(u[i] @ c.T))[:probes, None]).sum() for i in small]
    assert sum(looked) < 0.1 * len(small) * len(x)
    assert vectors.knn_cells(q, v.limit(0), 3).count() == 0 and vectors.knn_cells(q.limit(0), v, 3).count() == 0


@pytest.mark.parametrize("k,piece", [(4, 8), (50, 40), (3, 500)])
def test_neighbours_within_a_radius(spark, k, piece):
    """The nearest points are those of all pairs, with a dense corner, ties, points on borders and beyond the origin, and odd rows."""
    import numpy as np

    rng = np.random.default_rng(k)
    x = np.concatenate([rng.normal(size=(150, 3)) * 0.05 + 1, rng.uniform(-4, 4, (150, 3)), np.repeat([[0.0, 0.0, 0.0], [1.0, -1.0, 2.0]], 12, 0), np.round(rng.uniform(-2, 2, (60, 3)))])
    rows = [(i * 7 % 1009, *map(float, p)) for i, p in enumerate(x)]
    ids = np.array([r[0] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = set()
    for i, a in enumerate(ids):
        near = sorted((d[i, j], b) for j, b in enumerate(ids) if b != a and d[i, j] <= 1)
        want |= {(a, b, n + 1, round(v, 9)) for n, (v, b) in enumerate(near[:k])}
    p = spark.createDataFrame([*rows, (rows[0][0], *rows[0][1:]), (None, 0.0, 0.0, 0.0), (5000, None, 0.0, 0.0)], "id long, x double, y double, z double").repartition(4)
    got = edges.radius_neighbours(p, 1.0, k, piece)
    assert {(r.a_id, r.id, r["rank"], round(r.distance, 9)) for r in got.collect()} == want and len(want) > 700
    assert edges.near_pieces(p, 1.0, piece).agg(F.max(F.size("rows"))).first()[0] <= piece
    assert edges.radius_neighbours(p.limit(0), 1.0, k).count() == 0


def test_all_pairs_are_not_shuffled(spark):
    """Pieces meet where two partitions are read; no piece is copied for each other one beforehand."""
    plan = edges.edges_above(views.samples(spark, SF), 0.6, piece=10)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan


@pytest.mark.parametrize("name", ["knn_exact", "knn_weighted", "find_similar", "knn_lsh", "knn_cells_recall"])
def test_vectors_meet_as_matrices(spark, name):
    """No pair of vectors is a row of a join, which would be sorted or shuffled before the best are known."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == (1 if name == "knn_cells_recall" else 0) and "MapInArrow" in plan


def test_copies_and_odd_vectors(spark):
    """Of many copies the smallest ids count; rows without a vector or of another length are no neighbours; ids of any number of queries."""
    rows = [(i, [1.0, float(i % 5), 0.5]) for i in range(300)] + [(300, None), (301, [1.0]), (302, [])]
    v = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    for limit in (1, 100):
        got = sorted((r.query_id, r["rank"], r.id) for r in vectors.knn(v.where("id in (7, 2, 300, 301)"), v, 3, limit).collect())
        assert got == [(2, 1, 7), (2, 2, 12), (2, 3, 17), (7, 1, 2), (7, 2, 12), (7, 3, 17)]


def test_fnv_in_steps(spark):
    """Hashes of many seeds, empty, long and unknown ones too, as plain Python has them, in a tenth of the time that a fold by column takes."""
    import time

    def plain(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return f"{text.ADJECTIVES[h % 12]}-{text.NOUNS[(h >> 16) % 12]}"

    seeds = ["", "a", "\u00e4\u00f6 \u20ac", "x" * 5000]
    got = spark.createDataFrame([(s,) for s in [*seeds, None]], "s string").select("s", text.stem_fnv(F.col("s")).alias("stem")).collect()
    assert {r.s: r.stem for r in got} == {s: plain(s) for s in seeds} | {None: None}
    many = spark.range(300_000, numPartitions=8).select(text.stem_fnv(F.rpad(F.col("id").cast("string"), 100, "x")).alias("stem"))
    begun = time.time()
    assert many.where("stem is null").count() == 0 and time.time() - begun < 12


def test_many_labels(spark):
    v = views.vectors(spark, SF)
    labels = v.where("id % 25 = 0").select(F.col("id").alias("label"), "v")
    few, many = (sorted((r.id, r.label, round(r.confidence, 9)) for r in vectors.label_by_vectors(v, labels, limit=n).collect()) for n in (10_000, 3))
    assert few == many and len(few) == 3 * v.count()
