"""The filter before the exact step of near-duplicates, and connected components, against plain Python."""

import random

from pyspark.sql import functions as F

from soundframe.llm import minhash
from soundframe.llm.common import components


def test_filter_loses_no_wanted_row(spark):
    docs = spark.range(20000).select(F.when(F.col("id") > 0, F.col("id") - 5000).alias("doc_id"), F.lit("x").alias("text"))
    wanted = docs.where("doc_id % 50 = 0").select("doc_id")
    kept = minhash.mostly_in(docs, wanted).select("doc_id")
    assert wanted.subtract(kept).count() == 0 and kept.count() < 2 * wanted.count()
    assert minhash.mostly_in(docs, wanted.limit(0)).count() == 0
    assert minhash.mostly_in(docs.limit(0), wanted).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200, 230)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(300, i) for i in range(301, 350)] + [(7, 7), (300, 301)]
    lead = {}

    def find(x):
        while lead.setdefault(x, x) != x:
            x = lead[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            lead[high] = low
    got = [tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert sorted(got) == sorted((x, find(x)) for x in lead)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
