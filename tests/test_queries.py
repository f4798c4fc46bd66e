"""Every registered query of the catalogue and the signals against its SQL, on the small tables."""

import os
from collections import Counter

import duckdb
import pytest

from soundframe.plans.all import QUERIES, SQL

SF = "/root/testdata/sf0.001"
#: Too few clips at this scale; at 0.01 these have rows.
RARE = ("search_type", "missing_embeddings", "missing_work")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else int(v) if isinstance(v, bool) else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    found = want.fetchall()
    assert found or name in RARE, "an empty result shows nothing"
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, found)


def test_hashed_neighbours_recall(spark):
    exact = {(r.query_id, r.id) for r in QUERIES["knn_exact"](spark, "/root/testdata/sf0.01").collect()}
    found = {(r.query_id, r.id) for r in QUERIES["knn_lsh"](spark, "/root/testdata/sf0.01").collect()}
    assert len(exact & found) / len(exact) >= 0.9
