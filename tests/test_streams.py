"""Streams with state and timers against their batch twins."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from soundframe.operators import features, signal
from soundframe.streaming import jobs


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    jobs.with_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def played(spark, batches, f, path):
    """The rows that a stream gives for batches, one file and one trigger each."""
    for k, b in enumerate(batches):
        b.coalesce(1).write.parquet(f"{path}/in/{k:03d}")
    stream = f(spark.readStream.schema(batches[0].schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
    name = "out_" + str(abs(hash(path)))
    stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{path}/point").start().awaitTermination(300)
    return [tuple(r) for r in spark.sql(f"select * from {name}").collect()]


def test_takes_with_timers(spark, tmp_path):
    """The stream gives the rows of the batch, though readings come late, tie, and silences cross batches."""
    rng = np.random.default_rng(3)
    rows, t = [], 0.0
    for i in range(160):
        t += float(rng.choice([0.25, 0.5, 1.0, 3.0]))
        rows.append((i, int(rng.integers(0, 2)), t, float(rng.choice([-60.0, -20.0, -50.0], p=[0.5, 0.3, 0.2]))))
    rows += [(200 + d, d, t + 30.0 + d * 0.001 + s, -60.0) for d in (0, 1) for s in (0, 20)]  # silence that ends every take
    rows += [(300 + d, d, t + 500.0, -60.0) for d in (0, 1)] + [(400, 9, t + 900.0, -60.0)]  # moves the watermark behind all
    schema = "event_id long, device_id long, s double, peak_db double"
    df = lambda rs: spark.createDataFrame(rs, schema).select("event_id", "device_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), "peak_db")
    late = sorted(rows, key=lambda r: r[2] + float(rng.uniform(0, 4)) * (r[0] < 160))  # up to four seconds behind later ones
    batches = [df(late[i : i + 41]) for i in range(0, len(late) - 1, 41)] + [df(late[-1:])]
    want = sorted((r.device_id, r.take, r.started_at, r.ended_at, r.loud_readings) for r in signal.takes(df(rows), -40.0, 2.0).collect())
    got = played(spark, batches, lambda s: jobs.armed_takes(s, -40.0, 2.0, "10 seconds"), str(tmp_path))
    assert len(want) > 10 and sorted(got) == want


def test_chunks_that_cross_batches(spark, tmp_path):
    rng = np.random.default_rng(5)
    sound = {1: rng.normal(size=5003), 2: rng.normal(size=200), 3: np.zeros(1024)}
    pieces, at = [], dict.fromkeys(sound, 0)
    while any(at[d] < len(x) for d, x in sound.items()):
        for d, x in sound.items():
            n = int(rng.choice([1, 37, 256, 700]))
            if at[d] < len(x):
                pieces.append((d, len(pieces), x[at[d] : at[d] + n].tolist()))
                at[d] += n
    batches = [spark.createDataFrame(pieces[i : i + 7], "device_id long, seq long, pcm array<double>") for i in range(0, len(pieces), 7)]
    got = played(spark, batches, lambda s: jobs.recording_chunks(s, 8000.0, 256), str(tmp_path))
    b = spark.createDataFrame([(d, i // 90, x[i : i + 90].tolist()) for d, x in sound.items() for i in range(0, len(x), 90)], "clip_id long, block long, pcm array<double>")
    want = [tuple(r) for r in features.recording_chunks(b, 8000.0, 256, 90).collect()]
    assert len(want) == 23 and len(got) == len(want)
    for g, w in zip(sorted(got), sorted(want)):
        assert g[:2] == w[:2] and np.allclose(g[2:], w[2:])


@pytest.mark.parametrize("total,bars", [(33, 20), (5, 20), (20, 20), (1000, 7), (49, 48), (3, 1)])
def test_bars_of_chunks(spark, total, bars):
    rng = np.random.default_rng(total)
    peak, tone = rng.random(total), rng.random(total) * 1000
    c = spark.createDataFrame(pd.DataFrame({"clip_id": 1, "chunk": np.arange(total), "peak": peak, "centroid": tone}))
    got = sorted((r.bar, r.peak, r.centroid) for r in features.chunk_bars(c, bars).collect())
    per = total / bars
    edges = [(int(b * per), min(int((b + 1) * per), total)) for b in range(bars)] if total > bars else [(i, i + 1) for i in range(total)]
    assert [g[0] for g in got] == list(range(len(edges))) and all(g[1] == peak[a:b].max() and abs(g[2] - tone[a:b].mean()) < 1e-9 for g, (a, b) in zip(got, edges))
