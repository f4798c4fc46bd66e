import hashlib
import random
import re
import time
import tracemalloc
from collections import Counter

from pyspark.sql import functions as F

from soundframe.llm import repeats as R


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(r)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(r), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def check(spark, texts, docs_of, length):
    from pyspark.sql import functions as F

    got = R.remove_repeats(docs_of(texts, ", k1 string, key string", ("a", "b")), length)
    rows = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in got.select("doc_id", "n_bytes", "kept", "removed").withColumn("x", F.lit(1)).collect()}
    for i, want in enumerate(brute(texts, length)):
        assert rows[i] == want, (i, rows[i], want)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "éa", "north", "wind", "x", "blue"]) + str(rng.randrange(1000)) for _ in range(n))


def corpus(rng):
    shared = [prose(rng, 150) for _ in range(4)]
    texts = [None, "", "a" * 399, "a" * 400, "b" * 401, "ab" * 600, "abc" * 2000]
    for k in range(60):
        t = prose(rng, rng.randrange(5, 200))
        if k % 3 == 0:
            s = rng.choice(shared)
            cut = rng.randrange(len(s) // 2)
            t = t + s[cut : cut + rng.randrange(350, 900)] + prose(rng, 30)
        if k % 7 == 0:
            t = t[:300] + rng.choice(["Z", ""]) + t[300:] + t[100:700]
        texts.append(t)
    return texts + texts[10:14] + [texts[20][:250] + "é" + texts[20][250:]]


def test_equals_brute_force(spark, docs_of):
    check(spark, corpus(random.Random(5)), docs_of, 400)


def test_crowded_anchors_are_split(spark, docs_of, monkeypatch):
    monkeypatch.setattr(R, "CROWD", 3)
    rng = random.Random(6)
    passage = prose(rng, 120)
    texts = corpus(rng) + [prose(rng, 20) + passage[rng.randrange(60) :] + prose(rng, 20) for _ in range(30)]
    check(spark, texts, docs_of, 400)


def test_long_texts_in_parts(spark, docs_of, monkeypatch):
    monkeypatch.setattr(R, "LONG", 3000)
    rng = random.Random(7)
    t = prose(rng, 3000)
    import numpy as np

    data = np.frombuffer(t.encode(), np.uint8)
    whole = R.anchors_of(data, np.array([0, len(data)]), np.array([0]), np.array([len(data) - 399]))
    got = set()
    for lo, hi, _, bounds, first, last in R.parts(np.array([0, len(data)]), 400):
        p = R.anchors_of(data[lo:hi], bounds, first, last)
        got |= set((p[1] + lo).tolist())
    assert got == set(whole[1].tolist())


def test_index_by_hand():
    import numpy as np

    text = np.frombuffer(b"abracadabra-abracadabra" + bytes([255]), np.uint8)
    index = R.RunIndex(text)
    raw = text.tobytes()
    order = sorted(range(len(raw)), key=lambda i: raw[i:])
    assert R.suffix_array(text).tolist() == order
    rows = np.repeat(index.letters, index.lengths)
    assert rows.tolist() == [raw[i - 1] for i in order] and len(index.letters) < len(raw)
    firsts = np.r_[0, np.cumsum(index.lengths)[:-1]]
    assert index.heads.tolist() == [order[k] for k in firsts] and index.tails.tolist() == [order[k - 1] for k in np.cumsum(index.lengths)]
    same = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    lcp = [max(same(raw[i:], raw[j:]) for j in range(len(raw)) if j != i) for i in range(len(raw))]
    assert index.statistics().tolist() == lcp
    assert len(index.heads) < len(raw)


def test_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(150)
    texts = [r.text for r in docs.collect()]
    got = {r.doc_id: r for r in R.remove_repeats(docs).collect()}
    for i, want in enumerate(brute(texts, 400)):
        r = got[i]
        assert (r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), hashlib.sha256(r.kept).hexdigest()) == want


def test_empty(spark, docs_of):
    assert R.remove_repeats(docs_of(["x"]).limit(0)).count() == 0


def test_rows_that_repeat_and_null_ids(spark, docs_of):
    import random

    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(900))
    docs = docs_of([long, "x" + long[:500] + "y", "short", None], ", k1 int, k2 int, maybe string", (1, 2, "m"))
    docs = docs.unionByName(docs.where("doc_id = 0")).unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    rows = [(r.doc_id, r.n_bytes, len(r.kept)) for r in R.remove_repeats(docs).collect()]
    assert sorted(rows, key=str) == sorted([(0, 900, 0), (0, 900, 0), (1, 502, 0), (None, 502, 0), (2, 5, 5), (3, 0, 0)], key=str)


def test_many_repeated_rows(spark, docs_of):
    """Ten thousand rows of one id and text, and of one text under null ids, lose what they share, each row's spans held once."""
    rng = random.Random(11)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    one = docs_of([text]).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(10_000)))).drop("n")
    null = one.withColumn("doc_id", F.lit(None).cast("long"))
    clean = docs_of(["", "".join(rng.choice("abcdefgh ") for _ in range(3000))]).withColumn("doc_id", F.col("doc_id") + 7)
    began = time.time()
    got = R.remove_repeats(one.unionByName(null.limit(500)).unionByName(clean)).groupBy("doc_id", F.octet_length("kept").alias("kept"), F.size("removed").alias("spans")).count().collect()
    assert sorted((str(r.doc_id), r.kept, r.spans, r["count"]) for r in got) == [("0", 0, 1, 10_000), ("7", 0, 0, 1), ("8", 3000, 0, 1), ("None", 0, 1, 500)]
    assert time.time() - began < 60


def peak_mb(work):
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def test_what_a_python_worker_holds():
    """8 MB of texts are hashed in under 20 MB, and a unit of 0.75 MB of near copies is indexed in under 48 MB (54 and 64 MB before)."""
    import numpy as np

    rng = np.random.default_rng(1)
    texts = rng.integers(97, 123, (2000, 4000)).astype(np.uint8)
    R.Powers.get(1 << 21)
    assert peak_mb(lambda: [R.anchors_of(texts.reshape(-1)[lo:hi], *more) for lo, hi, _, *more in R.parts(np.arange(2001) * 4000)]) < 20
    near = np.repeat(texts[:200, :750], 5, axis=0)
    near[np.arange(1000), rng.integers(0, 750, 1000)] = 35
    assert peak_mb(lambda: R.repeated_starts([t.tobytes() for t in near])) < 48


def test_statistics_in_steps(monkeypatch):
    import numpy as np

    monkeypatch.setattr(R, "STEP", 3)
    rng = random.Random(12)
    for _ in range(20):
        raw = bytes(rng.choice(b"\0ab") for _ in range(60)) * 2 + bytes([255])
        same = lambda a, b: next((k for k in range(len(raw) - max(a, b)) if raw[a + k] != raw[b + k]), len(raw) - max(a, b))
        assert R.RunIndex(np.frombuffer(raw, np.uint8)).statistics().tolist() == [max(same(i, j) for j in range(len(raw)) if j != i) for i in range(len(raw))]


def test_tasks_have_one_python_step_and_small_batches(spark, docs_of):
    """Where spans are too many to broadcast, a task of the result has one Python worker; a row group of 40 MB of text comes to it in batches of some 4 MB."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        long = prose(random.Random(13), 100)
        plan = R.remove_repeats(docs_of([long, "x" + long, "short"]))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    most, above = 0, []
    for line in plan.splitlines():
        lead = re.match(r"[ :+\-]*", line)[0]
        name = re.sub(r"^\*?\s?\(\d+\)\s", "", line[len(lead) :])
        above = above[: next((k for k, (depth, _) in enumerate(above) if depth >= len(lead)), len(above))]
        steps = 0 if "Exchange" in name.split(" ")[0] else (above[-1][1] if above else 0) + name.startswith(("ArrowEvalPython", "MapInArrow"))
        above.append((len(lead), steps))
        most = max(most, steps)
    assert most == 1

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    texts = spark.range(0, 10_000, 1, 1).select(F.repeat(F.lit("word "), 800).alias("text"))
    assert texts.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 6e6
