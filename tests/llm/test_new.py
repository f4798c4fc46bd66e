"""Importance resampling, periodic runs and token counts against plain Python, the SQL and the tokenizers library."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from soundframe.llm import bpe, importance, periodic, tokens
from soundframe.llm.common import mix

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def features(text, ngrams=1):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, ngrams + 1) for i in range(len(w) - k + 1)]


def resampled(rows, target, percent=10, least=20, ngrams=1, buckets=10000):
    """[(doc_id, n_features, weight, score)] and the ids drawn, in order."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t, ngrams)[1])
    t = Counter(bucket(f) for x in target for f in features(x, ngrams)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    out, able = [], []
    for i, text in rows:
        n, f = features(text, ngrams)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(f), weight, score))
        if n >= least:
            able.append((-score, i is None, i or 0, -len(f), i))
    return out, [x[-1] for x in sorted(able)[: percent * len(able) // 100]]


@pytest.mark.parametrize("ngrams", [1, 3])
def test_resampling_against_plain_python(spark, docs_of, ngrams):
    rng = random.Random(ngrams)
    words = [f"w{i}" if i % 7 else f"Wé{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) + "?" for _ in range(300)] + [None, "", "  .", "x" * 5000 + " " + "é" * 200 + " y-z" * 20]
    target = [" ".join(words[:40]), None, "w1 W1 w1, w2"]
    docs = docs_of(texts, ", score string, number int, n_words int, rank long", ("x", 1, 2, 3))
    docs = docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(docs.where("doc_id < 40").withColumn("doc_id", F.lit(None).cast("long")))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    rows, drawn = resampled([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], target, 10, 20, ngrams, 500)
    got = importance.resample(docs, bench, ngrams=ngrams, buckets=500)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = got.collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(rows)
    ranked = sorted((r.rank, r.doc_id) for r in got if r.rank is not None)
    assert len(drawn) > 20 and [i for _, i in ranked] == drawn and [n for n, _ in ranked] == list(range(1, len(drawn) + 1))


def test_resampling_of_odd_tables(spark, docs_of):
    docs, bench = docs_of(["a " * 30] * 25), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = importance.resample(docs.limit(0), bench)
    assert none.count() == 0 and dict(none.dtypes)["rank"] == "bigint"
    assert importance.resample(docs.limit(9), bench).where("rank is not null").count() == 0  # a tenth of 9 is none
    assert importance.resample(docs, bench.limit(0)).where("rank is not null").count() == 2
    same = docs.withColumn("doc_id", F.lit(7))  # all rows tie in everything
    assert sorted(r.rank for r in importance.resample(same, bench, percent=20).where("rank is not null").collect()) == [1, 2, 3, 4, 5]
    assert importance.resample(docs, bench, percent=100).where("rank is null").count() == 0


def test_bracket_is_widened(spark, monkeypatch):
    """Whatever the sketch says, exact counts lead to a bracket that holds the cutoff."""
    rng = random.Random(4)
    values = [rng.choice((0, 0, 0, rng.randrange(-5000, 5000))) for _ in range(3000)]
    scored = spark.createDataFrame([(v,) for v in values], "score long")
    order = sorted(values, reverse=True)
    for k in (1, 2, 300, 1500, 2999, 3000):
        for accuracy in (2, 50, 10_000):
            low, high, above = importance.bracket(scored, k, len(values), accuracy)
            assert low <= order[k - 1] <= high and above == sum(v > high for v in values)
    real = F.percentile_approx
    monkeypatch.setattr(importance.F, "percentile_approx", lambda c, marks, n: real(c, [max(m - 0.2, 0.0) for m in marks], n))
    low, high, above = importance.bracket(scored, 300, len(values), 10_000)
    assert low <= order[299] <= high and above < 300


def test_resampling_against_sql(spark, sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    names = [d[0] for d in con.execute(importance.SQL).description]
    want = con.execute(importance.SQL).fetchall()
    assert Counter(tuple(r[n] for n in names) for r in importance.query_importance(spark, sf).collect()) == Counter(want)


def runs_by_force(w, least=24, exponent=3):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s = w[i : j + q]
            if len(s) >= max(least, exponent * q) and not any(all(s[x] == s[x + d] for x in range(len(s) - d)) for d in range(1, q)):
                out.append((i, len(s), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    w = []
    for _ in range(rng.randrange(1, 6)):
        unit = [f"x{rng.randrange(rng.choice((2, 3, 50)))}" for _ in range(rng.choice((1, 2, 3, 5, 12)))]
        w += unit * rng.randrange(1, 14) + unit[: rng.randrange(len(unit))]
    return w + w if rng.random() < 0.3 else w


@pytest.mark.parametrize("least,exponent", [(24, 3), (6, 2), (10, 4)])
def test_runs_against_brute_force(least, exponent):
    rng = random.Random(least)
    texts = [repetitive(rng) for _ in range(150)] + [[], ["x1"]]
    number = {w: i for i, w in enumerate(sorted({x for t in texts for x in t}))}
    hashes = mix(np.array([number[x] for t in texts for x in t], np.uint64) + np.uint64(9))
    got = periodic.runs_of(hashes, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), least, exponent)
    want = [runs_by_force(t, least, exponent) for t in texts]
    assert got == want and sum(map(len, want)) > 100


def digest_by_force(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = runs_by_force(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if runs else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_query_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", " \n", "one", "a b " * 30, "Ab ab " * 20, "é " * 24, "x " * 23, ("p q r s t u v w x " * 4 + "\n") * 2]
    texts += [" ".join(repetitive(rng) if rng.random() < 0.6 else [f"w{rng.randrange(900)}" for _ in range(rng.randrange(150))]) for _ in range(150)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[4], "x", 1), (4, texts[4], "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.query_periodic(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(digest_by_force(i, t) for i, t, *_ in rows)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_runs_of_a_very_long_text(spark, docs_of):
    line = " ".join(f"w{i}" for i in range(40))
    r = periodic.periodic_runs(docs_of(["spam " * 200_000, f"{line}\n" * 3000])).orderBy("doc_id").collect()
    assert [tuple(x) for x in r[0].runs] == [(0, 200_000, 1)] and r[0].collapsed == "spam"
    assert [tuple(x) for x in r[1].runs] == [(0, 120_000, 40)] and r[1].collapsed == line


def test_token_counts_of_the_whole_table(spark, sf):
    want = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.vocabulary())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = tokens.query_tokens(spark, sf).collect()
    assert len(rows) == len(texts) and sum(r.n_whole for r in rows) > 0.2 * sum(r.n_tokens for r in rows)
    for r in rows:
        n = len(want.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def test_token_counts_of_odd_texts(spark, docs_of):
    want = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.vocabulary())
    texts = [None, "", " \n", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|end", "ΣΑΣ İstanbul ǅ ﬁ Å", "日本語 텍스트 😀", "a" * 3000, "ab" * 30_000, "don'T 12 ½ \x00 \x85", "the " * 2048, "the " * 2049]
    docs = docs_of(texts, ", n_tokens string, over_limit int, n_bytes int", ("x", 1, 1))
    docs = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs, bpe.vocabulary()).collect())
    n = [len(want.encode(t or "", add_special_tokens=False).ids) for t in texts]
    one = [(len((t or "").encode()), k, k > 2048) for t, k in zip(texts, n)]
    assert got == Counter([(i, *x) for i, x in enumerate(one)] * 2 + [(None, *x) for x in one])
    assert tokens.token_counts(docs.limit(0), bpe.vocabulary()).count() == 0


def test_proof_of_whole_words():
    """Every proven string is one token to the library, and no other single-token word of the vocabulary is left out."""
    want = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.vocabulary())
    whole = tokens.proven(bpe.vocabulary())
    split = bpe.tokenizer(bpe.vocabulary()).split
    words = [w for w in whole if split(w) == [w]]
    assert len(whole) > 30_000 and len(words) > 0.9 * len(whole)
    assert all(len(e.ids) == 1 for e in want.encode_batch(words, add_special_tokens=False))
    others = [k[:-4] for k in want.get_vocab() if k.endswith("</w>") and k[:-4].isascii() and k[:-4].isalpha() and k[:-4] not in whole]
    assert all(len(e.ids) > 1 for e in want.encode_batch(others, add_special_tokens=False))
