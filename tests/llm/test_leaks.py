"""Leaks that once were lost, against every window in plain Python."""

import random
from collections import Counter

from pyspark.sql import functions as F

from soundframe.llm import decontaminate


def best_window(text, item):
    d, b = ([tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in (text.split(), item.split()))
    width, found = min(len(d), len(b)), 0.0
    for i in range(len(d) - width + 1):
        both = sum((Counter(d[i : i + width]) & Counter(b)).values())
        found = max(found, both / (width + len(b) - both))
    return round(found, 6)


def first_best(text, item):
    """(start, similarity) of the first best window of a long text: shared shingles are counted up and down from window to window."""
    d, b = ([tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in (text.split(), item.split()))
    width, own, have, both, best = min(len(d), len(b)), Counter(b), Counter(), 0, (0.0, 0)
    for i, x in enumerate(d):
        if i >= width:
            both -= have[d[i - width]] <= own[d[i - width]]
            have[d[i - width]] -= 1
        have[x] += 1
        both += have[x] <= own[x]
        if i >= width - 1:
            best = max(best, (both / (width + len(b) - both), width - 1 - i))
    return -best[1], round(best[0], 6)


def leaks(spark, docs_of, texts, items):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in decontaminate.contaminated(docs_of(texts), bench).collect()}
    want = {(i, j): best_window(t, x) for i, t in enumerate(texts) for j, x in enumerate(items)}
    assert got == {k: v for k, v in want.items() if v >= 0.75}
    return got


def test_rotated_items(spark, docs_of):
    rng = random.Random(4)
    fill = lambda n: " ".join(f"f{rng.randrange(10**6)}" for _ in range(n))
    w = [f"w{i}" for i in range(60)]
    few = [f"r{rng.randrange(6)}" for _ in range(50)]
    swapped, turned = " ".join(w[30:] + w[:30]), " ".join(few[20:] + few[:20])
    texts = [f"{fill(80)} {swapped} {fill(90)}", swapped, f"{fill(7)} {turned} {fill(3)}", " ".join(w[20:40]), f"{' '.join(w[30:])} {fill(40)} {' '.join(w[:30])}", " ".join(few * 3)]
    assert {(0, 0), (1, 0), (5, 1)} <= set(leaks(spark, docs_of, texts, [" ".join(w), " ".join(few)]))


def test_near_copies_that_repeat_a_word(spark, docs_of):
    texts, items = [], []
    for k in range(12):
        item = [f"a{k}x{i}" for i in range(176)] + ["_"] * 28  # 200 shingles, of which the last 24 are one
        near = item[:176] + [f"q{k}x{i}" for i in range(28)]  # 172 of 228
        texts.append(" ".join(near))
        items.append(" ".join(item))
    assert len(leaks(spark, docs_of, texts, items)) == 12


def test_fingerprints_of_long_texts(spark):
    df = spark.range(1).selectExpr("sequence(1L, 70000L) as h")
    h = df.select(F.transform("h", lambda x: F.xxhash64(x, F.lit(0))).alias("h"))
    plain = [sum(x >> b & 1 for x in h.first().h) for b in range(60)]
    got = df.select(decontaminate.simhash(F.col("h")).alias("x")).first().x
    assert [got[b // 10] >> b % 10 & 1 for b in range(60)] == [int(2 * n > 70000) for n in plain]


def test_moved_windows_equal_those_taken_alone(spark):
    """Entries, fingerprints and shared entries of windows that are moved along, on few and on many different shingles."""
    rng = random.Random(12)
    rows = []
    for _ in range(60):
        n, kinds = rng.randrange(1, 90), rng.choice([1, 2, 5, 30, 10**6])
        width = rng.randrange(1, n + 1)
        at = sorted({0, *rng.sample(range(n - width + 1), rng.randrange(1, n - width + 2))})
        rows.append(([rng.randrange(kinds) for _ in range(n)], at, width, [rng.randrange(kinds) for _ in range(rng.randrange(1, 60))]))
    df = spark.createDataFrame(rows, "h array<bigint>, at array<int>, width int, g array<bigint>").withColumn("n", F.element_at("at", -1) + F.col("width"))
    df = df.withColumn("h", F.slice("h", F.lit(1), F.col("n"))).withColumn("m", decontaminate.moves(F.col("h"), F.col("width")))
    df = df.select("*", "m.add", "m.rem", F.sort_array(decontaminate.moves(F.col("g"), F.size("g"))["add"]).alias("own"))
    moved = [F.col(c) for c in ("add", "rem", "at", "width")]
    df = df.withColumns({"fps": decontaminate.fingerprints(*moved), "both": decontaminate.shared(*moved, F.col("own"))})
    alone = F.transform("at", lambda a: decontaminate.simhash(F.slice("h", a + 1, F.col("width"))))
    for r in df.withColumn("alone", alone).collect():
        assert r.fps == r.alone
        assert r.both == [sum((Counter(r.h[a : a + r.width]) & Counter(r.g)).values()) for a in r["at"]]


def test_long_items(spark, docs_of):
    """Items of 20,000 words inside longer documents, one with a repeated stretch; the work grows with the words, not with their square."""
    words = [f"w{i}" for i in range(20_000)]
    again = words[:9_000] + words[500:1_500] * 11
    fill = [f"f{i}" for i in range(20_000)]
    texts = [" ".join(fill + words + fill), " ".join(words[2_000:]), " ".join(fill + again[:18_500] + fill), " ".join(words[:9_000])]
    bench = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(again))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, round(r.similarity, 6)) for r in decontaminate.contaminated(docs_of(texts), bench).collect()}
    want = {(i, r.item_id): first_best(t, r.text) for i, t in enumerate(texts) for r in bench.collect()}
    assert got == {k: v for k, v in want.items() if v[1] >= 0.75} and set(got) == {(0, 0), (1, 0), (2, 1)}


def test_blocks_find_all_within_the_radius(spark):
    rng = random.Random(8)
    blocks = lambda: [rng.randrange(1 << decontaminate.WIDTH) for _ in range(decontaminate.BLOCKS)]
    items = [(i, 7 + i % 2, blocks()) for i in range(20)]
    windows = []
    for w in range(300):
        fp = list(items[w % 20][2])
        for b in rng.sample(range(120), rng.randrange(50)):
            fp[b // 10] ^= 1 << b % 10
        windows.append((w, 7 + rng.randrange(2), fp))
    got = {tuple(r) for r in decontaminate.block_pairs(spark.createDataFrame(windows, "wid long, size int, fp array<int>"), spark.createDataFrame(items, "item long, size int, fp array<int>")).collect()}
    far = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b))
    want = {(w, i) for w, s, a in windows for i, t, b in items if s == t and far(a, b) <= decontaminate.RADIUS}
    assert got == want and len(want) > 80


def test_recall_at_the_threshold(spark):
    """Pairs of item-sized windows at a similarity of 0.75 to 0.8: at least 0.99 lie within the radius."""
    rng = random.Random(9)
    rows = []
    for k in range(400):
        size = rng.randrange(30, 80)
        lost = size // 7 - rng.randrange(2)
        a = [rng.randrange(1 << 60) for _ in range(size)]
        rows.append((a, a[lost:] + [rng.randrange(1 << 60) for _ in range(lost)]))
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>").select(decontaminate.simhash(F.col("a")).alias("x"), decontaminate.simhash(F.col("b")).alias("y"))
    near = df.where(decontaminate.hamming("x", "y") <= decontaminate.RADIUS).count()
    assert near >= 0.99 * len(rows)


def test_rows_that_repeat_and_clash(spark, docs_of):
    item = " ".join(f"b{i}" for i in range(30))
    docs = docs_of([item, item, None, "", "x " * 4], ", size int, start int, h int, wid int, fp int, k int, item int, text2 string", (1, 2, 3, 4, 5, 6, 7, "t"))
    docs = docs.unionByName(docs.where("doc_id = 1")).unionByName(docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    bench = spark.createDataFrame([(1, item), (1, item), (None, item), (2, "b1 b2 b3")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.similarity) for r in decontaminate.contaminated(docs, bench).collect() if r.doc_id is not None and r.item_id is not None)
    assert got == [(0, 1, 1.0), (1, 1, 1.0)]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [2, 3, 4]
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
