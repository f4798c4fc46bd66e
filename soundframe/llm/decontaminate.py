"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

Only built-in functions.

1. Windows. Every window of an item's size counts. A document's five-word shingles that occur in an item bound the similarity of
   the windows there, so only windows with enough of them are formed, and of those only the ones where a shared shingle enters:
   the similarity rises nowhere else, so the first best window is always among them.
2. Fingerprints. A window and an item each get a SimHash of BLOCKS * WIDTH = 120 bits over their shingles. Each occurrence of a
   repeated shingle counts as a shingle of its own, so that none outweighs the rest. Overlapping windows are not counted anew: from one
   to the next the counts of each bit lose what leaves and gain what enters.
3. Blocks. The fingerprints are cut into BLOCKS blocks. Items are indexed under all values within NEAR = 2 bits of each block;
   a window looks up its own value of each. Fingerprints within RADIUS = BLOCKS * (NEAR + 1) - 1 = 35 bits agree so in one block at
   least, so the equi-join on size, block and value finds all of them. A random pair of one size meets 0.66 times on average.
4. What is within RADIUS is verified by the weighted Jaccard similarity of the shingles (weights: occurrences), moved along likewise.

At a similarity of 0.75 a bit differs with probability acos(6/7) / pi = 0.172, so 20.6 of 120 do, with a deviation of 4.1, and RADIUS
misses two pairs in ten thousand there, fewer above. The SQL has no fingerprints and tries every window.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundframe.llm.common import SPACE_RE, free, read, written

SHINGLE, LEAST = 5, 0.75
#: Up to so many bytes of benchmark shingles (some 100 each in a task) or keys of fingerprints (some 200) are broadcast; more are joined by shuffle.
SENT = 64 << 20
BLOCKS, WIDTH, NEAR = 12, 10, 2
#: Windows of one size that begin within so many words (of large items: within a sixteenth of their size) are moved along together.
STRETCH = 512
RADIUS = BLOCKS * (NEAR + 1) - 1


def let(value: Column, f) -> Column:
    """f(value): value stands in an array of one, so that the lambda's name holds it and it is computed once, wherever f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shingled(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds h, the hashes of all shingles in order. Texts with fewer words, and null texts, have none."""
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), SPACE_RE), "")
    shingle = lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, SHINGLE)]))
    return df.withColumn("h", let(F.transform(words, lambda x: F.xxhash64(x)), shingle))


def powers(a: Column) -> Column:
    """Powers of two from over the array's length down to 1: the steps of rank."""
    return F.transform(F.sequence(F.ceil(F.log2(F.size(a) + 1)).cast("int"), F.lit(0)), lambda k: F.call_function("shiftleft", F.lit(1), k))


def rank(a: Column, steps: Column, less) -> Column:
    """How many entries of the sorted array a are first ones for which less holds, by halving."""
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when(less(F.get(a, p + s - 1)), p + s).otherwise(p))


def moves(h: Column, width: Column) -> Column:
    """What enters and leaves a window of width shingles that is moved along h: add has an entry for each shingle of h, rem one for each move.

    An entry is the hash of a shingle and of the number of equal ones in the window, itself left out: a repeated one is many different
    ones, and every window has the entries of its occurrences 0, 1, 2... wherever it starts.
    """
    both = lambda add, rem: F.struct(add.alias("add"), rem.alias("rem"))
    leaving = lambda h: F.slice(h, F.lit(1), F.size(h) - width)
    first = lambda x: F.xxhash64(x, F.lit(0))

    def counted(h: Column, s: Column, steps: Column) -> Column:
        before = lambda x, i: rank(s, steps, lambda y: (y["x"] < x) | ((y["x"] == x) & (y["i"] < i)))
        entry = lambda x, lo, hi: F.xxhash64(x, before(x, hi) - before(x, lo))
        add = F.transform(h, lambda x, i: entry(x, F.greatest(i - width + 1, F.lit(0)), i))
        return both(add, F.transform(leaving(h), lambda x, i: entry(x, i + 1, i + width)))

    places = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    plain = lambda h: F.size(F.array_distinct(h)) == F.size(h)
    repeats = lambda h: let(places(h), lambda s: let(powers(s), lambda steps: counted(h, s, steps)))
    return let(h, lambda h: F.when(plain(h), both(F.transform(h, first), F.transform(leaving(h), first))).otherwise(repeats(h)))


def running(add: Column, rem: Column, at: Column, width: Column, weight) -> Column:
    """The sum of weight over the entries of the window at each of `at` (sorted, the first is 0): summed up once, then moved along."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + weight(x))
    moved = lambda a, b: total(F.slice(add, a + width + 1, b - a)) - total(F.slice(rem, a + 1, b - a))
    steps = F.transform(F.slice(at, F.lit(2), F.size(at)), lambda b, j: moved(F.get(at, j), b))
    return F.aggregate(steps, F.array(total(F.slice(add, F.lit(1), width))), lambda t, d: F.array_append(t, F.element_at(t, -1) + d))


def fingerprints(add: Column, rem: Column, at: Column, width: Column) -> Column:
    """The blocks of the fingerprint of each window: a bit is set if over half of the entries have it. Two counts share a long."""
    half = BLOCKS // 2 * WIDTH // 2
    right = lambda x, k: F.call_function("shiftrightunsigned", x, k)
    bit = lambda x, k: right(x, k).bitwiseAND(F.lit(1).cast("long"))
    two = lambda k: lambda x: bit(x, k) + F.shiftleft(bit(x, k + half), 32)
    counts = lambda add, rem: F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda k: running(add, rem, at, width, two(k)))
    count = lambda c, t, n: right(F.get(F.get(c, n % half), t), F.when(n < half, 0).otherwise(32)).bitwiseAND(F.lit(0xFFFFFFFF))
    over = lambda c, t, n, k: F.call_function("shiftleft", (2 * count(c, t, n) > width).cast("int"), k)
    block = lambda c, t, b: F.aggregate(F.sequence(F.lit(0), F.lit(WIDTH - 1)), F.lit(0), lambda f, k: f.bitwiseOR(over(c, t, b * WIDTH + k, k)))
    blocks = lambda c: F.transform(at, lambda _, t: F.transform(F.sequence(F.lit(0), F.lit(BLOCKS // 2 - 1)), lambda b: block(c, t, b)))
    again = lambda a: F.transform(a, lambda x: F.xxhash64(x))
    return F.zip_with(let(counts(add, rem), blocks), let(again(add), lambda a: let(again(rem), lambda r: let(counts(a, r), blocks))), lambda x, y: F.concat(x, y))


def simhash(h: Column) -> Column:
    """The blocks of the fingerprint of all shingles h."""
    return let(h, lambda h: let(moves(h, F.size(h))["add"], lambda a: F.get(fingerprints(a, F.slice(a, F.lit(1), F.lit(0)), F.array(F.lit(0)), F.size(h)), F.lit(0))))


def hamming(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


#: What a block may differ by.
MASKS = [sum(1 << k for k in ks) for n in range(NEAR + 1) for ks in combinations(range(WIDTH), n)]


def block_pairs(windows: DataFrame, items: DataFrame) -> DataFrame:
    """(wid, item) of all windows (wid, size, fp) and items (item, size, fp) of one size within RADIUS, once each."""
    keys = items.select("item", "size", F.col("fp").alias("item_fp"), F.posexplode("fp").alias("block", "bits"))
    keys = keys.select("item", "size", "item_fp", "block", F.explode(F.transform(F.array(*map(F.lit, MASKS)), lambda m: F.col("bits").bitwiseXOR(m))).alias("bits"))
    # the planner knows the items' size only, not how many keys they have
    keys = F.broadcast(keys) if items.count() * BLOCKS * len(MASKS) * 200 <= SENT else keys.hint("merge")
    met = windows.select("wid", "size", "fp", F.posexplode("fp").alias("block", "bits")).join(keys, ["size", "block", "bits"])
    return met.where(hamming("fp", "item_fp") <= RADIUS).select("wid", "item").distinct()


def shared(add: Column, rem: Column, at: Column, width: Column, own: Column) -> Column:
    """Of each window: how many of its entries an item has, whose sorted ones are own. Equal ones count as often as both have them."""
    return let(powers(own), lambda steps: running(add, rem, at, width, lambda x: F.get(own, rank(own, steps, lambda y: y < x)).eqNullSafe(x).cast("long")))


def starts() -> Column:
    """From the sorted words `at` that begin a shared shingle: where windows with `need` of them begin, the last just entered."""
    last = F.sequence(F.col("need") - 1, F.size("at") - 1)
    both = F.transform(last, lambda e: F.struct(F.greatest(F.get("at", e) - F.col("width") + 1, F.lit(0)).alias("lo"), F.get("at", e - F.col("need") + 1).alias("hi")))
    return F.array_distinct(F.transform(F.filter(both, lambda x: x.lo <= x.hi), lambda x: x.lo))


def item_windows(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """(cid, doc_id, size, width, starts, at, add, rem, fps): the windows of docs (doc_id, text) that an item of that size could be similar to.

    A row has the windows of one size that begin within a short stretch, so that they share most shingles: the stretch's entries
    stand there once, whatever the number of windows, and the fingerprints follow by moving the window along.
    """
    d = docs.withColumn("k", F.xxhash64("text"))
    index = written(items.select("item", "size", F.explode(F.array_distinct("item_h")).alias("s")), "item_shingles")
    index = F.broadcast(index) if index.count() * 100 <= SENT else index
    # outer, as else a filter on h is put before the explosion, which computes it twice; its one null row meets nothing
    hits = shingled(d).select("doc_id", "k", F.size("h").alias("n"), F.posexplode_outer("h").alias("i", "s")).join(index, "s")
    pairs = hits.groupBy("doc_id", "k", "item", "n", "size").agg(F.array_sort(F.collect_set("i")).alias("at"))
    width = F.least("n", "size")
    need = F.greatest(F.ceil((width + F.col("size")) * (least / (1 + least)) - 1e-9), F.lit(1)).cast("int")
    pairs = pairs.withColumns({"width": width, "need": need}).where(F.size("at") >= F.col("need"))
    places = pairs.select("doc_id", "k", F.explode_outer(starts()).alias("start"), "size").where("start is not null")
    stretch = F.floor(F.col("start") / F.greatest(F.lit(STRETCH), F.col("size") / 16))
    places = places.groupBy("doc_id", "k", "size", stretch.alias("stretch")).agg(F.sort_array(F.collect_set("start")).alias("starts"))
    places = places.groupBy("doc_id", "k").agg(F.collect_list(F.struct("size", "starts")).alias("places"))
    places = written(places, "window_places")  # its size is known from now on, so that few are sent to where the texts are
    found = d.join(places.select(F.col("doc_id").alias("_d"), F.col("k").alias("_k"), "places"), F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("k").eqNullSafe(F.col("_k")))
    w = shingled(found.select("doc_id", "text", "places")).select("doc_id", "h", F.explode_outer("places").alias("p"))
    w = w.select("doc_id", "p.size", "p.starts", F.least("p.size", F.size("h")).alias("width"), "h")
    first = F.get("starts", F.lit(0))
    stretch = F.slice("h", first + 1, F.element_at("starts", -1) - first + F.col("width"))
    w = w.select("doc_id", "size", "width", "starts", F.transform("starts", lambda s: s - first).alias("at"), moves(stretch, F.col("width")).alias("m"))
    w = w.select("doc_id", "size", "width", "starts", "at", "m.add", "m.rem")
    return written(w.withColumns({"fps": fingerprints(*map(F.col, ("add", "rem", "at", "width"))), "cid": F.monotonically_increasing_id()}), "windows")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): for each document and item the best window of at least `least`.

    Of equal windows the first counts. Items and documents of fewer than five words are never matched; null texts are empty; rows
    that repeat an id and a text count once; a null id stays null; items that repeat id and text count once. Texts and items may be of any
    length: windows that overlap share their work. Other columns are ignored, whatever their names; empty tables give none.
    """
    items = shingled(benchmark.select("item_id", "text")).select("item_id", F.size("h").alias("size"), F.col("h").alias("item_h"))
    items = items.where("size > 0").dropDuplicates(["item_id", "item_h"])
    items = items.withColumn("own", moves(F.col("item_h"), F.col("size"))["add"])
    items = items.withColumns({"fp": simhash(F.col("item_h")), "own": F.sort_array("own"), "item": F.monotonically_increasing_id()})
    items = written(items, "items")
    windows = item_windows(docs.select("doc_id", F.col("text").cast("string").alias("text")), items, least)
    each = windows.select("cid", "size", F.posexplode("fps").alias("t", "fp")).select(F.struct("cid", "t").alias("wid"), "size", "fp")
    met = block_pairs(each, items.select("item", "size", "fp")).groupBy("wid.cid", "item").agg(F.collect_list("wid.t").alias("ts"))
    w = windows.join(met, "cid").drop("size").join(items.select("item", "item_id", "size", "own", F.col("fp").alias("item_fp")), "item")
    similarity = lambda n: n / (F.col("width") + F.col("size") - n)
    window = lambda c, t: F.struct(
        similarity(F.get(c, t)).alias("similarity"), (-F.get("starts", t)).alias("s"), F.col("width").alias("n"), hamming(F.get("fps", t), "item_fp").alias("hamming")
    )
    sums = shared(*map(F.col, ("add", "rem", "at", "width", "own")))
    w = w.select("doc_id", "item_id", let(sums, lambda c: F.array_max(F.transform("ts", lambda t: window(c, t)))).alias("b"))
    w = w.where(F.col("b.similarity") >= least).groupBy("doc_id", "item_id").agg(F.max("b").alias("b"))
    return w.select("doc_id", "item_id", (-F.col("b.s")).cast("long").alias("start_word"), (F.col("b.n") + SHINGLE - 1).cast("long").alias("n_words"), F.col("b.hamming").cast("long").alias("hamming"), F.col("b.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """docs without the rows whose id has a contaminated text; rows with a null id go if any null id is contaminated."""
    key = free(docs, "_bad")
    bad = contaminated(docs, benchmark, least).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(key)), "left_anti")


def query_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "start_word", "n_words", F.round("similarity", 6).alias("similarity"))


SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT row_number() OVER () AS r, doc_id, len(w) - 4 AS n, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) AS h FROM d WHERE len(w) > 4),
bs AS (SELECT row_number() OVER () AS q, item_id, len(w) - 4 AS size, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) AS g FROM b WHERE len(w) > 4),
de AS (SELECT r, n, unnest(h) AS s, unnest(range(0, n)) AS i FROM ds),
be AS (SELECT q, size, unnest(g) AS s, unnest(range(0, size)) AS j FROM bs),
m AS (SELECT r, q, n, size FROM (SELECT r, q, n, size, count(DISTINCT i) AS c FROM de JOIN be USING (s) GROUP BY ALL) WHERE c >= (least(n, size) + size) * 3 / 7 - 1e-9),
w AS (SELECT r, q, unnest(range(0, greatest(n - size, 0) + 1)) AS start FROM m),
x AS (SELECT doc_id, item_id, start, h[start + 1 : start + size] AS h, g FROM w JOIN ds USING (r) JOIN bs USING (q)),
y AS (SELECT *, list_sum(list_transform(list_distinct(h), lambda s: least(len(list_filter(h, lambda t: t = s)), len(list_filter(g, lambda t: t = s))))) AS inter FROM x),
z AS (SELECT doc_id, item_id, start, len(h) AS n, inter / (len(h) + len(g) - inter) AS similarity FROM y)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start_word, CAST(n + 4 AS BIGINT) AS n_words, round(similarity, 6) AS similarity
FROM z WHERE similarity >= 0.75 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
