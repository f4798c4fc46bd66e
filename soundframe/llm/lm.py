"""Language-model scoring: word counts of the whole training part, and a log-bilinear model trained by noise contrast.

* Counts: every task counts the words of its texts, Spark adds them up by word. Nothing holds the whole vocabulary: words
  with a count above a power of two, chosen so that at most FREQUENT qualify, go to every task (12 bytes each); all rarer
  words of a document are joined with the counts by word and summed back per document.
* Classes: the end mark, the TOP most frequent words, and SPELLED classes of all other words, seen or not, by their last two letters and
  whether a punctuation mark follows them. In those, a word has its add-one share of the class's count, so the counts reach every word.
* Model: a class's score is the product of its vector with the sum of the vectors that the ORDER classes before have at their
  places, plus a bias. Training texts become class sequences, which are dealt by a hash of id and text over shards of about SHARD
  tokens. In each round every shard goes through its sequences, in order of the hash, in minibatches of noise contrast (numpy,
  one matrix product a batch), from the parameters of the round before; Spark averages the shards' results by their tokens. Shards,
  order and noise follow from the rows alone, so the model is the same however the input lies.
* Scoring normalises exactly: matrix products give all classes' scores after each two classes, once per process, and the log of the
  sum of their exponentials, which a token then looks up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundframe.llm.common import mix, pieces, read, span_hashes, text_buffer, word_spans, written

FREQUENT = 500_000
TOP, SPELLED, SIZE, ORDER = 383, 256, 16, 2
NOISE, BATCH, RATE, SMALL = 64, 4096, 0.03, 1e-4
#: Tokens of a shard, and how many rounds go through all of them.
SHARD, ROUNDS = 1 << 20, 2
FOLDS, HELD = 7, 2
END = 0
LOG10 = float(np.log(10))
MARKS = np.zeros(256, bool)
MARKS[list(b".,;:!?|")] = True


def training(docs: DataFrame) -> DataFrame:
    """doc_id, text and fold: crc32 of the id as text modulo FOLDS (a null id counts as the empty text)."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), fold.cast("int").alias("fold"))


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, spelling classes from 0, word offsets) of the words of texts."""
    low, s, e, woff = word_spans(data, off)
    marked = MARKS[low[e - 1]] & (e - s > 1) if len(e) else np.zeros(0, bool)
    last = e - marked
    code = (low[last - 1].astype(np.uint64) << np.uint64(9)) | (marked.astype(np.uint64) << np.uint64(8)) if len(e) else np.zeros(0, np.uint64)
    two = np.where(last - s > 1, low[np.maximum(last - 2, 0)], 0).astype(np.uint64) if len(e) else code
    return span_hashes(low, s, e), (mix(code | two) % np.uint64(SPELLED)).astype(np.int32), woff


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, spelled, n): counts of the words' hashes with their spelling class, and of the end mark as word 0, over all rows of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffer(batch.column(0))
            for i, j in pieces(off, 1 << 23):
                parts = [words_of(data, off[i + a : i + b + 1])[:2] for a, b in pieces(off[i : j + 1])]
                words, at, n = np.unique(np.concatenate([w for w, _ in parts]), return_index=True, return_counts=True)
                spelled = np.concatenate([c for _, c in parts])[at]
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[words.view(np.int64), END]), pa.array(np.r_[spelled, np.int32(-1)].astype(np.int32)), pa.array(np.r_[n, j - i])], names=["word", "spelled", "n"])

    return docs.select("text").mapInArrow(run, "word long, spelled int, n long").groupBy("word").agg(F.max("spelled").alias("spelled"), F.sum("n").alias("n"))


class Model:
    """Classes: 0 end, then the most frequent words (their hashes, sorted), then the spelling classes."""

    def __init__(self, frequent: np.ndarray, share: np.ndarray, seed: int = 3):
        self.frequent, self.c, self.share = frequent, len(share), share / share.sum()
        rng = np.random.default_rng(seed)
        self.noise = np.log(self.share).astype(np.float32)
        self.context = rng.normal(0, 0.05, (ORDER, self.c, SIZE)).astype(np.float32)
        self.out = rng.normal(0, 0.05, (self.c, SIZE)).astype(np.float32)
        self.bias = self.noise.copy()
        self.sums: np.ndarray | None = None

    def flat(self) -> np.ndarray:
        return np.concatenate([self.context.ravel(), self.out.ravel(), self.bias]).astype(np.float64)

    def load(self, flat: np.ndarray) -> None:
        a, b, flat = self.context.size, self.context.size + self.out.size, flat.astype(np.float32)
        self.context, self.out, self.bias, self.sums = flat[:a].reshape(self.context.shape), flat[a:b].reshape(self.out.shape), flat[b:], None

    def learn(self, before: np.ndarray, target: np.ndarray, rng: np.random.Generator, seen: dict[str, np.ndarray]) -> None:
        """One minibatch of noise contrast with adaptive steps, in 32 bits; seen holds the sums of squared gradients."""
        n = rng.choice(self.c, NOISE, p=self.share)
        base, few = np.float32(np.log(NOISE)), np.float32(1 / len(target))
        r = self.context[0][before[:, 0]]
        for k in range(1, ORDER):
            r = r + self.context[k][before[:, k]]
        out, noise = self.out[target], self.out[n]
        good = 1 / (1 + np.exp(self.noise[target] + base - self.bias[target] - np.einsum("ij,ij->i", r, out)))
        bad = r @ noise.T
        bad += self.bias[n] - self.noise[n] - base
        np.negative(bad, out=bad)
        np.exp(bad, out=bad)
        bad += 1
        np.reciprocal(bad, out=bad)
        up = (1 - good) * few
        bad *= few
        to_r = up[:, None] * out - bad @ noise

        def total(index: np.ndarray, x: np.ndarray) -> np.ndarray:
            """Sums of the rows of x with equal index, by sorting: rows that belong together are added in one go."""
            order = np.argsort(index, kind="stable")
            at = index[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            sums = np.zeros((self.c, x.shape[1]), np.float32)
            sums[at[first]] = np.add.reduceat(x[order], first)
            return sums

        to_out = total(target, up[:, None] * r)
        np.add.at(to_out, n, -(bad.T @ r))
        to_bias = np.bincount(target, up, self.c).astype(np.float32)
        np.add.at(to_bias, n, -bad.sum(0))
        for k, p, g in (("out", self.out, to_out), ("bias", self.bias, to_bias), *((k, self.context[k], total(before[:, k], to_r)) for k in range(ORDER))):
            seen[k] = seen.get(k, np.float32(SMALL**2)) + g * g
            p += np.float32(RATE) * g / np.sqrt(seen[k])

    def log_sums(self) -> np.ndarray:
        """The logarithm of the sum of all classes' exponentials after each two classes, by matrix products over blocks of pairs."""
        if self.sums is None:
            out = np.ascontiguousarray(self.out.T)
            self.sums = np.empty((self.c, self.c), np.float32)
            for a in range(self.c):
                s = (self.context[0][a] + self.context[1]) @ out + self.bias
                top = s.max(1, keepdims=True)
                self.sums[a] = top[:, 0] + np.log(np.exp(s - top).sum(1))
        return self.sums

    def log_probs(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithms of the classes' probabilities after the classes before, normalised over all classes."""
        r = self.context[0][before[:, 0]] + self.context[1][before[:, 1]]
        own = np.einsum("ij,ij->i", r, self.out[target]) + self.bias[target]
        return own.astype(np.float64) - self.log_sums()[before[:, 0], before[:, 1]]


def classes(model: Model, words: np.ndarray, spelled: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each token, texts' token offsets); an end mark follows each text."""
    cls = spelled.astype(np.int64) + 1 + len(model.frequent)
    if len(model.frequent):
        at = np.minimum(np.searchsorted(model.frequent, words), len(model.frequent) - 1)
        cls = np.where(model.frequent[at] == words, at + 1, cls)
    texts = len(woff) - 1
    tokens = np.zeros(len(words) + texts, np.int64)
    tokens[np.arange(len(words)) + np.repeat(np.arange(texts), np.diff(woff))] = cls
    return tokens, woff + np.arange(texts + 1)


def contexts(tokens: np.ndarray, toff: np.ndarray) -> np.ndarray:
    """The ORDER classes before each token, nearest first; the end mark stands for what is before a text."""
    place = np.arange(len(tokens)) - np.repeat(toff[:-1], np.diff(toff))
    before = np.zeros((len(tokens), ORDER), np.int64)
    for k in range(ORDER):
        ok = place > k
        before[ok, k] = tokens[np.flatnonzero(ok) - k - 1]
    return before


def sequences(docs: DataFrame, model: Model, shards: int) -> DataFrame:
    """(shard, h, tokens): the class sequence of each row as 16-bit numbers; h orders a shard's rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffer(batch.column(2))
            for i, j in pieces(off):
                tokens, toff = classes(shared.value, *words_of(data, off[i : j + 1]))
                raw = tokens.astype(np.uint16).tobytes()
                rows = pa.array([raw[2 * a : 2 * b] for a, b in zip(toff[:-1].tolist(), toff[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), rows], names=["shard", "h", "tokens"])

    keyed = docs.withColumn("h", F.xxhash64("doc_id", "text")).select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "h", "text")
    return keyed.mapInArrow(run, "shard int, h long, tokens binary")


def train(rows: DataFrame, model: Model, round_no: int) -> None:
    """One round over sequences; model gets the averaged parameters."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # some 30,000 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        total, count, shard, m = None, 0, None, None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def learn(whole: bool) -> int:
            """Learns the full minibatches of what is held, at a shard's end the rest too."""
            before, target = (np.concatenate(x) for x in zip(*held, strict=True))
            end = len(target) if whole else len(target) // BATCH * BATCH
            for i in range(0, end, BATCH):
                m.learn(before[i : i + BATCH], target[i : i + BATCH], rng, seen)
            held[:] = [(before[end:], target[end:])]
            return end

        def close() -> None:
            nonlocal total, count
            n = done + learn(True)
            total = m.flat() * n if total is None else total + m.flat() * n
            count += n

        for batch in batches:
            ids = np.asarray(batch.column(0))
            for a in np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]).tolist() if len(ids) else []:
                if ids[a] != shard:
                    if shard is not None:
                        close()
                    shard, m, seen, done, held = int(ids[a]), copy.deepcopy(sent.value), {}, 0, []
                    rng = np.random.default_rng([5, round_no, shard])
                b = a + int(np.argmax(np.r_[ids[a:] != shard, True]))
                texts = [np.frombuffer(x, np.uint16) for x in batch.column(2).slice(a, b - a).to_pylist()]
                tokens = np.concatenate(texts).astype(np.int64)
                held.append((contexts(tokens, np.concatenate([[0], np.cumsum([len(t) for t in texts])])), tokens))
                if sum(len(t) for _, t in held) >= BATCH:
                    done += learn(False)
        if shard is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), float(count)))], names=["k", "x", "n"])

    ordered = rows.repartition("shard").sortWithinPartitions("shard", "h")
    found = ordered.mapInArrow(run, "k long, x double, n double").groupBy("k").agg((F.sum("x") / F.sum("n")).alias("x")).toArrow()  # the parameters
    if found.num_rows:
        model.load(found.sort_by("k")["x"].to_numpy().copy())


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of docs, learned from the rows not held out.

    Null and empty texts are one end mark. Rows that repeat id and text are scored alike, words that are equally frequent are ordered
    by their hashes; texts may be of any length; a null id counts as the empty text; other columns are ignored; an empty table gives
    an empty result. Without training rows every count is 0 and the model is what it began with.
    """
    docs = training(docs)
    learn = docs.where(F.col("fold") != HELD)
    counts = written(word_counts(learn), "counts")
    level = F.floor(F.log2("n")).cast("int")
    levels = {r.level: (r.words, r.tokens) for r in counts.where(F.col("word") != END).groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()}  # 64 rows at most
    ends = counts.where(F.col("word") == END).agg(F.max("n")).first()[0] or 0
    total = sum(t for _, t in levels.values()) + ends
    distinct = sum(w for w, _ in levels.values()) + (ends > 0)
    bound, many = 64, 0
    while bound > 0 and many + levels.get(bound - 1, (0, 0))[0] <= FREQUENT:
        bound -= 1
        many += levels.get(bound, (0, 0))[0]
    head = counts.where((F.col("word") != END) & (F.col("n") >= F.lit(1 << min(bound, 62)))).toArrow()  # FREQUENT rows of three numbers at most
    word, n, spelled = head["word"].to_numpy().astype(np.int64).view(np.uint64), head["n"].to_numpy().astype(np.int64), head["spelled"].to_numpy()
    top = np.lexsort((word, -n))[:TOP]
    top = top[np.argsort(word[top])]
    tokens, kinds = np.zeros(SPELLED, np.int64), np.zeros(SPELLED, np.int64)
    for r in counts.where(F.col("word") != END).groupBy("spelled").agg(F.sum("n").alias("tokens"), F.count("*").alias("kinds")).collect():  # SPELLED rows at most
        tokens[r.spelled], kinds[r.spelled] = r.tokens, r.kinds
    np.subtract.at(tokens, spelled[top], n[top])
    np.subtract.at(kinds, spelled[top], 1)
    share = np.r_[ends, n[top], tokens].astype(float) + 1
    model = Model(word[top], share / share.sum())
    rows = written(sequences(learn, model, max(1, round(total / SHARD))), "sequences")
    for k in range(ROUNDS):
        train(rows, model, k)
    order = np.argsort(word)
    shared = docs.sparkSession.sparkContext.broadcast((word[order], n[order], model, np.log10(tokens + kinds + 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, n, model, size = shared.value
        log = np.log10(n + 1.0)
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for i, j in pieces(off):
                words, spelled, woff = words_of(data, off[i : j + 1])
                target, toff = classes(model, words, spelled, woff)
                row = np.repeat(np.arange(j - i), np.diff(woff))
                at = np.minimum(np.searchsorted(word, words), max(len(word) - 1, 0))
                known = word[at] == words if len(word) else np.zeros(len(words), bool)
                add = np.where(known, log[at], 0.0) if len(word) else np.zeros(len(words))
                rare = target[np.arange(len(words)) + row] > len(model.frequent)
                lm = np.bincount(np.repeat(np.arange(j - i), np.diff(toff)), model.log_probs(contexts(target, toff), target), j - i) / LOG10
                tail = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(row[~known], minlength=j - i))].astype(np.int32)), pa.array(words[~known].view(np.int64)))
                total = lambda x, row=row, rows=j - i: np.bincount(row, x, rows).astype(float)
                model_part = lm + total(rare * (add - size[spelled]))
                columns = [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), batch.column(3).slice(i, j - i), pa.array(np.diff(woff) + 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total(known)), pa.array(total(add)), pa.array(model_part), tail], names=["doc_id", "fold", "k", "n_tokens", "known", "logs", "lm", "tail"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.withColumn("k", F.xxhash64("text")).select("doc_id", "text", "fold", "k").mapInArrow(run, f"doc_id {kind}, fold int, k long, n_tokens long, known double, logs double, lm double, tail array<long>")
    scored = written(scored, "scored")
    tail = scored.dropDuplicates(["doc_id", "k"]).select("doc_id", "k", F.explode("tail").alias("word"))
    few = counts.where((F.col("word") != END) & (F.col("n") < F.lit(1 << min(bound, 62))))
    sums = tail.join(few, "word").groupBy("doc_id", "k").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count("*").alias("found"))
    s, t = scored.drop("tail").alias("s"), sums.alias("t")
    j = s.join(t, F.col("s.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("s.k") == F.col("t.k")), "left")
    more = F.coalesce("more", F.lit(0.0))
    end_log = float(np.log10(ends + 1.0))
    base = F.col("logs") + more + end_log - F.col("n_tokens") * float(np.log10(total + distinct + 1.0))
    return j.select(
        "s.doc_id", (F.col("fold") == HELD).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("lm") + more).alias("score"),
    )


def query_lm(spark, sf_dir: str) -> DataFrame:
    return scores(read(spark, sf_dir, "documents"))
