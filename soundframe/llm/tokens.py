"""Token counts without encoding most words.

A vocabulary string is proven whole if merging its own bytes, as a word, ends in the one token that it names. Merging depends on the
word alone, so wherever such a string stands as a word it is one token and need not be merged. The proof runs once, over the
vocabulary and before any text is read; its result (at most as many strings as the vocabulary has) is broadcast. Words of a text
that are among them count one each, and only the rest are merged (`bpe`).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundframe.llm.bpe import Bpe, byte_letters, tokenizer, vocabulary
from soundframe.llm.common import pieces, read, text_buffer


@lru_cache(maxsize=2)
def proven(path: str) -> frozenset[str]:
    """The strings of the vocabulary that encode, as words, to one token each."""
    bpe, byte = tokenizer(path), {c: b for b, c in enumerate(byte_letters())}
    out = set()
    for token, name in enumerate(bpe.names):
        letters = name.removesuffix(bpe.suffix)
        if not letters or not name.endswith(bpe.suffix) or not all(c in byte for c in letters):
            continue
        raw = bytes(byte[c] for c in letters)
        ids = [*(bpe.inner[b] for b in raw[:-1]), bpe.final[raw[-1]]]
        if None not in ids and bpe.merge(ids) == [token]:
            try:
                out.add(raw.decode())
            except UnicodeDecodeError:  # part of a letter, never a word
                continue
    return frozenset(out)


def count(bpe: Bpe, whole: frozenset[str], text: str) -> tuple[int, int]:
    """(tokens of text, words among them that counted as whole)."""
    tokens = words = 0
    for part in bpe.parts(text):
        if part in bpe.special:
            tokens += 1
            continue
        found = bpe.split(part)
        rest = [w for w in found if w not in whole]
        words += len(found) - len(rest)
        tokens += sum([len(bpe[w]) for w in rest]) // 4
    return tokens + words, words


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_whole (words that the shortcut counted) and over_limit (n_tokens > limit) of every row.

    Null and empty texts have no tokens; null ids and repeated rows stay, each counted by itself; texts and words may be of any
    length; other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    whole = docs.sparkSession.sparkContext.broadcast(proven(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = tokenizer(path), whole.value
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for i, j in pieces(off):
                n = [count(bpe, known, data[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace")) for k in range(i, j)]
                sizes = pa.array(off[i + 1 : j + 1] - off[i:j])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), sizes, pa.array([x for x, _ in n], pa.int64()), pa.array([x for _, x in n], pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "n_whole"])

    kind = docs.select(F.col(id_col).alias("doc_id")).dtypes[0][1]
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, n_whole long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query_tokens(spark, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), vocabulary())
