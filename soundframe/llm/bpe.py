"""Byte-pair encoding and decoding with the vocabulary file of a public tokenizer (word ends marked, lower case).

A word's parts stand in one contiguous array of ids beside a second one with the rank of each adjacent pair. The smallest
rank is found by scanning, its boundary is deleted, and only the two neighbouring ranks are looked up anew. Words longer than
SHORT parts take a heap over the same ranks (scanning would be quadratic); both give the leftmost smallest rank each time.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundframe.llm.common import pieces, text_buffer

SHORT = 400
NONE = 1 << 30
#: Words kept by a worker before its memory of words starts anew.
REMEMBERED = 400_000


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte: itself where printable in Latin-1, else the next free one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


class Bpe(dict):
    """word -> packed little-endian ids, filled when a word is first asked for."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, kinds = spec["model"], {x["type"] for x in spec["normalizer"]["normalizers"]}
        if model["type"] != "BPE" or kinds != {"NFC", "Replace", "Lowercase"} or spec["decoder"] or spec["post_processor"] or model["unk_token"] or model["ignore_merges"]:
            raise ValueError(f"{path}: another kind of tokenizer")
        self.suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        letters = byte_letters()
        self.inner = [vocab.get(c) for c in letters]
        self.final = [vocab.get(c + self.suffix) for c in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {v: k for k, v in vocab.items()} | {v: k for k, v in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        ids = [i for i in [*(self.inner[b] for b in raw[:-1]), self.final[raw[-1]]] if i is not None]
        ids = self.merge(ids) if len(ids) <= SHORT else self.merge_long(ids)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = packed
        return packed

    def merge(self, ids: list[int]) -> list[int]:
        get, none = self.merges.get, (NONE, -1)
        ranks = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best is none or best[0] == NONE:
                break
            at = ranks.index(best)
            ids[at : at + 2] = [best[1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get((ids[at - 1], ids[at]), none)
            if at < len(ranks):
                ranks[at] = get((ids[at], ids[at + 1]), none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        get, n = self.merges.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
        return [i for i in ids if i >= 0]

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if not text.isascii():
            # each letter is lower-cased by itself: a final capital sigma has no form of its own
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.words(text.lower())

    def parts(self, text: str) -> list[str]:
        """The text cut at special tokens, which are parts of their own."""
        return [text] if self.cut is None or "<|" not in text else self.cut(text)

    def encode(self, text: str) -> bytes:
        return b"".join([struct.pack("<I", self.special[x]) if x in self.special else b"".join([self[w] for w in self.split(x)]) for x in self.parts(text)])

    def decode(self, packed: bytes) -> str:
        names = self.names
        return " ".join([names[i] for i in np.frombuffer(packed, "<u4").tolist()])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Bpe:
    """One per worker process, which keeps its words over tasks."""
    return Bpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit) of every row; with decoded also the text that decoding them gives.

    Null and empty texts have no ids; null ids and repeated rows stay; texts and words may be of any length; other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for i, j in pieces(off):
                ids = [bpe.encode(data[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace")) for k in range(i, j)]
                columns = [batch.column(0).slice(i, j - i), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array(map(bpe.decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    kind = docs.select(F.col(id_col).alias("doc_id")).dtypes[0][1]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded of packed ids, the tokens joined by spaces; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = pa.array((bpe.decode(x or b"") for x in batch.column(1).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "decoded"])

    kind = encoded.select(F.col(id_col).alias("doc_id")).dtypes[0][1]
    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, decoded string")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def query_bpe(spark, sf_dir: str) -> DataFrame:
    from soundframe.llm.common import read

    return digests(encode(read(spark, sf_dir, "documents"), vocabulary(), decoded=True))
