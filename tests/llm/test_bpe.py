import hashlib
import struct

import pytest

tokenizers = pytest.importorskip("tokenizers")
from soundframe.llm import bpe  # noqa: E402

TEXTS = [
    None, "", "Hello, World's 123 cats' can't", "<|startoftext|>Hi<|endoftext|> <|end", "ΣΑΣ İstanbul ŒUVRE ǅ ﬁ", "é café  x y\x1cz\x85w", "日本語 текст 😀😀 ½²", "a" * 3000,
    "ab" * 20_000, "\x00\x01 tab\tnew\nline", "don'T WE'LL i'd", "ﷺ ㎏ Å", "word " * 500,
]


def test_same_as_library(spark, docs_of):
    want = tokenizers.Tokenizer.from_file(bpe.vocabulary())
    out = {r.doc_id: r for r in bpe.encode(docs_of(TEXTS, ", ids string", ("x",)), bpe.vocabulary(), decoded=True).collect()}
    for i, t in enumerate(TEXTS):
        ids = want.encode(t or "", add_special_tokens=False).ids
        assert bytes(out[i].ids) == struct.pack(f"<{len(ids)}I", *ids), t[:40]
        assert out[i].decoded == want.decode(ids, skip_special_tokens=False)


def test_whole_table(spark, sf):
    want = tokenizers.Tokenizer.from_file(bpe.vocabulary())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = bpe.query_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = want.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(want.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_both_merges_agree():
    b = bpe.tokenizer(bpe.vocabulary())
    for w in ("internationalisation", "aaaaaaaaaaaaa", "abababababab", "x", "mississippi" * 20):
        ids = [*(b.inner[c] for c in w.encode()[:-1]), b.final[w.encode()[-1]]]
        assert b.merge(list(ids)) == b.merge_long(list(ids))


def test_decode_and_empty(spark, docs_of):
    docs = docs_of(["one two", None])
    encoded = bpe.encode(docs, bpe.vocabulary())
    assert [r.decoded for r in bpe.decode(encoded, bpe.vocabulary()).orderBy("doc_id").collect()] == ["one</w> two</w>", ""]
    assert bpe.encode(docs.limit(0), bpe.vocabulary()).count() == 0


def test_null_ids_and_repeated_rows(spark, docs_of):
    docs = docs_of(["one two", "three"])
    docs = docs.unionByName(docs).unionByName(docs.selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars"))
    rows = bpe.encode(docs, bpe.vocabulary()).collect()
    assert len(rows) == 6 and len({bytes(r.ids) for r in rows}) == 2 and sum(r.doc_id is None for r in rows) == 2
