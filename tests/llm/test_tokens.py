"""Byte-level BPE against the tiktoken library, and token counts from flat files."""

import hashlib

import pytest
from pyspark.sql import functions as F

from attest.llm import bpe, catalog, tokens

TEXTS = ["", None, "Hello world", "  two  spaces \n\n\ttabs", "naïve Ünïcode 日本語 🙂 <|endoftext|>", "x" * 3000, "1234567890 it's we'll 'tis", "\x00\x1f a b", "ab" * 1000 + " " * 500]


@pytest.fixture(scope="module")
def library():
    import tiktoken
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.RANKS), special_tokens={})


def test_ids_equal_the_library_and_decode(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    out = spark.createDataFrame(rows, "doc_id long, text string, ids string").select("doc_id", "text", bpe.ids(F.col("text")).alias("got"))
    for r in out.select("*", bpe.decoded(F.col("got")).alias("back")).collect():
        assert r.got == library.encode_ordinary(r.text or ""), r.text
        assert bytes(r.back) == (r.text or "").encode()


def test_query_on_whole_documents(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = catalog.QUERIES["op10_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    counts = {r.doc_id: r.n_tokens for r in catalog.QUERIES["op8_token_counts"](spark, sf).collect()}
    assert counts == {i: len(library.encode_ordinary(t)) for i, t in texts.items()}


def test_counts_across_small_blocks_and_files(spark, library, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(3, "again"), (None, "no id")], "doc_id long, text string").coalesce(1)
    folder = str(tmp_path / "tokens")
    index = docs.sparkSession.createDataFrame(tokens.written(docs, folder, limit=400).collect(), "doc_id long, file string, ordinal long, file_bytes long")
    files = index.groupBy("file").agg(F.max("file_bytes").alias("file_bytes"))
    assert files.count() > 1
    for block in (2, 6, 1 << 20):
        got = index.join(tokens.counts(tokens.separators(files, folder, block=block)), ["file", "ordinal"]).select("doc_id", "n_tokens").collect()
        want = sorted((str(i), len(library.encode_ordinary(t or ""))) for i, t in [*enumerate(TEXTS), (3, "again"), (None, "no id")])
        assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, file string")
    assert tokens.token_counts(empty).collect() == []
    assert empty.select(bpe.ids(F.col("text"))).collect() == []
