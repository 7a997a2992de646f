"""Cross-tokenizer alignment against whole-text encoding and nested loops."""

import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attest.llm import alignment as al, sparse
from attest.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows):
    """The contract, text by text: whole texts encoded, cuts from sets of ends, links pair by pair."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    a_side = Tokenizer.from_file(al.BYTE_LEVEL)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=al.PIECES)
    letters = al.byte_letters()
    names = {i: n for n, i in a_side.get_vocab(with_added_tokens=False).items()}
    found, held = [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            a = [(i, bytes(letters[c] for c in names[i])) for i in a_side.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode())
                 for i, p in ((i, b_side.id_to_piece(i)) for i in b_side.encode(text))]
            data = (" " + text).encode()
            if b"".join(x for _, x in a) == data and b"".join(x for _, x in b) == data:
                ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
                cuts = sorted(ends[0] & ends[1])
                sides = []
                for side in (a, b):
                    place, at, out = 0, 0, defaultdict(list)
                    for i, x in side:
                        place += len(x)
                        while cuts[at] < place:
                            at += 1
                        out[at].append(i)
                    sides.append(out)
                groups = [(sides[0][g], sides[1][g]) for g in range(len(cuts))]
        links = Counter((i, j) for x, y in groups for i in x for j in y)
        held.update(links.keys())
        found.append((doc_id, groups, links))
    best = Counter()
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return Counter(
        (doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()),
         sum(n for p, n in links.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in links.items()),
         hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else "")
        for doc_id, groups, links in found)


TEXTS = ["", None, " ", "  ", "a", " a ", "the cat", "the cat", "the  cat\n sat\n\n on\t the mat ", "don't <|endoftext|> </s><s> [INST]", "x▁y z", "naïve café — 日本語 テキスト 🙂👍🏽",
         "\x00 \x01\x7f \x85 \xa0 b　 c﻿ d", "1234567 3.14 aaaaaaaaaaaaaaaaaaaa " * 3, "ﬁ ﬂ Å̊ \r\n\r\n x", "��   y", "foo" + " " * 50 + "bar" + " " * 7, "= " * 40, "᠎ q", "a​ b⁠ c"]


def columns(df):
    return Counter(tuple(r) for r in df.select("doc_id", *al.COUNTS, "n_best", "count_sum", "groups_sha256").collect())


def test_texts_of_all_kinds(spark):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(TEXTS)] + [(1, "the cat")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pairs", F.lit(1)).withColumn("row", F.lit("x")).withColumn("n", F.lit(2)).repartition(3)
    assert columns(al.summaries(docs)) == brute(rows)


@pytest.mark.parametrize("hot", [0, 500, al.HOT_PAIRS])
def test_any_share_of_hot_pairs(spark, hot):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert columns(al.summaries(spark.createDataFrame(rows, "doc_id long, text string"), hot_pairs=hot)) == brute(rows)


def test_query_over_all_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert columns(QUERIES["op11_alignment"](spark, SF)) == brute(rows)


def test_long_texts(spark):
    rows = [(1, "abc" * 400_000), (2, "word after word, " * 300_000), (3, "é" * 200_000)]
    found = {r["doc_id"]: r for r in al.summaries(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[2]["n_a"] > 10**6 and found[2]["n_groups"] > 10**6
    assert all(r["n_links"] >= max(r["n_a"], r["n_b"]) for r in found.values())


def test_empty_table(spark):
    assert al.summaries(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_links_and_groups_of_a_text(spark):
    row = al.aligned(spark.createDataFrame([(7, "unbelievable 12345 ✓")], "doc_id long, text string")).first()
    pair = al.pair_of(al.BYTE_LEVEL, al.PIECES)
    data = " unbelievable 12345 ✓".encode()
    spans = []
    for ids, spelt in ((row["a"], pair.bytes_a), (row["b"], pair.bytes_b)):
        assert b"".join(spelt[i] for i in ids) == data
        ends = np.cumsum([len(spelt[i]) for i in ids]).tolist()
        spans.append(list(zip([0, *ends], ends)))
    shared = {(i, j): min(x[1], y[1]) - max(x[0], y[0]) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if min(x[1], y[1]) > max(x[0], y[0])}
    assert {(x["a"], x["b"]): x["bytes"] for x in row["overlaps"]} == shared
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    assert row["a_group"] == [sum(c < e for c in cuts) for _, e in spans[0]]
    assert row["b_group"] == [sum(c < e for c in cuts) for _, e in spans[1]]


def test_product_by_rows_in_any_blocks():
    draw = np.random.default_rng(3)
    x, y = draw.integers(0, 3, (40, 30)), draw.integers(0, 3, (30, 50))
    def rows(m):
        r, c = np.nonzero(m)
        return sparse.Rows(sparse.bounds((m != 0).sum(1)), c, m[r, c])
    for partials in (1, 100, 1 << 20):
        out = np.zeros((40, 50), np.int64)
        for first, block in sparse.products(rows(x), rows(y), 50, partials):
            out[first + block.row_of_entries(), block.columns] = block.values
        assert (out == x @ y).all()
