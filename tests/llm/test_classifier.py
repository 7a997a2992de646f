"""The quality classifier: held-out accuracy, what it may read, and its edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attest.llm import classifier as cl
from attest.llm.catalog import QUERIES


def area(labels, scores):
    """Share of (1, 0) pairs in order, ties half."""
    good, bad = (np.array([s for l, s in zip(labels, scores) if l == k]) for k in (1, 0))
    return float(np.mean((good[:, None] > bad[None]) + 0.5 * (good[:, None] == bad[None])))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_held_out_documents(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = QUERIES["op13_quality_classifier"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    pairs = [(quality[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in quality]
    assert area(*zip(*pairs)) >= 0.98
    assert np.mean([(s >= 0.5) == (q == 1) for q, s in pairs]) >= 0.95


def test_held_out_labels_and_other_columns_change_nothing(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    want = {r.doc_id: r.score for r in cl.judged(docs, labels).collect()}
    turned = labels.withColumn("quality", F.when(cl.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)).withColumn("score", F.lit(3)).withColumn("quality", F.lit("q")).withColumn("label", F.lit(1)).repartition(5)
    assert {r.doc_id: r.score for r in cl.judged(other, turned.withColumn("place", F.lit(1)).repartition(4)).collect()} == want


def test_edge_cases(spark):
    junk, fine = "x### y$$$ z&&&", "plain words in a row."
    docs = spark.createDataFrame(
        [(None, fine), (0, None), (0, ""), (2, "w" * 2_000_000), (3, "word " * 500_000), *[(i, (fine, junk)[i % 2] * (i % 7 + 1)) for i in range(4, 60)], (5, junk)], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (0, None), (6, 7), *[(i, 1 - i % 2) for i in range(4, 60)], (9, 0), (9, 1)], "doc_id long, quality int")
    rows = cl.judged(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert all(r.predicted == 1 - r.doc_id % 2 for r in rows if r.doc_id and r.doc_id > 3)
    none = cl.judged(docs, labels.filter("false")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    assert len(cl.judged(docs, labels.filter("quality = 1")).collect()) == docs.count()
    assert cl.judged(docs.filter("false"), labels).collect() == []


def test_sample_is_bounded_and_weighed(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)] + [(1, "another text")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(400)], "doc_id long, quality int")
    rows = cl.lessons(docs, labels, sample=20).collect()
    by_label = {k: [r for r in rows if r.label == k] for k in (0, 1)}
    assert all(len(x) == 20 for x in by_label.values())
    learnt = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    share = sum(i % 10 > 0 for i in learnt) / len(learnt)
    assert abs(sum(r.weight for r in by_label[1]) / 40 - share) < 1e-9


def test_vectors_are_counts_of_hashed_n_grams():
    starts, buckets, values = cl.vectors(["a b a b", "", "a a"])
    assert np.diff(starts).tolist()[1] == 1 and buckets[starts[1]] == 1 << cl.BITS
    for i in (0, 2):
        inside = slice(starts[i], starts[i + 1] - 1)
        assert abs((values[inside] ** 2).sum() - 1) < 1e-12 and len(set(buckets[inside].tolist())) == starts[i + 1] - 1 - starts[i]
    alone = cl.vectors(["a b a b"])
    assert (alone[1] == buckets[: starts[1]]).all() and (alone[2] == values[: starts[1]]).all()
    assert cl.shape("Abc12&&x") == "Aa9&&a"
