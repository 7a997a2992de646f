"""Indexes on disk: cells of vectors and impact-ordered postings, against exhaustive search."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from attest import fixtures as fx
from attest.catalog import queries
from attest.functions import vectors as vx
from attest.operators import cells as cs, impacts as im, lexical as lx, retrieval as rt

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "rnk", "doc_id", "score").collect())


def embeddings(spark, sf=SF):
    return fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


def centroid_queries(docs):
    return vx.centroids(docs, "label", "vector").select(F.col("label").alias("query_id"), F.col("centroid").alias("vector"))


@pytest.fixture(scope="module")
def clustered(spark):
    """20,000 vectors around 50 directions, a third of them around one."""
    draw = np.random.default_rng(11)
    directions = draw.normal(size=(50, 16))
    of = np.where(draw.random(20_000) < 1 / 3, 0, draw.integers(0, 50, 20_000))
    made = directions[of] + 0.15 * draw.normal(size=(20_000, 16))
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(made)]
    rows += [(20_000, None), (20_001, []), (20_002, [0.0] * 16), *[(20_003 + i, rows[7][1]) for i in range(20)]]
    return spark.createDataFrame(rows, "doc_id long, vector array<double>").repartition(8).cache()


def test_only_probed_cells_are_read(spark, clustered, tmp_path):
    cs.write_cells(clustered, str(tmp_path), 40, file_rows=1000)
    index = cs.open_cells(spark, str(tmp_path))
    assert index.rows.count() == clustered.count() and index.n_rows.sum() == clustered.count()
    asked = clustered.filter("doc_id % 400 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    exact = rows_of(rt.dense_search(clustered, asked, 10))
    few = cs.search(index, asked.filter("query_id = 400"), 10, 2)
    plan = few._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell_id" in plan or "PartitionFilters: [cell_id" in plan
    names = {f.rpartition("cell_id=")[2].split("/")[0] for f in cs.probed(index, cs.probes(index, asked.filter("query_id = 400"), 2), 10).inputFiles()}
    assert names <= {f.rpartition("cell_id=")[2].split("/")[0] for f in index.rows.inputFiles()}
    hits, read = cs.exact_search(index, asked, 10, 2)
    assert rows_of(hits) == exact
    sizes = dict(zip(index.cells.tolist(), index.n_rows.tolist()))
    share = sum(sizes[r.cell_id] for r in read.collect()) / (asked.count() * clustered.count())
    assert share < 0.5
    n_probe = cs.calibrated(index, clustered.filter("doc_id % 400 = 7").select(F.col("doc_id").alias("query_id"), "vector"), 10)
    kept = {(r[0], r[2]) for r in rows_of(cs.search(index, asked, 10, n_probe))} & {(r[0], r[2]) for r in exact}
    assert len(kept) / len(exact) >= 0.9 and n_probe < 20


def test_many_queries_meet_shards(spark, clustered, tmp_path, monkeypatch):
    cs.write_cells(clustered, str(tmp_path), 20)
    index = cs.open_cells(spark, str(tmp_path))
    asked = clustered.filter("doc_id % 1000 = 0 or doc_id >= 20000").select(F.col("doc_id").alias("query_id"), "vector")
    want = rows_of(cs.search(index, asked, 5, 6))
    monkeypatch.setattr(cs, "BROADCAST_QUERIES", 1)
    monkeypatch.setattr(cs, "FILE_ROWS", 900)
    assert rows_of(cs.search(index, asked, 5, 6)) == want
    assert rows_of(cs.exact_search(index, asked, 5, 3)[0]) == rows_of(rt.dense_search(clustered, asked, 5))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_registered_query(spark, sf):
    rows = queries()["ret_03"](spark, f"/root/testdata/{sf}").collect()
    assert rows and np.mean([r.recall for r in rows]) >= 0.9


def test_ids_of_other_kinds_and_odd_vectors(spark, tmp_path):
    """Text and short whole-number ids, float vectors, nulls among full rows, no queries; the same rows by one scan and exhaustively."""
    docs = spark.createDataFrame([(f"d{i}", None if i % 7 == 0 else [] if i % 11 == 0 else [float(i % 5), float(i % 3) - 1, 1.0]) for i in range(200)], "doc_id string, vector array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.5]), (2, None), (3, [0.0, 1.0, 1.0])], "query_id int, vector array<double>")
    cs.write_cells(docs, str(tmp_path), 5)
    index = cs.open_cells(spark, str(tmp_path))
    got = cs.search(index, asked, 4, len(index.cells))
    assert rows_of(got) == rows_of(rt.dense_search(docs, asked, 4)) and dict(got.dtypes)["query_id"] == "int"
    assert cs.search(index, asked.limit(0), 4, 2).collect() == []


def test_small_and_empty_indexes(spark, tmp_path):
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "doc_id long, vector array<double>")
    asked = spark.createDataFrame([(9, [0.5, 0.5]), (8, None)], "query_id long, vector array<double>")
    for name, docs in (("one", one), ("zero", one.filter("doc_id = 2")), ("none", one.filter("false"))):
        cs.write_cells(docs, f"{tmp_path}/{name}", 3)
        index = cs.open_cells(spark, f"{tmp_path}/{name}")
        if name == "none":
            assert len(index.cells) == 0
            continue
        assert rows_of(cs.exact_search(index, asked, 2)[0]) == rows_of(rt.dense_search(docs, asked, 2))


def test_standing_index_reads_few_rows(spark, tmp_path):
    """200,000 vectors in 200 clusters; the index stands, as it does for every query after the first. Times are printed."""
    draw = np.random.default_rng(2)
    directions = draw.normal(size=(200, 32))
    centre = F.array(*[F.array(*[F.lit(float(x)) for x in d]) for d in directions[:, :32]])
    docs = spark.range(200_000, numPartitions=8).select(F.col("id").alias("doc_id"), F.transform(
        F.get(centre, F.pmod(F.xxhash64("id"), F.lit(200)).cast("int")),
        lambda x, i: x + 0.1 * (F.pmod(F.xxhash64("id", i), F.lit(2001)) / 1000.0 - 1)).alias("vector"))
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    cs.write_cells(docs, f"{tmp_path}/index", 200)
    index = cs.open_cells(spark, f"{tmp_path}/index")
    asked = docs.filter("doc_id % 20000 = 3").select(F.col("doc_id").alias("query_id"), "vector")
    rt.dense_search(docs.limit(100), asked, 10).count()
    start = time.time()
    exact = rows_of(rt.dense_search(docs, asked, 10))
    middle = time.time()
    found = rows_of(cs.search(index, asked, 10, 4))
    end = time.time()
    kept = {(r[0], r[2]) for r in found} & {(r[0], r[2]) for r in exact}
    assert len(kept) / len(exact) >= 0.9
    print(f"exhaustive {middle - start:.2f} s, cells {end - middle:.2f} s")
    sizes = dict(zip(index.cells.tolist(), index.n_rows.tolist()))
    read = {r.cell_id for r in cs.probes(index, asked, 4).select("cell_id").distinct().collect()}
    assert sum(sizes[c] for c in read) < 0.25 * 200_000


def lexical(spark, sf=SF):
    return fx.table(spark, sf, "documents").select("doc_id", "text"), fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@pytest.mark.parametrize("block", [5, im.BLOCK_POSTINGS])
def test_impacts_equal_exhaustive_scores(spark, tmp_path, block):
    docs, asked = lexical(spark)
    docs = docs.unionByName(spark.createDataFrame([(-5, None), (-4, ""), (-3, "zzz unseen")], docs.schema))
    asked = asked.unionByName(spark.createDataFrame([(1001, "zzz"), (1002, "nothing known here qqq"), (1003, None), (1004, "zzz unseen words")], asked.schema))
    im.write_impacts(docs, str(tmp_path), block)
    index = im.open_impacts(spark, str(tmp_path))
    hits, read = im.search(index, asked, 10)
    assert rows_of(hits) == rows_of(lx.search(docs, asked, 10))
    shares = read.agg(F.sum("n_read"), F.sum("n_postings")).first()
    assert 0 < shares[0] < shares[1]


def test_impacts_skip_most_postings(spark, tmp_path):
    """Common words in all texts, a rare one in a few: the common ones' low bands are left out."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(
        " ", F.array_repeat(F.lit("common"), 3), F.concat(F.lit("w"), (F.col("id") % 700).cast("string")), F.when(F.col("id") % 100 == 0, "rare rare"),
        F.array_join(F.transform(F.sequence(F.lit(1), (F.col("id") % 40).cast("int") + 1), lambda i: F.concat(F.lit("x"), F.pmod(F.xxhash64("id", i), F.lit(50)).cast("string"))), " ")).alias("text"))
    asked = spark.createDataFrame([(1, "rare common"), (2, "w5 common"), (3, "common x1 x2 rare")], "query_id long, text string")
    im.write_impacts(docs, str(tmp_path), 100)
    hits, read = im.search(im.open_impacts(spark, str(tmp_path)), asked, 5)
    assert rows_of(hits) == rows_of(lx.search(docs, asked, 5))
    first = {r.query_id: r for r in read.collect()}
    assert first[1].n_read < 0.5 * first[1].n_postings
