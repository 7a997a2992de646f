"""A lexical index of impact-ordered postings, and exact top-k search that skips the blocks that cannot matter.

A term's postings are cut by weight into bands of a quarter of an octave, and a band into blocks of a bounded number of
postings, so the index is built by one aggregation and no task sorts or holds the postings of a hot term. A small
directory keeps, per term and band, the number of postings and the highest weight.

A search asks the directory first and reads postings twice:

1. Per query term the highest bands, until some multiple of k postings is seen. The k-th partial sum is a score that k
   documents reach.
2. All bands that a document could need beyond that: contributions under a level are left out such that those of all terms
   together stay below the k-th partial sum, so a document seen nowhere can't be a hit. The level is filled up: terms
   that never reach it leave their room to the others.

Documents whose partial sum and whatever they may have in the bands left out reach the new k-th partial sum are then scored
in full from their vectors. The result equals that of ``lexical.search``; ties, and documents that share no term, go
in document order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import materialised
from . import lexical
from .topk import top_k

BANDS_PER_OCTAVE = 4
BLOCK_POSTINGS = 4096
# Postings per query term, in multiples of k, that the first reading asks for.
FIRST = 4
SLACK = 1e-9
BROADCAST_BANDS = 500_000
HIT = ["query_id", "rnk", "doc_id", "score"]


@dataclass
class ImpactIndex:
    blocks: DataFrame
    directory: DataFrame
    vectors: DataFrame
    frequency: DataFrame
    n_docs: int


def band(weight: Column) -> Column:
    """0 for the highest weights; a unit vector has none above 1."""
    return F.floor(-F.log2(weight) * BANDS_PER_OCTAVE).cast("int")


def write_impacts(docs: DataFrame, path: str, block: int = BLOCK_POSTINGS) -> None:
    """Writes the index of ``docs`` (doc_id, text) below ``path``; the number of documents is written last."""
    spark, n_docs = docs.sparkSession, docs.count()
    lexical.document_frequency(docs).write.parquet(f"{path}/frequency")
    frequency = spark.read.parquet(f"{path}/frequency")
    lexical.packed_vectors(docs, frequency, n_docs, "doc_id", F.lit(True)).write.parquet(f"{path}/vectors")
    postings = spark.read.parquet(f"{path}/vectors").select("doc_id", F.explode(F.arrays_zip("terms", "weights")).alias("x")).select(
        "doc_id", F.col("x.terms").alias("term"), F.col("x.weights").alias("weight"))
    # The hash of a posting picks its block, from as many as the term's frequency needs; terms of more than one block have
    # more than ``block`` postings each, so there are few of them.
    large = frequency.filter(F.col("df") > block).select("term", F.ceil(F.col("df") / block).alias("n_blocks"))
    sized = postings.join(F.broadcast(large), "term", "left")
    number = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("n_blocks")), F.lit(0).cast("bigint"))
    blocks = sized.groupBy("term", band(F.col("weight")).alias("band"), number.alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.max("weight").alias("bound"), F.collect_list(F.struct("doc_id", "weight")).alias("postings"))
    blocks.sortWithinPartitions("term", "band").write.parquet(f"{path}/blocks")
    spark.read.parquet(f"{path}/blocks").groupBy("term", "band").agg(F.sum("n").alias("n"), F.max("bound").alias("bound")).sortWithinPartitions(
        "term").write.parquet(f"{path}/directory")
    spark.range(1).select(F.lit(n_docs).alias("n_docs")).write.parquet(f"{path}/size")


def open_impacts(spark: SparkSession, path: str) -> ImpactIndex:
    read = spark.read.parquet
    n_docs = read(f"{path}/size").first()[0]
    return ImpactIndex(*[read(f"{path}/{t}") for t in ("blocks", "directory", "vectors", "frequency")], n_docs)


def asked_terms(index: ImpactIndex, queries: DataFrame) -> DataFrame:
    """(query_id, term, asked): the weights of the queries' known terms."""
    packed = lexical.packed_vectors(queries, index.frequency, index.n_docs, "query_id", F.col("df").isNotNull())
    return packed.select("query_id", F.explode(F.arrays_zip("terms", "weights")).alias("x")).select(
        "query_id", F.col("x.terms").alias("term"), F.col("x.weights").alias("asked"))


def asked_bands(index: ImpactIndex, terms: DataFrame) -> DataFrame:
    """(query_id, term, asked, band, n, most, seen_before): the bands of the queries' terms, with the most a posting of a band can
    add to the query's score and the number of postings in the term's higher bands. A query has at most its terms times the bands."""
    higher = W.partitionBy("query_id", "term").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    return terms.join(index.directory, "term").select(
        "query_id", "term", "asked", "band", "n", (F.col("asked") * F.col("bound")).alias("most"),
        F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("seen_before"))


def partial_sums(index: ImpactIndex, bands: DataFrame, few: bool) -> DataFrame:
    """(query_id, doc_id, partial, open_there) from the postings of the bands asked for; ``bands`` carries ``left``, the most that the
    bands left out of the same term can add. Postings are added up where they are read before they are shuffled."""
    wanted = bands.select("query_id", "term", "band", "asked", "left")
    met = index.blocks.join(F.broadcast(wanted) if few else wanted, ["term", "band"])
    return met.select("query_id", "asked", "left", F.explode("postings").alias("p")).groupBy("query_id", F.col("p.doc_id").alias("doc_id")).agg(
        F.sum(F.col("asked") * F.col("p.weight")).alias("partial"), F.sum("left").alias("open_there"))


def kth(sums: DataFrame, k: int) -> DataFrame:
    """(query_id, least): the k-th partial sum; none for a query with fewer documents."""
    return top_k(sums.select("query_id", "partial"), k, ["query_id"], [F.desc("partial")]).filter(F.col("rnk") == k).select(
        "query_id", F.col("partial").alias("least"))


def cut_levels(bands: DataFrame, reached: DataFrame) -> DataFrame:
    """(query_id, level): contributions below the level may be left out. With the terms' highest contributions in ascending order, the
    level is what the reached score leaves per term once the terms that stay below it have had theirs; a query without a k-th
    score leaves nothing out."""
    highest = bands.groupBy("query_id", "term").agg(F.max("most").alias("most")).join(reached, "query_id")
    order = W.partitionBy("query_id").orderBy("most", "term")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    terms_left = F.count(F.lit(1)).over(W.partitionBy("query_id")) - F.row_number().over(order) + 1
    shares = highest.select("query_id", "most", ((F.col("least") * (1 - SLACK) - before) / terms_left).alias("share"))
    return shares.groupBy("query_id").agg(F.max(F.when(F.col("share") <= F.col("most"), F.col("share"))).alias("level"))


def search(index: ImpactIndex, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, rnk, doc_id, score), and (query_id, n_postings, n_read, n_scored): how many postings the query's terms have, how many
    were read and how many documents were scored in full."""
    if k < 1:
        raise ValueError("k must be positive")
    terms = materialised(asked_terms(index, queries), "asked-terms")
    bands = materialised(asked_bands(index, terms), "asked-bands")
    few = bands.count() <= BROADCAST_BANDS
    first = bands.filter(F.col("seen_before") < FIRST * k)
    # The first reading leaves bounds out of account.
    reached = materialised(kth(partial_sums(index, first.withColumn("left", F.lit(0.0)), few), k), "reached")
    levels = cut_levels(bands, reached)
    # A level that no term reaches leaves out nothing that was not asked for: all contributions together stay below the score.
    marked = bands.join(levels, "query_id", "left").join(reached, "query_id", "left").withColumn(
        "read", (F.col("seen_before") < FIRST * k) | F.col("least").isNull() | (F.col("level").isNotNull() & (F.col("most") >= F.col("level"))))
    left = F.coalesce(F.max(F.when(~F.col("read"), F.col("most"))).over(W.partitionBy("query_id", "term")), F.lit(0.0))
    marked = materialised(marked.withColumn("left", left), "marked-bands")
    sums = materialised(partial_sums(index, marked.filter("read"), few), "partial-sums")
    open_all = marked.groupBy("query_id", "term").agg(F.max("left").alias("left")).groupBy("query_id").agg(F.sum("left").alias("open_all"))
    bounded = sums.join(open_all, "query_id").join(kth(sums, k), "query_id", "left")
    upper = F.col("partial") + F.col("open_all") - F.col("open_there")
    chosen = materialised(bounded.filter(F.col("least").isNull() | (upper >= F.col("least") - SLACK)).select("query_id", "doc_id"), "candidates")
    scored = full_scores(index, chosen, terms)
    hits = top_k(with_fill(index, scored, queries, k), k, ["query_id"], [F.desc("score"), F.asc("doc_id")]).select(*HIT)
    read = marked.groupBy("query_id").agg(F.sum("n").alias("n_postings"), F.sum(F.when(F.col("read"), F.col("n")).otherwise(0)).alias("n_read"))
    return hits, read.join(chosen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_scored")), "query_id", "left")


def full_scores(index: ImpactIndex, chosen: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of chosen pairs, from the documents' vectors."""
    wanted = index.vectors.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    long = wanted.select("doc_id", F.explode(F.arrays_zip("terms", "weights")).alias("x")).select("doc_id", F.col("x.terms").alias("term"), F.col("x.weights").alias("weight"))
    pairs = chosen.join(terms, "query_id").join(long, ["doc_id", "term"])
    return pairs.groupBy("query_id", "doc_id").agg((F.round(F.sum(F.col("asked") * F.col("weight")), 10) + 0.0).alias("score"))


def with_fill(index: ImpactIndex, scored: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Adds the first documents, which score 0 where they share no term with a query of fewer than k hits.

    A query's k hits can be among the first 2k documents, and k of these are left to fill up."""
    first = index.vectors.select("doc_id").orderBy("doc_id").limit(2 * k)
    short = queries.select("query_id").join(scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").filter(F.coalesce("n", F.lit(0)) < k)
    fill = short.select("query_id").join(F.broadcast(first), F.lit(True)).join(scored.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return scored.unionByName(fill.select("query_id", "doc_id", F.lit(0.0).alias("score")))
