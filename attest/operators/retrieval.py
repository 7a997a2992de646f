"""Dense retrieval, fusion, alignment and lookup. Search by cells is in ``cells``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import labelled_sections
from ..functions.vectors import sparse_cosine
from ..session import materialised
from . import lexical
from .blocks import dense_block, nearest
from .topk import top_k

HIT = ["query_id", "rnk", "doc_id", "score"]


def dense_search(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact search: ``docs`` holds doc_id, vector; ``queries`` query_id, vector; both may
    carry ``concepts`` to restrict the documents a query sees."""
    keep = ["vector"] + (["concepts"] if "concepts" in docs.columns and "concepts" in queries.columns else [])
    return nearest(docs.sparkSession, docs.select("doc_id", *keep), queries.select("query_id", *keep), k, dense_block)


def overfetch_search(docs: DataFrame, queries: DataFrame, k: int, factor: int = 10) -> DataFrame:
    """Search factor * k first, then drop documents without a concept of the query; may return fewer."""
    wide = dense_search(docs.drop("concepts"), queries.drop("concepts"), factor * k)
    rows = wide.join(docs.select("doc_id", F.col("concepts").alias("dc")), "doc_id").join(
        queries.select("query_id", F.col("concepts").alias("qc")), "query_id")
    kept = rows.filter((F.size("qc") == 0) | F.arrays_overlap("dc", "qc"))
    return top_k(kept.drop("rnk"), k, ["query_id"], [F.desc("score"), F.asc("doc_id")]).select(*HIT)


def fuse(hits: DataFrame, k: int, group: str = "case_id") -> DataFrame:
    """Hits of several queries per case: best score per document, then the top k."""
    best = hits.groupBy(group, "doc_id").agg(F.max("score").alias("score"))
    return top_k(best, k, [group], [F.desc("score"), F.asc("doc_id")])


def fused_search(docs: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """``parts`` holds case_id, part_idx, text: every part is a query, its hits are fused per case."""
    asked = parts.withColumn("query_id", F.concat_ws("#", "case_id", "part_idx"))
    hits = lexical.search(docs, asked.select("query_id", "text"), k)
    return fuse(hits.join(asked.select("query_id", "case_id"), "query_id"), k)


def section_queries(cases: DataFrame) -> DataFrame:
    """(case_id, part_idx, text): each labelled section of a case's text is a query; the whole text if it has none."""
    found = F.transform(labelled_sections(F.col("context")), lambda s: s["content"])
    parts = F.when(F.size(found) > 0, found).otherwise(F.array("context"))
    return cases.select("case_id", F.posexplode(parts).alias("part_idx", "text"))


def align(docs: DataFrame, answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rank each answer's candidate documents by TF-IDF cosine with the answer text."""
    # Read by three joins, and candidates may be costly to find.
    pairs = materialised(candidates.select(F.col("query_id").alias("a_id"), F.col("doc_id").alias("b_id")).distinct(), "pairs")
    frequency = lexical.asked_table(docs, answers)
    n_docs = docs.count()
    # Only candidate documents are weighed, and only the answers' terms of them are kept.
    wanted = docs.join(pairs.select(F.col("b_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    a = lexical.weights(answers, frequency.filter("asked"), n_docs, "query_id").withColumnRenamed("query_id", "id")
    b = lexical.weights(wanted, frequency, n_docs, keep=F.col("asked")).withColumnRenamed("doc_id", "id")
    scored = sparse_cosine(a, b, pairs).select(
        F.col("a_id").alias("query_id"), F.col("b_id").alias("doc_id"), (F.round("score", 10) + 0.0).alias("score"))
    from pyspark.sql import Window as W
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return scored.withColumn("rnk", F.row_number().over(order)).select(*HIT)


def lookup(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted document ids; ``found`` is false for an unknown id."""
    return wanted.join(docs.withColumn("found", F.lit(True)), "doc_id", "left").fillna(False, ["found"])


def with_texts(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """The hits and their documents' texts. Hits are written first: Spark then knows their size and sends few to
    every task, where it would shuffle the texts of all documents to meet them."""
    return materialised(hits, "hits").join(docs.select("doc_id", "text"), "doc_id")


def evidence_for_cases(cases: DataFrame, hits: DataFrame, docs: DataFrame, mode: str = "rag") -> DataFrame:
    """Evidence rows for a whole case table; the baseline mode has none. Texts join last."""
    if mode == "baseline":
        return hits.limit(0).join(docs, "doc_id").select(F.col("query_id").alias("case_id"), "rnk", "doc_id", "text", "score")
    known = hits.join(cases.select(F.col("case_id").alias("query_id")), "query_id", "left_semi")
    return with_texts(known, docs).select(F.col("query_id").alias("case_id"), "rnk", "doc_id", "text", "score")
