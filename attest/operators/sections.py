"""Sections most similar to a sentence."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import dot, norm
from .blocks import dense_block, nearest
from .topk import top_k

EPSILON = 1e-8


def _similarity(a, b):
    return F.round(dot(a, b) / (norm(a) * norm(b) + F.lit(EPSILON)), 10)


def _ranked(sentences: DataFrame, sections: DataFrame, k: int, limit: int) -> DataFrame:
    """Up to ``limit`` sections stand as one list beside each sentence and the k best are picked in the row; more are
    searched in blocks, with the same result."""
    if sections.limit(limit + 1).count() > limit:
        found = nearest(sentences.sparkSession, sections.withColumnRenamed("section_idx", "doc_id"),
                        sentences.withColumnRenamed("sentence_idx", "query_id"), k, partial(dense_block, epsilon=EPSILON))
        return found.select(F.col("query_id").alias("sentence_idx"), F.col("doc_id").alias("section_idx"), "rnk", F.col("score").alias("sim"))
    listed = sections.agg(F.collect_list(F.struct("section_idx", "vector")).alias("sections"))
    scored = F.transform("sections", lambda s: F.struct(
        (-_similarity(F.col("vector"), s["vector"])).alias("distance"), s["section_idx"].alias("section_idx")))
    best = F.slice(F.sort_array(scored), 1, k)
    # One row on the broadcast side.
    rows = sentences.join(F.broadcast(listed), F.lit(True)).select("sentence_idx", F.posexplode(best).alias("pos", "s"))
    return rows.select("sentence_idx", "s.section_idx", (F.col("pos") + 1).alias("rnk"), (-F.col("s.distance")).alias("sim"))


def nearest_sections(sentences: DataFrame, sections: DataFrame, k: int, case: str | None = None,
                     limit: int = 1_000) -> DataFrame:
    """The k sections most similar to each sentence, ties in section order. With a case column
    every sentence sees the sections of its case, else all share one set."""
    if case is None:
        return _ranked(sentences, sections, k, limit)
    joined = sentences.join(sections.withColumnRenamed("vector", "section_vector"), case).withColumn(
        "sim", _similarity(F.col("vector"), F.col("section_vector")))
    return top_k(joined, k, [case, "sentence_idx"], [F.desc("sim"), F.asc("section_idx")])


def best_section(sentences: DataFrame, sections: DataFrame, case: str | None = None) -> DataFrame:
    keys = [case] if case else []
    return nearest_sections(sentences, sections, 1, case).select(*keys, "sentence_idx", "section_idx")
