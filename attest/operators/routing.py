"""Selective retrieval: which cases retrieve, with what query, and what comes of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialised
from .pairs import match_critiques


def with_fallback(predictions: DataFrame, critiques: DataFrame) -> DataFrame:
    """Critiques, and for a case without any a critique that doubts every prediction."""
    # Read twice, and critiques may be costly to parse.
    critiques = materialised(critiques.select("case_id", "critique_idx", "label", "confidence", "needs_evidence"), "critiques")
    missing = predictions.join(critiques.select("case_id").distinct(), "case_id", "left_anti")
    doubts = missing.select("case_id", (F.col("rnk") - 1).alias("critique_idx"), "label", F.lit("LOW").alias("confidence"),
                            F.lit(True).alias("needs_evidence"))
    return critiques.unionByName(doubts)


def routed(critiques: DataFrame) -> DataFrame:
    """Per case: whether it retrieves, and how many predictions are uncertain."""
    return critiques.groupBy("case_id").agg(
        F.bool_or("needs_evidence").alias("needs_retrieval"), F.count(F.when(F.col("needs_evidence"), 1)).alias("n_uncertain"))


def retrieval_queries(predictions: DataFrame, critiques: DataFrame) -> DataFrame:
    """Query text per case: ``label. reasoning`` of the uncertain predictions in rank order, or all
    reasoning where none is. A case has a handful of ranked predictions."""
    rows = match_critiques(predictions, critiques)
    part = F.concat("label", F.lit(". "), "reasoning")
    lists = rows.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("needs_evidence"), F.struct("rnk", part.alias("t"))))).alias("doubtful"),
        F.array_sort(F.collect_list(F.when(F.trim("reasoning") != "", F.struct("rnk", F.col("reasoning").alias("t"))))).alias("every"))

    def text(name):
        return F.array_join(F.transform(name, lambda x: x["t"]), " ")
    return lists.select("case_id", F.when(F.size("doubtful") > 0, text("doubtful")).otherwise(text("every")).alias("text"))


def keep_or_replace(initial: DataFrame, refined: DataFrame, routes: DataFrame) -> DataFrame:
    """The refined attempt of a routed case where it parsed, else the initial one, with how it came about."""
    new = refined.select("case_id", F.col("items").alias("_items"), F.col("parse_success").alias("_ok"))
    rows = initial.join(routes, "case_id", "left").join(new, "case_id", "left")
    triggered = F.coalesce("needs_retrieval", F.lit(False))
    use = triggered & F.coalesce("_ok", F.lit(False))
    return rows.withColumn("triggered", triggered).withColumn("replaced", use).withColumn(
        "items", F.when(use, F.col("_items")).otherwise(F.col("items"))).withColumn(
        "parse_success", F.col("parse_success") | use).drop("_items", "_ok", "needs_retrieval")


def primary(attempts: DataFrame) -> DataFrame:
    """The first sample of each case; the full table keeps the others."""
    return attempts.filter("sample_idx = 0")
