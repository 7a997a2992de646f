"""Writers: every table is one distributed write; exports of several tables are whole or not there."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, functions as F

from .exports import write_export


def write_corpus(docs: DataFrame, path: str) -> None:
    """JSON lines of doc_id, text, metadata."""
    docs.select("doc_id", "text", "metadata").write.json(path)


def write_results(results: DataFrame, summary: DataFrame, config: dict[str, str], path: str) -> None:
    """Nested results, a one-row summary and the configuration as one export (see ``exports``)."""
    pairs = ", ".join("(?, ?)" for _ in config) or "(null, null)"
    args = [x for pair in config.items() for x in pair]
    settings = results.sparkSession.sql(f"SELECT * FROM VALUES {pairs} AS t(key, value)", args=args)
    write_export({"results": (results, "json"), "summary": (summary, "json"), "config": (settings, "json")}, path)


def write_per_case(results: DataFrame, path: str, key: str = "case_id", limit: int = 10_000) -> None:
    """One folder per case, for small runs; warns of a case count that floods the file system."""
    if results.select(key).distinct().limit(limit + 1).count() > limit:
        warnings.warn(f"more than {limit} folders under {path}; one table may serve better", stacklevel=2)
    results.write.partitionBy(key).json(path)


def write_metrics(aggregate: DataFrame, per_case: DataFrame, path: str) -> None:
    """Aggregate and rows per case as one export."""
    write_export({"aggregate": (aggregate, "json"), "per_case": (per_case, "parquet")}, path)


def annotation_queue(judgements: DataFrame) -> DataFrame:
    """Judgements with empty columns for a human verdict."""
    return judgements.select("judgement_id", "label", "gold", "verdict", "confidence",
                             F.lit(None).cast("boolean").alias("is_correct"), F.lit("").alias("notes"))


def judge_audit(tasks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Judge prompts beside the raw answers and what was read from them."""
    from ..functions.text import verdict
    joined = tasks.join(verdicts.select("case_id", "rnk", "raw_output"), ["case_id", "rnk"], "left")
    said = F.trim("raw_output")
    return joined.withColumn("verdict_text", F.coalesce(F.regexp_extract(F.upper(said), "^(TRUE|FALSE)", 1), F.lit(""))).withColumn(
        "is_correct", F.coalesce(verdict(F.col("raw_output")), F.lit(False)))


def save_index(vectors: DataFrame, path: str) -> None:
    """Vectors (by cell, if there are cells) and a one-row description."""
    writer = vectors.write.partitionBy("cell_id") if "cell_id" in vectors.columns else vectors.write
    writer.parquet(f"{path}/vectors")
    vectors.agg(F.max(F.size("vector")).alias("dimension"), F.count("*").alias("n_vectors")).write.parquet(f"{path}/meta")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/meta")
