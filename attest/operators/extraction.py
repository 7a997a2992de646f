"""From raw outputs to prediction rows. Only rows that do not parse are repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import repair as rp


def parse_attempts(attempts: DataFrame, fallback: bool = True) -> DataFrame:
    """Adds ``items`` (five label/reasoning pairs, padded), ``parse_success`` (three complete
    ones), ``parse_error`` and ``stage`` (clean, repaired, pattern, failed)."""
    first = attempts.withColumn("_text", rp.list_object(F.col("raw_output"))).withColumn(
        "_clean", rp.listed_items(F.col("_text")))
    good = F.coalesce(F.size("_clean"), F.lit(-1)) > 0
    # One pass: clean rows carry a null where the repair steps look for a text.
    fixed = rp.repaired(first.withColumn("_good", good).withColumn(
        "_text", F.when(~F.col("_good"), F.col("_text"))), "_text").withColumn("_fixed", rp.listed_items(F.col("_text")))
    none = F.array().cast(f"array<{rp.ITEM}>")
    found = rp.fallback_items(F.col("raw_output")) if fallback else none
    rows = fixed.withColumn("items", F.when(F.col("_good"), F.col("_clean")).when(
        F.col("_fixed").isNotNull(), F.col("_fixed")).otherwise(found)).withColumn(
        "stage", F.when(F.col("_good"), "clean").when(F.col("_fixed").isNotNull(), "repaired")
        .when(F.size("items") > 0, "pattern").otherwise("failed"))
    rows = rows.drop("_text", "_clean", "_good", "_fixed").withColumn("n_complete", rp.complete(F.col("items")))
    success = F.col("n_complete") >= 3
    error = F.when(success, "").when(F.col("stage").isin("failed", "pattern"), "JSON parse error").otherwise(
        F.concat(F.lit("Only "), F.col("n_complete"), F.lit("/5 complete diagnoses parsed")))
    return rows.withColumn("items", rp.padded(F.col("items"))).withColumn(
        "parse_success", success).withColumn("parse_error", error)


def prediction_rows(parsed: DataFrame, keys: list[str], items: str = "items") -> DataFrame:
    """One row per prediction with a label; rank is the list position from 1.

    The outer form of the explode keeps the planner from adding a filter on the list, which
    would parse every output a second time."""
    return parsed.select(*keys, F.posexplode_outer(items).alias("pos", "p")).filter(F.trim("p.label") != "").select(
        *keys, (F.col("pos") + 1).alias("rnk"), "p.label", "p.reasoning")


def parse_critiques(outputs: DataFrame) -> DataFrame:
    """Adds ``critiques`` (null when unreadable) and ``parse_success``; repair only where needed."""
    first = outputs.withColumn("_text", rp.critique_text(F.col("raw_output"))).withColumn(
        "_clean", rp.critique_items(F.col("_text"))).withColumn(
        "_text", F.when(F.col("_clean").isNull(), F.col("_text")))
    fixed = rp.repaired(first, "_text").withColumn("critiques", F.coalesce("_clean", rp.critique_items(F.col("_text"))))
    return fixed.drop("_text", "_clean").withColumn("parse_success", F.col("critiques").isNotNull())


def rescue(parsed: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Failed attempts take the items of a second extraction if those are complete enough; the
    error text of a row that stays failed is kept."""
    extra = second.select(*keys, F.col("items").alias("_new"))
    joined = parsed.join(extra, keys, "left")
    better = ~F.col("parse_success") & F.col("_new").isNotNull()
    merged = joined.withColumn("items", F.when(better, rp.padded(F.col("_new"))).otherwise(F.col("items"))).withColumn(
        "rescued", better & (rp.complete(F.col("items")) >= 3))
    return merged.withColumn("parse_success", F.col("parse_success") | F.col("rescued")).withColumn(
        "parse_error", F.when(F.col("parse_success"), "").otherwise(F.col("parse_error"))).drop("_new")


def match_records(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """Parsed MCQ attempts beside the gold letter: accuracy 1/0 and ``correct``; null if unparsed."""
    joined = answers.join(gold.select("case_id", "gold_answer"), "case_id", "left")
    same = F.upper(F.trim("answer")) == F.upper(F.trim("gold_answer"))
    return joined.withColumn("parse_success", F.col("answer").isNotNull()).withColumn(
        "accuracy", F.when(F.col("answer").isNotNull(), F.when(F.coalesce(same, F.lit(False)), 1.0).otherwise(0.0))).withColumn(
        "correct", F.col("accuracy") == 1.0)


def error_summary(failures: DataFrame, n_attempts: DataFrame) -> DataFrame:
    """Count and share per error type, and the overall failure rate. ``failures`` holds
    ``error_type``; ``n_attempts`` one row ``total``."""
    counts = failures.groupBy("error_type").agg(F.count("*").alias("n"))
    failed = counts.agg(F.sum("n").alias("n_failed"))
    one = F.lit(True)
    return counts.join(F.broadcast(failed), one).join(F.broadcast(n_attempts), one).select(
        "error_type", "n", (F.col("n") / F.col("n_failed")).alias("share"),
        (F.col("n_failed") / F.col("total")).alias("failure_rate"))


def error_examples(failures: DataFrame, n: int = 3, preview: int = 500) -> DataFrame:
    """Up to n example outputs per error type, in attempt order, with a preview of the text."""
    from .topk import top_k
    kept = top_k(failures, n, ["error_type"], [F.asc("attempt_id")], "example")
    return kept.select("error_type", "example", "attempt_id", F.substring("raw_output", 1, preview).alias("preview"))


# Share of failures above which a recommendation is made.
RULES = (
    ("truncation", 0.30, "Raise the output token limit."),
    ("json_syntax", 0.30, "Use structured output or more examples."),
    ("incomplete_json", 0.20, "State the JSON structure; the output may hit its token limit."),
    ("extra_text", 0.10, "Ask for the JSON only."),
    ("missing_fields", 0.10, "State every field with an example."),
    ("empty_output", 0.05, "Check generation for silent failures."),
)
FAILURE_RULE = (0.50, "Use a more capable model or structured output.")


def recommendations(summary: DataFrame) -> DataFrame:
    """Rules whose threshold the error distribution exceeds, and the one on the failure rate."""
    spark = summary.sparkSession
    values = ", ".join(f"('{t}', {x}D, '{m}')" for t, x, m in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS r(error_type, threshold, message)")
    by_type = summary.join(F.broadcast(rules), "error_type").filter(F.col("share") > F.col("threshold")).select("message")
    overall = summary.agg(F.max("failure_rate").alias("r")).filter(F.col("r") > FAILURE_RULE[0]).select(
        F.lit(FAILURE_RULE[1]).alias("message"))
    return by_type.unionByName(overall)
