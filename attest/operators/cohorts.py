"""Outcome taxonomy, movement between conditions, and the tables behind the plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .stats import with_quantiles

# The six outcome labels.
GROUNDED = {True: "Evidence-Based", False: "Reasoning Failure"}
WEAK = {True: "Weakly Supported", False: "Unsupported Error"}
CONTRADICTED = {True: "Lucky Guess", False: "Hallucination"}
LABELS = [d[c] for d in (GROUNDED, WEAK, CONTRADICTED) for c in (True, False)]


def outcome(score: Column, correct: Column, threshold: float = 0.5) -> Column:
    """Grounded above t, contradicted below -t, weak otherwise (both bounds and null), by correctness."""
    right = F.coalesce(correct, F.lit(False))

    def pick(names):
        return F.when(right, names[True]).otherwise(names[False])
    return F.when(score > threshold, pick(GROUNDED)).when(score < -threshold, pick(CONTRADICTED)).otherwise(pick(WEAK))


def taxonomy(judged: DataFrame, k: int, score: str = "g_max", threshold: float = 0.5,
             by: tuple[str, ...] = ()) -> DataFrame:
    """One row per group over the top k predictions: counts, shares and faithfulness."""
    if score not in judged.columns:
        raise ValueError(f"score column {score!r} is missing")
    rows = judged.filter(F.col("rnk") <= k).withColumn("outcome", outcome(F.col(score), F.col("matched"), threshold))
    names = {x: x.lower().replace("-", "_").replace(" ", "_") for x in LABELS}
    counted = rows.groupBy(*by).agg(
        F.count("*").alias("total"),
        *[F.count(F.when(F.col("outcome") == x, 1)).alias(n) for x, n in names.items()])
    total = F.col("total")

    def share(*columns):
        return F.when(total > 0, sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / total).otherwise(0.0)
    correct = F.col("evidence_based") + F.col("weakly_supported") + F.col("lucky_guess")
    return (
        counted.withColumn("eb_pct", share("evidence_based"))
        .withColumn("rf_pct", share("reasoning_failure"))
        .withColumn("h_pct", share("hallucination"))
        .withColumn("lg_pct", share("lucky_guess"))
        .withColumn("weak_pct", share("weakly_supported", "unsupported_error"))
        .withColumn("faithfulness", F.when(correct > 0, F.col("evidence_based") / correct).otherwise(0.0))
    )


def taxonomy_long(judged: DataFrame, k: int, score: str = "g_max", threshold: float = 0.5,
                  by: tuple[str, ...] = ()) -> DataFrame:
    """(group, outcome, n, rate), all six outcomes present."""
    wide = taxonomy(judged, k, score, threshold, by)
    rows = F.array(*[F.struct(F.lit(x).alias("outcome"),
                              F.col(x.lower().replace("-", "_").replace(" ", "_")).alias("n")) for x in LABELS])
    return wide.select(*by, "total", F.inline(rows)).withColumn(
        "rate", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0)).drop("total")


def case_scores(scored: DataFrame, score: str = "g_max", key: str = "case_id") -> DataFrame:
    """Mean score per case and condition, at 12 digits: a mean that cancels to zero is zero
    whatever the order of summation, which the sign reports rely on."""
    if score not in scored.columns:
        raise ValueError(f"score column {score!r} is missing")
    return scored.groupBy(key, "cond").agg((F.round(F.avg(score), 12) + 0.0).alias("score"))


def trajectory(per_case: DataFrame, conditions: list[str], key: str = "case_id") -> DataFrame:
    """One row per case present in every condition, a column per condition."""
    wide = per_case.groupBy(key).agg(*[
        F.max(F.when(F.col("cond") == c, F.col("score"))).alias(c) for c in conditions])
    everywhere = F.lit(True)
    for c in conditions:
        everywhere = everywhere & F.col(c).isNotNull()
    return wide.filter(everywhere)


def movement(paths: DataFrame, first: str, last: str, threshold: float = 0.15) -> DataFrame:
    change = F.col(last) - F.col(first)
    return paths.withColumn("change", change).withColumn(
        "movement", F.when(change > threshold, "improved").when(change < -threshold, "worsened").otherwise("stable"))


def sign_transitions(paths: DataFrame, first: str, last: str) -> DataFrame:
    before, after = F.col(first) > 0, F.col(last) > 0

    def n(condition):
        return F.count(F.when(condition, 1))
    return paths.agg(
        n(~before & after).alias("neg_to_pos"), n(~before & ~after).alias("neg_to_neg"),
        n(before & after).alias("pos_to_pos"), n(before & ~after).alias("pos_to_neg"),
        F.avg(after.cast("double")).alias("positive_after"))


def change_statistics(paths: DataFrame, first: str, last: str) -> DataFrame:
    d = F.col(last) - F.col(first)

    def share(condition):
        return 100 * F.avg(condition.cast("double"))
    plain = paths.agg(
        F.count("*").alias("n"), F.avg(d).alias("mean"),
        F.stddev_pop(d).alias("std"), share(d > 0).alias("improved"), share(d > 0.1).alias("improved_01"),
        share(d > 0.2).alias("improved_02"), share(d < 0).alias("worsened"), share(d < -0.1).alias("worsened_01"))
    return with_quantiles(plain, paths, d, {"median": 0.5})


def mean_trajectory(paths: DataFrame, conditions: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("cond"), F.col(c).alias("score")) for c in conditions])
    return paths.select(F.inline(rows)).groupBy("cond").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))
