"""The long per-case metric table and its summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from . import ranking as rk
from .stats import with_quantiles

REWARDS = {"g_max": "g_max", "g_avg": "g_avg", "reward_precision": "precision", "combined": "combined"}


def metric_rows(tally: DataFrame, rewards: DataFrame, cases: DataFrame, max_k: int = 5) -> DataFrame:
    """(case_id, metric, k, value): precision, recall, F1, and the mean rewards at k."""
    quality = rk.precision_recall(tally).select("case_id", "k", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("precision", "recall", "f1")])))
    # All rewards in one pass over the predictions.
    span = range(1, max_k + 1)
    empty = cases.select("case_id", F.lit(None).cast("int").alias("rnk"),
                         *[F.lit(None).cast("double").alias(c) for c in REWARDS.values()])
    wide = rewards.select("case_id", "rnk", *REWARDS.values()).unionByName(empty).groupBy("case_id").agg(
        *[F.avg(F.when(F.col("rnk") <= k, F.col(c))).alias(f"{c}_{k}") for c in REWARDS.values() for k in span])
    rows = F.array(*[F.struct(
        F.lit(k).alias("k"), F.lit(m).alias("metric"), F.coalesce(F.col(f"{c}_{k}"), F.lit(0.0)).alias("value"))
        for m, c in REWARDS.items() for k in span])
    parts = [quality, wide.select("case_id", F.inline(rows))]
    return reduce(DataFrame.unionByName, [p.select("case_id", "metric", "k", "value") for p in parts])


def mean_metrics(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*by, "metric", "k").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def run_summary(attempts: DataFrame, predictions: DataFrame, reward_at_3: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: parse-success rate, predictions per case, share with reasoning, mean reasoning
    length (mean of per-case means), and cases with low (< 0.3) and high (>= 0.7) reward@3."""
    per_case = predictions.groupBy("case_id").agg(
        F.count("*").alias("n"), F.count(F.when(F.trim("reasoning") != "", 1)).alias("with_reasoning"),
        F.avg(F.when(F.trim("reasoning") != "", F.length("reasoning"))).alias("mean_length"))
    one = F.lit(True)
    parse = attempts.agg(F.avg(F.col("success").cast("double")).alias("parse_success_rate"))
    shape = cases.join(per_case, "case_id", "left").agg(
        F.avg(F.coalesce("n", F.lit(0))).alias("predictions_per_case"),
        F.sum("with_reasoning").alias("with_reasoning"), F.avg("mean_length").alias("mean_reasoning_length"))
    bands = reward_at_3.agg(F.count(F.when(F.col("value") < 0.3, 1)).alias("low_reward_cases"),
                            F.count(F.when(F.col("value") >= 0.7, 1)).alias("high_reward_cases"))
    return parse.join(F.broadcast(shape), one).join(F.broadcast(bands), one)


def distribution(scored: DataFrame, score: str, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """Shares grounded / weak / contradicted and the spread of a score."""
    s = F.col(score)
    plain = scored.filter(s.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg((s > threshold).cast("double")).alias("grounded"),
        F.avg(((s >= -threshold) & (s <= threshold)).cast("double")).alias("weak"),
        F.avg((s < -threshold).cast("double")).alias("contradicted"),
        F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"),
        F.min(s).alias("min"), F.max(s).alias("max"))
    return with_quantiles(plain, scored, s, {"median": 0.5}, by)


def grounding_by_correctness(judged: DataFrame, score: str) -> DataFrame:
    """Mean and standard error per model and condition for correct, incorrect and all predictions."""
    s = F.col(score)
    group = F.when(F.grouping("matched") == 1, "overall").when(F.col("matched"), "correct").otherwise("incorrect")
    n = F.count(s)
    return judged.groupingSets(
        [[F.col("model"), F.col("cond"), F.col("matched")], [F.col("model"), F.col("cond")]],
        "model", "cond", "matched").agg(
        group.alias("group"), n.alias("n"), F.coalesce(F.avg(s), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_pop(s) / F.sqrt(n), F.lit(0.0)).alias("std_error")).drop("matched")


def model_scatter(judged: DataFrame, score: str, threshold: float = 0.2) -> DataFrame:
    """Counts and means by correctness and shares beyond a threshold, per model."""
    s, ok = F.col(score), F.col("matched")
    return judged.groupBy("model").agg(
        F.count("*").alias("n"), F.count(F.when(ok, 1)).alias("n_correct"), F.count(F.when(~ok, 1)).alias("n_incorrect"),
        F.avg(F.when(ok, s)).alias("mean_correct"), F.avg(F.when(~ok, s)).alias("mean_incorrect"),
        F.avg((s > threshold).cast("double")).alias("share_above"),
        F.avg((s < -threshold).cast("double")).alias("share_below"))


def accuracy_by_subject(answers: DataFrame) -> DataFrame:
    """Accuracy and parse rate per subject (blank -> unknown) with the grand total as ``(all)``."""
    subject = F.when(F.trim(F.coalesce("subject", F.lit(""))) == "", "unknown").otherwise(F.trim("subject"))
    return answers.withColumn("subject", subject).rollup("subject").agg(
        F.grouping("subject").alias("is_total"), F.count("*").alias("n"),
        F.count(F.when(F.col("correct"), 1)).alias("n_correct"),
        F.avg(F.coalesce(F.col("correct"), F.lit(False)).cast("double")).alias("accuracy"),
    ).withColumn("subject", F.when(F.col("is_total") == 1, "(all)").otherwise(F.col("subject"))).drop("is_total")


def answer_distribution(answers: DataFrame) -> DataFrame:
    """Count per answer letter, with failed parses under ``unparsed``, and the share of each."""
    total = answers.agg(F.count("*").alias("total"))
    return answers.groupBy(F.coalesce("answer", F.lit("unparsed")).alias("answer")).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("correct"), 1)).alias("n_correct"),
    ).join(F.broadcast(total), F.lit(True)).withColumn("share", F.col("n") / F.col("total"))
