"""Grounding and reward per prediction, from entailment scores of (premise, sentence) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PREDICTION = ["case_id", "rnk"]


def pair_score(entailment: str = "entailment", contradiction: str = "contradiction") -> Column:
    """Entailment minus contradiction; a missing class counts 0."""
    return F.coalesce(F.col(entailment), F.lit(0.0)) - F.coalesce(F.col(contradiction), F.lit(0.0))


def strongest(score: Column, index: Column) -> Column:
    """The value largest in magnitude, sign kept; the smallest index wins a tie."""
    return F.max_by(score, F.struct(F.abs(score), -index))


def sentence_scores(nli: DataFrame) -> DataFrame:
    return nli.withColumn("score", pair_score()).groupBy(*PREDICTION, "sentence_idx").agg(
        strongest(F.col("score"), F.col("premise_idx")).alias("score"))


def sentence_level(nli: DataFrame) -> DataFrame:
    """g_max: strongest sentence; g_avg: mean over sentences, each scored by its strongest premise."""
    return sentence_scores(nli).groupBy(*PREDICTION).agg(
        strongest(F.col("score"), F.col("sentence_idx")).alias("g_max"), F.avg("score").alias("g_avg"),
        F.count("*").alias("n_sentences"))


def whole_level(nli: DataFrame) -> DataFrame:
    """g_max and g_avg over all pairs of a prediction."""
    order = F.col("sentence_idx") * F.lit(1 << 32).cast("bigint") + F.col("premise_idx")
    return nli.withColumn("score", pair_score()).groupBy(*PREDICTION).agg(
        strongest(F.col("score"), order).alias("g_max"), F.avg("score").alias("g_avg"))


def attach(predictions: DataFrame, grounding: DataFrame, missing: float | None = 0.0) -> DataFrame:
    """Left-join grounding to predictions; a prediction without pairs gets ``missing``
    (0 for ranked lists, null for the MCQ form)."""
    base = predictions.drop("g_max", "g_avg")
    joined = base.join(grounding, PREDICTION, "left")
    return joined if missing is None else joined.fillna(missing, ["g_max", "g_avg"])


def precision_reward(judged: DataFrame, gold_counts: DataFrame) -> DataFrame:
    """1.0 for a matched prediction; 0.0 otherwise, for a blank label, and for a case without gold."""
    counts = gold_counts.select("case_id", "n_gold")
    good = F.col("matched") & (F.trim("label") != "") & (F.coalesce("n_gold", F.lit(0)) > 0)
    return judged.join(counts, "case_id", "left").withColumn(
        "precision", F.when(good, 1.0).otherwise(0.0)).drop("n_gold")


def combined(grounding: Column, precision: Column, weight: float = 0.5) -> Column:
    if not 0.0 <= weight <= 1.0:
        raise ValueError("weight must lie in [0, 1]")
    return F.lit(weight) * grounding + F.lit(1.0 - weight) * precision


def reward_rows(grounded: DataFrame, judged: DataFrame, weight: float = 0.5) -> DataFrame:
    """One full row per prediction: label, g_max, g_avg, precision, combined, matched labels.

    The two scoring phases must cover the same predictions; a row that only one phase
    has raises when the result is read."""
    left = grounded.select(*PREDICTION, "g_max", "g_avg", F.lit(1).alias("in_g"))
    right = judged.select(*PREDICTION, "label", "matched", F.lit(1).alias("in_j"))
    both = left.join(right, PREDICTION, "full_outer")
    checked = F.when(F.col("in_g").isNull() | F.col("in_j").isNull(),
                     F.raise_error(F.lit("a prediction was scored in one phase only")).cast("double")).otherwise(
        F.when(F.col("matched"), 1.0).otherwise(0.0))
    return (
        both.withColumn("precision", checked)
        .withColumn("combined", combined(F.col("g_max"), F.col("precision"), weight))
        .withColumn("matched_labels", F.when(F.col("matched"), F.col("label")).otherwise(""))
        .drop("in_g", "in_j")
    )


def gated_alignment(alignment: Column, correct: Column) -> Column:
    """Alignment counts only where the answer is correct."""
    return F.when(correct, alignment).otherwise(F.lit(0.0))
