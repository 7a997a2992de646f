"""Judge calibration and agreement between raters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

BINS = 10
EDGES = [float(x) for x in np.linspace(0, 1, BINS + 1)]


def bin_index(confidence: Column) -> Column:
    """Bin [lower, upper) by the exact edges, the last one with 1.0; null outside [0, 1]."""
    found = F.when(confidence == 1.0, BINS - 1)
    for i in range(BINS):
        found = found.when((confidence >= EDGES[i]) & (confidence < EDGES[i + 1]), i)
    return found


def calibration_curve(judgements: DataFrame) -> DataFrame:
    """One row per bin, empty ones included: count, accuracy, mean confidence."""
    counted = judgements.withColumn("bin", bin_index(F.col("confidence"))).filter(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count("*").alias("n"), F.avg(F.col("gold").cast("double")).alias("accuracy"), F.avg("confidence").alias("confidence"))
    bins = judgements.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    return bins.join(counted, "bin", "left").fillna(0, ["n"])


def calibration(judgements: DataFrame) -> DataFrame:
    """ECE (weighted by bin size over all judgements), MCE, accuracy, mean confidence, and how many
    confidences lie outside [0, 1]. One pass: everything follows from the bin sums."""
    sums = judgements.withColumn("bin", bin_index(F.col("confidence"))).groupBy("bin").agg(
        F.count("*").alias("n"), F.sum(F.col("gold").cast("double")).alias("right"), F.sum("confidence").alias("conf"))
    total = sums.agg(F.sum("n").alias("total"))
    gap = F.abs(F.col("right") - F.col("conf")) / F.col("n")
    return sums.join(F.broadcast(total), F.lit(True)).agg(
        F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), F.col("n") / F.col("total") * gap)), F.lit(0.0)).alias("ece"),
        F.coalesce(F.max(F.when(F.col("bin").isNotNull(), gap)), F.lit(0.0)).alias("mce"),
        (F.sum("right") / F.max("total")).alias("accuracy"), (F.sum("conf") / F.max("total")).alias("avg_confidence"),
        F.coalesce(F.sum(F.when(F.col("bin").isNull(), F.col("n"))), F.lit(0)).alias("out_of_range"))


def agreement(ratings: DataFrame, first: str, second: str) -> DataFrame:
    """Accuracy, Cohen's kappa, precision, recall and F1 of ``first`` against ``second``."""
    a, b = F.col(first), F.col(second)

    def n(condition):
        return F.count(F.when(condition, 1)).cast("double")
    s = ratings.filter(a.isNotNull() & b.isNotNull()).agg(
        F.count("*").cast("double").alias("n"), n(a & b).alias("tp"), n(a & ~b).alias("fp"), n(~a & b).alias("fn"), n(~a & ~b).alias("tn"))
    n_, tp, fp, fn, tn = (F.col(c) for c in ("n", "tp", "fp", "fn", "tn"))
    po = (tp + tn) / n_
    pe = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n_ * n_)
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return s.select(
        po.alias("accuracy"), F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"),
        precision.alias("precision"), recall.alias("recall"),
        F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"))
