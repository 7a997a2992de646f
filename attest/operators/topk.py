"""Top-k selections. A row_number filter lets Spark cut each map task to k rows per key
before the shuffle, so a hot key ships k rows per task, not all of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def top_k(scored: DataFrame, k: int, keys: list[str], order: list[Column], rank: str = "rnk") -> DataFrame:
    """The first k rows per key in the given order."""
    if k < 1:
        raise ValueError("k must be positive")
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return scored.withColumn(rank, place).filter(F.col(rank) <= k)


def ordered_labels(label_counts: DataFrame, by: str = "f1") -> DataFrame:
    """The per-label table in descending order of a column, with its place.

    There is one row per distinct label here, far fewer than predictions."""
    if by not in ("f1", "support", "precision", "recall"):
        raise ValueError(f"cannot order labels by {by!r}")
    value = F.round(by, 9)
    return label_counts.withColumn("place", F.row_number().over(W.orderBy(value.desc(), "label")))


def best_and_worst(label_counts: DataFrame, by: str, n: int = 5) -> DataFrame:
    best = label_counts.orderBy(F.desc(by), "label").limit(n).withColumn("side", F.lit("best"))
    worst = label_counts.orderBy(F.asc(by), "label").limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)
