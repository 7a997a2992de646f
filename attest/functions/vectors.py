"""Vector functions on array columns and (id, term, weight) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """Cosine similarity; 0 for an empty or zero vector."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0) & (size > 0), dot(a, b) / (size + F.lit(epsilon))).otherwise(F.lit(0.0))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda v: v.cast("double") / n)).otherwise(a.cast("array<double>"))


def centroids(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """Normalised element-wise mean per group. One partial sum per group, position and task is
    all that is shuffled, whatever the size of a group."""
    means = vectors.select(group, F.posexplode(vector).alias("pos", "v")).groupBy(group, "pos").agg(
        F.avg(F.col("v").cast("double")).alias("v"))
    packed = means.groupBy(group).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("mean"))
    return packed.select(group, normalise(F.col("mean")).alias("centroid"))


def sparse_cosine(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Dot product of unit sparse vectors for the given (a_id, b_id) pairs, over shared terms."""
    left = pairs.join(a.select(F.col("id").alias("a_id"), "term", F.col("weight").alias("wa")), "a_id")
    right = b.select(F.col("id").alias("b_id"), "term", F.col("weight").alias("wb"))
    hits = left.join(right, ["b_id", "term"]).groupBy("a_id", "b_id").agg(F.sum(F.col("wa") * F.col("wb")).alias("score"))
    return pairs.join(hits, ["a_id", "b_id"], "left").fillna(0.0, ["score"])
