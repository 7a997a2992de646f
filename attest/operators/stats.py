"""Descriptive statistics, intervals and tests. Spark computes sufficient statistics; tail
probabilities are applied to the one row per comparison that is left."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import distributions as ds
from ..session import materialised


def describe(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    v = F.col(value)
    plain = rows.filter(v.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return with_quantiles(plain, rows, v, {"median": 0.5, "q1": 0.25, "q3": 0.75}, by)


def value_places(rows: DataFrame, value: Column, by: tuple[str, ...] = (), bucket_rows: int = 100_000) -> DataFrame:
    """(by, _v, _n, _upto, _all) per group and distinct value: its rows, those up to it, and the group's.

    Values are counted first, and their number says what follows. If they fit one bucket a running count per group does; else
    they are ranged into buckets of some ``bucket_rows`` values and counts run inside a bucket over the totals of those below."""
    counts = materialised(rows.select(*by, value.alias("_v")).filter("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_n")), "counts")
    buckets = 1 + counts.count() // bucket_rows
    if buckets == 1:
        running = W.partitionBy(*by).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
        return counts.withColumn("_upto", F.sum("_n").over(running)).withColumn("_all", F.sum("_n").over(W.partitionBy(*by)))
    cuts = _bounds(counts, "_v", buckets)
    edges = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    placed = counts.withColumn("_bucket", F.size(F.filter(edges, lambda e: e < F.col("_v"))))
    # One row per group and bucket.
    totals = placed.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_total"))
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    below = totals.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_below"),
                          F.sum("_total").over(W.partitionBy(*by)).alias("_all"))
    same = F.col("_bucket") == F.col("_b")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    inside = W.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    return placed.withColumn("_upto", F.sum("_n").over(inside)).join(below, same).withColumn(
        "_upto", F.col("_upto") + F.col("_below")).select(*by, "_v", "_n", "_upto", "_all")


def with_quantiles(groups: DataFrame, rows: DataFrame, value: Column, wanted: dict[str, float], by: tuple[str, ...] = (),
                   bucket_rows: int = 100_000) -> DataFrame:
    """``groups`` (one row per group) with exact quantiles of ``value`` over ``rows``, interpolated between neighbours.

    The places come from ``value_places``; no task holds all values of a group."""
    upto = value_places(rows, value, by, bucket_rows)

    def at(place):
        return F.max(F.when((F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto")), F.col("_v")))
    ends = upto.groupBy(*by).agg(*[f for name, p in wanted.items() for f in (
        at(F.floor(p * (F.col("_all") - 1))).alias(f"_lo_{name}"), at(F.ceil(p * (F.col("_all") - 1))).alias(f"_hi_{name}"),
        F.max(p * (F.col("_all") - 1) - F.floor(p * (F.col("_all") - 1))).alias(f"_part_{name}"))])
    found = ends.select(*[F.col(c).alias(f"_q_{c}") for c in by], *[
        ((1 - F.col(f"_part_{n}")) * F.col(f"_lo_{n}") + F.col(f"_part_{n}") * F.col(f"_hi_{n}")).alias(n) for n in wanted])
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_q_{c}"))
    return groups.join(found if by else F.broadcast(found), on, "left").drop(*[f"_q_{c}" for c in by])


# Poisson(1) cumulative probabilities; beyond the last one the weight is its index.
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) if k else np.exp(-1.0) for k in range(12)])


# Groups whose sums are taken at once.
GROUPS = 64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit counter hash, so a weight depends on (row, replicate, seed) alone."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _weight(u: np.ndarray) -> np.ndarray:
    return np.searchsorted(_POISSON, (u >> np.uint64(11)) * 2.0 ** -53, side="right").astype(np.float64)


# Weights by the first bits of a draw; not a number where the other bits decide.
START_BITS = 12
_STARTS = np.arange(1 << START_BITS, dtype=np.uint64) << np.uint64(64 - START_BITS)
_BY_START = np.where(_weight(_STARTS) == _weight(_STARTS | np.uint64((1 << 64 - START_BITS) - 1)), _weight(_STARTS), np.nan)


def poisson_weights(ids: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """len(ids) x replicates weights, each Poisson(1)."""
    with np.errstate(over="ignore"):
        rows = _mix(ids.astype(np.int64).view(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        steps = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        u = _mix(rows[:, None] + steps[None, :])
    out = _BY_START[(u >> np.uint64(64 - START_BITS)).view(np.int64)]
    open_ = np.isnan(out)
    out[open_] = _weight(u[open_])
    return out


def _groups(batch: pd.DataFrame, keys: list[str]) -> tuple[list[tuple], np.ndarray]:
    """The groups of a batch and the group of each row."""
    if not keys:
        return [()], np.zeros(len(batch), dtype=np.int64)
    number = batch.groupby(keys, sort=False).ngroup().to_numpy()
    first = batch[keys].iloc[np.unique(number, return_index=True)[1]]
    return list(first.itertuples(index=False, name=None)), number


def partial_sums(batches: Iterable[pd.DataFrame], keys: list[str], replicates: int, seed: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """Each group's key, and its weighted sums and weights per replicate, over batches of keys, _id and _v."""
    block, sums = max(1, 2_000_000 // replicates), {}
    for batch in batches:
        found, group = _groups(batch, keys)
        ids, place = np.unique(batch["_id"].to_numpy(), return_inverse=True)
        sums_of = [sums.setdefault(key, np.zeros((2, replicates))) for key in found]
        order = np.argsort(place, kind="stable")
        place, group, v = place[order], group[order], batch["_v"].to_numpy()[order]
        for start in range(0, len(ids), block):
            w = poisson_weights(ids[start:start + block], replicates, seed)
            first, last = np.searchsorted(place, [start, start + len(w)])
            for low in range(0, len(found), GROUPS):
                # Sums and counts by group and id; few groups at a time.
                here = np.flatnonzero((group[first:last] >= low) & (group[first:last] < low + GROUPS)) + first
                size = min(GROUPS, len(found) - low)
                used, at = np.unique(place[here] - start, return_inverse=True)
                drawn = w if len(used) == len(w) else w[used]
                cell = (group[here] - low) * len(used) + at
                s = np.bincount(cell, v[here], size * len(used)).reshape(size, -1) @ drawn
                n = np.bincount(cell, minlength=size * len(used)).reshape(size, -1).astype(np.float64) @ drawn
                for j in range(size):
                    sums_of[low + j][0] += s[j]
                    sums_of[low + j][1] += n[j]
    yield from sums.items()


def bootstrap_means(rows: DataFrame, value: str, row_id: Column, by: tuple[str, ...] = (), replicates: int = 1000,
                    seed: int = 42) -> DataFrame:
    """(group, replicate, mean): each row enters replicate b with a Poisson(1) weight.

    A task returns one partial sum per group and replicate, whatever its rows; the weights are
    functions of the row id, so the result does not depend on the partitioning. Rows of a batch that share
    an id, such as the metrics of a case, share its weights, which are drawn once."""
    keys = list(by)
    data = rows.filter(F.col(value).isNotNull()).select(*keys, row_id.cast("bigint").alias("_id"), F.col(value).cast("double").alias("_v"))
    data = data.dropna(subset=keys) if keys else data

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, acc in partial_sums(batches, keys, replicates, seed):
            out = pd.DataFrame({"replicate": np.arange(replicates, dtype=np.int32), "s": acc[0], "w": acc[1]})
            for name, k in zip(keys, key):
                out[name] = k
            yield out[[*keys, "replicate", "s", "w"]]
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in data.select(*keys).schema.fields) if keys else ""
    parts = data.mapInPandas(partial, fields + "replicate int, s double, w double")
    sums = parts.groupBy(*keys, "replicate").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    return sums.select(*keys, "replicate", F.when(F.col("w") > 0, F.col("s") / F.col("w")).alias("mean"))


def bootstrap_ci(rows: DataFrame, value: str, row_id: Column, by: tuple[str, ...] = (), replicates: int = 1000,
                 seed: int = 42, level: float = 0.95) -> DataFrame:
    """Mean and percentile interval per group; a group of fewer than two rows gets (m, m, m)."""
    tail = (1 - level) / 2
    means = bootstrap_means(rows, value, row_id, by, replicates, seed)
    bounds = means.groupBy(*by).agg(F.percentile("mean", F.lit(tail)).alias("lo"), F.percentile("mean", F.lit(1 - tail)).alias("hi"))
    plain = rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    joined = plain.join(bounds, list(by)) if by else plain.join(F.broadcast(bounds), F.lit(True))
    few = F.col("n") < 2
    return joined.select(*by, "n", "mean", F.when(few, F.col("mean")).otherwise(F.col("lo")).alias("lower"),
                         F.when(few, F.col("mean")).otherwise(F.col("hi")).alias("upper")).withColumn(
        "width", F.col("upper") - F.col("lower"))


def moments(rows: DataFrame, value: str, group: str) -> DataFrame:
    return rows.filter(F.col(value).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"),
        F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"))


def group_pairs(stats: DataFrame, group: str) -> DataFrame:
    """All pairs a < b of a table with one row per group."""
    a = stats.select(*[F.col(c).alias(f"a_{c}") for c in stats.columns])
    b = stats.select(*[F.col(c).alias(f"b_{c}") for c in stats.columns])
    # One row per model on either side.
    return a.join(F.broadcast(b), F.col(f"a_{group}") < F.col(f"b_{group}"))


def pooled(pairs: DataFrame) -> DataFrame:
    """Cohen's d, pooled t and its p value for each pair of groups."""
    n1, n2, v1, v2 = (F.col(c) for c in ("a_n", "b_n", "a_var", "b_var"))
    s2 = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    d = F.col("a_mean") - F.col("b_mean")
    out = pairs.withColumn("difference", d).withColumn("df", n1 + n2 - 2).withColumn(
        "cohens_d", F.when(s2 > 0, d / F.sqrt(s2)).otherwise(0.0)).withColumn(
        "t", F.when(s2 > 0, d / F.sqrt(s2 * (1 / n1 + 1 / n2))))
    return out.withColumn("p", ds.t_p(F.col("t"), F.col("df").cast("double")))


# Corrections of the two outer weights by powers of 1 / sqrt(n), from the first power on.
OUTER_WEIGHT = (0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
SECOND_WEIGHT = (0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
# Mean and log deviation of the transformed statistic, by powers of n up to 11 rows and of ln n beyond.
FEW_MEAN, FEW_SPREAD = (0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322)
MANY_MEAN, MANY_SPREAD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)
FEW_SHIFT = (-2.273, 0.459)
# Ranks a row works through.
RANK_CHUNK = 4096


def normality(rows: DataFrame, value: str, group: str, alpha: float = 0.05) -> DataFrame:
    """Shapiro-Wilk per group: (group, n, w, p, normal), by the published approximation of weights and p value.

    The ordered values meet the normal scores of their ranks: a distinct value takes the sum of the scores of its ranks, in chunks of
    ranks, so neither a group nor a value of many rows is gathered. What is left per group are sums and the two
    outermost values on each side. A group of fewer than three rows counts as normal with null w; equal values have w 1."""
    places = value_places(rows, F.col(value).cast("double"), (group,))
    chunks = places.withColumn("first", F.explode(F.sequence(F.col("_upto") - F.col("_n") + 1, F.col("_upto"), F.lit(RANK_CHUNK).cast("bigint"))))
    score = lambda i: ds.normal_quantile((i - 0.375) / (F.col("_all") + 0.25))
    scores = F.transform(F.sequence("first", F.least(F.col("first") + RANK_CHUNK - 1, F.col("_upto"))), score)
    summed = chunks.withColumn("scores", scores).select(
        group, "_v", "_n", "_upto", "_all", F.aggregate("scores", F.lit(0.0), lambda a, x: a + x).alias("s1"), F.aggregate("scores", F.lit(0.0), lambda a, x: a + x * x).alias("s2"))
    at = lambda place: F.max(F.when((F.col("_upto") - F.col("_n") < place) & (place <= F.col("_upto")), F.col("_v")))
    n_rows = F.col("_all")
    whole = summed.groupBy(group).agg(
        F.max("_all").alias("n"), F.sum(F.col("_v") * F.col("s1")).alias("met"), F.sum("s2").alias("squares"),
        at(F.lit(1)).alias("x1"), at(F.lit(2)).alias("x2"), at(n_rows - 1).alias("y2"), at(n_rows).alias("y1"))
    spread = rows.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("of_group")).agg((F.var_pop(value) * F.count(F.lit(1))).alias("deviations"))
    # One row per group on either side.
    joined = whole.join(spread, F.col(group).eqNullSafe(F.col("of_group"))).drop("of_group")
    n, u = F.col("n").cast("double"), 1 / F.sqrt("n")
    outer_score = lambda k: ds.normal_quantile((n - k - 0.375) / (n + 0.25))
    m1, m2 = F.col("m1"), F.col("m2")
    joined = joined.withColumn("m1", outer_score(0)).withColumn("m2", outer_score(1))
    a1 = F.when(F.col("n") == 3, F.sqrt(F.lit(0.5))).otherwise(m1 / F.sqrt("squares") + u * ds.polynomial(OUTER_WEIGHT, u))
    a2 = m2 / F.sqrt("squares") + u * ds.polynomial(SECOND_WEIGHT, u)
    joined = joined.withColumn("a1", a1).withColumn("a2", F.when(F.col("n") > 5, a2))
    inner = F.when(F.col("n") > 5, (F.col("squares") - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * F.col("a1") ** 2 - 2 * F.col("a2") ** 2)).otherwise(
        (F.col("squares") - 2 * m1 * m1) / (1 - 2 * F.col("a1") ** 2))
    wide, next_wide = F.col("y1") - F.col("x1"), F.col("y2") - F.col("x2")
    rest = F.col("met") - m1 * wide - F.when(F.col("n") > 5, m2 * next_wide).otherwise(0.0)
    line = F.when(F.col("n") == 3, 0.0).otherwise(rest / F.sqrt(inner)) + F.col("a1") * wide + F.when(F.col("n") > 5, F.col("a2") * next_wide).otherwise(0.0)
    w = F.when(F.col("n") < 3, None).when(wide <= 0, 1.0).otherwise(F.least(F.lit(1.0), line * line / F.col("deviations")))
    out = joined.withColumn("w", w).withColumn("z", normality_z(F.col("w"), n))
    tail = ds.normal_p(F.col("z"))
    p = F.when(F.col("w") == 1.0, 1.0).when(F.col("n") == 3, F.greatest(F.lit(0.0), 6 / np.pi * (F.asin(F.sqrt("w")) - F.asin(F.sqrt(F.lit(0.75)))))).when(
        F.col("z").isNull() & F.col("w").isNotNull(), 0.0).when(F.col("z") >= 0, tail / 2).otherwise(1 - tail / 2)
    return out.withColumn("p", p).select(group, "n", "w", "p", F.coalesce(F.col("p") > alpha, F.lit(True)).alias("normal"))


def normality_z(w: Column, n: Column) -> Column:
    """The statistic on the scale of a standard normal; null where it lies beyond what the transform reaches."""
    log = F.log(1 - w)
    shift = ds.polynomial(FEW_SHIFT, n)
    few = F.when(log < shift, (-F.log(shift - log) - ds.polynomial(FEW_MEAN, n)) / F.exp(ds.polynomial(FEW_SPREAD, n)))
    many = (log - ds.polynomial(MANY_MEAN, F.log(n))) / F.exp(ds.polynomial(MANY_SPREAD, F.log(n)))
    return F.when(w < 1, F.when(n < 12, few).otherwise(many))


def choose_test(rows: DataFrame, value: str, group: str, first: str, second: str, alpha: float = 0.05) -> DataFrame:
    """(test, statistic, p): the pooled t test if both groups pass as normal, else the rank test."""
    two = rows.filter(F.col(group).isin(first, second))
    both = normality(two, value, group, alpha).agg(F.min("normal").alias("normal"))
    # One row each.
    side = lambda name: moments(two, value, group).filter(F.col(group) == name)
    pair = side(first).select(*[F.col(c).alias(f"a_{c}") for c in ("n", "mean", "var")]).join(
        side(second).select(*[F.col(c).alias(f"b_{c}") for c in ("n", "mean", "var")]), F.lit(True))
    t = pooled(pair).select(F.lit("t").alias("test"), F.col("t").alias("statistic"), "p", F.lit(True).alias("when_normal"))
    u = mann_whitney(rows, value, group, first, second).select(F.lit("mann_whitney").alias("test"), F.col("u").alias("statistic"), "p", F.lit(False).alias("when_normal"))
    return t.unionByName(u).join(F.broadcast(both), F.col("when_normal") == F.coalesce("normal", F.lit(True))).select("test", "statistic", "p")


def _bounds(values: DataFrame, value: str, buckets: int) -> list[float]:
    """At most ``buckets`` cut points of the values."""
    probs = [i / buckets for i in range(1, buckets)]
    return sorted(set(values.approxQuantile(value, probs, 0.1 / buckets))) if probs else []


def average_ranks(rows: DataFrame, value: str, by: str | None = None, bucket_rows: int = 100_000) -> DataFrame:
    """(value, n, rank): the average rank of each distinct value over all rows.

    Counts per distinct value are ranged into buckets; a running count inside a bucket plus the
    total of the buckets below gives the rank. No window spans all rows. The counts are written once; their
    number gives the number of buckets, so that a bucket holds some ``bucket_rows`` values at any size."""
    counts = materialised(
        rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n")), "counts")
    cuts = _bounds(counts, "value", 1 + counts.count() // bucket_rows)
    edges = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    placed = counts.withColumn("bucket", F.size(F.filter(edges, lambda e: e < F.col("value"))))
    totals = placed.groupBy("bucket").agg(F.sum("n").alias("total"))
    below = totals.alias("a").join(totals.alias("b"), F.col("b.bucket") < F.col("a.bucket"), "left").groupBy("a.bucket").agg(
        F.coalesce(F.sum("b.total"), F.lit(0)).alias("below"))
    inside = F.sum("n").over(W.partitionBy("bucket").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    # At most one row per bucket.
    return placed.withColumn("upto", inside).join(F.broadcast(below), "bucket").select(
        "value", "n", (F.col("below") + F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))


def rank_sums(rows: DataFrame, value: str, group: str) -> DataFrame:
    """Per group: size and rank sum, with the number of rows and the tie term of the whole."""
    ranks = average_ranks(rows, value)
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("value")).agg(F.count("*").alias("m"))
    sums = counts.join(ranks.select("value", "rank"), "value").groupBy(group).agg(
        F.sum("m").alias("n"), F.sum(F.col("m") * F.col("rank")).alias("rank_sum"))
    whole = ranks.agg(F.sum("n").alias("total"), F.sum((F.col("n").cast("double") ** 3) - F.col("n")).alias("ties"))
    return sums.join(F.broadcast(whole), F.lit(True))


# The exact form is taken up to so many rows in the smaller group, without ties, while its table has so many cells.
EXACT_ROWS = 8
EXACT_CELLS = 100_000


def mann_whitney(rows: DataFrame, value: str, group: str, first: str, second: str) -> DataFrame:
    """U of ``first`` against ``second``, two-sided: ``p`` is exact if a group has at most ``EXACT_ROWS`` rows and no
    values tie, else the normal approximation with tie correction. ``exact`` says which; a group without rows leaves no p."""
    two = rows.filter(F.col(group).isin(first, second))
    sums = rank_sums(two, value, group)
    wide = sums.agg(
        F.coalesce(F.max(F.when(F.col(group) == first, F.col("n"))), F.lit(0)).cast("double").alias("n1"),
        F.coalesce(F.max(F.when(F.col(group) == second, F.col("n"))), F.lit(0)).cast("double").alias("n2"),
        F.coalesce(F.max(F.when(F.col(group) == first, F.col("rank_sum"))), F.lit(0.0)).alias("r1"), F.max("ties").alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide("ties", n * (n - 1))))
    out = wide.select(n1.alias("n1"), n2.alias("n2"), u.alias("u"), F.try_divide(F.abs(u - n1 * n2 / 2) - 0.5, sigma).alias("z"), "ties")
    both = (n1 > 0) & (n2 > 0)
    exact = both & (F.least(n1, n2) <= EXACT_ROWS) & (F.col("ties") == 0) & (n1 * n2 <= EXACT_CELLS)
    out = out.withColumn("exact", F.coalesce(exact, F.lit(False)))
    counted = ds.rank_sum_p(*[F.when(F.col("exact"), F.col(c)) for c in ("n1", "n2", "u")])
    approximate = F.when(both, F.least(F.lit(1.0), ds.normal_p(F.greatest(F.col("z"), F.lit(0.0)))))
    return out.withColumn("p", F.coalesce(counted, approximate)).drop("ties")


def anova(rows: DataFrame, value: str, group: str) -> DataFrame:
    """One-way F from the group moments."""
    m = moments(rows, value, group)
    grand = m.agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.count("*").alias("k"))
    s = m.join(F.broadcast(grand), F.lit(True)).agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("between"),
        F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("within"), F.max("k").alias("k"), F.max("total").alias("total"))
    df1, df2 = (F.col("k") - 1).cast("double"), (F.col("total") - F.col("k")).cast("double")
    out = s.select(df1.alias("df1"), df2.alias("df2"), ((F.col("between") / df1) / (F.col("within") / df2)).alias("f"))
    return out.withColumn("p", ds.f_p("f", "df1", "df2"))


def kruskal(rows: DataFrame, value: str, group: str) -> DataFrame:
    """H with tie correction."""
    s = rank_sums(rows, value, group).agg(
        F.max("total").cast("double").alias("n"), F.max("ties").alias("ties"), F.count("*").alias("k"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("q"))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    out = s.select((F.col("k") - 1).cast("double").alias("df"), h.alias("h"))
    return out.withColumn("p", ds.chi2_p("h", "df"))


def post_hoc(rows: DataFrame, value: str, group: str, overall: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Pooled t of every pair of groups at the Bonferroni level, if the overall test is significant."""
    pairs = pooled(group_pairs(moments(rows, value, group), group))
    n = pairs.agg(F.count("*").alias("n_pairs"))
    gate = overall.filter(F.col("p") < alpha).select(F.lit(True).alias("go"))
    return pairs.join(F.broadcast(n), F.lit(True)).join(F.broadcast(gate), F.lit(True)).withColumn(
        "alpha", F.lit(alpha) / F.col("n_pairs")).withColumn("significant", F.col("p") < F.col("alpha")).drop("go", "n_pairs")


def paired_difference_ci(runs: DataFrame, first: str, second: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Interval of the mean difference of two runs over the cases both have."""
    diff = runs.withColumn("difference", F.col(first) - F.col(second))
    return bootstrap_ci(diff, "difference", F.xxhash64("case_id"), (), replicates, seed)


def independent_difference_ci(rows: DataFrame, value: str, group: str, first: str, second: str, row_id: Column,
                              replicates: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Interval of the difference of two group means, each resampled by itself."""
    tail = (1 - level) / 2
    means = bootstrap_means(rows.filter(F.col(group).isin(first, second)), value, row_id, (group,), replicates, seed)
    wide = means.groupBy("replicate").agg(
        (F.max(F.when(F.col(group) == first, F.col("mean"))) - F.max(F.when(F.col(group) == second, F.col("mean")))).alias("d"))
    return wide.agg(F.percentile("d", F.lit(tail)).alias("lower"), F.percentile("d", F.lit(1 - tail)).alias("upper"))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for every pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = rows.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def regression(rows: DataFrame, y: str, x: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Slope, intercept and r per group, for groups of more than two rows."""
    good = rows.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    return good.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"),
                                 F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r")).filter(F.col("n") > 2)
