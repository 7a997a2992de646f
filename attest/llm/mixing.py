"""Mixing sources to target weights.

Sizes are summed per source, targets are filled like water under a ceiling, and a document is emitted
floor(rate) times plus one seeded Bernoulli copy whose probability is the fraction.

Defined results: a null or empty text has size 0 and is emitted like any other row of its source; a null
source is a source of its own, ordered last; repeated rows, alike in id and text, share their decision;
an empty table gives an empty mix; a source whose texts are all empty has target 0 and rate 0. Columns
of other names pass through; a column that bears a name the operator adds is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, fresh, materialised, unit_hash

WEIGHTS = (5.0, 2.0, 1.0)
CEILING = 3
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_rates(sizes: DataFrame, weights=WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size).

    One row per source goes on, so the windows below sort the short list of sources, never documents. In
    order of ceiling per weight the sources that fill up come first; the first that does not, read off
    with what the fuller ones leave, fixes the level for all the others."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * ceiling
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = per_source.withColumn("weight", weight).withColumn("cap", cap).withColumn("fill", F.col("cap") / F.col("weight"))
    by_fill = W.orderBy("fill", F.col("source").asc_nulls_last())
    before, onward = by_fill.rowsBetween(W.unboundedPreceding, -1), by_fill.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    levels = ranked.withColumn("level", level)
    least = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(W.partitionBy())
    target = F.least(F.col("cap").cast("double"), least["level"] * F.col("weight"))
    return (
        levels.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0)))
        .select("source", "source_size", "target",
                F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate")))


def with_copies(docs: DataFrame, rates: DataFrame, seed: str = SEED, digest: Column | None = None) -> DataFrame:
    """Rows of ``docs`` with source_size, target, rate and ``copies``, the times the mix emits the row. The draw depends on the id
    and on ``digest``, by default one of the text."""
    docs = docs.drop("source_size", "target", "rate", "copies")
    of = fresh("rate_source", *docs.columns)
    joined = docs.join(rates.withColumnRenamed("source", of), F.col("source").eqNullSafe(F.col(of))).drop(of)
    whole = F.floor("rate")
    digest = F.md5(F.coalesce("text", F.lit(""))) if digest is None else digest
    extra = (unit_hash(F.lit(seed), F.col("doc_id"), digest) < F.col("rate") - whole).cast("bigint")
    return joined.withColumn("copies", whole + extra)


def mix(docs: DataFrame, weights=WEIGHTS, ceiling: int = CEILING, seed: str = SEED) -> DataFrame:
    """The mixed documents, with the columns of ``docs``; a row appears as often as it is emitted."""
    # Written, so that Spark knows the size of the list of sources before it plans the join with the texts.
    rates = materialised(source_rates(docs.select("source", n_words(F.col("text")).alias("size")), weights, ceiling), "rates")
    # The operator's columns stand beside those of ``docs``, whatever these are called.
    own = {c: fresh(f"own_{c}", *docs.columns) for c in ("source_size", "target", "rate", "copies") if c in docs.columns}
    copied = with_copies(docs.withColumnsRenamed(own), rates, seed)
    copy = fresh("copy", *copied.columns)
    emitted = copied.filter("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return emitted.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
