"""Training rows from scored outputs. The selection rules are this library's own, stated with each function.

Rows hold the keys of a group, an ``item`` (what can be chosen) and a ``score``. All rules are aggregates per group with a
map-side part, so a group may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Training rows with texts: what was asked, and what was said.
PREFERENCE = ["prompt", "chosen", "rejected"]
SUPERVISED = ["prompt", "response"]

MARGIN = 0.1
HIGH_REWARD = 0.7


def preference_pairs(rows: DataFrame, keys: list[str], margin: float = MARGIN) -> DataFrame:
    """(keys, chosen, rejected, margin): the best and the worst item of a group, if they are ``margin`` or more apart.
    Of equal scores the larger item is chosen and the smaller rejected; null scores take no part."""
    pair = F.struct("score", "item")
    ends = rows.filter("score is not null").groupBy(*keys).agg(F.max(pair).alias("best"), F.min(pair).alias("worst"))
    apart = F.round(F.col("best.score") - F.col("worst.score"), 9)
    return ends.select(*keys, F.col("best.item").alias("chosen"), F.col("worst.item").alias("rejected"), apart.alias("margin")).filter(
        F.col("margin") >= margin)


def run_pairs(rows: DataFrame, keys: list[str], margin: float = MARGIN) -> DataFrame:
    """(keys, chosen, rejected, margin): every two runs of a case of which one is more than ``margin`` better. A case has
    one row per run, so its pairs are as many as the pairs of runs."""
    a, b = (rows.select(*keys, F.col("item").alias(n), F.col("score").alias(f"{n}_score")) for n in ("chosen", "rejected"))
    apart = F.round(F.col("chosen_score") - F.col("rejected_score"), 9)
    return a.join(b, keys).withColumn("margin", apart).filter(F.col("margin") > margin).select(*keys, "chosen", "rejected", "margin")


def group_advantages(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``advantage``: the score less the group's mean over its deviation; 0 where all scores are equal."""
    stats = rows.groupBy(*keys).agg(F.avg("score").alias("_mean"), F.stddev_pop("score").alias("_std"))
    return rows.join(stats, keys).withColumn(
        "advantage", F.when(F.col("_std") > 1e-12, (F.col("score") - F.col("_mean")) / F.col("_std")).otherwise(0.0)).drop("_mean", "_std")


def supervised_rows(rows: DataFrame, keys: list[str], least: float = HIGH_REWARD) -> DataFrame:
    """(keys, item, score): the best item of each group whose score is ``least`` or more; of equal scores the smallest."""
    best = rows.filter(F.col("score") >= least).groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("loss"), "item")).alias("b"))
    return best.select(*keys, F.col("b.item").alias("item"), (-F.col("b.loss")).alias("score"))


def with_texts(rows: DataFrame, prompts: DataFrame, responses: DataFrame, keys: list[str], prompt_keys: list[str], items: tuple[str, ...]) -> DataFrame:
    """``rows`` with the prompt of their group and, in place of each named item, the text that was said.

    ``prompts`` holds prompt_keys and ``prompt``, ``responses`` keys, ``item`` and ``response``. The texts of the chosen items alone are
    shuffled: responses nobody chose are left out by a semi-join on keys first. A row whose texts are missing is dropped, as there is
    nothing to learn from it."""
    wanted = rows.select(*keys, F.explode(F.array(*items)).alias("item")).distinct()
    said = responses.join(wanted, [*keys, "item"], "left_semi").filter(F.col("response").isNotNull())
    out = rows
    for item in items:
        out = out.join(said.select(*keys, F.col("item").alias(item), F.col("response").alias(f"{item}_text")), [*keys, item])
    asked = prompts.filter(F.col("prompt").isNotNull())
    named = [F.col(f"{i}_text").alias(i if len(items) > 1 else "response") for i in items]
    return out.join(asked.select(*prompt_keys, "prompt"), prompt_keys).select(*keys, "prompt", *named, *[c for c in rows.columns if c not in (*keys, *items)])
