"""Scores of pairs kept across runs.

The store is a folder of score tables, one per run, keyed by a digest of scorer, premise and sentence. A run reads the
digests it already has, sends the scorer only the pairs that none has, and adds them as a table of its own. A run that is
repeated under its name replaces its own table, so nothing is added twice; a table counts once it is whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.exports import manifest, read_export, write_export
from . import scoring

SCORES = ("entailment", "neutral", "contradiction")
SCHEMA = "pair_key string, entailment double, neutral double, contradiction double"


def pair_key(scorer: str):
    """128 bits over the name of the scorer and both texts; null if a text is null."""
    sized = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.md5(F.concat(F.lit(f"{len(scorer.encode())}:{scorer}"), sized(F.col("premise")), sized(F.col("sentence"))))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All scores of whole runs, one row per pair; of a pair that two runs scored at the same time, one score stays."""
    from pyarrow import fs
    system, place = fs.FileSystem.from_uri(path)
    out = spark.createDataFrame([], SCHEMA)
    if system.get_file_info(place).type == fs.FileType.Directory:
        # One folder per run.
        for run in sorted(f.base_name for f in system.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.Directory):
            if manifest(f"{path}/{run}"):
                out = out.unionByName(read_export(spark, f"{path}/{run}", "scores"))
    return out.groupBy("pair_key").agg(F.min(F.struct(*SCORES)).alias("s")).select("pair_key", "s.*")


def score_pairs(pairs: DataFrame, load: Callable[[], Callable[[list[tuple[str, str]]], list]], path: str, run: str, scorer: str = "") -> DataFrame:
    """``pairs`` with entailment, neutral, contradiction, as ``scoring.score_pairs`` gives them; pairs that the store has
    don't reach the scorer. ``scorer`` names the model, so that two models don't share scores."""
    spark = pairs.sparkSession
    keyed = pairs.drop("pair_key", *SCORES).withColumn("pair_key", pair_key(scorer))
    asked = keyed.filter(F.col("pair_key").isNotNull()).select("pair_key", "premise", "sentence").dropDuplicates(["pair_key"])
    missing = asked.join(stored(spark, path).select("pair_key"), "pair_key", "left_anti")
    if missing.take(1):
        new = scoring.score_pairs(missing, load).select("pair_key", *SCORES)
        if manifest(f"{path}/{run}"):
            # The run is repeated with more pairs: what it had stays in its table.
            new = read_export(spark, f"{path}/{run}", "scores").unionByName(new)
        write_export({"scores": (new, "parquet")}, f"{path}/{run}")
    return keyed.join(stored(spark, path), "pair_key", "left").drop("pair_key")
