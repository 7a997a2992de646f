"""The corpus pipeline: five stages; the documents each returns are written as Parquet for the next one.

A stage is called when the documents of the one before have been written, and then removes what that one kept in the
shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attest.llm import bpe, mixing, neardup, quality, suffixes
from attest.session import materialised, release, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules go, and those that fail a soft rule in a host that mostly fails."""
    return quality.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words a shingle, a similarity of 0.8 or more."""
    return neardup.kept(docs, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has are cut; n_chars follows the text."""
    cut = suffixes.cleaned(docs)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else cut


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat so that sources come near their target shares."""
    return mixing.mix(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text that is left."""
    return bpe.digests(docs)


_kept: dict[int, list[str]] = {}


def _stage(number: int, work):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for earlier in [n for n in _kept if n < number]:
            release(_kept.pop(earlier))
        mark = len(scratch())
        out = work(spark, docs, sf_dir)
        _kept[number] = scratch()[mark:]
        return out
    return stage


STAGES = [(name, _stage(number, work)) for number, (name, work) in enumerate((
    ("quality rules", quality_rules), ("near dedup", near_dedup), ("suffix dedup", suffix_dedup), ("mixing", mixing_sources), ("bpe", bpe_encoding)))]

# Prefix doubling and merges have no SQL; the stages are tested one by one and the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
