"""Self-consistency: votes of several samples, clusters of equal labels, and the winner list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .topk import top_k

CLUSTER = ["case_id", "leader"]


def pool_votes(parsed: DataFrame) -> DataFrame:
    """Votes of successful attempts, blank labels dropped, list position kept. ``parsed`` holds
    case_id, sample_idx, parse_success, items."""
    return parsed.filter("parse_success").select("case_id", "sample_idx", F.posexplode("items").alias("position", "v")).filter(
        F.trim("v.label") != "").select("case_id", "sample_idx", "position", "v.label", "v.reasoning")


def label_counts(votes: DataFrame) -> DataFrame:
    return votes.groupBy("case_id", "label").agg(F.count("*").alias("n"))


def lead_clusters(votes: DataFrame, vectors: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(case_id, label, leader): labels by frequency, then by name, join the first cluster whose
    leader's cosine reaches the threshold, or open one.

    The order matters, so the counted labels of a case are read in that order within one
    partition; only the leaders of the current case are held. Labels without a vector stand alone."""
    counts = label_counts(votes).join(vectors.select("label", "vector"), "label", "left")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        case, leaders, units = None, [], []
        for batch in batches:
            chosen = []
            for current, label, vector in zip(batch["case_id"], batch["label"], batch["vector"]):
                if current != case:
                    case, leaders, units = current, [], []
                unit = None
                if vector is not None:
                    v = np.asarray(vector, dtype=np.float64)
                    size = np.sqrt(v @ v)
                    unit = v / size if size else v
                at = None if unit is None else next(
                    (i for i, u in enumerate(units) if u is not None and u @ unit >= threshold), None)
                if at is None:
                    leaders.append(label)
                    units.append(unit)
                    at = len(leaders) - 1
                chosen.append(leaders[at])
            yield pd.DataFrame({"case_id": batch["case_id"], "label": batch["label"], "leader": chosen})
    kind = votes.schema["case_id"].dataType.simpleString()
    ordered = counts.repartition("case_id").sortWithinPartitions("case_id", F.desc("n"), "label")
    return ordered.mapInPandas(walk, f"case_id {kind}, label string, leader string")


def cluster_statistics(votes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster: distinct samples, mean position, canonical label, best reasoning, score."""
    rows = votes.join(clusters, ["case_id", "label"])
    per_label = rows.groupBy(*CLUSTER, "label").agg(F.count("*").alias("n")).groupBy(*CLUSTER).agg(
        F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("canonical"))
    early = (F.col("position") <= 1).cast("int")
    order = -(F.col("sample_idx") * 1000 + F.col("position"))
    stats = rows.groupBy(*CLUSTER).agg(
        F.count_distinct("sample_idx").alias("vote_count"), F.avg("position").alias("avg_position"),
        F.max_by("reasoning", F.struct(early.alias("a"), F.length("reasoning").alias("b"), order.alias("c"))).alias("best_reasoning"))
    return stats.join(per_label, CLUSTER).withColumn("score", 100 * F.col("vote_count") - F.col("avg_position"))


def winners(stats: DataFrame, n: int = 5) -> DataFrame:
    """The best clusters of a case in order; ``success`` if it has at least three."""
    ranked = top_k(stats, n, ["case_id"], [F.desc(F.round("score", 9)), F.asc("canonical")])
    size = stats.groupBy("case_id").agg((F.count("*") >= 3).alias("success"))
    return ranked.join(size, "case_id")


def audit(attempts: DataFrame, votes: DataFrame, stats: DataFrame) -> DataFrame:
    """Per case: parsed and failed samples, votes pooled, clusters."""
    parts = [
        attempts.select("case_id", F.col("parse_success").cast("int").alias("ok"), (~F.col("parse_success")).cast("int").alias("bad"),
                        F.lit(0).alias("vote"), F.lit(0).alias("cluster")),
        votes.select("case_id", F.lit(0).alias("ok"), F.lit(0).alias("bad"), F.lit(1).alias("vote"), F.lit(0).alias("cluster")),
        stats.select("case_id", F.lit(0).alias("ok"), F.lit(0).alias("bad"), F.lit(0).alias("vote"), F.lit(1).alias("cluster")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("case_id").agg(
        F.sum("ok").alias("n_parsed"), F.sum("bad").alias("n_failed"), F.sum("vote").alias("n_pooled"), F.sum("cluster").alias("n_clusters"))


def run_rates(audits: DataFrame) -> DataFrame:
    return audits.agg(
        F.count("*").alias("n_cases"), (F.sum("n_parsed") / (F.sum("n_parsed") + F.sum("n_failed"))).alias("parse_rate"),
        F.avg("n_clusters").alias("clusters_per_case"), F.avg((F.col("n_clusters") >= 3).cast("double")).alias("success_rate"))
