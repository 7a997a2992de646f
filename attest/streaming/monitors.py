"""Running monitors of parse failures and of judge confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.repair import error_class
from ..operators.judging import bin_index


def attempt_type(raw: str = "raw_output", success: str = "success"):
    return F.when(F.col(success), "success").otherwise(error_class(F.col(raw), F.lit(None).cast("string")))


def parse_monitor(attempts: DataFrame, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Attempts per window and outcome type. Works on a stream and on a table; on a stream the
    watermark bounds the state. The window and the lateness are choices of this engine."""
    rows = attempts.withColumn("error_type", attempt_type())
    if attempts.isStreaming:
        rows = rows.withWatermark("ts", lateness)
    return rows.groupBy(F.window("ts", window).alias("w"), "error_type").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), "error_type", "n")


def judge_monitor(judgements: DataFrame) -> DataFrame:
    """Running sums per confidence bin, from which the calibration follows. Eleven keys at most."""
    return judgements.groupBy(F.coalesce(bin_index(F.col("confidence")), F.lit(-1)).alias("bin")).agg(
        F.count("*").alias("n"), F.sum(F.col("gold").cast("bigint")).alias("n_right"), F.sum("confidence").alias("sum_confidence"))


def review_queue(judgements: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Judgements to review, as they arrive."""
    return judgements.filter(F.col("confidence") < threshold)


def run_available(stream: DataFrame, path: str, mode: str, state_partitions: int = 8) -> None:
    """Process what has arrived. Each batch has its own folder, so a batch that is run again after
    a failure replaces its own rows.

    The monitors hold few keys (windows x types, or bins) and are summed before the shuffle, so a
    handful of state partitions serves any input; the number is fixed when a stream first starts. A starting
    stream takes a copy of the session's settings, so the setting is changed for the start alone."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
    conf, name = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(name)
    conf.set(name, str(state_partitions))
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(
            availableNow=True).foreachBatch(save).start()
    finally:
        conf.set(name, before)
    query.awaitTermination()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last update of each key."""
    rows = spark.read.parquet(f"{path}/rows")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, "v.*")


def appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop("batch")


def replay(table: DataFrame, path: str, step: Callable[[DataFrame], None], parts: int = 4) -> None:
    """Let a stored table arrive in time order: write one time range, run ``step`` on the stream
    over the folder, write the next. The stream's checkpoint carries its state and watermark over."""
    seconds = F.col("ts").cast("double")
    cuts = sorted(set(table.select(seconds.alias("s")).approxQuantile("s", [i / parts for i in range(1, parts)], 0.01)))
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = table
        if low is not None:
            part = part.filter(seconds > low)
        if high is not None:
            part = part.filter(seconds <= high)
        part.write.mode("append").parquet(path)
        step(table.sparkSession.readStream.schema(table.schema).parquet(path))
