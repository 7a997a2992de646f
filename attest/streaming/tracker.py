"""A running tracker of parse attempts: how many there were of each outcome, and the first examples of each error.

State is kept per outcome and spread key, so an outcome that holds most attempts is split over tasks. A key's state is a
count and a bounded list of examples, whatever the number of attempts. With an expiry, a key that sees nothing for so long, by the
stream's own time, drops its state and starts anew."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .monitors import attempt_type

SPREAD = 16
EXAMPLES = 3
PREVIEW = 500
OUTPUT = "error_type string, spread int, n bigint, examples array<struct<attempt_id:bigint,preview:string>>"
STATE = "n bigint, ids array<bigint>, previews array<string>"


def track(attempts: DataFrame, examples: int = EXAMPLES, preview: int = PREVIEW, spread: int = SPREAD, expiry_ms: int | None = None,
          lateness: str = "2 hours") -> DataFrame:
    """(error_type, spread, n, examples) as a stream of updates per key; ``tracked`` puts the last ones together."""
    text = F.when(F.col("success"), "").otherwise(F.substring("raw_output", 1, preview))
    if expiry_ms is not None:
        attempts = attempts.withWatermark("ts", lateness)
    rows = attempts.select("ts", attempt_type().alias("error_type"), F.pmod(F.xxhash64("attempt_id"), F.lit(spread)).cast("int").alias("spread"),
                           F.col("attempt_id").cast("bigint").alias("attempt_id"), text.alias("preview"))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, ids, previews = state.get if state.exists else (0, [], [])
        best, latest = list(zip(ids, previews)), 0
        for batch in batches:
            n += len(batch)
            latest = max(latest, int(batch["ts"].max().timestamp() * 1000))
            first = batch.nsmallest(examples, "attempt_id")
            best = sorted([*best, *zip((int(i) for i in first["attempt_id"]), first["preview"])], key=lambda x: x[0])[:examples]
        state.update((n, [i for i, _ in best], [p for _, p in best]))
        if expiry_ms is not None:
            # The watermark has passed what is on time, so the timeout lies behind it.
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + expiry_ms)
        # A success leaves no example.
        shown = [] if key[0] == "success" else [{"attempt_id": i, "preview": p} for i, p in best]
        yield pd.DataFrame({"error_type": [key[0]], "spread": [int(key[1])], "n": [n], "examples": [shown]})
    timeout = GroupStateTimeout.NoTimeout if expiry_ms is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("error_type", "spread").applyInPandasWithState(update, OUTPUT, STATE, "update", timeout)


def tracked(updates: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """(error_type, n, examples) from the last update of each key: counts added up, the first examples of all spread keys."""
    first = F.slice(F.array_sort(F.flatten(F.collect_list("examples"))), 1, examples)
    return updates.groupBy("error_type").agg(F.sum("n").alias("n"), first.alias("examples"))
