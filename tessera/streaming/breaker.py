"""The circuit breaker over a stream of requests: its counter of errors in a row is the state of each caller.

The batch form is operators.translate.error_runs(). Order is that of `order` within a micro-batch and of arrival between
micro-batches, so a log that arrives in order gives the same openings as in one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _count(limit: int) -> Callable:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (n,) = state.get if state.exists else (0,)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        opened = []
        for event_id, bad in zip(rows["event_id"], rows["is_error"], strict=True):
            n = n + 1 if bad else 0
            if n == limit:
                opened.append(event_id)
        state.update((n,))
        yield pd.DataFrame({"caller": [key[0]] * len(opened), "event_id": opened}).astype({"caller": "int64", "event_id": "int64"})

    return run


def openings(log: DataFrame, limit: int) -> DataFrame:
    """caller, event_id: the requests (caller, event_id, ts, is_error) with which a caller's errors in a row reach
    `limit`. For a stream or a table."""
    if log.isStreaming:
        rows = log.select("caller", "event_id", "ts", "is_error").groupBy("caller")
        return rows.applyInPandasWithState(_count(limit), "caller long, event_id long", "n int", "append", GroupStateTimeout.NoTimeout)
    w = Window.partitionBy("caller").orderBy("ts", "event_id")
    runs = log.withColumn("run", F.sum(F.when(F.col("is_error"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("is_error")
    nth = F.row_number().over(Window.partitionBy("caller", "run").orderBy("ts", "event_id"))
    return runs.withColumn("n", nth).filter(F.col("n") == limit).select("caller", "event_id")


def requests(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("caller"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("is_error"))


def watched_errors(log: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Errors and requests in each window of event time; rows later than `late` are left out of a stream."""
    counted = log.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"))
    return counted.agg(F.count(F.lit(1)).alias("requests"), F.count_if("is_error").alias("errors")).select("w.start", "requests", "errors")


def run_to(stream: DataFrame, path: str, checkpoint: str, **options: Any) -> None:
    """Process all that has arrived, into Parquet files."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start()
    query.awaitTermination()
