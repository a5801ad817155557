"""Incremental traces: an append-only stream of probe facts kept as one table of counts.

Events may come more than once. Each micro-batch is reduced to its last record of a
key and appended under its batch number; readers take the last record of each key.
A batch that is repeated after a failure overwrites its own folder, so it counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import latest


def start(stream: DataFrame, keys: list[str], order: str, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    def put(batch: DataFrame, number: int) -> None:
        latest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    return latest(spark.read.parquet(path), keys, order).drop("batch")


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event time and kind with a watermark, for a stream or a table."""
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w, kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")
