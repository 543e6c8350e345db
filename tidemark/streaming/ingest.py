"""Signals from a stream of events: daily sums under a watermark, folded into the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import model


def daily_cells(events: DataFrame, lateness: str = "2 days", ts: str = "ts") -> DataFrame:
    """(id, t, x): sum of value per user and day, t in days since 1970; on a stream, days close once the watermark passes."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("_ts", lateness)
    sums = rows.groupBy(F.col("user_id").alias("id"), F.window("_ts", "1 day").alias("w")).agg(F.sum("value").alias("x"))
    return sums.select("id", F.datediff(F.col("w.start"), F.lit("1970-01-01").cast("date")).alias("t"), "x")


def run(stream: DataFrame, path: str, checkpoint: str, lateness: str = "2 days"):
    """Append closed days to path; exactly once, by Spark's file sink."""
    return daily_cells(stream, lateness).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def signals(cells: DataFrame, first: int | None = None, days: int | None = None) -> DataFrame:
    """Signals over `days` days from day `first` on; without them, from the first day of the cells to the last."""
    if first is None or days is None:
        ends = cells.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()  # one row
        first = (ends["a"] or 0) if first is None else first
        days = max(1, (ends["b"] if ends["b"] is not None else first) - first + 1) if days is None else days
    return model.from_long(cells.withColumn("t", F.col("t") - first), days)
