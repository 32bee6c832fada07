"""Structured Streaming forms: not part of what the surveyed tools do, an addition for feeds.

Cells and returns that arrive over time are folded into stored sums, and events
into tumbling windows with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of events (ts, event_type, value) by tumbling window; later events than `late` are left out on a stream."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def pixel_sums(points: DataFrame, res: float) -> DataFrame:
    """(px, py, n, z_sum, z_max): sums that can be merged with those of other batches."""
    return points.groupBy(F.floor(F.col("x") / res).cast("long").alias("px"), F.floor(F.col("y") / res).cast("long").alias("py")).agg(F.count("z").alias("n"), F.sum("z").alias("z_sum"), F.max("z").alias("z_max"))


def merged_sums(*parts: DataFrame) -> DataFrame:
    """The pixel sums of several batches made one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("px", "py").agg(F.sum("n").alias("n"), F.sum("z_sum").alias("z_sum"), F.max("z_max").alias("z_max"))


def fold_points(stream: DataFrame, path: str, res: float, checkpoint: str):
    """A query that writes each micro-batch's pixel sums under path, by batch, so that a batch done twice replaces itself."""
    def put(batch: DataFrame, epoch: int) -> None:
        pixel_sums(batch, res).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
