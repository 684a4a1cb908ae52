"""A pyramid level kept up to date by a stream of points: additions commute, so counts per cell are all the state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import geo


def cell_counts(points: DataFrame, level: int, items: list[str], time: str | None = None, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Streaming (col, row, *items[, start], m); with a time column the counts are for windows, and state older than the watermark goes."""
    inside = points.where(geo.in_world("x", "y"))
    keys = [F.expr(geo.col("x", level)).alias("col"), F.expr(geo.row("y", level)).alias("row"), *map(F.col, items)]
    if time is None:
        return inside.groupBy(*keys).agg(F.count("*").alias("m"))
    out = inside.withWatermark(time, late).groupBy(F.window(time, window).alias("_w"), *keys).agg(F.count("*").alias("m"))
    return out.select(F.col("_w.start").alias("start"), "col", "row", *items, "m")


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Write updates of a cell table as Parquet parts with their batch number; merged() reads the latest."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/b={number}")

    return stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark, path: str) -> DataFrame:
    got = spark.read.parquet(path).drop("b")
    keys = [c for c in got.columns if c not in ("m", "batch")]
    return got.groupBy(*keys).agg(F.max_by("m", "batch").alias("m"))
