"""Mosaic of a stream of cells: the value with the latest time stays.  An extension; batch mosaics are in operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def latest(cells: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(window, raster_id, row, col, value) of a stream (ts, raster_id, row, col, value); late cells beyond ``delay`` are dropped by the watermark."""
    marked = cells.withWatermark("ts", delay).where("value is not null")
    return marked.groupBy(F.window("ts", window), "raster_id", "row", "col").agg(F.max_by("value", "ts").alias("value"))


def merge_into(path: str):
    """foreachBatch function that keeps the newest value of each cell in a Parquet table, a version for each batch."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("raster_id", "row", "col", "ts", "value").where("value is not null")
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{path}/v{number - 1}"))
        newest = rows.groupBy("raster_id", "row", "col").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))
        newest.write.mode("overwrite").parquet(f"{path}/v{number}")

    return run
