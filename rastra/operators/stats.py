"""Aggregates of cells; no data is skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import checkpointed


def _checked(qs: list[float]) -> Column:
    if any(not 0 <= q <= 1 for q in qs):
        raise ValueError("quantiles lie between 0 and 1")
    return F.array(*[F.lit(float(q)) for q in qs])


def quantiles(cells: DataFrame, qs: list[float], *, approximate: bool = False) -> DataFrame:
    """(raster_id, quantiles): linear interpolation at q (n - 1).

    Exact ones are found without a task that holds a raster: values are counted, the counts dealt by ranges of value,
    and summed up over the ranges; a quantile is the least value whose running count reaches its rank.
    ``approximate`` needs one pass only.
    """
    if approximate:
        return cells.groupBy("raster_id").agg(F.percentile_approx("value", _checked(qs), 100_000).cast("array<double>").alias("quantiles"))
    _checked(qs)
    counted = cells.where("value is not null").groupBy("raster_id", "value").agg(F.count("*").alias("__n"))
    placed = checkpointed(counted.repartitionByRange("raster_id", "value").withColumn("__p", F.spark_partition_id()))
    parts = placed.groupBy("raster_id", "__p").agg(F.sum("__n").alias("__n"))  # a row for each raster and partition
    before = Window.partitionBy("raster_id").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("raster_id", "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    total = parts.groupBy("raster_id").agg(F.sum("__n").alias("__all"))
    inner = Window.partitionBy("raster_id", "__p").orderBy("value")
    ranked = placed.withColumn("__upto", F.sum("__n").over(inner)).join(base, ["raster_id", "__p"]).join(total, "raster_id")
    upto = F.col("__base") + F.col("__upto")
    place = [F.lit(float(q)) * (F.col("__all") - 1) for q in qs]
    least = lambda rank: F.min(F.when(upto >= rank + 1, F.col("value")))
    ends = ranked.groupBy("raster_id").agg(F.max("__all").alias("__all"), *[f for k, p in enumerate(place) for f in (least(F.floor(p)).alias(f"__a{k}"), least(F.ceil(p)).alias(f"__b{k}"))])
    between = [F.col(f"__a{k}") + (F.col(f"__b{k}") - F.col(f"__a{k}")) * (p - F.floor(p)) for k, p in enumerate(place)]
    return cells.select("raster_id").distinct().join(ends, "raster_id", "left").select("raster_id", F.when(F.col("__all").isNotNull(), F.array(*between)).alias("quantiles"))


def quantiles_neg_pos(cells: DataFrame, qs: list[float]) -> DataFrame:
    """(raster_id, negative, positive): quantiles of the values below zero and of the others."""
    v = F.col("value")
    part = lambda keep, name: quantiles(cells.withColumn("value", F.when(keep, v)), qs).withColumnRenamed("quantiles", name)
    return part(v < 0, "negative").join(part(v >= 0, "positive"), "raster_id")


def statistics(cells: DataFrame, qs: list[float]) -> DataFrame:
    """min, max, mean, median, population deviation, quantiles, counts and sum of each raster."""
    v = F.col("value")
    simple = cells.groupBy("raster_id").agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"),
        F.count(v).alias("data_count"), F.count_if(v.isNull()).alias("nodata_count"), F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"),
    )
    ranks = quantiles(cells, [0.5, *qs]).select("raster_id", F.col("quantiles")[0].alias("median"), F.expr(f"slice(quantiles, 2, {len(qs)})").alias("quantiles"))
    return simple.join(ranks, "raster_id")


def min_max(cells: DataFrame) -> DataFrame:
    return cells.groupBy("raster_id").agg(F.min("value").alias("min"), F.max("value").alias("max"))


def counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("raster_id").agg(F.count("*").alias("cells"), F.count_if(F.col("value").isNull()).alias("nodata_count"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("sum"))
