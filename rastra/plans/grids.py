"""Deterministic rasters and tables derived from the star schema, in Spark and, word for word, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geo import Georef
from ..operators.algebra import KEY, full_grid

N = 64
#: The grid's cells are degrees on the map.
MAP = Georef(N, N, -32.0, 40.0, 1.0, -1.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark, sf_dir, value) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    sums = lines.groupBy((F.col("l_suppkey") % N).cast("int").alias("row"), (F.col("l_partkey") % N).cast("int").alias("col")).agg(value.alias("value"))
    return full_grid(spark, N, N).drop("value").join(sums, ["row", "col"], "left")  # sums: a row for each cell at most


#: A grid of the size that the reference's own benchmark has.
WIDE = (768, 1024)


def wide(spark, sf_dir, value=None) -> DataFrame:
    """Lines dealt over 768 x 1024 cells: their quantities, or another aggregate; cells without a line have no data."""
    rows, cols = WIDE
    row, col = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % rows, (F.col("l_partkey") * 13 + F.col("l_suppkey")) % cols
    sums = table(spark, sf_dir, "lineitem").groupBy(row.cast("int").alias("row"), col.cast("int").alias("col")).agg((F.sum("l_quantity") if value is None else value).cast("double").alias("value"))
    return full_grid(spark, rows, cols).drop("value").join(sums, ["row", "col"], "left").select(*KEY, "value")


def _masked(cells: DataFrame, mask: str) -> DataFrame:
    return cells.select(*KEY, F.expr(f"case when {mask} then null else value end").alias("value"))


def demand(spark, sf_dir) -> DataFrame:
    return _masked(_lines(spark, sf_dir, F.sum("l_quantity")), "(row * 5 + col * 3) % 7 = 0")


def price(spark, sf_dir) -> DataFrame:
    return _masked(_lines(spark, sf_dir, F.min("l_extendedprice")), "(row * 3 + col) % 11 = 0")


def _counted(spark, sf_dir, expression: str) -> DataFrame:
    """An expression of row, col and n, the number of lines in the cell."""
    return _lines(spark, sf_dir, F.count("*")).withColumn("n", F.coalesce("value", F.lit(0))).select(*KEY, F.expr(expression).cast("double").alias("value"))


def landuse(spark, sf_dir) -> DataFrame:
    return _counted(spark, sf_dir, "(row div 3 * 7 + col div 4 * 13 + ((row * col) % 3) div 2 + (n div 2) % 2) % 4")


def obstacles(spark, sf_dir) -> DataFrame:
    return _counted(spark, sf_dir, "case when (row * 31 + col * 17 + n % 3) % 11 = 0 then 1 else 0 end")


def targets(spark, sf_dir) -> DataFrame:
    return _counted(spark, sf_dir, "case when (row * 29 + col * 41 + n % 2) % 97 = 0 then 1 + (row + col) % 5 else 0 end")


def weight(spark, sf_dir) -> DataFrame:
    return _counted(spark, sf_dir, "case when (row * 31 + col * 17 + n % 3) % 11 = 0 then null else 1 + (row * 7 + col * 3 + n) % 5 end")


def items(spark, sf_dir) -> DataFrame:
    return _counted(spark, sf_dir, "case when (row * row * 3 + col * 7 + row * col + n % 2) % 9 = 0 then 1 + (row + col) % 2 else 0 end")


def points(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("id"), ((key * 37 % 36000) / 100 - 180).alias("lon"), ((key * 53 % 16000) / 100 - 80).alias("lat"))


def rects(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey").cast("double")
    x0, y0 = -30 + k * 7 % 50 + 0.25, -20 + k * 11 % 50 + 0.5
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("polygon_id"), F.col("n_name").alias("name"), (k + 1).alias("value"), x0.alias("x0"), y0.alias("y0"), (x0 + 2.5 + k % 3).alias("x1"), (y0 + 1.25 + k % 4).alias("y1"))


SQL = """WITH RECURSIVE lines AS (SELECT (l_suppkey % 64)::INTEGER AS r, (l_partkey % 64)::INTEGER AS c, sum(l_quantity) AS q, min(l_extendedprice) AS p, count(*) AS n FROM lineitem GROUP BY 1, 2),
g AS MATERIALIZED (SELECT i.r, i.c, i.id, coalesce(n, 0)::BIGINT AS cnt, q AS qty, p AS least_price FROM (SELECT (k // 64)::INTEGER AS r, (k % 64)::INTEGER AS c, k::BIGINT AS id FROM range(4096) t(k)) i LEFT JOIN lines ON i.r = lines.r AND i.c = lines.c),
demand AS (SELECT r, c, CASE WHEN (r * 5 + c * 3) % 7 = 0 THEN NULL ELSE qty END AS v FROM g),
price AS (SELECT r, c, CASE WHEN (r * 3 + c) % 11 = 0 THEN NULL ELSE least_price END AS v FROM g),
landuse AS (SELECT r, c, id, ((r // 3 * 7 + c // 4 * 13 + ((r * c) % 3) // 2 + (cnt // 2) % 2) % 4)::DOUBLE AS v FROM g),
obstacles AS (SELECT r, c, id, CASE WHEN (r * 31 + c * 17 + cnt % 3) % 11 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM g),
targets AS (SELECT r, c, id, CASE WHEN (r * 29 + c * 41 + cnt % 2) % 97 = 0 THEN 1 + (r + c) % 5 ELSE 0 END::DOUBLE AS v FROM g),
weight AS (SELECT r, c, id, CASE WHEN (r * 31 + c * 17 + cnt % 3) % 11 = 0 THEN NULL ELSE 1 + (r * 7 + c * 3 + cnt) % 5 END::DOUBLE AS v FROM g),
items AS (SELECT r, c, id, CASE WHEN (r * r * 3 + c * 7 + r * c + cnt % 2) % 9 = 0 THEN 1 + (r + c) % 2 ELSE 0 END::DOUBLE AS v FROM g),
points AS (SELECT c_custkey AS id, (c_custkey * 37 % 36000) / 100.0::DOUBLE - 180 AS lon, (c_custkey * 53 % 16000) / 100.0::DOUBLE - 80 AS lat FROM customer),
rects AS (SELECT n_nationkey::BIGINT AS polygon_id, n_name AS name, n_nationkey + 1.0::DOUBLE AS value,
  -30 + (n_nationkey * 7) % 50 + 0.25::DOUBLE AS x0, -20 + (n_nationkey * 11) % 50 + 0.5::DOUBLE AS y0,
  -30 + (n_nationkey * 7) % 50 + 0.25::DOUBLE + 2.5 + n_nationkey % 3 AS x1, -20 + (n_nationkey * 11) % 50 + 0.5::DOUBLE + 1.25 + n_nationkey % 4 AS y1 FROM nation),
moves AS (SELECT dr, dc, CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2) ELSE 1.0 END AS d FROM (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) m(dr, dc)),
e8 AS (SELECT g.id AS s, (g.r + dr) * 64 + g.c + dc AS t, d, dr, dc, g.r * 64 + g.c + dc AS p, (g.r + dr) * 64 + g.c AS q FROM g, moves WHERE g.r + dr BETWEEN 0 AND 63 AND g.c + dc BETWEEN 0 AND 63)
"""
