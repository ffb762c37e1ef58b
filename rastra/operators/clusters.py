"""Clusters of cells, numbered from 1 in row-major order of their first cell; 0 is no cluster, null no data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpointed, dense_ids
from . import fixpoint
from .algebra import KEY
from .distance import index


def _numbered(cells: DataFrame, member: Column, layers: list[str], cost, steps, **options) -> DataFrame:
    """cells (KEY, value, layers) with ``id``: of members the cluster's number, else null."""
    seeded = cells.withColumn("seed", F.when(member, F.lit(0.0))).withColumn("tag", F.when(member, index()))
    found = fixpoint.propagate(seeded, layers, cost, steps=steps, **options).select(*KEY, "tag").where("tag is not null")
    found = checkpointed(found)
    ids = dense_ids(found, "tag", "id", ["raster_id"])
    return cells.join(found.join(ids, ["raster_id", "tag"]).select(*KEY, "id"), KEY, "left")


def _positive() -> Column:
    return F.coalesce(F.col("value") > 0, F.lit(False))


def cluster_id(cells: DataFrame, *, diagonals: bool = False, **options) -> DataFrame:
    """Connected cells of one positive value."""
    out = _numbered(cells.select(*KEY, "value"), _positive(), ["value"], fixpoint.same_value, fixpoint.STEPS if diagonals else fixpoint.STRAIGHT, **options)
    return out.select(*KEY, F.when(F.col("value").isNotNull(), F.coalesce("id", F.lit(0))).cast("long").alias("value"))


def disc(radius: float) -> list[tuple[int, int]]:
    """Steps no longer than the radius, in cells; its square is cut to an integer."""
    n, most = int(radius + 0.5), int(radius * radius)
    return [(r, c) for r in range(-n, n + 1) for c in range(-n, n + 1) if (r or c) and r * r + c * c <= most]


def fuzzy_cluster_id(cells: DataFrame, radius: float, cell_size: float = 1.0, **options) -> DataFrame:
    """Positive cells within the radius of each other chain together, whatever their values."""
    steps = disc(radius / cell_size) or fixpoint.STRAIGHT
    cost = fixpoint.both_positive if disc(radius / cell_size) else _never
    out = _numbered(cells.select(*KEY, "value"), _positive(), ["value"], cost, steps, **options)
    return out.select(*KEY, F.when(F.col("value").isNotNull(), F.coalesce("id", F.lit(0))).cast("long").alias("value"))


def _never(v, dr, dc):
    return v.at("there") * float("inf")


def cluster_id_with_obstacles(categories: DataFrame, obstacles: DataFrame, **options) -> DataFrame:
    """8-connected cells of one category; no diagonal between two obstacles.  An obstacle cell takes the cluster
    that most of its neighbours have (the smaller id of equals), else 0; other cells without a cluster are no data."""
    cells = categories.select(*KEY, "value").join(obstacles.select(*KEY, F.col("value").alias("blocked")), KEY)
    member = _positive() & F.coalesce(F.col("blocked") == 0, F.lit(False))
    out = checkpointed(_numbered(cells, member, ["value", "blocked"], fixpoint.same_value_around, fixpoint.STEPS, **options))
    moves = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in fixpoint.STEPS])
    near = out.where("id is not null").withColumn("m", F.explode(moves)).select("raster_id", (F.col("row") + F.col("m.dr")).alias("row"), (F.col("col") + F.col("m.dc")).alias("col"), "id")
    walls = out.where(_positive() & F.coalesce(F.col("blocked") > 0, F.lit(False))).select(*KEY)
    votes = near.join(walls, KEY, "left_semi").groupBy(*KEY, "id").agg(F.count("*").alias("n"))
    won = votes.groupBy(*KEY).agg(F.max_by("id", F.struct("n", -F.col("id"))).alias("won"))
    wall = _positive() & F.coalesce(F.col("blocked") > 0, F.lit(False))
    return out.join(won, KEY, "left").select(*KEY, F.when(wall, F.coalesce("won", F.lit(0))).otherwise(F.col("id")).cast("long").alias("value"))


def fuzzy_cluster_id_with_obstacles(items: DataFrame, obstacles: DataFrame, radius: float, cell_size: float = 1.0, **options) -> DataFrame:
    """Cells of one positive value within the radius, in one open area and in unblocked sight, chain together;
    an item on an obstacle is a cluster by itself; cells without an item are 0."""
    ground = items.select(*KEY, F.lit(1.0).alias("value"))
    areas = cluster_id_with_obstacles(ground, obstacles, **options).select(*KEY, F.col("value").alias("area"))
    cells = items.select(*KEY, "value").join(obstacles.select(*KEY, F.col("value").alias("blocked")), KEY).join(areas, KEY)
    found = disc(radius / cell_size)
    out = _numbered(cells, _positive(), ["value", "blocked", "area"], fixpoint.same_value_in_sight if found else _never, found or fixpoint.STRAIGHT, **options)
    return out.select(*KEY, F.when(F.col("value").isNotNull(), F.coalesce("id", F.lit(0))).cast("long").alias("value"))
