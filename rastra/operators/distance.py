"""Distances, nearest targets and sums within reach on grids; no data is null.

Inputs are cells (raster_id, row, col, value).  Nearest targets that tie go to the first in row-major order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpointed
from . import fixpoint
from .algebra import KEY


def index() -> Column:
    """A cell's number in row-major order."""
    return F.shiftleft(F.col("row").cast("long"), 32) + F.col("col")


def _joined(target: DataFrame, **others: DataFrame) -> DataFrame:
    out = target.select(*KEY, F.col("value").alias("target"))
    for name, df in others.items():
        out = out.join(df.select(*KEY, F.col("value").alias(name)), KEY)
    return out


def _seeded(cells: DataFrame, seed) -> DataFrame:
    return cells.withColumn("seed", F.when(seed, F.lit(0.0))).withColumn("tag", F.when(seed, index()))


def _target() -> Column:
    return F.coalesce(F.col("target") != 0, F.lit(False))


def distance(target: DataFrame, cell_size: float = 1.0, *, cap: float = math.inf, **options) -> DataFrame:
    """Octile distance to the nearest non-zero cell; no data is impassable and stays; unreached is infinite (or ``cap``, in cells)."""
    cells = _seeded(_joined(target), _target()).withColumn("open", F.col("target").isNotNull().cast("double"))
    found = fixpoint.propagate(cells, ["open"], fixpoint.octile, limit=cap, **options)
    out = found.join(target.select(*KEY, F.col("value").alias("target")), KEY)
    label = F.least(F.col("label"), F.lit(float(cap))) * cell_size
    return out.select(*KEY, F.when(F.col("target").isNotNull(), label).alias("value"))


def distance_with_obstacles(target: DataFrame, obstacles: DataFrame, cell_size: float = 1.0, *, diagonals: bool = False, **options) -> DataFrame:
    """Obstacles (non-zero or no data) are impassable; a diagonal between two is open only with ``diagonals``."""
    cells = _seeded(_joined(target, blocked=obstacles), _target())
    found = fixpoint.propagate(cells, ["blocked"], fixpoint.past_obstacles if diagonals else fixpoint.around_obstacles, **options)
    return found.select(*KEY, (F.col("label") * cell_size).alias("value"))


def travel_distance(target: DataFrame, time: DataFrame, *, cap: float = math.inf, **options) -> DataFrame:
    """A step costs its length times the mean weight of its cells; no data of either raster stays no data."""
    cells = _joined(target, weight=time)
    cells = cells.withColumn("weight", F.when(F.col("target").isNotNull(), F.col("weight")))
    found = fixpoint.propagate(_seeded(cells, _target() & F.col("weight").isNotNull()), ["weight"], fixpoint.mean_weight, limit=cap, **options)
    out = found.join(cells.select(*KEY, "weight"), KEY)
    return out.select(*KEY, F.when(F.col("weight").isNotNull(), F.least(F.col("label"), F.lit(float(cap)))).alias("value"))


def _value_at_tag(found: DataFrame, value: DataFrame, default) -> DataFrame:
    at = value.select("raster_id", index().alias("tag"), F.col("value").alias("value"))
    out = found.join(at, ["raster_id", "tag"], "left")
    return out.select(*KEY, F.when(F.col("tag").isNull(), default).otherwise(F.col("value")).alias("value"))


def closest_target(target: DataFrame, **options) -> DataFrame:
    """The value of the nearest non-zero cell; the way may lead through no data."""
    found = fixpoint.propagate(_seeded(_joined(target), _target()), [], fixpoint.any_cell, **options)
    return _value_at_tag(found, target, F.lit(None).cast("double"))


def value_at_closest_target(target: DataFrame, value: DataFrame, **options) -> DataFrame:
    """``value`` at the nearest target; 0 if there is none."""
    found = fixpoint.propagate(_seeded(_joined(target), _target()), [], fixpoint.any_cell, **options)
    return _value_at_tag(found, value, F.lit(0.0))


def value_at_closest_travel_target(target: DataFrame, time: DataFrame, value: DataFrame, *, cap: float = math.inf, **options) -> DataFrame:
    """As above by travel cost (length times the weight of the cell entered); cells where ``value`` is no data are impassable and stay."""
    cells = _joined(target, weight=time, own=value)
    cells = cells.withColumn("weight", F.when(F.col("own").isNotNull(), F.col("weight")))
    found = fixpoint.propagate(_seeded(cells, _target() & F.col("own").isNotNull()), ["weight"], fixpoint.entered_weight, limit=cap, **options)
    picked = _value_at_tag(found, value, F.lit(0.0))
    keep = value.select(*KEY, F.col("value").alias("own"))
    return picked.join(keep, KEY).select(*KEY, F.when(F.col("own").isNotNull(), F.col("value")).alias("value"))


def reach(seeds: DataFrame, weight: DataFrame, limit: float, *, mean: bool) -> DataFrame:
    """(raster_id, srow, scol, row, col, cost): all cells that each seed reaches at a cost of at most ``limit``.

    The frontier of all seeds advances together by equi-joins on the cell; the result is as large as the answer.
    """
    if limit <= 0:
        raise ValueError("the largest cost must be positive")
    w = weight.where("value is not null").select(*KEY, F.col("value").alias("w"))
    if not w.where("w < 0").isEmpty():
        raise ValueError("weights must not be negative")
    pair = ["raster_id", "srow", "scol", "row", "col"]
    known = checkpointed(seeds.select("raster_id", F.col("row").alias("srow"), F.col("col").alias("scol"), "row", "col", F.lit(0.0).alias("cost")))
    moves = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc"), F.lit(fixpoint.length(r, c)).alias("d")) for r, c in fixpoint.STEPS])
    front = known
    while not front.isEmpty():
        here = front.join(w, KEY).withColumn("m", F.explode(moves)).select("raster_id", "srow", "scol", (F.col("row") + F.col("m.dr")).alias("row"), (F.col("col") + F.col("m.dc")).alias("col"), "cost", F.col("w").alias("w0"), F.col("m.d").alias("d"))
        step = F.col("d") / 2 * (F.col("w0") + F.col("w")) if mean else F.col("d") * F.col("w")
        new = here.join(w, KEY).withColumn("cost", F.col("cost") + step).where(F.col("cost") <= limit + 1e-9).groupBy(*pair).agg(F.min("cost").alias("cost"))
        old = known.select(*pair, F.col("cost").alias("old"))
        front = checkpointed(new.join(old, pair, "left").where("old is null or cost < old - 1e-9").select(*pair, "cost"))
        known = checkpointed(known.unionByName(front).groupBy(*pair).agg(F.min("cost").alias("cost")))
    return known


def sum_within_travel_distance(mask: DataFrame, resistance: DataFrame, value: DataFrame, limit: float, *, adjacent: bool = False) -> DataFrame:
    """For each non-zero cell of ``mask`` the sum of ``value`` over the cells within ``limit``, and over the ring beside them if ``adjacent``."""
    seeds = mask.where(F.coalesce(F.col("value") != 0, F.lit(False)))
    found = reach(seeds, resistance, limit, mean=True).drop("cost")
    if adjacent:
        moves = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in [(0, 0), *fixpoint.STRAIGHT]])
        found = found.withColumn("m", F.explode(moves)).select("raster_id", "srow", "scol", (F.col("row") + F.col("m.dr")).alias("row"), (F.col("col") + F.col("m.dc")).alias("col")).distinct()
    sums = found.join(value.where("value is not null").select(*KEY, "value"), KEY).groupBy("raster_id", "srow", "scol").agg(F.sum("value").alias("value"))
    to = sums.select("raster_id", F.col("srow").alias("row"), F.col("scol").alias("col"), "value")
    return seeds.select(*KEY).join(to, KEY, "left").select(*KEY, F.coalesce("value", F.lit(0.0)).alias("value"))


def sum_targets_within_travel_distance(targets: DataFrame, resistance: DataFrame, limit: float) -> DataFrame:
    """Each cell gets the sum of the targets from which it is within ``limit``; a target with unknown resistance reaches nothing."""
    seeds = targets.where(F.coalesce(F.col("value") != 0, F.lit(False)))
    able = seeds.join(resistance.where("value is not null").select(*KEY), KEY, "left_semi")
    found = reach(able, resistance, limit, mean=False)
    worth = seeds.select("raster_id", F.col("row").alias("srow"), F.col("col").alias("scol"), "value")
    sums = found.join(worth, ["raster_id", "srow", "scol"]).groupBy(*KEY).agg(F.sum("value").alias("sum"))
    return targets.select(*KEY).join(sums, KEY, "left").select(*KEY, F.coalesce("sum", F.lit(0.0)).alias("value"))
