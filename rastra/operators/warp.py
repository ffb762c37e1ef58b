"""Reprojection: target grids of rasters in another system, and nearest-neighbour warps onto them.

A warp generates the target's cells in parallel, takes each cell's centre back to the source by the column
expressions of ``functions.crs``, and equi-joins the source cell that holds it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import crs, geo
from ..functions.geo import Georef
from ..session import checkpointed
from .algebra import KEY

EDGE_POINTS = 25


def _edge(start, end, n: int):
    t = np.linspace(0.0, 1.0, max(2, n))
    return start[0] + t * (end[0] - start[0]), start[1] + t * (end[1] - start[1])


def warped_box(box, source, target, points: int = EDGE_POINTS) -> tuple[float, float, float, float]:
    """The box around a box's edges, sampled, in another system."""
    x0, y0, x1, y1 = box
    sides = [_edge(a, b, points) for a, b in (((x0, y1), (x1, y1)), ((x1, y1), (x1, y0)), ((x1, y0), (x0, y0)), ((x0, y0), (x0, y1)))]
    x, y = crs.transform(np.concatenate([s[0] for s in sides]), np.concatenate([s[1] for s in sides]), source, target)
    return float(x.min()), float(y.min()), float(x.max()), float(y.max())


def georeference(source: Georef, source_srs, target_srs, *, size: tuple[int, int] | None = None, cell: tuple[float, float] | None = None, aligned: bool = False, exact: Georef | None = None) -> Georef:
    """The grid of a raster in another system.

    By default cells are square and the diagonal keeps its number of cells; or ``size`` (rows, cols) fills the
    box; or cells of size ``cell`` (cx, cy) do, their edges at multiples of the size if ``aligned``; or it is ``exact``.
    """
    if exact is not None:
        return exact
    source_srs, target_srs = crs.parse(source_srs), crs.parse(target_srs)
    x0, y0, x1, y1 = warped_box(source.box, source_srs, target_srs)
    if size is None or cell is not None:
        a, b = source.box, crs.transform(np.array([source.box[0], source.box[2]]), np.array([source.box[3], source.box[1]]), source_srs, target_srs)
        across = math.hypot(a[2] - a[0], a[3] - a[1]) / source.cx
        step = math.hypot(b[0][1] - b[0][0], b[1][1] - b[1][0]) / across
        rows, cols = math.floor((y1 - y0) / step + 0.5), math.floor((x1 - x0) / step + 0.5)
        natural = Georef(rows, cols, x0, y1, step, -step)
        if cell is None:
            return natural
    else:
        natural = None
    if cell is not None:
        cx, cy = cell[0], abs(cell[1])
        x0, y0, x1, y1 = natural.box
        if aligned:
            x0, x1, y0, y1 = math.floor(x0 / cx) * cx, math.ceil(x1 / cx) * cx, math.floor(y0 / cy) * cy, math.floor(y1 / cy) * cy
        return geo.from_bottom_left(math.floor((y1 - y0) / cy + 0.5), math.floor((x1 - x0) / cx + 0.5), x0, y0, cx, cy)
    rows, cols = size
    return geo.from_bottom_left(rows, cols, x0, y0, (x1 - x0) / cols, (y1 - y0) / rows)


def _grid(spark, g: Georef) -> DataFrame:
    return spark.range(g.rows * g.cols).select(F.expr(f"cast(id div {g.cols} as int)").alias("row"), (F.col("id") % g.cols).cast("int").alias("col"))


def places(spark, source: Georef, target: Georef, source_srs, target_srs, error: float = 0.0) -> DataFrame:
    """For each target cell (row, col) the source cell (__r, __c) that holds its centre.

    With ``error`` (in source cells) a row of the target is interpolated between its ends, where the middle of the
    row shows that this is off by no more; other rows stay exact.
    """
    source_srs, target_srs = crs.parse(source_srs), crs.parse(target_srs)

    def back(df: DataFrame, row, col, r: str, c: str) -> DataFrame:
        out = crs.project(df, *geo.centre(row, col, target), target_srs, source_srs, ("__x", "__y"))
        return out.withColumns({r: (F.col("__y") - source.y0) / source.cy, c: (F.col("__x") - source.x0) / source.cx}).drop("__x", "__y")

    whole = lambda r, c: (F.floor(r).cast("int").alias("__r"), F.floor(c).cast("int").alias("__c"))
    if error <= 0:
        return back(_grid(spark, target), F.col("row"), F.col("col"), "r", "c").select("row", "col", *whole("r", "c"))
    last, rows = target.cols - 1, spark.range(target.rows).select(F.col("id").cast("int").alias("row"))
    for k, v in (("a", 0.0), ("b", last / 2), ("z", float(last))):
        rows = back(rows, F.col("row"), F.lit(v), f"r{k}", f"c{k}")
    rows = checkpointed(rows)  # a row for each row of the target; else conditions on it would be written out down to its start
    off = F.greatest(*[F.abs((F.col(f"{n}a") + F.col(f"{n}z")) / 2 - F.col(f"{n}b")) for n in "rc"])
    grid = rows.withColumn("ok", F.coalesce(off <= error, F.lit(False))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(last))))
    line = lambda n: F.col(f"{n}a") + (F.col(f"{n}z") - F.col(f"{n}a")) * (F.col("col") / max(1, last))
    near = grid.where("ok").select("row", "col", *whole(line("r"), line("c")))
    exact = back(grid.where("not ok").select("row", "col"), F.col("row"), F.col("col"), "r", "c").select("row", "col", *whole("r", "c"))
    return near.unionByName(exact)


def warp(cells: DataFrame, source: Georef, target: Georef, source_srs="EPSG:4326", target_srs="EPSG:3857", *, error: float = 0.0, raster_id: str = "warped") -> DataFrame:
    """The raster on the target grid, nearest neighbour; cells that fall outside the source are no data."""
    at = places(cells.sparkSession, source, target, source_srs, target_srs, error)
    from_ = cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), "value")
    return at.join(from_, ["__r", "__c"], "left").select(F.lit(raster_id).alias("raster_id"), "row", "col", "value").select(*KEY, "value")


def translate(cells: DataFrame, source: Georef, *, window: tuple[float, float, float, float] | None = None, size: tuple[int, int] | None = None) -> tuple[DataFrame, Georef]:
    """A raster cut to a box (west, south, east, north) and, or, resized to (rows, cols) by nearest neighbour."""
    west, south, east, north = window or source.box
    c0, r0 = math.floor((west - source.x0) / source.cx + 1e-9), math.floor((north - source.y0) / source.cy + 1e-9)
    c1, r1 = math.ceil((east - source.x0) / source.cx - 1e-9), math.ceil((south - source.y0) / source.cy - 1e-9)
    part = Georef(r1 - r0, c1 - c0, source.x0 + c0 * source.cx, source.y0 + r0 * source.cy, source.cx, source.cy)
    rows, cols = size or (part.rows, part.cols)
    to = Georef(rows, cols, part.x0, part.y0, part.cx * part.cols / cols, part.cy * part.rows / rows)
    grid = _grid(cells.sparkSession, to)
    r, c = (F.floor((F.col(n) + 0.5) * (k / m)).cast("int") + o for n, k, m, o in (("row", part.rows, rows, r0), ("col", part.cols, cols, c0)))
    from_ = cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), "value")
    out = grid.select("row", "col", r.alias("__r"), c.alias("__c")).join(from_, ["__r", "__c"], "left")
    return out.select(F.lit("r").alias("raster_id"), "row", "col", "value"), to
