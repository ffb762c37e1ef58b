"""Polygons on grids: coverage shares, border adjustment, burning values.

Polygons are rings of (x, y); a cell's share is the area of the polygon clipped to it.  Each polygon becomes
one row for each row of cells that its box touches (a range, no join against the grid).  There its ring is cut to the row
once, and the areas left of all cell edges, by an integral along the ring, give the areas of the row's cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.geo import Georef


def ring_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2 if len(ring) > 2 else 0.0


def clip(ring: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """The ring cut by a box, side after side."""
    for axis, limit, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        if not len(ring):
            break
        inside = sign * (ring[:, axis] - limit) >= 0
        if inside.all():
            continue
        out = []
        for k in range(len(ring)):
            a, b = ring[k - 1], ring[k]
            if inside[k - 1] != inside[k]:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                out.append(a + t * (b - a))
            if inside[k]:
                out.append(b)
        ring = np.array(out).reshape(-1, 2)
    return ring


def _bbox_cells(shapes: DataFrame, g: Georef, x0, y0, x1, y1) -> DataFrame:
    c0, c1 = F.floor((x0 - g.x0) / g.cx), F.ceil((x1 - g.x0) / g.cx) - 1
    r0, r1 = F.floor((y1 - g.y0) / g.cy), F.ceil((y0 - g.y0) / g.cy) - 1
    clamp = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), c)).cast("int")
    some = (c1 >= 0) & (c0 < g.cols) & (r1 >= 0) & (r0 < g.rows) & (c1 >= c0) & (r1 >= r0)
    return shapes.where(some).withColumn("row", F.explode(F.sequence(clamp(r0, g.rows), clamp(r1, g.rows)))).withColumn("col", F.explode(F.sequence(clamp(c0, g.cols), clamp(c1, g.cols))))


def rect_coverage(rects: DataFrame, g: Georef) -> DataFrame:
    """rects (polygon_id, name, value, x0, y0, x1, y1) to covered cells with coverage (share of the polygon)
    and cell_coverage (share of the cell); expressions only."""
    cells = _bbox_cells(rects, g, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    cx0, cy1 = F.lit(g.x0) + F.col("col") * g.cx, F.lit(g.y0) + F.col("row") * g.cy
    w = F.least(F.col("x1"), cx0 + g.cx) - F.greatest(F.col("x0"), cx0)
    h = F.least(F.col("y1"), cy1) - F.greatest(F.col("y0"), cy1 + g.cy)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return cells.withColumn("a", w * h).where((w > 0) & (h > 0)).select("polygon_id", "name", "value", "row", "col", (F.col("a") / area).alias("coverage"), (F.col("a") / abs(g.cx * g.cy)).alias("cell_coverage"))


def areas_left_of(ring: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Area of a ring left of each vertical line: the integral of y along the ring, as far as it lies there."""
    (xa, ya), (xb, yb) = ring.T[:, :, None], np.roll(ring, -1, axis=0).T[:, :, None]
    run = xb - xa
    slope = np.divide(yb - ya, run, out=np.zeros_like(run), where=run != 0)
    x1, x2 = np.minimum(xa, edges), np.minimum(xb, edges)
    middle = ya + slope * ((x1 + x2) / 2 - xa)
    return np.abs(((x2 - x1) * middle).sum(0))


def polygon_coverage(polygons: DataFrame, g: Georef) -> DataFrame:
    """As ``rect_coverage`` for polygons (polygon_id, name, value, ring: array of arrays [x, y])."""
    at = lambda k: F.transform("ring", lambda p: p[k])
    r0, r1 = F.floor((F.array_max(at(1)) - g.y0) / g.cy), F.ceil((F.array_min(at(1)) - g.y0) / g.cy) - 1
    held = polygons.where((r1 >= 0) & (r0 < g.rows) & (r1 >= r0))
    rows = held.withColumn("row", F.explode(F.sequence(F.greatest(F.lit(0), r0).cast("int"), F.least(F.lit(g.rows - 1), r1).cast("int"))))
    kept = [c for c in ("polygon_id", "name", "value")]
    schema = ", ".join(f"{c} {dict(polygons.dtypes)[c]}" for c in kept) + ", row int, col int, coverage double, cell_coverage double"

    def cut(batches):
        for frame in batches:
            out = []
            for r in frame.itertuples(index=False):
                ring = np.array([list(q) for q in r.ring], float)
                whole, top = ring_area(ring), g.y0 + r.row * g.cy
                band = clip(ring, -np.inf, top + g.cy, np.inf, top)
                if len(band) < 3 or not whole:
                    continue
                c0, c1 = max(0, int(np.floor((band[:, 0].min() - g.x0) / g.cx))), min(g.cols, int(np.ceil((band[:, 0].max() - g.x0) / g.cx)))
                if c1 <= c0:
                    continue
                area = np.diff(areas_left_of(band, g.x0 + np.arange(c0, c1 + 1) * g.cx))
                cols = np.flatnonzero(area > 1e-12 * abs(g.cx * g.cy))
                out.append(pd.DataFrame({**{c: [getattr(r, c)] * len(cols) for c in kept}, "row": r.row, "col": cols + c0, "coverage": area[cols] / whole, "cell_coverage": area[cols] / abs(g.cx * g.cy)}))
            if out:
                yield pd.concat(out)

    return rows.select(*kept, "ring", "row").mapInPandas(cut, schema)


def adjust_borders(coverage: DataFrame) -> DataFrame:
    """Where 0 < coverage < 1: coverage over the sum of other-named polygons in the cell; 1 if alone.

    Unnamed polygons do not meet.  Sums by cell and by cell and name are joined back; no cell is gathered.
    """
    named = coverage.where("name is not null")
    by_name = named.groupBy("row", "col", "name").agg(F.sum("coverage").alias("own"))
    by_cell = by_name.groupBy("row", "col").agg(F.sum("own").alias("all"), F.count("*").alias("names"))
    both = coverage.join(by_name, ["row", "col", "name"], "left").join(by_cell, ["row", "col"], "left")
    others = F.when(F.col("name").isNotNull() & (F.col("names") > 1), F.col("all") - F.col("own"))
    adjusted = F.when(others.isNull(), F.lit(1.0)).otherwise(F.col("coverage") / others)
    inner = (F.col("coverage") > 0) & (F.col("coverage") < 1)
    return both.withColumn("coverage", F.when(inner, adjusted).otherwise(F.col("coverage"))).select(*coverage.columns)


def rasterize(coverage: DataFrame, how: str = "sum", *, all_touched: bool = True) -> DataFrame:
    """Burn values: their sum, or that of the last polygon id; else only cells at least half covered."""
    rows = coverage if all_touched else coverage.where("cell_coverage >= 0.5")
    f = F.sum("value") if how == "sum" else F.max_by("value", "polygon_id")
    return rows.groupBy("row", "col").agg(f.alias("value"))
