"""Areas of equal value as polygons.

Cells of a cluster contribute the sides that face another cluster (equi-joins with the four neighbours), directed so
that the area lies to their right.  Sides in one line are merged by a window over the line, so that a ring is
put together from its corners only; a task holds the corners of one cluster.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.geo import Georef
from . import clusters
from .algebra import KEY

#: side: step to the neighbour, and the start and end of the side in corners of the cell.
_SIDES = {"up": (-1, 0, (0, 0), (0, 1)), "right": (0, 1, (0, 1), (1, 1)), "down": (1, 0, (1, 1), (1, 0)), "left": (0, -1, (1, 0), (0, 0))}


def areas(cells: DataFrame, **options) -> DataFrame:
    """cells with ``area``: the number of the 4-connected area of equal value, no data apart."""
    least = cells.groupBy("raster_id").agg(F.min("value").alias("__least"))
    positive = cells.join(least, "raster_id").select(*KEY, (F.col("value") - F.col("__least") + 1).alias("value"))
    found = clusters.cluster_id(positive, **options).select(*KEY, F.col("value").alias("area"))
    return cells.join(found, KEY)


def borders(numbered: DataFrame) -> DataFrame:
    """Directed straight sides (raster_id, area, r0, c0, r1, c1) around areas, as long as they go."""
    own = numbered.where("area > 0").select(*KEY, "area")
    parts = None
    for side, (dr, dc, a, b) in _SIDES.items():
        near = own.select("raster_id", (F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.col("area").alias("__other"))
        met = own.join(near, KEY, "left").where(F.col("__other").isNull() | (F.col("__other") != F.col("area")))
        line, at = ("row", "col") if dr else ("col", "row")
        run = F.col(at) - F.row_number().over(Window.partitionBy("raster_id", "area", line).orderBy(at))
        ends = met.withColumn("__run", run).groupBy("raster_id", "area", line, "__run").agg(F.min(at).alias("__lo"), F.max(at).alias("__hi"))
        first, last = (("__lo", "__hi") if side in ("up", "right") else ("__hi", "__lo"))
        corner = lambda k, c: (F.col(line) + k[0], F.col(c) + k[1]) if dr else (F.col(c) + k[0], F.col(line) + k[1])
        (r0, c0), (r1, c1) = corner(a, first), corner(b, last)
        part = ends.select("raster_id", "area", r0.alias("r0"), c0.alias("c0"), r1.alias("r1"), c1.alias("c1"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def rings_of(sides: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Closed rings of directed sides.  Where two rings touch at a corner the sharper right turn is taken."""
    out_of: dict = {}
    for r0, c0, r1, c1 in sides:
        out_of.setdefault((r0, c0), []).append((r1, c1))
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])
    rings = []
    while out_of:
        start = min(out_of)
        ring, before = [start], None
        while True:
            here = ring[-1]
            nexts = out_of[here]
            best = nexts[0] if before is None or len(nexts) == 1 else min(nexts, key=lambda n: turn(before, here, n))
            nexts.remove(best)
            if not nexts:
                del out_of[here]
            before = here
            ring.append(best)
            if best == start:
                break
        rings.append(ring)
    return rings


def _area(ring) -> float:
    return sum(c0 * r1 - c1 * r0 for (r0, c0), (r1, c1) in zip(ring, ring[1:])) / 2


def polygonize(cells: DataFrame, g: Georef, **options) -> DataFrame:
    """(raster_id, area, value, cells, perimeter, geometry): GeoJSON polygons, the outer ring first; no data has none."""
    numbered = areas(cells, **options)
    facts = numbered.where("area > 0").groupBy("raster_id", "area").agg(F.first("value").alias("value"), F.count("*").alias("cells"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        sides = list(frame[["r0", "c0", "r1", "c1"]].itertuples(index=False, name=None))
        rings = sorted(rings_of(sides), key=lambda r: -abs(_area(r)))
        points = [[[g.x0 + c * g.cx, g.y0 + r * g.cy] for r, c in ring] for ring in rings]
        long = int(sum(abs(r1 - r0) + abs(c1 - c0) for r0, c0, r1, c1 in sides))
        return pd.DataFrame({"raster_id": [frame["raster_id"].iloc[0]], "area": [frame["area"].iloc[0]], "perimeter": [long], "geometry": [json.dumps({"type": "Polygon", "coordinates": points})]})

    shapes = borders(numbered).groupBy("raster_id", "area").applyInPandas(build, "raster_id string, area long, perimeter long, geometry string")
    return facts.join(shapes, ["raster_id", "area"]).select("raster_id", "area", "value", "cells", "perimeter", "geometry")
