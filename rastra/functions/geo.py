"""Georeference, Web Mercator and XYZ tiles as column expressions.

A georeference is (x0, y0, cx, cy): the upper left corner and the cell size, cy negative.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

RADIUS = 6378137.0
CIRCUMFERENCE = 2 * math.pi * RADIUS
TILE, EPSILON = 256, 2.0**-52
#: Latitude at which Web Mercator's square ends.
MAX_LATITUDE = math.degrees(2 * math.atan(math.exp(math.pi)) - math.pi / 2)


@dataclass(frozen=True)
class Georef:
    rows: int
    cols: int
    x0: float
    y0: float
    cx: float
    cy: float

    @property
    def box(self) -> tuple[float, float, float, float]:
        """x0, y0 (lower), x1, y1."""
        return self.x0, self.y0 + self.rows * self.cy, self.x0 + self.cols * self.cx, self.y0

    def aligned(self, other: Georef, tolerance: float = 1e-6) -> bool:
        near = lambda x: abs(x - round(x)) <= tolerance
        same = abs(self.cx - other.cx) <= 1e-10 and abs(self.cy - other.cy) <= 1e-10
        return same and near((self.x0 - other.x0) / self.cx) and near((self.y0 - other.y0) / self.cy)

    def intersects(self, other: Georef) -> bool:
        a, b = self.box, other.box
        return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]

    def cut_out(self, other: Georef) -> dict[str, int]:
        """Where the common part lies in this raster and in ``other``."""
        if abs(self.cx - other.cx) > 1e-10 or abs(self.cy - other.cy) > 1e-10:
            raise ValueError("cell sizes do not match")
        if not self.cx or not self.cy:
            raise ValueError("the cell size is zero")
        a, b = self.box, other.box
        x0, y0, x1, y1 = max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])
        return {"src_col": round((x0 - a[0]) / self.cx), "src_row": round((a[3] - y1) / -self.cy), "dst_col": round((x0 - b[0]) / self.cx), "dst_row": round((b[3] - y1) / -self.cy),
                "rows": max(0, round((y1 - y0) / -self.cy)), "cols": max(0, round((x1 - x0) / self.cx))}

    def with_cell_size(self, cx: float, cy: float) -> Georef:
        """The same extent in other cells."""
        return Georef(round(self.rows * self.cy / cy), round(self.cols * self.cx / cx), self.x0, self.y0, cx, cy)


def centre(row: Column, col: Column, g: Georef) -> tuple[Column, Column]:
    return F.lit(g.x0) + (col + 0.5) * g.cx, F.lit(g.y0) + (row + 0.5) * g.cy


def cell_at(x: Column, y: Column, g: Georef) -> tuple[Column, Column]:
    """(row, col) of the cell that holds a point; outside the grid too."""
    return F.floor((y - g.y0) / g.cy).cast("int"), F.floor((x - g.x0) / g.cx).cast("int")


def on_map(row: Column, col: Column, g: Georef) -> Column:
    return row.between(0, g.rows - 1) & col.between(0, g.cols - 1)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    lat = F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), lat))
    return F.radians(lon) * RADIUS, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * RADIUS


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - F.lit(math.pi / 2))


def tile_at(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    n = 2.0**zoom
    s = F.sin(F.radians(lat))
    px, py = lon / 360 + 0.5, 0.5 - 0.25 * F.log((1 + s) / (1 - s)) / math.pi

    def index(p: Column) -> Column:
        return F.when(p <= 0, 0.0).when(p >= 1, n - 1).otherwise(F.floor((p + EPSILON) * n)).cast("int")

    return index(px), index(py)


def parent(x: Column, y: Column, levels: int = 1) -> tuple[Column, Column]:
    return F.shiftright(x, levels), F.shiftright(y, levels)


def children(tiles: DataFrame) -> DataFrame:
    """Four tiles one zoom further for each (z, x, y)."""
    four = F.array(*[F.struct((F.col("z") + 1).alias("z"), (F.col("x") * 2 + dx).alias("x"), (F.col("y") * 2 + dy).alias("y")) for dy in (0, 1) for dx in (0, 1)])
    return tiles.select(F.explode(four).alias("t")).select("t.*")


def tiles_for_bounds(bounds: DataFrame, zoom: int) -> DataFrame:
    """Every tile that a box (west, south, east, north) touches; other columns are kept."""
    x0, y0 = tile_at(F.col("west"), F.col("north"), zoom)
    x1, y1 = tile_at(F.col("east"), F.col("south"), zoom)
    return bounds.withColumn("z", F.lit(zoom)).withColumn("x", F.explode(F.sequence(x0, x1))).withColumn("y", F.explode(F.sequence(y0, y1)))


def pixel_size(zoom: int, tile: int = TILE) -> float:
    return CIRCUMFERENCE / 2.0 ** (zoom + tile // TILE - 1) / TILE


def zoom_for(pixel: Column, strategy: str | int = "closest", tile: int = TILE) -> Column:
    """Strategies: higher, lower, closest, or a number, which is the zoom."""
    if isinstance(strategy, int):
        return F.lit(strategy)
    z = F.log2(F.lit(CIRCUMFERENCE / TILE) / pixel) - (tile // TILE - 1)
    return {"higher": F.ceil(z), "lower": F.floor(z), "closest": F.round(z)}[strategy].cast("int")


def wrap_longitude(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


# ---- constructors and metadata arithmetic


def from_bottom_left(rows: int, cols: int, x: float, y: float, cx: float, cy: float | None = None) -> Georef:
    """A grid by its lower left corner; square cells without ``cy``."""
    cy = -abs(cx if cy is None else cy)
    return Georef(rows, cols, x, y - cy * rows, cx, cy)


def from_tile(z: int, x: int, y: int, size: int = TILE, ratio: int = 1) -> Georef:
    """The Web Mercator grid of an XYZ tile with ``size`` x ``ratio`` cells a side."""
    west, _, _, north = mercator_box(z, x, y)
    cell = CIRCUMFERENCE / 2.0**z / (size * ratio)
    return Georef(size * ratio, size * ratio, west, north, cell, -cell)


def mercator_box(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    side = CIRCUMFERENCE / 2.0**z
    west, north = x * side - CIRCUMFERENCE / 2, CIRCUMFERENCE / 2 - y * side
    return west, north - side, west + side, north


def intersection(a: Georef, b: Georef) -> Georef | None:
    """The common part of two aligned grids, in cells of both; None if they share no cell."""
    if not a.aligned(b):
        raise ValueError("the grids are not aligned")
    cut = a.cut_out(b)
    if not cut["rows"] or not cut["cols"]:
        return None
    return Georef(cut["rows"], cut["cols"], a.x0 + cut["src_col"] * a.cx, a.y0 + cut["src_row"] * a.cy, a.cx, a.cy)


def tile_of(lon: float, lat: float, zoom: int) -> tuple[int, int]:
    """The tile (x, y) of one point; see ``tile_at``."""
    n, s = 2.0**zoom, math.sin(math.radians(lat))
    part = (lon / 360 + 0.5, 0.5 - 0.25 * math.log((1 + s) / (1 - s)) / math.pi)
    return tuple(0 if p <= 0 else int(n - 1) if p >= 1 else math.floor((p + EPSILON) * n) for p in part)


def xyz_aligned(mercator: Georef, zoom: int | None = None, size: int = TILE, strategy: str = "lower") -> Georef:
    """The grid of all XYZ tiles that a Web Mercator raster touches, at ``zoom`` or at the one that fits its cells."""
    if zoom is None:
        z = math.log2(CIRCUMFERENCE / TILE / mercator.cx) - (size // TILE - 1)
        zoom = {"higher": math.ceil, "lower": math.floor, "closest": lambda v: math.floor(v + 0.5)}[strategy](z)
    west, south, east, north = mercator.box
    back = lambda x, y: (math.degrees(x / RADIUS), math.degrees(2 * math.atan(math.exp(y / RADIUS)) - math.pi / 2))
    a, b = mercator_box(zoom, *tile_of(*back(west, north), zoom)), mercator_box(zoom, *tile_of(*back(east, south), zoom))
    cell = (a[2] - a[0]) / size
    return from_bottom_left(math.ceil((a[3] - b[1]) / cell - 1e-9), math.ceil((b[2] - a[0]) / cell - 1e-9), a[0], b[1], cell)


def size_for_tiles(west: float, south: float, east: float, north: float, zoom: int, size: int = TILE) -> tuple[int, int]:
    """(rows, cols) of all tiles that a box touches."""
    (x0, y0), (x1, y1) = tile_of(west, north, zoom), tile_of(east, south, zoom)
    return (y1 - y0 + 1) * size, (x1 - x0 + 1) * size


# ---- cells


def lower_left(row: Column, col: Column, g: Georef) -> tuple[Column, Column]:
    return F.lit(g.x0) + col * g.cx, F.lit(g.y0) + (row + 1) * g.cy


def cell_box(row: Column, col: Column, g: Georef) -> Column:
    """struct(west, south, east, north) of a cell."""
    x, y = lower_left(row, col, g)
    return F.struct(x.alias("west"), y.alias("south"), (x + g.cx).alias("east"), (y - g.cy).alias("north"))


def nearest_cell(x: Column, y: Column, g: Georef) -> tuple[Column, Column]:
    """(row, col) of the cell whose upper left corner is nearest."""
    return F.round((y - g.y0) / g.cy).cast("int"), F.round((x - g.x0) / g.cx).cast("int")


def affine(row: Column, col: Column, gt: list[float]) -> tuple[Column, Column]:
    """x, y of a place in cells by the six coefficients of a geotransform, rotation included."""
    return F.lit(gt[0]) + col * gt[1] + row * gt[2], F.lit(gt[3]) + col * gt[4] + row * gt[5]


def inverted(gt: list[float]) -> list[float]:
    """The geotransform from x, y back to column and row."""
    a, b, c, d, e, f = gt
    det = b * f - c * e
    if det == 0:
        raise ValueError("the geotransform cannot be inverted")
    return [(c * d - a * f) / det, f / det, -c / det, (a * e - b * d) / det, -e / det, b / det]


# ---- bounds: structs (west, south, east, north)


def box_of(west, south, east, north) -> Column:
    return F.struct(*[F.lit(v).cast("double").alias(n) if not isinstance(v, Column) else v.alias(n) for v, n in zip((west, south, east, north), ("west", "south", "east", "north"))])


def holds(a: Column, b: Column) -> Column:
    """Box ``b`` lies within ``a``; edges may touch."""
    return (b["north"] <= a["north"]) & (b["south"] >= a["south"]) & (b["east"] <= a["east"]) & (b["west"] >= a["west"])


def meets(a: Column, b: Column) -> Column:
    """The boxes share more than an edge."""
    return (b["north"] > a["south"]) & (b["south"] < a["north"]) & (b["east"] > a["west"]) & (b["west"] < a["east"])


def holds_point(a: Column, lon: Column, lat: Column) -> Column:
    return lat.between(a["south"], a["north"]) & lon.between(a["west"], a["east"])


def crosses_antimeridian(a: Column) -> Column:
    return wrap_longitude(a["west"]) > wrap_longitude(a["east"])


def constrained(a: Column, lon: Column, lat: Column) -> tuple[Column, Column]:
    """The point of the box nearest to a point."""
    return F.least(F.greatest(lon, a["west"]), a["east"]), F.least(F.greatest(lat, a["south"]), a["north"])


def is_empty(a: Column) -> Column:
    return (a["east"] == a["west"]) | (a["north"] == a["south"])


def hull(boxes: DataFrame, *by: str) -> DataFrame:
    """The box around all boxes (west, south, east, north) of a group: one aggregate, combined on the map side."""
    return boxes.groupBy(*by).agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))


def valid_point(lon: Column, lat: Column) -> Column:
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) != float("inf")), F.lit(False))


def degrees_apart(lon: Column, lat: Column, lon2: Column, lat2: Column) -> Column:
    return F.hypot(lat2 - lat, lon2 - lon)


# ---- tiles


def tile_box(x: Column, y: Column, z: Column) -> Column:
    """struct(west, south, east, north) of a tile in degrees."""
    n = F.pow(F.lit(2.0), z)
    lat = lambda k: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * k / n))))
    return F.struct((x / n * 360 - 180).alias("west"), lat(y + 1).alias("south"), ((x + 1) / n * 360 - 180).alias("east"), lat(y).alias("north"))


def tile_mercator_box(x: Column, y: Column, z: Column) -> Column:
    side = F.lit(CIRCUMFERENCE) / F.pow(F.lit(2.0), z)
    west, north = x * side - CIRCUMFERENCE / 2, F.lit(CIRCUMFERENCE / 2) - y * side
    return F.struct(west.alias("west"), (north - side).alias("south"), (west + side).alias("east"), north.alias("north"))


def tile_centre(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Longitude and latitude half a tile's degrees right of and below its upper left corner."""
    box, half = tile_box(x, y, z), F.lit(180.0) / F.pow(F.lit(2.0), z)
    return box["west"] + half, box["north"] - half


def pixel_in_tile(lon: Column, lat: Column, x: Column, y: Column, z: Column, size: int = TILE) -> Column:
    """struct(px, py) of a point within a tile, latitude taken as linear; null outside."""
    box = tile_box(x, y, z)
    px, py = (lon - box["west"]) / (box["east"] - box["west"]) * size, (box["north"] - lat) / (box["north"] - box["south"]) * size
    at = lambda v: F.greatest(v, F.lit(0.0)).cast("int")
    return F.when((px >= -1e-6) & (py >= -1e-6) & (px < size) & (py < size), F.struct(at(px).alias("px"), at(py).alias("py")))


def neighbours(tiles: DataFrame, own: bool = True) -> DataFrame:
    """The tiles around each (z, x, y), itself included unless ``own`` is false; none beyond the upper and left edge."""
    nine = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if own or dx or dy])
    spread = tiles.select(*[F.col(c).alias(f"of_{c}") for c in ("z", "x", "y")], "z", F.explode(nine).alias("t"))
    return spread.select("of_z", "of_x", "of_y", "z", "t.x", "t.y").where("x >= 0 and y >= 0")


def descendants(tiles: DataFrame, zoom: int) -> DataFrame:
    """Every tile below each (z, x, y) down to ``zoom``: index ranges, level by level, without recursion."""
    deep = tiles.select("z", "x", "y").where(F.col("z") < zoom).select("*", F.explode(F.sequence(F.lit(1), F.lit(zoom) - F.col("z"))).alias("d"))
    side = F.expr("shiftleft(1, d)")
    spread = deep.select((F.col("z") + F.col("d")).alias("z"), (F.col("x") * side).alias("x0"), (F.col("y") * side).alias("y0"), side.alias("side"))
    spread = spread.select("z", "y0", "side", F.explode(F.sequence(F.col("x0"), F.col("x0") + F.col("side") - 1)).alias("x"))
    return spread.select("z", "x", F.explode(F.sequence(F.col("y0"), F.col("y0") + F.col("side") - 1)).alias("y"))


def world_file_name(text: Column) -> Column:
    """struct(y, ratio, extension) of a tile's file name such as 12@2x.png; null if it is none."""
    form = r"^(\d+)(?:@(\d+)x)?\.([A-Za-z0-9]+)$"
    part = lambda k: F.regexp_extract(text, form, k)
    ratio = F.when(part(2) == "", 1).otherwise(part(2).try_cast("int"))
    return F.when(text.rlike(form), F.struct(part(1).try_cast("int").alias("y"), ratio.alias("ratio"), F.lower(part(3)).alias("extension")))
