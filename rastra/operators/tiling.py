"""Tile layout, web tiles, pyramids, tile differences, point look-up and nearest-neighbour warps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo
from ..functions.geo import Georef
from .algebra import KEY


def to_tiles(cells: DataFrame, size: int = 256) -> DataFrame:
    """A row for each tile with its values in row-major order; null elements are no data."""
    tr, tc = F.expr(f"cast(floor(row / {size}) as int)").alias("trow"), F.expr(f"cast(floor(col / {size}) as int)").alias("tcol")
    grouped = cells.groupBy("raster_id", tr, tc).agg(F.sort_array(F.collect_list(F.struct("row", "col", "value"))).alias("s"), F.count_distinct("row").cast("int").alias("h"), F.count_distinct("col").cast("int").alias("w"), F.min("row").alias("row0"), F.min("col").alias("col0"))
    return grouped.select("raster_id", "trow", "tcol", "row0", "col0", "h", "w", F.col("s.value").alias("data"))


def to_cells(tiles: DataFrame) -> DataFrame:
    spread = tiles.select("raster_id", "row0", "col0", "w", F.posexplode("data").alias("k", "value"))
    return spread.select("raster_id", F.expr("row0 + cast(k div w as int)").alias("row"), (F.col("col0") + F.col("k") % F.col("w")).alias("col"), "value")


def downsample(cells: DataFrame, factor: int = 2, how: str = "mean") -> DataFrame:
    """One level of a pyramid: the mean, or the upper left value, of factor x factor cells."""
    row, col = F.expr(f"cast(floor(row / {factor}) as int)"), F.expr(f"cast(floor(col / {factor}) as int)")
    value = F.avg("value") if how == "mean" else F.min_by("value", F.struct("row", "col"))
    return cells.groupBy("raster_id", row.alias("row"), col.alias("col")).agg(value.alias("value"))


def pyramid(tiles: DataFrame, min_zoom: int) -> DataFrame:
    """Distinct ancestors down to ``min_zoom`` of the non-empty tiles (z, x, y): an empty tile never has any."""
    up = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("z") - min_zoom)))
    spread = tiles.select("z", "x", "y", up.alias("d")).select((F.col("z") - F.col("d")).alias("z"), F.expr("shiftright(x, d)").alias("x"), F.expr("shiftright(y, d)").alias("y"))
    return spread.distinct()


def web_tiles(cells: DataFrame, g: Georef, zoom: int) -> DataFrame:
    """Cells of a lon/lat raster with the web tile (z, x, y) that holds their centre."""
    lon, lat = geo.centre(F.col("row"), F.col("col"), g)
    x, y = geo.tile_at(lon, lat, zoom)
    return cells.withColumns({"z": F.lit(zoom), "x": x, "y": y})


def look_up(points: DataFrame, cells: DataFrame, g: Georef, x: str = "x", y: str = "y") -> DataFrame:
    """Points with the value of the cell that holds them: an equi-join, points outside get no data."""
    row, col = geo.cell_at(F.col(x), F.col(y), g)
    return points.withColumns({"row": row, "col": col}).join(cells.select("row", "col", "value"), ["row", "col"], "left")


def value_range(cells: DataFrame, g: Georef, west: float, south: float, east: float, north: float) -> DataFrame:
    x, y = geo.centre(F.col("row"), F.col("col"), g)
    inside = cells.where(x.between(west, east) & y.between(south, north))
    return inside.groupBy("raster_id").agg(F.min("value").alias("min"), F.max("value").alias("max"))


def nearest_overview(levels: DataFrame, wanted: Column) -> DataFrame:
    """The level (level, width) whose width is closest, the finer of equals."""
    return levels.agg(F.min_by("level", F.struct(F.abs(F.col("width") - wanted), F.col("level"))).alias("level"))


def tile_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """b - a of tiled cells (z, x, y, row, col, value)."""
    on = ["z", "x", "y", "row", "col"]
    return a.select(*on, F.col("value").alias("__a")).join(b.select(*on, F.col("value").alias("__b")), on).select(*on, (F.col("__b") - F.col("__a")).alias("value"))


def warp_to_mercator(cells: DataFrame, source: Georef, target: Georef) -> DataFrame:
    """Nearest neighbour: each target cell's centre goes back to lon/lat and takes the source cell that holds it."""
    spark = cells.sparkSession
    grid = spark.range(target.rows * target.cols).select(F.expr(f"cast(id div {target.cols} as int)").alias("row"), (F.col("id") % target.cols).cast("int").alias("col"))
    lon, lat = geo.from_mercator(*geo.centre(F.col("row"), F.col("col"), target))
    at = grid.withColumns({"__lon": lon, "__lat": lat})
    srow, scol = geo.cell_at(F.col("__lon"), F.col("__lat"), source)
    at = at.select("row", "col", srow.alias("__r"), scol.alias("__c"))
    from_ = cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), "value")
    return at.join(from_, ["__r", "__c"], "left").select(F.lit("warped").alias("raster_id"), "row", "col", "value")


def mercator_georef(source: Georef, rows: int, cols: int) -> Georef:
    """The Web Mercator grid of a lon/lat raster's extent."""
    import math

    west, south, east, north = source.box
    y = lambda lat: geo.RADIUS * math.log(math.tan(math.pi / 4 + math.radians(max(-geo.MAX_LATITUDE, min(geo.MAX_LATITUDE, lat))) / 2))
    x0, x1, y0, y1 = math.radians(west) * geo.RADIUS, math.radians(east) * geo.RADIUS, y(south), y(north)
    return Georef(rows, cols, x0, y1, (x1 - x0) / cols, (y0 - y1) / rows)


def shifted(cells: DataFrame, cut: dict[str, int]) -> DataFrame:
    """The common part of two aligned rasters in the other's cells."""
    inside = cells.where(F.col("row").between(cut["src_row"], cut["src_row"] + cut["rows"] - 1) & F.col("col").between(cut["src_col"], cut["src_col"] + cut["cols"] - 1))
    return inside.select("raster_id", (F.col("row") - cut["src_row"] + cut["dst_row"]).alias("row"), (F.col("col") - cut["src_col"] + cut["dst_col"]).alias("col"), "value").select(*KEY, "value")
