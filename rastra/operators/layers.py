"""Layers: what a map asks of rasters.  A layer is a raster of cells with a grid on the map.

A catalog row tells a layer's bounds, zooms and values.  Tiles are warps of the part of a layer that lies under the
tile; the rest is pruned by a range of rows and columns before anything is joined.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import crs, geo
from ..functions.geo import Georef
from ..sources import codecs
from . import warp
from .algebra import binary, window

#: Tile formats and their file extensions.
FORMATS = {"png": "png", "float_png": "vrt", "raster_tile": "rt", "protobuf": "pbf", "jpeg": "jpg", "geojson": "json", "webp": "webp"}
_CATALOG = "id string, name string, description string, scheme string, tile_format string, min_zoom int, max_zoom int, west double, south double, east double, north double, min_value double, max_value double, nodata double"


def wgs84_bounds(g: Georef, srs="EPSG:4326") -> tuple[float, float, float, float]:
    """West, south, east, north of a raster in degrees."""
    return warp.warped_box(g.box, srs, "EPSG:4326")


def catalog(cells: DataFrame, grids: dict[str, tuple[Georef, object]], *, tile_format: str = "raster_tile", strategy: str = "lower") -> DataFrame:
    """A row for each layer of ``grids`` (id: grid, reference system) with the range of its values in ``cells``."""
    rows = []
    for name, (g, srs) in grids.items():
        west, south, east, north = wgs84_bounds(g, srs)
        cell = warp.georeference(g, srs, "EPSG:3857").cx
        zoom = math.log2(geo.CIRCUMFERENCE / geo.TILE / cell)
        zoom = {"higher": math.ceil, "lower": math.floor, "closest": round}[strategy](zoom)
        rows.append((name, name, "", "xyz", tile_format, 0, max(0, int(zoom)), west, south, east, north, None, None, None))
    known = cells.sparkSession.createDataFrame(rows, _CATALOG)
    values = cells.groupBy(F.col("raster_id").alias("id")).agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    return known.join(values, "id", "left").withColumns({"min_value": F.col("__lo"), "max_value": F.col("__hi")}).drop("__lo", "__hi")


def layer(layers: DataFrame, name: str) -> DataFrame:
    return layers.where(F.col("id") == name)


def url(root: str, ratio: bool = True) -> Column:
    """A layer's address with places for z, x and y."""
    form = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.concat(F.lit(f"{root}/api/"), F.col("id"), F.lit("/{z}/{x}/{y}" + ("{ratio}" if ratio else "") + "."), F.coalesce(F.try_element_at(form, F.col("tile_format")), F.lit("")))


def tile_json(layers: DataFrame, root: str, *, ratio: bool = True) -> DataFrame:
    """(id, json): each layer's TileJSON."""
    body = F.struct(
        F.lit("2.0.0").alias("tilejson"), "scheme", F.lit("overlay").alias("type"), "name", "description", F.col("min_zoom").alias("minzoom"), F.col("max_zoom").alias("maxzoom"),
        F.array("west", "south", "east", "north").alias("bounds"), F.col("min_value").alias("minvalue"), F.col("max_value").alias("maxvalue"), F.array(url(root, ratio)).alias("tiles"),
    )
    return layers.select("id", F.to_json(body).alias("json"))


def _under(g: Georef, box: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
    """First and last row and column that a box touches, with a cell to spare."""
    west, south, east, north = box
    return math.floor((north - g.y0) / g.cy) - 1, math.floor((west - g.x0) / g.cx) - 1, math.floor((south - g.y0) / g.cy) + 1, math.floor((east - g.x0) / g.cx) + 1


def get_tile(cells: DataFrame, g: Georef, z: int, x: int, y: int, *, size: int = 256, ratio: int = 1, srs="EPSG:4326") -> DataFrame:
    """The cells of an XYZ tile: every pixel of it, no data outside the layer."""
    target = geo.from_tile(z, x, y, size, ratio)
    part = window(cells, *_under(g, warp.warped_box(target.box, "EPSG:3857", srs)))
    return warp.warp(part, g, target, srs, "EPSG:3857", raster_id=f"{z}/{x}/{y}")


def get_tile_coloured(cells: DataFrame, g: Georef, z: int, x: int, y: int, legend, **options) -> DataFrame:
    """``get_tile`` with ``colour``: ``legend`` maps a column to colours."""
    return get_tile(cells, g, z, x, y, **options).withColumn("colour", legend(F.col("value")))


def get_diff_tile(a: DataFrame, b: DataFrame, g: Georef, z: int, x: int, y: int, **options) -> DataFrame:
    """The tile of ``b`` less that of ``a``."""
    return binary(get_tile(b, g, z, x, y, **options), get_tile(a, g, z, x, y, **options), "sub")


def get_value(cells: DataFrame, g: Georef, lon: float, lat: float, srs="EPSG:4326") -> DataFrame:
    """The value of the cell under a coordinate; no row outside the layer."""
    x, y = crs.transform(lon, lat, "EPSG:4326", srs)
    row, col = math.floor((float(y) - g.y0) / g.cy), math.floor((float(x) - g.x0) / g.cx)
    return cells.where((F.col("row") == row) & (F.col("col") == col)).select("value")


def encoded(tile: DataFrame, size: int, form: str = "raster_tile", dtype: str = "f32") -> DataFrame:
    """(raster_id, data): tiles as bytes.  Coloured tiles (png) need ``colour``; a task holds a tile."""

    def encode(frame: pd.DataFrame) -> pd.DataFrame:
        at = frame["row"].to_numpy(), frame["col"].to_numpy()
        if form == "png":
            rgba = np.zeros((size, size, 4), np.uint8)
            colour = frame["colour"].to_numpy()
            for k, shift in enumerate((24, 16, 8, 0)):
                rgba[(*at, k)] = colour >> shift & 255
            data = codecs.encode_png(rgba)
        else:
            values = np.full((size, size), np.nan)
            values[at] = frame["value"].astype(float)
            data = codecs.encode_float_png(values) if form == "float_png" else codecs.encode_tile(values, dtype)
        return pd.DataFrame({"raster_id": [frame["raster_id"].iloc[0]], "data": [data]})

    return tile.groupBy("raster_id").applyInPandas(encode, "raster_id string, data binary")


def decoded(tiles: DataFrame, form: str = "raster_tile") -> DataFrame:
    """The cells of tiles (raster_id, data)."""

    def decode(batches):
        for frame in batches:
            for name, data in zip(frame["raster_id"], frame["data"]):
                values = codecs.decode_float_png(bytes(data)) if form == "float_png" else codecs.decode_tile(bytes(data))[0]
                at = np.indices(values.shape).reshape(2, -1)
                yield pd.DataFrame({"raster_id": name, "row": at[0].astype("int32"), "col": at[1].astype("int32"), "value": values.ravel()})

    cells = tiles.select("raster_id", "data").mapInPandas(decode, "raster_id string, row int, col int, value double")
    return cells.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


# ---- web tiles of a cloud-optimised file


def _cuts(first: Column, n: Column, chunk: Column, size: int) -> Column:
    """Along one axis the tiles that a chunk lies in: array of struct(tile, src, dst, n)."""
    lo, hi = first + chunk * size, first + F.least(n, (chunk + 1) * size) - 1

    def cut(t: Column) -> Column:
        start = F.greatest(lo, t * size)
        return F.struct(t.alias("tile"), (start - lo).alias("src"), (start - t * size).alias("dst"), (F.least(hi, (t + 1) * size - 1) - start + 1).alias("n"))

    return F.transform(F.sequence(F.floor(lo / size).cast("int"), F.floor(hi / size).cast("int")), cut)


def tile_index(spark: SparkSession, g: Georef, levels: int, *, bands: int = 1, size: int = 256) -> DataFrame:
    """Which chunks of a Web Mercator file hold which web tile, on all its overviews.

    Rows (z, x, y, overview, band, chunk, src_row, src_col, dst_row, dst_col, rows, cols, aligned): a tile takes ``rows`` x
    ``cols`` cells of a chunk from (src_row, src_col) to its own (dst_row, dst_col).  Of an aligned level a tile is one chunk
    of each band, else up to four.  Chunks are numbered by band, then by row.
    """
    zoom = math.log2(geo.CIRCUMFERENCE / geo.TILE / g.cx) - (size // geo.TILE - 1)
    if abs(zoom - round(zoom)) > 1e-9:
        raise ValueError(f"cells of {g.cx} m are those of no zoom level")
    half = geo.CIRCUMFERENCE / 2
    out = None
    for k in range(levels):
        cell = g.cx * 2**k
        rows, cols = -(-g.rows // 2**k), -(-g.cols // 2**k)
        row0, col0 = round((half - g.y0) / cell), round((g.x0 + half) / cell)
        wide, high = -(-cols // size), -(-rows // size)
        chunks = spark.range(wide * high * bands).select((F.col("id") / (wide * high)).cast("int").alias("band"), F.col("id").cast("int").alias("chunk"), F.expr(f"cast((id % {wide * high}) div {wide} as int)").alias("cr"), (F.col("id") % wide).cast("int").alias("cc"))
        spans = [_cuts(F.lit(first), F.lit(n), F.col(at), size) for first, n, at in ((row0, rows, "cr"), (col0, cols, "cc"))]
        level = chunks.withColumn("r", F.explode(spans[0])).withColumn("c", F.explode(spans[1]))
        aligned = row0 % size == 0 and col0 % size == 0 and rows % size == 0 and cols % size == 0
        level = level.select(F.lit(int(round(zoom)) - k).alias("z"), F.col("c.tile").alias("x"), F.col("r.tile").alias("y"), F.lit(k).alias("overview"), (F.col("band") + 1).alias("band"), "chunk",
                             *[F.col(f"{a}.{b}").cast("int").alias(n) for n, a, b in (("src_row", "r", "src"), ("src_col", "c", "src"), ("dst_row", "r", "dst"), ("dst_col", "c", "dst"), ("rows", "r", "n"), ("cols", "c", "n"))], F.lit(aligned).alias("aligned"))
        out = level if out is None else out.unionByName(level)
    return out


def zoom_range(index: DataFrame) -> DataFrame:
    return index.agg(F.min("z").alias("min_zoom"), F.max("z").alias("max_zoom"))


def data_bounds(index: DataFrame) -> DataFrame:
    """The box in degrees around the tiles of the highest zoom."""
    top = index.agg(F.max("z").alias("z"))  # one row
    boxes = index.join(F.broadcast(top), "z").select(geo.tile_box(F.col("x"), F.col("y"), F.col("z")).alias("b")).select("b.*")
    return geo.hull(boxes)


def tiles_of(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cells (z, x, y, band, row, col, value) of the indexed tiles, from the cells of chunks (overview, chunk, row, col,
    value), whose rows and columns count within the chunk: an equi-join on the chunk, then a cut."""
    met = index.join(chunks.select("overview", "chunk", F.col("row").alias("__r"), F.col("col").alias("__c"), "value"), ["overview", "chunk"])
    inside = met.where((F.col("__r") >= F.col("src_row")) & (F.col("__r") < F.col("src_row") + F.col("rows")) & (F.col("__c") >= F.col("src_col")) & (F.col("__c") < F.col("src_col") + F.col("cols")))
    return inside.select("z", "x", "y", "band", (F.col("__r") - F.col("src_row") + F.col("dst_row")).alias("row"), (F.col("__c") - F.col("src_col") + F.col("dst_col")).alias("col"), "value")


def chunked(cells: DataFrame, g: Georef, overview: int, size: int = 256) -> DataFrame:
    """Cells of one level as cells of its chunks; see ``tiles_of``."""
    wide = -(-(-(-g.cols // 2**overview)) // size)
    at = lambda c: F.expr(f"{c} div {size}")
    return cells.select(F.lit(overview).alias("overview"), (at("row") * wide + at("col")).cast("int").alias("chunk"), (F.col("row") % size).alias("row"), (F.col("col") % size).alias("col"), "value")


