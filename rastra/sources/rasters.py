"""Rasters by path: what one asks of a file, reads of all or a part as any type, writes, differences, and Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geo
from ..functions.dtypes import RANGES
from ..functions.geo import Georef
from ..operators import algebra as A
from . import geotiff, tables


def georeference(path: str, overview: int = 0) -> Georef:
    """A file's grid, from its header alone."""
    images = geotiff.header(path)
    first, image = images[0], images[overview]
    if not first.gt:
        raise ValueError(f"{path} has no place on the map")
    x0, cx, _, y0, _, cy = first.gt
    return Georef(image.height, image.width, x0, y0, cx * first.width / image.width, cy * first.height / image.height)


def data_type(path: str) -> str:
    return geotiff.header(path)[0].dtype


def facts(path: str) -> dict:
    """Bands, overviews, size, type, no data and code of the reference system."""
    images = geotiff.header(path)
    i = images[0]
    return {"bands": i.bands, "overviews": len(images) - 1, "rows": i.height, "cols": i.width, "dtype": i.dtype, "nodata": i.nodata, "epsg": i.epsg}


def read(spark: SparkSession, path: str, *, band: int = 1, overview: int = 0, dtype: str | None = None) -> DataFrame:
    """Cells of a band (from 1); with ``dtype`` what the type cannot hold is no data."""
    kind = tables.kind_of_file(path)
    if kind != "geotiff":
        raise ValueError(f"no raster reader for {kind} files: {path}")
    if dtype is not None and dtype not in RANGES and dtype not in ("f32", "f64"):
        raise ValueError(f"no pixel type {dtype}")
    return geotiff.read(spark, path, band=band, overview=overview, dtype=dtype)


def read_region(spark: SparkSession, path: str, region: Georef, *, band: int = 1, dtype: str | None = None) -> DataFrame:
    """Every cell of ``region``, a grid aligned with the file's: its rows and columns, no data outside the file.

    Only chunks that the region touches are read.
    """
    own = georeference(path)
    if not own.aligned(region):
        raise ValueError("the region's cells are not those of the file")
    row, col = round((region.y0 - own.y0) / own.cy), round((region.x0 - own.x0) / own.cx)
    found = geotiff.read(spark, path, band=band, region=(row, col, region.rows, region.cols), dtype=dtype)
    moved = found.select((F.col("row") - row).alias("row"), (F.col("col") - col).alias("col"), "value")
    return A.full_grid(spark, region.rows, region.cols, path).drop("value").join(moved, ["row", "col"], "left").select(*A.KEY, "value")


def write(cells: DataFrame, g: Georef, uri: str, *, dtype: str = "f32", **options) -> DataFrame:
    """Rasters as files of a type below ``uri``, cut to it first; see ``geotiff.write_cog``."""
    return geotiff.write_cog(A.cast(cells, dtype), g, uri, dtype=dtype, **options)


def files_diff(spark: SparkSession, a: str, b: str, tolerance: float = 0.0) -> DataFrame:
    """Cells in which two files of one grid differ; files of other sizes fail."""
    same = lambda d: d.withColumn("raster_id", F.lit("diff"))
    return A.diff(same(read(spark, a)), same(read(spark, b)), tolerance)


def files_intersection_diff(spark: SparkSession, a: str, b: str, tolerance: float = 0.0) -> DataFrame:
    """Cells in which two files with aligned grids differ, over the part that both cover; rows and columns count there."""
    part = geo.intersection(georeference(a), georeference(b))
    if part is None:
        raise ValueError("the files have no part in common")
    same = lambda p: read_region(spark, p, part).withColumn("raster_id", F.lit("diff"))
    return A.diff(same(a), same(b), tolerance)


def from_arrow(spark: SparkSession, array: pa.Array, rows: int, cols: int, raster_id: str = "r") -> DataFrame:
    """An Arrow array of values in row-major order as cells; nulls are no data."""
    if len(array) != rows * cols:
        raise ValueError(f"{len(array)} values do not fill {rows} rows of {cols}")
    at = np.indices((rows, cols), dtype=np.int32).reshape(2, -1)
    table = pa.table({"raster_id": pa.array([raster_id] * len(array)), "row": at[0], "col": at[1], "value": array.cast(pa.float64())})
    return spark.createDataFrame(table)


def to_arrow(cells: DataFrame) -> pa.Table:
    """The cells of a raster that fits the driver, in row-major order."""
    return cells.select(*A.KEY, "value").orderBy("raster_id", "row", "col").toArrow()
