"""Vector tables: GeoJSON in and out, a reader for each format, attribute and box filters.

A geometry is GeoJSON text with its box (west, south, east, north) in columns, so that box filters are range
predicates which reach a Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import tables

_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"


def box_of(geometry: Column) -> Column:
    """struct(west, south, east, north) of GeoJSON text, by its coordinate pairs."""
    pairs = rf"\[\s*({_NUMBER})\s*,\s*({_NUMBER})"
    xs, ys = (F.transform(F.regexp_extract_all(geometry, F.lit(pairs), F.lit(k)), lambda v: v.cast("double")) for k in (1, 2))
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def read_geojson(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Features of collections, or of files with a feature a line: the named properties, typed, geometry and its box.

    Features without any of the properties and without a geometry are dropped.
    """
    properties = ", ".join(f"`{c}`: {t}" for c, t in columns.items())
    schema = f"type string, features array<string>, properties struct<{properties}>, geometry string" if columns else "type string, features array<string>, geometry string"
    lines = spark.read.text(path, wholetext=True)
    roots = lines.select(F.explode(F.when(F.get_json_object("value", "$.type") == "FeatureCollection", F.from_json(F.get_json_object("value", "$.features"), "array<string>")).otherwise(F.split("value", "\n"))).alias("f"))
    parsed = roots.where(F.trim("f") != "").select(F.from_json("f", schema).alias("s"))
    rows = parsed.select(*[F.col(f"s.properties.{c}").alias(c) for c in columns], F.col("s.geometry").alias("geometry"))
    rows = rows.dropna(how="all")
    return rows.withColumn("__box", box_of(F.col("geometry"))).select(*rows.columns, "__box.*")


def to_features(rows: DataFrame, geometry: str = "geometry") -> DataFrame:
    """(feature): each row as a GeoJSON feature, its other columns being properties."""
    properties = F.to_json(F.struct(*[c for c in rows.columns if c not in (geometry, "west", "south", "east", "north")]), {"ignoreNullFields": "false"})
    text = F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), F.coalesce(F.col(geometry), F.lit("null")), F.lit("}"))
    return rows.select(text.alias("feature"))


def write_geojson(rows: DataFrame, path: str, geometry: str = "geometry") -> None:
    """A feature a line, written by all tasks (GeoJSON text sequences)."""
    to_features(rows, geometry).write.mode("overwrite").text(path)


def cell_polygon(row: Column, col: Column, g) -> Column:
    """A cell as GeoJSON text."""
    x0, y1 = F.lit(g.x0) + col * g.cx, F.lit(g.y0) + row * g.cy
    x1, y0 = x0 + g.cx, y1 + g.cy
    point = lambda x, y: F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]"))
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.concat_ws(",", point(x0, y1), point(x1, y1), point(x1, y0), point(x0, y0), point(x0, y1)), F.lit("]]}"))


def coverage_features(coverage: DataFrame, g) -> DataFrame:
    """Coverage (row, col, coverage, cell_coverage, name) with each cell as a polygon."""
    return coverage.select("row", "col", "coverage", F.col("cell_coverage").alias("cellcoverage"), "name", cell_polygon(F.col("row"), F.col("col"), g).alias("geometry"))


def filtered(rows: DataFrame, where: str | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Rows that an SQL condition holds for and whose box meets ``box``; both are pushed into the scan."""
    if where:
        rows = rows.where(where)
    if box:
        west, south, east, north = box
        rows = rows.where((F.col("east") >= west) & (F.col("west") <= east) & (F.col("north") >= south) & (F.col("south") <= north))
    return rows


def open_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """A reader by the format of the path; text formats give strings, typed by ``functions.parse``."""
    kind = tables.kind_of_file(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "geojson":
        return read_geojson(spark, path, options.get("columns", {}))
    if kind == "csv":
        return tables.read_csv(spark, path, **options)
    if kind == "xlsx":
        return tables.read_xlsx(spark, path, **options)
    if kind in ("geopackage", "mbtiles"):
        return tables.read_sqlite(spark, path, options["table"], options["schema"])
    raise ValueError(f"no reader for {kind or 'this kind of file'}: {path}")
