"""Tabular readers: CSV, XLSX and SQLite containers, with types inferred or given."""

from __future__ import annotations

import io
import re
import sqlite3
import tempfile
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import parse

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def kind_of_file(path: str) -> str:
    """Format by suffix or prefix."""
    low = path.lower()
    for prefix, kind in (("pg:", "postgis"), ("netcdf:", "netcdf")):
        if low.startswith(prefix):
            return kind
    suffix = low.rpartition(".")[2] if "." in low else ""
    known = {"asc": "asc", "tif": "geotiff", "tiff": "geotiff", "gif": "gif", "png": "png", "map": "pcraster", "nc": "netcdf", "mbtiles": "mbtiles", "db": "mbtiles", "gpkg": "geopackage", "grib": "grib",
             "csv": "csv", "xlsx": "xlsx", "tab": "tab", "shp": "shape", "dbf": "shape", "geojson": "geojson", "json": "geojson", "parquet": "parquet", "arrow": "arrow", "vrt": "vrt"}
    return known.get(suffix, "unknown")


def _named(df: DataFrame, names: list[str]) -> DataFrame:
    return df.toDF(*[re.sub("^﻿", "", n) for n in names])


def read_csv(spark: SparkSession, path: str, *, header: bool = True, types: dict[str, str] | None = None) -> DataFrame:
    """Typed rows with ``_errors``.  Without a header columns are Field1, Field2, ...; ``types`` also chooses columns."""
    raw = spark.read.csv(path, header=header, inferSchema=False, multiLine=True, ignoreLeadingWhiteSpace=False, quote='"', escape='"')
    raw = _named(raw, raw.columns if header else [f"Field{k + 1}" for k in range(len(raw.columns))])
    if not header and raw.columns:
        raw = raw.withColumn(raw.columns[0], F.regexp_replace(raw.columns[0], "^﻿", ""))
    return _typed(raw, types)


def _typed(raw: DataFrame, types: dict[str, str] | None) -> DataFrame:
    if types is None:
        found = {r["column"]: r["type"] for r in parse.infer_types(raw).collect()}  # a row for each column
        types = {c: found.get(c, "string") for c in raw.columns}
    return parse.typed(raw, types)


def sheet_rows(data: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """Cells of a sheet as text; dates stay serial numbers."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iterfind(".//m:sheet", _NS)]
    index = names.index(sheet) if sheet else 0
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in s.iterfind(".//m:t", _NS)) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)]
    rows = []
    for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{index + 1}.xml")).iterfind(".//m:row", _NS):
        cells: list[str | None] = []
        for cell in row.iterfind("m:c", _NS):
            at = 0
            for letter in re.match("[A-Z]+", cell.get("r", "A")).group():
                at = at * 26 + ord(letter) - 64
            cells += [None] * (at - len(cells))
            value, inline = cell.find("m:v", _NS), cell.find("m:is", _NS)
            text = value.text if value is not None else "".join(t.text or "" for t in inline.iterfind(".//m:t", _NS)) if inline is not None else None
            cells[at - 1] = shared[int(text)] if cell.get("t") == "s" and text is not None else text
        if any(c not in (None, "") for c in cells):
            rows.append(cells)
    return rows


def read_xlsx(spark: SparkSession, path: str, *, sheet: str | None = None, header: int | None = 0, types: dict[str, str] | None = None) -> DataFrame:
    """A sheet; ``header`` is the header's place among the rows that are not empty, None for no header.

    Files are parsed where they are read; the driver sees a header and the number of columns only.
    """

    def run(batches):
        for frame in batches:
            for data in frame["content"]:
                rows = sheet_rows(bytes(data), sheet)
                yield pd.DataFrame({"k": range(len(rows)), "cells": rows})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "k int, cells array<string>")
    width = rows.agg(F.max(F.size("cells"))).first()[0] or 0
    names = [f"Field{k + 1}" for k in range(width)]
    if header is not None and width:
        first = rows.where(F.col("k") == header).select("cells").first()
        given = list(first["cells"]) if first else []
        names = [(given[k] if k < len(given) and given[k] else names[k]) for k in range(width)]
        rows = rows.where(F.col("k") > header)
    raw = rows.select(*[F.try_element_at("cells", F.lit(k + 1)).alias(n) for k, n in enumerate(names)]) if width else spark.createDataFrame([], "Field1 string")
    return _typed(raw, types)


def serial_to_timestamp(serial):
    """Spreadsheet day number; day 60, a leap day that never was, is counted."""
    return F.timestamp_seconds((serial - 25569) * 86400).cast("timestamp_ntz")


def _with_database(data: bytes, use):
    with tempfile.NamedTemporaryFile(suffix=".db") as f:  # read in the same call, by the same process
        f.write(data)
        f.flush()
        con = sqlite3.connect(f.name)
        try:
            return use(con)
        finally:
            con.close()


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, where: str = "", values: tuple = ()) -> DataFrame:
    """A table of every SQLite file below ``path``, such as the tiles of MBTiles files; ``where``, with ``values`` for its
    question marks, is answered by the files' own index."""
    names = ", ".join(f'"{f.split()[0]}"' for f in schema.split(","))
    text = f'SELECT {names} FROM "{table}"' + (f" WHERE {where}" if where else "")

    def run(batches):
        for frame in batches:
            for data in frame["content"]:
                yield _with_database(bytes(data), lambda con: pd.read_sql_query(text, con, params=values))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def mbtiles_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row with all names and values as a map."""
    pairs = read_sqlite(spark, path, "metadata", "name string, value string")
    return pairs.agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("metadata"))  # a few rows a file


def read_mbtiles(spark: SparkSession, path: str, tile: tuple[int, int, int] | None = None) -> DataFrame:
    """(z, x, y, data), of one tile if (z, x, y) is given."""
    where = "zoom_level = ? AND tile_column = ? AND tile_row = ?" if tile else ""
    raw = read_sqlite(spark, path, "tiles", "zoom_level int, tile_column int, tile_row int, tile_data binary", where, tuple(tile or ()))
    return raw.select(F.col("zoom_level").alias("z"), F.col("tile_column").alias("x"), F.col("tile_row").alias("y"), F.col("tile_data").alias("data"))


def write_mbtiles(tiles: DataFrame, path: str, metadata: dict[str, str]) -> int:
    """Export (z, x, y, data) to one local MBTiles file, a partition at a time; returns the tiles written."""
    con, n = sqlite3.connect(path), 0
    with con:
        con.execute("CREATE TABLE metadata (name TEXT, value TEXT)")
        con.execute("CREATE TABLE tiles (zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data BLOB)")
        con.execute("CREATE UNIQUE INDEX tile_index ON tiles (zoom_level, tile_column, tile_row)")
        con.executemany("INSERT INTO metadata VALUES (?, ?)", metadata.items())
        for r in tiles.select("z", "x", "y", "data").toLocalIterator():
            con.execute("INSERT INTO tiles VALUES (?, ?, ?, ?)", (r["z"], r["x"], r["y"], bytes(r["data"])))
            n += 1
    con.close()
    return n
