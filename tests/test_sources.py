import numpy as np
import pytest
from pyspark.sql import functions as F

from rastra.functions import dtypes, parse
from rastra.plans import load
from rastra.sources import codecs, geotiff, tables
from rastra.streaming import mosaic


def sample(h=11, w=9):
    x = np.arange(h * w, dtype=float).reshape(h, w) % 200
    x[2, 3] = np.nan
    return x


@pytest.mark.parametrize("dtype", codecs.TYPES)
def test_raster_tile_round_trip(dtype):
    x = sample() % 100
    back, kind = codecs.decode_tile(codecs.encode_tile(x, dtype))
    assert kind == dtype
    np.testing.assert_array_equal(back, x)
    with pytest.raises(ValueError):
        codecs.decode_tile(b"x" * 20)


def test_float_png_round_trip():
    x = sample() / 7
    np.testing.assert_allclose(codecs.decode_float_png(codecs.encode_float_png(x)), x, rtol=1e-6)


@pytest.mark.parametrize("tile,compression", [(None, 1), (None, 8), (16, 8), (16, 50000)])
def test_geotiff(spark, tmp_path, tile, compression):
    x = sample(20, 37)
    (tmp_path / "a.tif").write_bytes(geotiff.encode(x, "f32", gt=[10.0, 2.0, 0, 50.0, 0, -2.0], nodata=-9.0, tile=tile, compression=compression, epsg=3857))
    uri = f"file://{tmp_path}"
    meta = geotiff.metadata(spark, uri).first()
    assert (meta["rows"], meta["cols"], meta["nodata"], meta["epsg"], meta["gt"]) == (20, 37, -9.0, 3857, [10.0, 2.0, 0, 50.0, 0, -2.0])
    got = {(r["row"], r["col"]): r["value"] for r in geotiff.read(spark, uri).collect()}
    assert len(got) == x.size and all(v == (None if np.isnan(x[k]) else x[k]) for k, v in got.items())
    part = geotiff.read(spark, uri, region=(5, 30, 4, 7)).collect()
    assert len(part) == 28 and all(r["value"] == x[r["row"], r["col"]] for r in part)


def test_predictors_and_lzw():
    image = geotiff.Image(4, 1, 1, "u8", 1, 2, 4, 1, [], [])
    assert geotiff.chunk(image, bytes([5, 1, 255, 2])).tolist() == [[5, 6, 5, 7]]
    # codes of nine bits: clear, 7, 7, 258, end
    bits = "".join(f"{c:09b}" for c in (256, 7, 7, 258, 257))
    data = int(bits.ljust(48, "0"), 2).to_bytes(6, "big")
    assert geotiff.lzw(data) == bytes([7, 7, 7, 7])
    with pytest.raises(ValueError):
        geotiff.parse(b"no tiff at all")


def test_csv_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Name,Count,Share,Day,Flag\nx,1,0.5,2023-05-17 0:00:00,ja\n,7,2,1/31/2020,0\n")
    df = tables.read_csv(spark, f"file://{tmp_path}/a.csv")
    assert dict(df.dtypes) == {"Name": "string", "Count": "bigint", "Share": "double", "Day": "timestamp_ntz", "Flag": "boolean", "_errors": "array<string>"}
    second = df.where("Count = 7").first()
    assert (second["Name"], str(second["Day"]), second["Flag"], second["_errors"]) == (None, "2020-01-31 00:00:00", False, [])
    chosen = tables.read_csv(spark, f"file://{tmp_path}/a.csv", types={"Name": "int", "Count": "float"})
    assert chosen.columns == ["Name", "Count", "_errors"] and chosen.where("Count = 1").first()["_errors"] == ["Name"]


def test_xlsx(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>k</t></si><si><t>v</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"/><row r="3"><c r="B3"><v>2.5</v></c></row></sheetData></worksheet>')
    rows = tables.read_xlsx(spark, f"file://{tmp_path}/a.xlsx").collect()
    assert [(r["k"], r["v"]) for r in rows] == [(None, 2.5)]
    day = spark.range(1).select(tables.serial_to_timestamp(F.lit(45063.0)).cast("string")).first()[0]
    assert day == "2023-05-17 00:00:00"


def test_mbtiles_round_trip(spark, tmp_path):
    tiles = spark.createDataFrame([(1, 0, 1, bytearray(b"abc")), (2, 3, 1, bytearray(b""))], "z int, x int, y int, data binary")
    assert tables.write_mbtiles(tiles, str(tmp_path / "a.mbtiles"), {"name": "n"}) == 2
    got = tables.read_mbtiles(spark, f"file://{tmp_path}/a.mbtiles").where("z = 1").collect()
    assert [tuple(r) for r in got] == [(1, 0, 1, bytearray(b"abc"))]


def test_parsing(spark):
    df = spark.createDataFrame([("JA", "2010-2015"), ("non", "x"), ("", None)], "a string, b string")
    got = df.select(parse.parse_bool(F.col("a")).alias("a"), parse.parse_int_range(F.col("b")).alias("b")).collect()
    assert [(r["a"], r["b"] and tuple(r["b"])) for r in got] == [(True, (2010, 2015)), (False, None), (None, None)]
    assert dtypes.result_dtype("i32", "i64") == "i32" and dtypes.result_dtype("i64", "i32") == "i64" and dtypes.result_dtype("u8", "u64") == "u64"
    assert dtypes.division_dtype("f64", "f32") == "f32" and dtypes.division_dtype("u8", "i8") == "f64"
    assert tables.kind_of_file("A.TIF") == "geotiff" and tables.kind_of_file("pg:x") == "postgis" and tables.kind_of_file("x") == "unknown"


@pytest.mark.parametrize("zone", ["UTC", "Europe/Brussels", "America/New_York"])
def test_dates_of_millis_in_any_zone(spark, tmp_path, zone):
    duckdb = pytest.importorskip("duckdb")
    millis = [0, -1, -62135596800000, None, 1445734441000, 1445738041001, 1427592600000, 576467453123001, 8210266876799999]  # two in the hour that Brussels repeats, one in the hour it skips
    keys = [0, -1, None, 79559, 79923, 6672076, 6672077, 6672079, -6672077, 8999999, 100000001]  # from 6672077 on DuckDB rounds seconds
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        spark.createDataFrame([(m,) for m in millis], "m long").select("m", parse.date_of_millis(F.col("m")).alias("d")).write.parquet(str(tmp_path / "dates"))
        load().QUERIES["epoch_millis"](spark, str(tmp_path)).write.parquet(str(tmp_path / "query"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    db = duckdb.connect()
    found = db.execute(f"SELECT m, epoch_us(d) FROM read_parquet('{tmp_path}/dates/*.parquet')").fetchall()
    assert sorted(found, key=str) == sorted([(m, None if m is None else m * 1000) for m in millis], key=str)  # exact
    db.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    sides = [db.execute(f"SELECT o_orderkey, epoch_us(d) FROM ({q}) ORDER BY 1").fetchall() for q in (load().ORACLES["epoch_millis"], f"SELECT * FROM read_parquet('{tmp_path}/query/*.parquet')")]
    assert len(sides[0]) == len(keys) and sides[0] == sides[1]


def test_stream_mosaic(spark, tmp_path):
    rows = spark.createDataFrame([("2020-01-01 00:00:00", "r", 0, 0, 1.0), ("2020-01-01 02:00:00", "r", 0, 0, 2.0)], "ts string, raster_id string, row int, col int, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = stream.writeStream.foreachBatch(mosaic.merge_into(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert [r["value"] for r in spark.read.parquet(str(tmp_path / "out" / "v0")).collect()] == [2.0]
    assert [r["value"] for r in mosaic.latest(rows).collect()] == [2.0]
