"""Reference systems, warps, colours, files, layers and polygons."""

import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rastra.functions import colours, crs, geo, legends
from rastra.functions.geo import Georef
from rastra.operators import algebra as A, layers as L, polygonize as P, stats, warp as W
from rastra.sources import geotiff, tables, vector


def cells_of(spark, values, name="r"):
    rows = [(name, r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(np.array(values, float))]
    return spark.createDataFrame(rows, "raster_id string, row int, col int, value double")


def grid_of(df, shape):
    out = np.full(tuple(map(int, shape)), np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r["value"] is None else r["value"]
    return out


# ---- reference systems


@pytest.mark.parametrize("code, lon, lat, x, y, near", [
    (3035, 5.0, 50.0, 3962799.45, 2999718.85, 0.01),  # the example of the system's definition
    (3035, 10.0, 52.0, 4321000.0, 3210000.0, 1e-6),
    (32632, 9.0, 0.0, 500000.0, 0.0, 1e-6),
    (32631, 3.0, 45.0, 500000.0, 4982950.400, 0.01),
    (32733, 15.0, -45.0, 500000.0, 1e7 - 4982950.400, 0.01),
    (3812, 4.359215833333333, 50.797815, 649328.0, 665262.0, 1e-3),
    (3857, 180.0, 85.0511287798066, 20037508.342789244, 20037508.342789244, 1e-3),
])
def test_known_points(code, lon, lat, x, y, near):
    got = crs.transform(lon, lat, "EPSG:4326" if code != 3035 else "EPSG:4258", code)
    assert abs(got[0] - x) < near and abs(got[1] - y) < near


@pytest.mark.parametrize("code", [31370, 3812, 3035, 32631, 3857, 3395, 4313])
def test_there_and_back_in_columns_and_numbers(spark, code):
    lon, lat = np.array([2.5, 4.4, 6.1]), np.array([49.6, 50.8, 51.4])
    x, y = crs.transform(lon, lat, 4326, code)
    back = crs.transform(x, y, code, 4326)
    assert np.allclose(back[0], lon, atol=1e-7) and np.allclose(back[1], lat, atol=1e-7)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lon, lat)], "lon double, lat double")
    got = np.array(crs.project(df, F.col("lon"), F.col("lat"), 4326, code).select("x", "y").collect())
    assert np.allclose(got[:, 0], x, atol=1e-6) and np.allclose(got[:, 1], y, atol=1e-6)


def test_definitions():
    wkt = 'PROJCS["Belge Lambert 72",GEOGCS["Belge 72",AUTHORITY["EPSG","4313"]],UNIT["metre",1],AUTHORITY["EPSG","31370"]]'
    assert crs.epsg_of(wkt) == 31370 and crs.parse(wkt).kind == "lcc"
    assert crs.parse("WGS84").geographic and crs.parse("epsg:3857").kind == "merc"
    assert crs.parse("+proj=utm +zone=31 +datum=WGS84").p["lon_0"] == 3
    for bad in ("", "EPSG:1", "+proj=robin", "nonsense"):
        with pytest.raises((ValueError, KeyError)):
            crs.parse(bad)


def test_target_grids():
    source = Georef(120, 240, 22000.0, 245000.0, 1000.0, -1000.0)
    natural = W.georeference(source, 31370, 3857)
    assert natural.cx == -natural.cy and abs(natural.cx / 1000 - 1.59) < 0.02
    sized = W.georeference(source, 31370, 3857, size=(50, 80))
    assert (sized.rows, sized.cols) == (50, 80) and np.allclose(sized.box, W.warped_box(source.box, 31370, 3857))
    for aligned in (False, True):
        g = W.georeference(source, 31370, 3857, cell=(500.0, -500.0), aligned=aligned)
        assert g.cx == 500 and (not aligned or (g.x0 / 500 % 1 == 0 and g.y0 / 500 % 1 == 0))
    exact = Georef(3, 4, 0.0, 0.0, 1.0, -1.0)
    assert W.georeference(source, 31370, 3857, exact=exact) == exact


def test_warp_by_hand_and_interpolated(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(1, 99, size=(30, 40)).astype(float)
    source = Georef(30, 40, 150000.0, 200000.0, 1000.0, -1000.0)
    target = W.georeference(source, 31370, 3035)
    want = np.full((target.rows, target.cols), np.nan)
    for r in range(target.rows):
        for c in range(target.cols):
            x, y = crs.transform(target.x0 + (c + 0.5) * target.cx, target.y0 + (r + 0.5) * target.cy, 3035, 31370)
            i, j = int(np.floor((y - source.y0) / source.cy)), int(np.floor((x - source.x0) / source.cx))
            if 0 <= i < 30 and 0 <= j < 40:
                want[r, c] = values[i, j]
    cells = cells_of(spark, values)
    assert np.array_equal(grid_of(W.warp(cells, source, target, 31370, 3035), want.shape), want, equal_nan=True)
    fast = grid_of(W.warp(cells, source, target, 31370, 3035, error=0.125), want.shape)
    assert np.mean((fast == want) | (np.isnan(fast) & np.isnan(want))) > 0.97


# ---- grids and tiles


def test_constructors():
    g = geo.from_bottom_left(10, 20, 5.0, 7.0, 2.0)
    assert g.box == (5.0, 7.0, 45.0, 27.0)
    t = geo.from_tile(1, 1, 0)
    assert t.x0 == 0 and abs(t.y0 - geo.CIRCUMFERENCE / 2) < 1e-6 and t.rows == 256
    part = geo.intersection(Georef(10, 10, 0.0, 10.0, 1.0, -1.0), Georef(10, 10, 4.0, 8.0, 1.0, -1.0))
    assert part == Georef(8, 6, 4.0, 8.0, 1.0, -1.0)
    assert geo.intersection(Georef(2, 2, 0.0, 2.0, 1.0, -1.0), Georef(2, 2, 9.0, 2.0, 1.0, -1.0)) is None
    with pytest.raises(ValueError):
        geo.intersection(Georef(2, 2, 0.0, 2.0, 1.0, -1.0), Georef(2, 2, 0.5, 2.0, 1.0, -1.0))
    x = geo.xyz_aligned(Georef(100, 100, 100.0, 50000.0, 150.0, -150.0), 9)
    side = geo.CIRCUMFERENCE / 2**9
    assert x.rows % 256 == 0 and x.cols % 256 == 0 and abs((x.x0 + geo.CIRCUMFERENCE / 2) / side % 1) < 1e-9
    assert geo.size_for_tiles(-10, -10, 10, 10, 3) == (512, 512)


# ---- colours


def test_every_map_has_256_colours_and_a_reverse():
    assert len(colours.NAMES) == 60
    for name in colours.NAMES:
        a = legends.preset(name.upper())
        assert len(a) == 256 and all(c & 255 == 255 for c in a) and legends.preset(name + "_r") == a[::-1]


def test_known_colours():
    assert legends.preset("jet")[0] == 0x000080FF and legends.preset("jet")[255] == 0x800000FF
    assert legends.preset("tab10")[0] == 0x1F77B4FF and legends.preset("tab10")[255] == 0x17BECFFF
    assert colours.by_functions(lambda x: x, lambda x: 0.0, lambda x: 1 - x, 3) == [0x0000FFFF, 0x800080FF, 0xFF0000FF]
    assert colours.placed([(0.0, 0x000000FF), (0.25, 0xFF0000FF), (1.0, 0xFF00FFFF)], 5)[1] == 0xFF0000FF
    faded = colours.faded([0xFFFFFFFF] * 4, fade_in=0.5)
    assert [c & 255 for c in faded] == [0, 127, 255, 255]


# ---- cells


def test_sizes_that_differ_fail(spark):
    a, b = cells_of(spark, np.ones((3, 3))), cells_of(spark, np.ones((3, 4)))
    for f in (lambda: A.binary(a, b, "add"), lambda: A.inclusive(a, b, "sub"), lambda: A.diff(a, b)):
        with pytest.raises(PySparkException):
            f().collect()
    assert A.same_size(a, b).first()["same"] is False and A.same_size(a, a).first()["same"] is True


def test_typed_rasters(spark):
    a, b = cells_of(spark, [[250.0, 100.0, np.nan]]), cells_of(spark, [[10.0, 55.0, 7.0]])
    added, dtype = A.typed_binary(a, b, "add", "u8", "u8")
    assert dtype == "u8" and np.array_equal(grid_of(added, (1, 3)), [[4.0, 155.0, np.nan]], equal_nan=True)
    held, _ = A.typed_inclusive(a, b, "add", "u8", "u8")
    assert np.array_equal(grid_of(held, (1, 3)), [[254.0, 155.0, 7.0]])
    assert A.typed_binary(a, b, "div", "f32", "f64")[1] == "f32" and A.typed_binary(a, b, "mul", "i64", "i32")[1] == "i64"


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(n, 0, k, None if k % 9 == 0 else float(v)) for n in ("a", "b") for k, v in enumerate(rng.integers(-20, 20, size=501))] + [("none", 0, 0, None)]
    df = spark.createDataFrame(rows, "raster_id string, row int, col int, value double").repartition(5)
    qs = [0.0, 0.1, 0.33, 0.5, 0.999, 1.0]
    got = {r["raster_id"]: r["quantiles"] for r in stats.quantiles(df, qs).collect()}
    for n in ("a", "b"):
        values = [r[3] for r in rows if r[0] == n and r[3] is not None]
        assert np.allclose(got[n], np.quantile(values, qs))
    assert got["none"] is None
    with pytest.raises(ValueError):
        stats.quantiles(df, [1.5])


# ---- files


@pytest.mark.parametrize("dtype, nodata, compression, predictor", [("f32", None, 8, 1), ("f64", -1.0, 1, 3), ("u8", 255.0, 50000, 2), ("i16", -9999.0, 8, 2), ("f32", None, 8, 3)])
def test_cog_round_trip(spark, tmp_path, dtype, nodata, compression, predictor):
    rng = np.random.default_rng(3)
    values = rng.integers(1, 200, size=(70, 50)).astype(float)
    values[rng.random(values.shape) < 0.1] = np.nan
    values[:16, :16] = np.nan
    g = Georef(70, 50, 10.0, 80.0, 0.5, -0.5)
    uri = f"file://{tmp_path}/cog"
    made = geotiff.write_cog(cells_of(spark, values), g, uri, levels=3, tile=16, dtype=dtype, nodata=nodata, compression=compression, predictor=predictor, sparse=True, epsg=4326).collect()
    data = (tmp_path / "cog" / "r.tif").read_bytes()
    assert geotiff.is_cog(data) and made[0]["bytes"] == len(data)
    images = geotiff.parse(data)
    assert [(i.height, i.width) for i in images] == [(70, 50), (35, 25), (18, 13)] and images[0].gt == [10.0, 0.5, 0.0, 80.0, 0.0, -0.5] and images[0].epsg == 4326
    assert images[0].sizes[0] == 0  # no data at all: no chunk
    assert np.array_equal(grid_of(geotiff.read(spark, uri), values.shape), values, equal_nan=True)
    assert geotiff.header(uri + "/r.tif", first=64)[2].width == 13  # the buffer grows until all directories are in it


def test_writers_refuse_what_a_type_cannot_hold(spark, tmp_path):
    with pytest.raises(ValueError):
        geotiff.write_cog(cells_of(spark, [[1.0]]), Georef(1, 1, 0, 0, 1, -1), f"file://{tmp_path}/x", dtype="u8", nodata=-1.0)


def test_gdal_metadata():
    found = geotiff.gdal_metadata('<GDALMetadata><Item name="OFFSET" sample="0" role="offset">5</Item><Item name="SCALE" sample="0" role="scale">0.5</Item><Item name="STATISTICS_MAXIMUM" sample="0">9</Item><Item name="AREA">Point</Item></GDALMetadata>')
    assert found == {"scale": {1: 0.5}, "offset": {1: 5.0}, "statistics": {1: {"maximum": 9.0}}, "items": {"AREA": "Point"}}


def test_mbtiles_by_key(spark, tmp_path):
    path = str(tmp_path / "t.mbtiles")
    tiles = spark.createDataFrame([(1, x, y, bytes([x, y])) for x in range(2) for y in range(2)], "z int, x int, y int, data binary")
    assert tables.write_mbtiles(tiles, path, {"name": "demo", "format": "png"}) == 4
    assert [tuple(r) for r in tables.read_mbtiles(spark, path, (1, 1, 0)).collect()] == [(1, 1, 0, bytearray([1, 0]))]
    assert tables.mbtiles_metadata(spark, path).first()["metadata"] == {"name": "demo", "format": "png"}


def test_geojson_collections(spark, tmp_path):
    feature = lambda k, v: {"type": "Feature", "properties": {"id": k, "name": v}, "geometry": {"type": "Point", "coordinates": [k, -k]} if k else None}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(1, "x"), feature(2, None), {"type": "Feature", "properties": {}, "geometry": None}]}))
    rows = vector.open_table(spark, f"{tmp_path}/a.geojson", columns={"id": "int", "name": "string"}).orderBy("id").collect()
    assert [(r["id"], r["name"], r["west"], r["south"]) for r in rows] == [(1, "x", 1.0, -1.0), (2, None, 2.0, -2.0)]
    with pytest.raises(ValueError):
        vector.open_table(spark, "pg:somewhere")


# ---- layers and polygons


def test_tile_of_a_layer(spark):
    g = Georef(20, 20, -10.0, 10.0, 1.0, -1.0)
    values = np.arange(400.0).reshape(20, 20)
    tile = L.get_tile(cells_of(spark, values), g, 3, 4, 3, size=8)
    got = grid_of(tile, (8, 8))
    assert tile.count() == 64 and got[7, 0] == values[g.rows // 2 - 3, 12] and np.isnan(got[0, 0])
    whole = L.encoded(tile, 8)
    assert np.array_equal(grid_of(L.decoded(whole), (8, 8)), got, equal_nan=True)


def test_polygons_with_holes(spark):
    values = np.array([[1, 1, 1, 2], [1, 2, 1, 2], [1, 1, 1, np.nan], [3, 3, 1, 1]], float)
    g = Georef(4, 4, 0.0, 4.0, 1.0, -1.0)
    got = {(r["value"], r["cells"]): json.loads(r["geometry"])["coordinates"] for r in P.polygonize(cells_of(spark, values), g).collect()}
    assert set(got) == {(1.0, 10), (2.0, 1), (2.0, 2), (3.0, 2)}
    area = lambda ring: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2
    rings = got[(1.0, 10)]
    assert len(rings) == 2 and abs(abs(area(rings[0])) - abs(area(rings[1])) - 10) < 1e-9 and area(rings[0]) * area(rings[1]) < 0
    assert len(got[(3.0, 2)][0]) == 5  # straight sides are one
    for ring in rings:
        assert ring[0] == ring[-1]
