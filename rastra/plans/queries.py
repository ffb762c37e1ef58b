"""Queries for every operator over the derived rasters, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geo, legends, parse
from ..functions.geo import Georef
from ..operators import algebra as A, clusters, coverage as C, distance as D, stats, tiling
from . import grids as G
from .registry import query

QS = [0.0, 0.25, 0.5, 0.75, 1.0]


def out(df: DataFrame, digits: int = 6, value: str = "value") -> DataFrame:
    return df.select("row", "col", F.round(value, digits).alias("value"))


def sql(body: str, more: str = "") -> str:
    return G.SQL + (", " + more if more else "") + body


def cells_sql(expression: str, source: str = "demand", more: str = "") -> str:
    return sql(f'SELECT r AS "row", c AS "col", round(({expression})::DOUBLE, 6) AS value FROM {source}', more)


PAIR = "(SELECT a.r, a.c, a.v AS x, b.v AS y FROM demand a JOIN price b ON a.r = b.r AND a.c = b.c)"

# ---- statistics


@query("raster_stats", sql("""SELECT 'r' AS raster_id, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, median(v) AS median, round(stddev_pop(v), 6) AS stddev,
  quantile_cont(v, 0) AS q0, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3, quantile_cont(v, 1) AS q4,
  count(v) AS data_count, count(*) - count(v) AS nodata_count, coalesce(sum(v), 0) AS sum FROM demand"""))
def raster_stats(spark, sf):
    s = stats.statistics(G.demand(spark, sf), QS)
    return s.select("raster_id", "min", "max", F.round("mean", 6).alias("mean"), "median", F.round("stddev", 6).alias("stddev"), *[F.col("quantiles")[k].alias(f"q{k}") for k in range(5)], "data_count", "nodata_count", "sum")


@query("min_max", sql("SELECT 'r' AS raster_id, min(v) AS min, max(v) AS max FROM demand"))
def min_max(spark, sf):
    return stats.min_max(G.demand(spark, sf))


@query("quantiles", sql("SELECT 'r' AS raster_id, quantile_cont(v, 0.1) AS q10, quantile_cont(v, 0.9) AS q90 FROM demand"))
def quantiles(spark, sf):
    q = stats.quantiles(G.demand(spark, sf), [0.1, 0.9])
    return q.select("raster_id", F.col("quantiles")[0].alias("q10"), F.col("quantiles")[1].alias("q90"))


@query("quantiles_neg_pos", sql("""SELECT 'r' AS raster_id, quantile_cont(v - 400, 0.5) FILTER (v < 400) AS neg, quantile_cont(v - 400, 0.5) FILTER (v >= 400) AS pos FROM demand"""))
def quantiles_neg_pos(spark, sf):
    q = stats.quantiles_neg_pos(A.scalar(G.demand(spark, sf), "sub", 400.0), [0.5])
    return q.select("raster_id", F.col("negative")[0].alias("neg"), F.col("positive")[0].alias("pos"))


@query("nodata_count", sql("SELECT 'r' AS raster_id, count(*) AS cells, count(*) - count(v) AS nodata_count, coalesce(sum(v), 0) AS sum FROM demand"))
def nodata_count(spark, sf):
    return stats.counts(G.demand(spark, sf))


@query("embedding_stats", """SELECT vec_id AS raster_id, round(min(x)::DOUBLE, 6) AS min, round(max(x)::DOUBLE, 6) AS max FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id""")
def embedding_stats(spark, sf):
    e = G.table(spark, sf, "embeddings").select(F.col("vec_id").alias("raster_id"), F.posexplode("embedding").alias("k", "x"))
    cells = e.select("raster_id", F.expr("k div 8").alias("row"), (F.col("k") % 8).alias("col"), F.col("x").cast("double").alias("value"))
    return stats.min_max(cells).select("raster_id", F.round("min", 6).alias("min"), F.round("max", 6).alias("max"))


# ---- map algebra

for _op, _sign in (("add", "x + y"), ("sub", "x - y"), ("mul", "x * y"), ("div", "x / nullif(y, 0)")):

    @query(f"raster_{_op}", cells_sql(_sign, PAIR))
    def raster_op(spark, sf, op=_op):
        return out(A.binary(G.demand(spark, sf), G.price(spark, sf), op))


for _op, _sign in (("add", "v + 7.5"), ("sub", "v - 7.5"), ("mul", "v * 7.5"), ("div", "v / 7.5")):

    @query(f"scalar_{_op}", cells_sql(_sign))
    def scalar_op(spark, sf, op=_op):
        return out(A.scalar(G.demand(spark, sf), op, 7.5))


@query("scalar_div_zero", cells_sql("v / nullif(0, 0)"))
def scalar_div_zero(spark, sf):
    return out(A.scalar(G.demand(spark, sf), "div", 0.0))


@query("add_inclusive", cells_sql("coalesce(x + y, x, y)", PAIR))
def add_inclusive(spark, sf):
    return out(A.inclusive(G.demand(spark, sf), G.price(spark, sf), "add"))


@query("sub_inclusive", cells_sql("coalesce(x - y, x, -y)", PAIR))
def sub_inclusive(spark, sf):
    return out(A.inclusive(G.demand(spark, sf), G.price(spark, sf), "sub"))


@query("sub_inclusive_unsigned", cells_sql("coalesce(x - y, x)", PAIR))
def sub_inclusive_unsigned(spark, sf):
    return out(A.inclusive(G.demand(spark, sf), G.price(spark, sf), "sub", signed=False))


@query("cast_u8", cells_sql("CASE WHEN trunc(v / 3) BETWEEN 0 AND 254 THEN trunc(v / 3) END"))
def cast_u8(spark, sf):
    return out(A.cast(A.scalar(G.demand(spark, sf), "div", 3.0), "u8"))


@query("replace_value", cells_sql("CASE WHEN v = 1 THEN 9 ELSE v END", "landuse"))
def replace_value(spark, sf):
    return out(A.replace_value(G.landuse(spark, sf), 1, 9))


@query("replace_nodata", cells_sql("coalesce(v, -1)"))
def replace_nodata(spark, sf):
    return out(A.replace_nodata(G.demand(spark, sf), -1))


@query("value_to_nodata", cells_sql("nullif(v, 0)", "landuse"))
def value_to_nodata(spark, sf):
    return out(A.value_to_nodata(G.landuse(spark, sf), 0))


@query("is_data_mask", cells_sql("CASE WHEN v IS NULL THEN 0 ELSE 1 END"))
def is_data_mask(spark, sf):
    return out(A.with_value(A.is_data(G.demand(spark, sf)), F.col("value").cast("double")))


@query("is_nodata_mask", cells_sql("CASE WHEN v IS NULL THEN 1 ELSE 0 END"))
def is_nodata_mask(spark, sf):
    return out(A.with_value(A.is_nodata(G.demand(spark, sf)), F.col("value").cast("double")))


@query("filter_value", cells_sql("CASE WHEN v = 2 THEN v END", "landuse"))
def filter_value(spark, sf):
    return out(A.filter_values(G.landuse(spark, sf), [2]))


@query("filter_values", cells_sql("CASE WHEN v IN (1, 3) THEN v END", "landuse"))
def filter_values(spark, sf):
    return out(A.filter_values(G.landuse(spark, sf), [1, 3]))


_SCALE = "lim AS (SELECT min(v) AS lo, max(v) AS hi FROM demand), sc AS (SELECT r, c, lo, CASE WHEN hi = lo THEN 1.0 ELSE (hi - lo) / 254 END AS s, v FROM demand, lim)"


@query("scale_u8", cells_sql("round(greatest(0, least(254, (v - lo) / s))) + 0 * v", "sc", _SCALE))
def scale_u8(spark, sf):
    return out(A.scale(G.demand(spark, sf), "u8"))


@query("descale", cells_sql("(round(greatest(0, least(254, (v - lo) / s))) + 0 * v) * s + lo", "sc", _SCALE))
def descale(spark, sf):
    return out(A.descale(A.scale(G.demand(spark, sf), "u8")))


@query("window_read", cells_sql("v", "(SELECT * FROM demand WHERE r BETWEEN 5 AND 20 AND c BETWEEN 7 AND 30)"))
def window_read(spark, sf):
    return out(A.window(G.demand(spark, sf), 5, 7, 20, 30))


@query("region_read", sql("""SELECT i AS "row", j AS "col", d.v AS value FROM (SELECT (k // 20)::INTEGER AS i, (k % 20)::INTEGER AS j FROM range(400) t(k)) x LEFT JOIN demand d ON d.r = i + 54 AND d.c = j - 6"""))
def region_read(spark, sf):
    return out(A.read_region(G.demand(spark, sf), 54, -6, 20, 20))


@query("crop", sql("""SELECT r - r0 AS "row", c - c0 AS "col", CASE WHEN r > 9 AND c > 4 AND r < 50 THEN v END AS value FROM landuse,
  (SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM landuse WHERE r > 9 AND c > 4 AND r < 50) WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1"""))
def crop(spark, sf):
    return out(A.crop(A.with_value(G.landuse(spark, sf), F.when((F.col("row") > 9) & (F.col("col") > 4) & (F.col("row") < 50), F.col("value")))))


@query("raster_diff", sql(f"""SELECT r AS "row", c AS "col", x AS "left", y AS "right", CASE WHEN (x IS NULL) <> (y IS NULL) THEN 'nodata' ELSE 'data' END AS kind FROM {PAIR} WHERE x IS DISTINCT FROM y"""))
def raster_diff(spark, sf):
    return A.diff(G.demand(spark, sf), G.price(spark, sf)).select("row", "col", "left", "right", "kind")


@query("diff_summary", sql("""SELECT 'r' AS raster_id, count(*) FILTER (a.v IS NOT DISTINCT FROM b.v) AS matches, count(*) FILTER ((a.v IS NULL) <> (b.v IS NULL)) AS nodata_mismatches, count(*) FILTER (a.v <> b.v) AS data_mismatches FROM landuse a JOIN items b ON a.id = b.id"""))
def diff_summary(spark, sf):
    return A.diff_summary(G.landuse(spark, sf), G.items(spark, sf))


@query("tile_mosaic", cells_sql("coalesce(y, x)", PAIR))
def tile_mosaic(spark, sf):
    return out(A.mosaic([G.demand(spark, sf), G.price(spark, sf)]))


# ---- colours

RAMP = legends.preset("hot", 16)
BANDS = legends.equal_bands(0.0, 800.0, legends.preset("rdylgn", 10))
_LIST = "[" + ", ".join(map(str, RAMP)) + "]"


@query("legend_linear", sql(f"""SELECT r AS "row", c AS "col", CASE WHEN v IS NULL THEN 0 WHEN v < 100 - 1e-4 THEN 1 WHEN v > 700 + 1e-4 THEN 2
  ELSE {_LIST}[1 + round(greatest(0, least(1, (v - 100) / 600)) * 15)::INTEGER] END::BIGINT AS colour FROM demand"""))
def legend_linear(spark, sf):
    return G.demand(spark, sf).select("row", "col", legends.linear(F.col("value"), 100.0, 700.0, RAMP, low=1, high=2).alias("colour"))


_BAND_SQL = " ".join(f"WHEN v >= {a} AND v < {b} THEN {c}" for a, b, c in BANDS)


@query("legend_banded", sql(f"""SELECT r AS "row", c AS "col", CASE WHEN v IS NULL THEN 0 WHEN v < -1e-4 THEN 0 WHEN v > 800 + 1e-4 THEN 0 {_BAND_SQL} WHEN abs(v - 800) <= 1e-4 THEN {BANDS[-1][2]} ELSE 0 END::BIGINT AS colour FROM demand"""))
def legend_banded(spark, sf):
    return G.demand(spark, sf).select("row", "col", legends.banded(F.col("value"), BANDS).alias("colour"))


@query("demand_colored", sql(f"""SELECT r AS "row", c AS "col", v AS value, CASE WHEN v IS NULL THEN 0 WHEN v < -1e-4 THEN 0 WHEN v > 800 + 1e-4 THEN 0 {_BAND_SQL} WHEN abs(v - 800) <= 1e-4 THEN {BANDS[-1][2]} ELSE 0 END::BIGINT AS colour FROM demand"""))
def demand_colored(spark, sf):
    return G.demand(spark, sf).select("row", "col", "value", legends.banded(F.col("value"), BANDS).alias("colour"))


@query("legend_categoric", sql("""SELECT r AS "row", c AS "col", CASE v WHEN 1 THEN 11 WHEN 2 THEN 22 ELSE 0 END::BIGINT AS colour FROM landuse"""))
def legend_categoric(spark, sf):
    return G.landuse(spark, sf).select("row", "col", legends.categoric(F.col("value"), {1: 11, 2: 22}, zero_is_nodata=True).alias("colour"))


@query("legend_string", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 255 WHEN 'O' THEN 4095 ELSE 0 END::BIGINT AS colour FROM orders""")
def legend_string(spark, sf):
    return G.table(spark, sf, "orders").select("o_orderkey", legends.categoric_text(F.col("o_orderstatus"), {"F": 255, "O": 4095}).alias("colour"))


@query("grey_levels", sql("""SELECT r AS "row", c AS "col", CASE WHEN v IS NULL THEN 0 ELSE round(greatest(0, least(1, v / 800)) * 255) END::INTEGER AS level FROM demand"""))
def grey_levels(spark, sf):
    return G.demand(spark, sf).select("row", "col", legends.grey(F.col("value"), 0.0, 800.0).alias("level"))


# ---- georeference and tiles

LIMIT = repr(geo.MAX_LATITUDE)


@query("cell_to_world", sql("""SELECT r AS "row", c AS "col", -32 + (c + 0.5::DOUBLE) AS x, 40 - (r + 0.5::DOUBLE) AS y FROM g"""))
def cell_to_world(spark, sf):
    x, y = geo.centre(F.col("row"), F.col("col"), G.MAP)
    return A.full_grid(spark, G.N, G.N).select("row", "col", x.alias("x"), y.alias("y"))


@query("point_to_cell", sql("""SELECT id, floor((lat - 40) / -1.0)::INTEGER AS "row", floor(lon + 32)::INTEGER AS "col", (floor((lat - 40) / -1.0) BETWEEN 0 AND 63 AND floor(lon + 32) BETWEEN 0 AND 63) AS on_map FROM points"""))
def point_to_cell(spark, sf):
    p = G.points(spark, sf)
    row, col = geo.cell_at(F.col("lon"), F.col("lat"), G.MAP)
    return p.select("id", row.alias("row"), col.alias("col"), geo.on_map(row, col, G.MAP).alias("on_map"))


_TILE = """least(255, greatest(0, floor((lon / 360 + 0.5 + 2.220446049250313e-16) * 256)))::INTEGER AS x,
  floor((0.5 - 0.25 * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / pi() + 2.220446049250313e-16) * 256)::INTEGER AS y"""


@query("tile_for_coordinate", sql(f"SELECT id, {_TILE} FROM points"))
def tile_for_coordinate(spark, sf):
    x, y = geo.tile_at(F.col("lon"), F.col("lat"), 8)
    return G.points(spark, sf).select("id", x.alias("x"), y.alias("y"))


@query("tiles_for_bounds", sql("""SELECT polygon_id, x::INTEGER AS x, y::INTEGER AS y FROM (SELECT polygon_id, unnest(range(floor((x0 / 360 + 0.5) * 64)::BIGINT, floor((x1 / 360 + 0.5) * 64)::BIGINT + 1)) AS x,
  floor((0.5 - 0.25 * ln((1 + sin(radians(y1))) / (1 - sin(radians(y1)))) / pi()) * 64) AS a, floor((0.5 - 0.25 * ln((1 + sin(radians(y0))) / (1 - sin(radians(y0)))) / pi()) * 64) AS b FROM rects) t, unnest(range(a::BIGINT, b::BIGINT + 1)) u(y)"""))
def tiles_for_bounds(spark, sf):
    b = G.rects(spark, sf).select("polygon_id", F.col("x0").alias("west"), F.col("y0").alias("south"), F.col("x1").alias("east"), F.col("y1").alias("north"))
    return geo.tiles_for_bounds(b, 6).select("polygon_id", "x", "y")


@query("zoom_for_pixel_size", """SELECT p_partkey, ceil(log2(156543.03392804097 / p_retailprice))::INTEGER AS higher, floor(log2(156543.03392804097 / p_retailprice))::INTEGER AS lower, round(log2(156543.03392804097 / p_retailprice))::INTEGER AS closest FROM part""")
def zoom_for_pixel_size(spark, sf):
    return G.table(spark, sf, "part").select("p_partkey", *[geo.zoom_for(F.col("p_retailprice"), s).alias(s) for s in ("higher", "lower", "closest")])


@query("mercator_roundtrip", sql("SELECT id, round(radians(lon) * 6378137, 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 3) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM points"))
def mercator_roundtrip(spark, sf):
    x, y = geo.to_mercator(F.col("lon"), F.col("lat"))
    p = G.points(spark, sf).select("id", x.alias("x"), y.alias("y"))
    lon, lat = geo.from_mercator(F.col("x"), F.col("y"))
    return p.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("pixel_lookup", sql("SELECT id, v AS value FROM points LEFT JOIN demand ON r = floor((lat - 40) / -1.0) AND c = floor(lon + 32)"))
def pixel_lookup(spark, sf):
    return tiling.look_up(G.points(spark, sf), G.demand(spark, sf), G.MAP, "lon", "lat").select("id", "value")


@query("extent_value_range", sql("SELECT 'r' AS raster_id, min(v) AS min, max(v) AS max FROM demand WHERE -32 + c + 0.5 BETWEEN -10 AND 12 AND 40 - r - 0.5 BETWEEN -5 AND 20"))
def extent_value_range(spark, sf):
    return tiling.value_range(G.demand(spark, sf), G.MAP, -10, -5, 12, 20)


@query("tile_pyramid", sql(f"""SELECT DISTINCT (8 - d)::INTEGER AS z, (x >> d)::INTEGER AS x, (y >> d)::INTEGER AS y FROM (SELECT {_TILE} FROM points) t, range(9) u(d)"""))
def tile_pyramid(spark, sf):
    x, y = geo.tile_at(F.col("lon"), F.col("lat"), 8)
    return tiling.pyramid(G.points(spark, sf).select(F.lit(8).alias("z"), x.alias("x"), y.alias("y")).distinct(), 0)


@query("downsample", sql('SELECT r // 4 AS "row", c // 4 AS "col", round(avg(v), 6) AS value FROM demand GROUP BY 1, 2'))
def downsample(spark, sf):
    return out(tiling.downsample(G.demand(spark, sf), 4))


_WEB = """least(31, greatest(0, floor(((-32 + c + 0.5) / 360 + 0.5) * 32)))::INTEGER AS x, floor((0.5 - 0.25 * ln((1 + sin(radians(39.5 - r))) / (1 - sin(radians(39.5 - r)))) / pi()) * 32)::INTEGER AS y"""


@query("tile_diff", sql(f"""SELECT 5 AS z, {_WEB}, a.r AS "row", a.c AS "col", round(b.v - a.v, 6) AS value FROM demand a JOIN (SELECT r AS br, c AS bc, v FROM price) b ON a.r = b.br AND a.c = b.bc""".replace(", a.r AS", ", r AS").replace(", a.c AS", ", c AS")))
def tile_diff(spark, sf):
    a, b = (tiling.web_tiles(f(spark, sf), G.MAP, 5) for f in (G.demand, G.price))
    return tiling.tile_diff(a, b).withColumn("value", F.round("value", 6))


@query("to_tiles_and_back", cells_sql("v"))
def to_tiles_and_back(spark, sf):
    return out(tiling.to_cells(tiling.to_tiles(G.demand(spark, sf), 24)))


OTHER = Georef(40, 50, -20.0, 50.0, 1.0, -1.0)


@query("cutout_offsets", sql('SELECT r + 10 AS "row", c - 12 AS "col", v AS value FROM demand WHERE r + 10 BETWEEN 0 AND 39 AND c - 12 BETWEEN 0 AND 49'))
def cutout_offsets(spark, sf):
    return out(tiling.shifted(G.demand(spark, sf), G.MAP.cut_out(OTHER)))


_WARP = tiling.mercator_georef(G.MAP, 50, 50)


@query("warp_nearest", sql(f"""SELECT i AS "row", j AS "col", d.v AS value FROM (SELECT i, j, floor((degrees(2 * atan(exp(({_WARP.y0!r}::DOUBLE + (i + 0.5) * {_WARP.cy!r}::DOUBLE) / 6378137)) - pi() / 2) - 40) / -1.0) AS sr,
  floor(degrees(({_WARP.x0!r}::DOUBLE + (j + 0.5) * {_WARP.cx!r}::DOUBLE) / 6378137) + 32) AS sc FROM (SELECT (k // 50)::INTEGER AS i, (k % 50)::INTEGER AS j FROM range(2500) t(k)) x) w LEFT JOIN demand d ON d.r = sr AND d.c = sc"""))
def warp_nearest(spark, sf):
    return out(tiling.warp_to_mercator(G.demand(spark, sf), G.MAP, _WARP))


# ---- distances


@query("distance_octile", sql("""SELECT g.r AS "row", g.c AS "col", round(min(greatest(abs(g.r - t.r), abs(g.c - t.c)) + (sqrt(2) - 1) * least(abs(g.r - t.r), abs(g.c - t.c))) * 100, 4) AS value FROM g, targets t WHERE t.v <> 0 GROUP BY 1, 2"""))
def distance_octile(spark, sf):
    return out(D.distance(G.targets(spark, sf), 100.0), 4)


def _shortest(edges: str, seeds: str = "SELECT id, CASE WHEN v <> 0 THEN 0.0 ELSE 1e9 END::DOUBLE FROM targets") -> str:
    return f"""e AS ({edges}), dd(id, d) USING KEY (id) AS ({seeds} UNION SELECT e.t, min(dd.d + e.w) FROM dd JOIN e ON e.s = dd.id JOIN recurring.dd r ON r.id = e.t WHERE dd.d + e.w < r.d - 1e-9 GROUP BY e.t)"""


@query("distance_obstacles", sql('SELECT g.r AS "row", g.c AS "col", CASE WHEN d < 1e8 THEN round(d * 10, 4) END AS value FROM dd JOIN g USING (id)',
       _shortest("SELECT e8.s, e8.t, e8.d AS w FROM e8 JOIN obstacles o ON o.id = e8.t AND o.v = 0 JOIN obstacles a ON a.id = e8.p JOIN obstacles b ON b.id = e8.q WHERE e8.dr = 0 OR e8.dc = 0 OR a.v = 0 OR b.v = 0")))
def distance_obstacles(spark, sf):
    found = D.distance_with_obstacles(G.targets(spark, sf), G.obstacles(spark, sf), 10.0)
    return out(A.with_value(found, F.when(F.col("value") < 1e8, F.col("value"))), 4)


@query("distance_obstacles_diagonal", sql('SELECT g.r AS "row", g.c AS "col", CASE WHEN d < 1e8 THEN round(d * 10, 4) END AS value FROM dd JOIN g USING (id)',
       _shortest("SELECT e8.s, e8.t, e8.d AS w FROM e8 JOIN obstacles o ON o.id = e8.t AND o.v = 0")))
def distance_obstacles_diagonal(spark, sf):
    found = D.distance_with_obstacles(G.targets(spark, sf), G.obstacles(spark, sf), 10.0, diagonals=True)
    return out(A.with_value(found, F.when(F.col("value") < 1e8, F.col("value"))), 4)


_MEAN = "SELECT e8.s, e8.t, e8.d / 2 * (a.v + b.v) AS w FROM e8 JOIN weight a ON a.id = e8.s AND a.v IS NOT NULL JOIN weight b ON b.id = e8.t AND b.v IS NOT NULL"
_ENTER = "SELECT e8.s, e8.t, e8.d * b.v AS w FROM e8 JOIN weight a ON a.id = e8.s AND a.v IS NOT NULL JOIN weight b ON b.id = e8.t AND b.v IS NOT NULL"
_PASSABLE = "SELECT t.id, CASE WHEN t.v <> 0 AND w.v IS NOT NULL THEN 0.0 ELSE 1e9 END::DOUBLE FROM targets t JOIN weight w USING (id)"


@query("travel_distance", sql('SELECT g.r AS "row", g.c AS "col", CASE WHEN w.v IS NOT NULL AND dd.d < 1e8 THEN round(dd.d, 4) END AS value FROM dd JOIN g USING (id) JOIN weight w USING (id)', _shortest(_MEAN, _PASSABLE)))
def travel_distance(spark, sf):
    found = D.travel_distance(G.targets(spark, sf), G.weight(spark, sf))
    return out(A.with_value(found, F.when(F.col("value") < 1e8, F.col("value"))), 4)


_NEAREST = """near AS (SELECT g.id, g.r, g.c, t.id AS tid, t.v, row_number() OVER (PARTITION BY g.id ORDER BY round(greatest(abs(g.r - t.r), abs(g.c - t.c)) + (sqrt(2) - 1) * least(abs(g.r - t.r), abs(g.c - t.c)), 6), t.id) AS k FROM g, targets t WHERE t.v <> 0)"""


@query("closest_target", sql('SELECT r AS "row", c AS "col", v AS value FROM near WHERE k = 1', _NEAREST))
def closest_target(spark, sf):
    return out(D.closest_target(G.targets(spark, sf)))


@query("value_at_closest", sql('SELECT near.r AS "row", near.c AS "col", l.v AS value FROM near JOIN landuse l ON l.id = near.tid WHERE k = 1', _NEAREST))
def value_at_closest(spark, sf):
    return out(D.value_at_closest_target(G.targets(spark, sf), G.landuse(spark, sf)))


def _per_seed(edges: str, seeds: str, limit: float) -> str:
    return f"""e AS MATERIALIZED ({edges}), seeds AS ({seeds}), pr(k, s, id, d) USING KEY (k) AS (SELECT id * 4096 + id, id, id, 0.0::DOUBLE FROM seeds UNION
  SELECT pr.s * 4096 + e.t, pr.s, e.t, min(pr.d + e.w) FROM pr JOIN e ON e.s = pr.id LEFT JOIN recurring.pr r ON r.k = pr.s * 4096 + e.t WHERE pr.d + e.w <= {limit} + 1e-9 AND (r.d IS NULL OR pr.d + e.w < r.d - 1e-9) GROUP BY 1, 2, 3)"""


@query("value_at_closest_travel", sql("""SELECT g.r AS "row", g.c AS "col", CASE WHEN w.v IS NULL THEN NULL WHEN best.s IS NULL THEN 0 ELSE l.v END AS value FROM g JOIN weight w USING (id)
  LEFT JOIN (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY round(d, 6), s) AS k FROM pr) best ON best.id = g.id AND best.k = 1 LEFT JOIN landuse l ON l.id = best.s""",
       _per_seed(_ENTER, "SELECT t.id FROM targets t JOIN weight w USING (id) WHERE t.v <> 0 AND w.v IS NOT NULL", 1e9)))
def value_at_closest_travel(spark, sf):
    open_ = A.with_value(A.binary(G.landuse(spark, sf), G.weight(spark, sf), "add"), F.col("value"))
    value = G.landuse(spark, sf).join(open_.where("value is not null").select(*A.KEY), A.KEY, "left_semi")
    value = A.full_grid(spark, G.N, G.N).drop("value").join(value, A.KEY, "left")
    return out(D.value_at_closest_travel_target(G.targets(spark, sf), G.weight(spark, sf), value))


_MASK = "SELECT t.id FROM targets t JOIN weight w USING (id) WHERE t.v = 3 AND w.v IS NOT NULL"


def _mask(spark, sf):
    open_ = G.weight(spark, sf).where("value is not null").select(*A.KEY)
    return A.filter_values(G.targets(spark, sf), [3]).join(open_, A.KEY, "left_semi")


@query("sum_within_travel", sql('SELECT g.r AS "row", g.c AS "col", round(sum(l.v), 4) AS value FROM pr JOIN g ON g.id = pr.s JOIN landuse l ON l.id = pr.id GROUP BY 1, 2', _per_seed(_MEAN, _MASK, 12.0)))
def sum_within_travel(spark, sf):
    return out(D.sum_within_travel_distance(_mask(spark, sf), G.weight(spark, sf), G.landuse(spark, sf), 12.0), 4)


@query("sum_within_travel_adjacent", sql("""SELECT g.r AS "row", g.c AS "col", round(sum(l.v), 4) AS value FROM (SELECT s, id FROM pr UNION SELECT s, t FROM pr JOIN e8 ON e8.s = pr.id WHERE dr = 0 OR dc = 0) x(s, id)
  JOIN g ON g.id = x.s JOIN landuse l ON l.id = x.id GROUP BY 1, 2""".replace("SELECT s, t FROM pr JOIN", "SELECT pr.s, e8.t FROM pr JOIN"), _per_seed(_MEAN, _MASK, 12.0)))
def sum_within_travel_adjacent(spark, sf):
    return out(D.sum_within_travel_distance(_mask(spark, sf), G.weight(spark, sf), G.landuse(spark, sf), 12.0, adjacent=True), 4)


@query("sum_targets_within_travel", sql('SELECT g.r AS "row", g.c AS "col", round(coalesce(x.v, 0), 4) AS value FROM g LEFT JOIN (SELECT pr.id, sum(t.v) AS v FROM pr JOIN targets t ON t.id = pr.s GROUP BY 1) x USING (id)',
       _per_seed(_ENTER, "SELECT t.id FROM targets t JOIN weight w USING (id) WHERE t.v <> 0 AND w.v IS NOT NULL", 9.0)))
def sum_targets_within_travel(spark, sf):
    return out(D.sum_targets_within_travel_distance(G.targets(spark, sf), G.weight(spark, sf), 9.0), 4)


# ---- clusters


def _components(edges: str, members: str) -> str:
    return f"""e AS ({edges}), cc(id, lab) USING KEY (id) AS ({members} UNION SELECT e.t, min(cc.lab) FROM cc JOIN e ON e.s = cc.id JOIN recurring.cc r ON r.id = e.t WHERE cc.lab < r.lab GROUP BY e.t),
  ids AS (SELECT id, dense_rank() OVER (ORDER BY lab) AS n FROM cc)"""


_CLUSTER = 'SELECT g.r AS "row", g.c AS "col", coalesce(n, 0)::BIGINT AS value FROM g LEFT JOIN ids USING (id)'
_LAND = "SELECT id, id FROM landuse WHERE v > 0"
_SAME = "SELECT s, t FROM e8 JOIN landuse a ON a.id = s JOIN landuse b ON b.id = t AND a.v = b.v AND a.v > 0"


@query("cluster_id", sql(_CLUSTER, _components(_SAME + " WHERE dr = 0 OR dc = 0", _LAND)))
def cluster_id(spark, sf):
    return clusters.cluster_id(G.landuse(spark, sf)).select("row", "col", "value")


@query("cluster_id_diag", sql(_CLUSTER, _components(_SAME, _LAND)))
def cluster_id_diag(spark, sf):
    return clusters.cluster_id(G.landuse(spark, sf), diagonals=True).select("row", "col", "value")


@query("fuzzy_cluster", sql(_CLUSTER, _components("SELECT a.id AS s, b.id AS t FROM items a JOIN items b ON b.r BETWEEN a.r - 2 AND a.r + 2 AND a.v > 0 AND b.v > 0 AND a.id <> b.id AND (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 4", "SELECT id, id FROM items WHERE v > 0")))
def fuzzy_cluster(spark, sf):
    return clusters.fuzzy_cluster_id(G.items(spark, sf), 210.0, 100.0).select("row", "col", "value")


_AROUND = """SELECT e8.s, e8.t FROM e8 JOIN {0} a ON a.id = e8.s JOIN {0} b ON b.id = e8.t AND a.v = b.v AND a.v > 0 JOIN obstacles oa ON oa.id = e8.s AND oa.v = 0 JOIN obstacles ob ON ob.id = e8.t AND ob.v = 0
  JOIN obstacles p ON p.id = e8.p JOIN obstacles q ON q.id = e8.q WHERE dr = 0 OR dc = 0 OR p.v = 0 OR q.v = 0"""
_OPEN = "SELECT x.id, x.id FROM {0} x JOIN obstacles o USING (id) WHERE x.v > 0 AND o.v = 0"


@query("cluster_obstacles", sql("""SELECT g.r AS "row", g.c AS "col", (CASE WHEN l.v > 0 AND o.v > 0 THEN coalesce(won, 0) ELSE n END)::BIGINT AS value FROM g JOIN landuse l USING (id) JOIN obstacles o USING (id) LEFT JOIN ids USING (id)
  LEFT JOIN (SELECT t, n AS won, row_number() OVER (PARTITION BY t ORDER BY count(*) DESC, n) AS k FROM e8 JOIN ids ON ids.id = e8.s GROUP BY t, n) w ON w.t = g.id AND w.k = 1""", _components(_AROUND.format("landuse"), _OPEN.format("landuse"))))
def cluster_obstacles(spark, sf):
    return clusters.cluster_id_with_obstacles(G.landuse(spark, sf), G.obstacles(spark, sf)).select("row", "col", "value")


@query("fuzzy_cluster_obstacles", sql(_CLUSTER, _components(_AROUND.format("items"), "SELECT id, id FROM items WHERE v > 0")))
def fuzzy_cluster_obstacles(spark, sf):
    return clusters.fuzzy_cluster_id_with_obstacles(G.items(spark, sf), G.obstacles(spark, sf), 150.0, 100.0).select("row", "col", "value")


# ---- coverage

_COVER = """cov AS (SELECT polygon_id, name, value, g.r, g.c, (least(x1, -32 + g.c + 1) - greatest(x0, -32 + g.c)) * (least(y1, 40 - g.r) - greatest(y0, 40 - g.r - 1)) AS a, (x1 - x0) * (y1 - y0) AS whole
  FROM rects, g WHERE least(x1, -32 + g.c + 1) > greatest(x0, -32 + g.c) AND least(y1, 40 - g.r) > greatest(y0, 40 - g.r - 1))"""


@query("rect_coverage", sql('SELECT polygon_id, name, value, r AS "row", c AS "col", round(a / whole, 9) AS coverage, round(a, 9) AS cell_coverage FROM cov', _COVER))
def rect_coverage(spark, sf):
    c = C.rect_coverage(G.rects(spark, sf), G.MAP)
    return c.select("polygon_id", "name", "value", "row", "col", F.round("coverage", 9).alias("coverage"), F.round("cell_coverage", 9).alias("cell_coverage"))


@query("polygon_coverage", sql('SELECT polygon_id, name, value, r AS "row", c AS "col", round(a / whole, 9) AS coverage, round(a, 9) AS cell_coverage FROM cov', _COVER))
def polygon_coverage(spark, sf):
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    rings = G.rects(spark, sf).select("polygon_id", "name", "value", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")).alias("ring"))
    c = C.polygon_coverage(rings, G.MAP)
    return c.select("polygon_id", "name", "value", "row", "col", F.round("coverage", 9).alias("coverage"), F.round("cell_coverage", 9).alias("cell_coverage"))


@query("border_adjust", sql("""SELECT polygon_id, r AS "row", c AS "col", round(CASE WHEN f > 0 AND f < 1 THEN CASE WHEN o IS NULL THEN 1 ELSE f / o END ELSE f END, 9) AS coverage FROM
  (SELECT a.polygon_id, a.r, a.c, a.a / a.whole AS f, (SELECT sum(b.a / b.whole) FROM cov b WHERE b.r = a.r AND b.c = a.c AND b.name <> a.name) AS o FROM cov a)""", _COVER))
def border_adjust(spark, sf):
    return C.adjust_borders(C.rect_coverage(G.rects(spark, sf), G.MAP)).select("polygon_id", "row", "col", F.round("coverage", 9).alias("coverage"))


@query("rasterize_sum", sql('SELECT r AS "row", c AS "col", sum(value) AS value FROM cov GROUP BY 1, 2', _COVER))
def rasterize_sum(spark, sf):
    return C.rasterize(C.rect_coverage(G.rects(spark, sf), G.MAP))


@query("rasterize_last", sql('SELECT r AS "row", c AS "col", max_by(value, polygon_id) AS value FROM cov WHERE a >= 0.5 GROUP BY 1, 2', _COVER))
def rasterize_last(spark, sf):
    return C.rasterize(C.rect_coverage(G.rects(spark, sf), G.MAP), "last", all_touched=False)


# ---- tabular text


@query("bool_parse", """SELECT o_orderkey, CASE w WHEN 'Oui' THEN true WHEN ' ja' THEN true WHEN '0' THEN false WHEN 'NEE' THEN false END AS b FROM (SELECT o_orderkey, ['Oui', ' ja', '0', 'NEE', 'maybe'][1 + o_orderkey % 5] AS w FROM orders)""")
def bool_parse(spark, sf):
    words = F.array(*[F.lit(w) for w in ("Oui", " ja", "0", "NEE", "maybe")])
    return G.table(spark, sf, "orders").select("o_orderkey", parse.parse_bool(F.element_at(words, (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("b"))


@query("date_parse", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE date_trunc('day', o_orderdate)::TIMESTAMP END AS d FROM orders""")
def date_parse(spark, sf):
    o = G.table(spark, sf, "orders")
    day = F.col("o_orderdate")
    text = F.element_at(F.array(F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "M/d/yyyy"), F.date_format(day, "MMMM d, yyyy"), F.lit("no date")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select("o_orderkey", parse.parse_date(text).alias("d"))


@query("range_parse", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END::INTEGER AS a, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size + 5 END::INTEGER AS b FROM part""")
def range_parse(spark, sf):
    p = G.table(spark, sf, "part")
    text = F.when(F.col("p_partkey") % 3 == 0, F.lit("2010 to 2015")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + 5).cast("string")))
    r = parse.parse_int_range(text)
    return p.select("p_partkey", r["start"].alias("a"), r["end"].alias("b"))


@query("infer_types", """SELECT * FROM (VALUES ('n_comment', 'string'), ('n_key', 'int'), ('n_half', 'float'), ('n_day', 'date')) t("column", type)""")
def infer_types(spark, sf):
    n = G.table(spark, sf, "nation")
    k = F.col("n_nationkey") + 2
    rows = n.select(F.col("n_name").alias("n_comment"), k.cast("string").alias("n_key"), (k / 2).cast("double").cast("string").alias("n_half"), F.concat(F.lit("2020-01-"), F.lpad(k.cast("string"), 2, "0")).alias("n_day"))
    return parse.infer_types(rows)
