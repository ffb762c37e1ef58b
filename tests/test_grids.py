import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from rastra.functions import legends
from rastra.operators import algebra as A, clusters, coverage, distance as D, stats, tiling
from rastra.functions.geo import Georef

from .conftest import grid, values

N = None


def test_distance_golden(spark):
    rows = [[0] * 10 for _ in range(5)]
    rows[2][0], rows[2][1], rows[3][0], rows[3][3] = 1, 2, 3, 1
    expected = """200.0 200.000 241.421 282.843 341.421 382.843 424.264 524.264 624.264 724.264
100.0 100.000 141.421 200.000 241.421 282.843 382.843 482.843 582.843 682.843
0.0 0.000 100.000 100.000 141.421 241.421 341.421 441.421 541.421 641.421
0.0 100.000 100.000 0.000 100.000 200.000 300.000 400.000 500.000 600.000
100.0 141.421 141.421 100.000 141.421 241.421 341.421 441.421 541.421 641.421"""
    for tile in (2, 256):
        got = values(D.distance(grid(spark, rows), 100.0, tile=tile))
        for a, b in zip(got, expected.splitlines()):
            assert a == pytest.approx([float(x) for x in b.split()], abs=1e-3)


def test_fuzzy_clusters_golden(spark):
    text = """1 1 1 1 1 0 0 0 0 0 1 1 1 1 1 0 0 0 0 0
1 1 0 1 0 0 1 0 1 0 1 1 0 1 0 0 2 0 2 0
1 0 0 1 0 0 0 1 0 0 1 0 0 1 0 0 0 2 0 0
1 0 1 1 0 0 1 0 1 0 1 0 1 1 0 0 2 0 2 0
1 1 1 1 0 0 0 0 0 0 1 1 1 1 0 0 0 0 0 0
0 0 0 0 0 0 0 0 0 1 0 0 0 0 0 0 0 0 0 3
0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0
0 0 0 0 0 0 0 0 1 0 0 0 0 0 0 0 0 0 4 0
1 0 1 0 1 0 1 0 0 0 5 0 6 0 7 0 8 0 0 0
0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0"""
    rows = [[int(x) for x in line.split()] for line in text.splitlines()]
    for tile in (3, 256):
        assert values(clusters.fuzzy_cluster_id(grid(spark, [r[:10] for r in rows]), 142.0, 100.0, tile=tile)) == [r[10:] for r in rows]


def test_cluster_ids(spark):
    rows = [[1, 1, 1, 1], [1, 1, 2, 3], [3, 3, 3, 3], [1, 1, 5, 5], [1, 1, 5, 1]]
    assert values(clusters.cluster_id(grid(spark, rows), tile=2)) == [[1, 1, 1, 1], [1, 1, 2, 3], [3, 3, 3, 3], [4, 4, 5, 5], [4, 4, 5, 6]]
    assert values(clusters.cluster_id(grid(spark, [[N, 0, -1]]))) == [[None, 0, 0]]


def random_grid(rng, rows, cols, choices):
    return [[rng.choice(choices) for _ in range(cols)] for _ in range(rows)]


def dijkstra(seeds, rows, cols, cost):
    best, heap = {}, [(0.0, s, s) for s in seeds]
    heapq.heapify(heap)
    while heap:
        d, tag, (r, c) = heapq.heappop(heap)
        if (r, c) in best and (best[r, c][0] < d - 1e-9 or best[r, c][1] <= tag):
            continue
        best[r, c] = d, tag
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                t = (r + dr, c + dc)
                if (dr or dc) and 0 <= t[0] < rows and 0 <= t[1] < cols:
                    w = cost((r, c), t)
                    if w is not None:
                        heapq.heappush(heap, (d + w, tag, t))
    return best


def length(a, b):
    return math.hypot(a[0] - b[0], a[1] - b[1])


def test_travel_and_obstacles_against_dijkstra(spark):
    rng = random.Random(4)
    rows, cols = 13, 17
    target, weight, wall = random_grid(rng, rows, cols, [0] * 20 + [3]), random_grid(rng, rows, cols, [N, 1, 2, 5]), random_grid(rng, rows, cols, [0, 0, 1])
    seeds = [(r, c) for r in range(rows) for c in range(cols) if target[r][c]]
    w = lambda p: weight[p[0]][p[1]]
    best = dijkstra([s for s in seeds if w(s) is not None], rows, cols, lambda a, b: None if w(a) is None or w(b) is None else length(a, b) / 2 * (w(a) + w(b)))
    for tile in (4, 256):
        got = values(D.travel_distance(grid(spark, target), grid(spark, weight), tile=tile))
        for r in range(rows):
            for c in range(cols):
                want = None if weight[r][c] is None else best[r, c][0] if (r, c) in best else math.inf
                assert got[r][c] == (want if want is None else pytest.approx(want))

    def step(a, b):
        if wall[b[0]][b[1]] or (a[0] != b[0] and a[1] != b[1] and wall[a[0]][b[1]] and wall[b[0]][a[1]]):
            return None
        return length(a, b)

    best = dijkstra(seeds, rows, cols, step)
    got = values(D.distance_with_obstacles(grid(spark, target), grid(spark, wall), 2.0, tile=5))
    for r in range(rows):
        for c in range(cols):
            assert got[r][c] == pytest.approx(2 * best[r, c][0] if (r, c) in best else math.inf)


def blocked_path(a, b, wall):
    r, c = a
    while (r, c) != b:
        dr, dc = (b[0] > r) - (b[0] < r), (b[1] > c) - (b[1] < c)
        if wall[r + dr][c + dc] or (dr and dc and wall[r][c + dc] and wall[r + dr][c]):
            return True
        r, c = r + dr, c + dc
    return False


def test_fuzzy_clusters_with_obstacles_against_search(spark):
    rng = random.Random(9)
    rows, cols, radius = 11, 12, 3.2
    item, wall = random_grid(rng, rows, cols, [0, 0, 0, 1, 2]), random_grid(rng, rows, cols, [0, 0, 0, 1])
    areas = values(clusters.cluster_id_with_obstacles(grid(spark, [[1] * cols] * rows), grid(spark, wall)))
    cells = [(r, c) for r in range(rows) for c in range(cols)]
    up = {p: p for p in cells}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    at = lambda g, p: g[p[0]][p[1]]
    for a in cells:
        for b in cells:
            near = (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= int(radius * radius)
            if a != b and near and at(item, a) > 0 and at(item, a) == at(item, b) and not at(wall, a) and not at(wall, b) and at(areas, a) == at(areas, b) and not blocked_path(a, b, wall):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    order = sorted({root(p) for p in cells if at(item, p) > 0})
    want = [[order.index(root((r, c))) + 1 if item[r][c] > 0 else 0 for c in range(cols)] for r in range(rows)]
    assert values(clusters.fuzzy_cluster_id_with_obstacles(grid(spark, item), grid(spark, wall), radius, tile=4)) == want


def test_algebra_edges(spark):
    a, b = grid(spark, [[1, N, 3, N]]), grid(spark, [[2, 5, 0, N]])
    assert values(A.binary(a, b, "div")) == [[0.5, None, None, None]]
    assert values(A.inclusive(a, b, "add")) == [[3, 5, 3, None]]
    assert values(A.inclusive(a, b, "sub")) == [[-1, -5, 3, None]]
    assert values(A.inclusive(a, b, "sub", signed=False)) == [[-1, None, 3, None]]
    assert values(A.cast(grid(spark, [[254.9, 255, -0.5, -1, N]]), "u8")) == [[254, None, 0, None, None]]
    rows = [[N, N, 4, 4], [4, 8, 4, 9], [2, 4, N, 7], [4, 4, 5, 8], [3, N, 4, N]]
    assert values(A.replace_value(grid(spark, rows), 4, 9)) == [[N, N, 9, 9], [9, 8, 9, 9], [2, 9, N, 7], [9, 9, 5, 8], [3, N, 9, N]]
    assert values(A.crop(grid(spark, [[N, N, N], [N, 1, N], [N, N, 2]]))) == [[1, None], [None, 2]]
    assert values(A.mosaic([a, b])) == [[2, 5, 0, None]]


def test_all_nodata_and_scale(spark):
    empty = grid(spark, [[N, N]])
    row = stats.statistics(empty, [0.5]).first()
    assert (row["min"], row["mean"], row["data_count"], row["nodata_count"], row["sum"]) == (None, None, 0, 2, 0.0)
    assert values(A.crop(empty)) == []
    assert values(clusters.cluster_id(empty)) == [[None, None]]
    assert values(D.distance(empty)) == [[None, None]]
    x = [[1.0, 2.5, N, 9.75]]
    back = values(A.descale(A.scale(grid(spark, x), "u16")))
    assert back[0][2] is None and [back[0][k] for k in (0, 1, 3)] == pytest.approx([1.0, 2.5, 9.75], abs=1e-3)
    assert values(A.scale(grid(spark, [[4, 4]]))) == [[0, 0]]
    with pytest.raises(ValueError):
        stats.quantiles(empty, [1.5])


def test_coverage_sums_to_one(spark):
    ring = [[0.3, 0.4], [7.2, 1.1], [5.5, 6.6], [1.0, 5.0]]
    g = Georef(10, 10, 0.0, 10.0, 1.0, -1.0)
    polygons = spark.createDataFrame([(1, "a", 2.0, ring)], "polygon_id long, name string, value double, ring array<array<double>>")
    found = coverage.polygon_coverage(polygons, g)
    assert found.agg(F.sum("coverage")).first()[0] == pytest.approx(1, abs=1e-10)
    assert coverage.adjust_borders(found).where("coverage <> 1").count() == 0


def test_legends(spark):
    assert legends.rgba("#f00") == 0xFF0000FF
    assert legends.preset("Gray_R", 2) == [0xFFFFFFFF, 0x000000FF]
    with pytest.raises(ValueError):
        legends.preset("none")
    bands = legends.classified("[0;10;ff0000,20;30;00ff00]")
    df = spark.createDataFrame([(v,) for v in (0.0, 15.0, 30.0, 31.0, None)], "v double")
    assert [r[0] for r in df.select(legends.banded(F.col("v"), bands)).collect()] == [0xFF0000FF, 0, 0x00FF00FF, 0, 0]


def test_tiles_and_pyramid(spark):
    rows = [[r * 7 + c if (r + c) % 3 else N for c in range(7)] for r in range(5)]
    g = grid(spark, rows)
    assert values(tiling.to_cells(tiling.to_tiles(g, 3))) == values(g)
    t = spark.createDataFrame([(2, 3, 1)], "z int, x int, y int")
    assert sorted(map(tuple, tiling.pyramid(t, 0).collect())) == [(0, 0, 0), (1, 1, 0), (2, 3, 1)]
    assert Georef(4, 4, 0, 4, 1, -1).with_cell_size(2, -2) == Georef(2, 2, 0, 4, 2, -2)
