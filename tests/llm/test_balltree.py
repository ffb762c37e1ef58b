"""Rows that repeat an id count once, also where they are the best of the seed shard."""

import numpy as np
import pytest

from rastra.llm import balltree


def brute(rows, k, query_mod):
    """Best score over all rows of both ids, by brute force."""
    best = {}
    ints = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
    for q, x in ints:
        for c, y in ints:
            if q % query_mod == 0 and q != c and len(x) == len(y):
                best.setdefault(q, {})[c] = max(best.get(q, {}).get(c, -(10**18)), int(x @ y))
    return sorted((q, n + 1, c, s) for q, of in best.items() for n, (c, s) in enumerate(sorted(of.items(), key=lambda z: (-z[1], z[0]))[:k]))


def repeated_rows(case):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(120)]
    top = max(rows[1:50], key=lambda r: np.dot(r[1], rows[0][1]))
    if case == "candidates":  # the same row five times at the front, in one shard
        return [top] * 5 + rows
    if case == "queries":  # fewer than k vectors in each shard, queries repeat; a seed shard for each length
        unit = {n: [1.0] + [0.0] * (n - 1) for n in range(3, 13)}
        return [(50 * n + max(0, j - 2), [x * (20.0 - j) for x in unit[n]]) for n in unit for j in range(9)]
    return rows + [(i, [-x for x in v]) for i, v in rows]  # every id again with another vector


@pytest.mark.parametrize("case, shard_rows", [("candidates", 40), ("candidates", 500), ("queries", 3), ("other vectors", 40), ("other vectors", 120)])
def test_repeated_ids_count_once(spark, case, shard_rows):
    rows = repeated_rows(case)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in balltree.top_k(df, 5, 50, shard_rows=shard_rows).collect())
    assert got == brute(rows, 5, 50)


def exact(rows, k, query_mod):
    """As ``brute``, with whole numbers of any size."""
    ints = [(i, [int(np.floor(256 * float(y))) for y in v]) for i, v in rows]
    best = {}
    for q, x in ints:
        for c, y in ints:
            if q % query_mod == 0 and q != c:
                s = min(max(sum(a * b for a, b in zip(x, y)), -(1 << 63)), (1 << 63) - 1)
                best.setdefault(q, {})[c] = max(best.get(q, {}).get(c, -(1 << 63)), s)
    return sorted((q, n + 1, c, s) for q, of in best.items() for n, (c, s) in enumerate(sorted(of.items(), key=lambda z: (-z[1], z[0]))[:k]))


@pytest.mark.parametrize("size", [1.0, 2.0**18, 9e6, 2.0**31 - 1, 1e18])
def test_components_of_any_size(spark, size):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * (size if i % 3 == 0 else 1.0)]) for i in range(90)]
    rows += [(200, [float(2**31 - 1)] * 2 + [0.0] * 6), (201, [float(2**31 - 1), float(2**31)] + [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in balltree.top_k(df, 5, 50, shard_rows=20).select("query_id", "rank", "vec_id", "score").collect())
    assert got == exact(rows, 5, 50)


def test_nothing_to_search(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, score string")
    assert balltree.top_k(empty).collect() == []
    odd = spark.createDataFrame([(None, [1.0]), (50, None), (100, []), (150, [None]), (200, [float("nan")]), (250, [1.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert balltree.top_k(odd).collect() == []


def test_one_id_fills_no_more_than_one_place(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(60)]
    rows += [(7, [5.0 * x for x in rows[0][1]])] * 7  # k + 2 copies of the best
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = sorted(tuple(r) for r in balltree.top_k(df, 5, 50, shard_rows=66).collect())
    assert got == brute(rows, 5, 50)
