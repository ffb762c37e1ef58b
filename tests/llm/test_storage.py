"""Bitmaps of keys and joins with frequent keys."""

import pytest
from pyspark.sql import functions as F

from rastra.llm import storage


@pytest.mark.parametrize("n", [0, 1, 50, 20_000])
def test_rows_are_divided_by_a_bitmap(spark, n):
    rows = spark.range(-1000, 50_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")).unionByName(spark.createDataFrame([(None, 1)], "k long, v long"))
    keys = spark.range(n).select(F.col("id").alias("k"))
    likely, not_in = storage.divided(rows, keys, "k")
    assert likely.columns == rows.columns == not_in.columns
    assert likely.count() + not_in.count() == rows.count()
    assert not_in.join(keys, "k").count() == 0
    assert likely.join(keys, "k").count() == n
    assert likely.count() <= 1.2 * n + 200


def test_rows_meet_frequent_and_rare_keys(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    found = rows.groupBy("k").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1 or least % 2 = 0")
    got = storage.join_unique(rows, found, "k", "n")
    want = rows.join(found, "k")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
