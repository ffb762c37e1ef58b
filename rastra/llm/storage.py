"""Where jobs put data that must outlive an executor.

Everything that cuts lineage goes to the folder named by ``spark.checkpoint.dir``, which the cluster
shares.  Only where that setting is absent on one machine (unit tests) is a folder made here; a cluster must name one.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; sets one of our own only if the session names none."""
    found = spark.sparkContext.getConf().get(_SETTING) or spark.conf.get(_SETTING, None)
    if not found:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return _qualified(spark, set_dir.get())
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"name a folder that all machines share in {_SETTING}")
        found = f"file://{tempfile.mkdtemp(prefix='rastra-')}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return _qualified(spark, found)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Hadoop gives it, so that Python workers open the same store."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files (no lineage behind them)."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that a job writes on its way.  Written tables have a known size, so that Catalyst broadcasts the small
    ones by itself; ``drop`` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.paths = spark, fresh_path(spark, name), []

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for held, path in self.paths:
            if any(held is x for x in tables):
                hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Bits of the largest bitmap of keys (32 MB); a smaller one has 16 bits a key.
MOST_BITS = 28


def divided(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` may be among ``keys``, rows whose key surely is not).

    The keys are hashed into one bitmap, in rows of 4 KB and of at most 2**MOST_BITS bits in all, which is broadcast.
    So only the first part needs to be shuffled to meet the keys.  Beyond that size more and more rows
    count as possible, which costs a shuffle of them, not a result.
    """
    bits = 1 << min(MOST_BITS, max(15, (16 * keys.count()).bit_length()))
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    place = [F.bitmap_bucket_number(slot).alias("__bucket"), F.bitmap_bit_position(slot).alias("__bit")]
    bitmap = keys.select(*place).groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__map"))
    marked = rows.select("*", *place).join(F.broadcast(bitmap), "__bucket", "left")
    byte = F.conv(F.hex(F.substring("__map", F.expr("cast(__bit div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (F.col("__bit") % 8).cast("int")) == 1, F.lit(False))
    return marked.where(found).select(rows.columns), marked.where(~found).select(rows.columns)


#: Keys that hold at least one row in so many are told apart: there are at most as many of them.
HOT_KEYS = 4096


def join_unique(rows: DataFrame, found: DataFrame, key: str, count: str, *, all_rows: bool = False) -> DataFrame:
    """The ``rows`` that meet ``found``, which has each key once and in ``count`` how many rows hold it.

    Rows whose key is in no row of ``found`` stay where they are (``divided``; needless if ``all_rows`` have one).  Keys that hold a HOT_KEYS-th of the
    found rows or more, at most HOT_KEYS in number, are broadcast, so that their rows need not meet in one task; all
    others are joined as Catalyst likes.  Both tables are read twice.
    """
    total, keys = found.agg(F.coalesce(F.sum(count), F.lit(0)), F.count("*")).first()
    hot = F.col(count) >= max(2, total / HOT_KEYS)
    hot_keys = found.where(hot).count()
    likely = rows if all_rows else divided(rows, found, key)[0]
    if hot_keys == keys:
        return likely.join(F.broadcast(found), key)
    if not hot_keys:
        return likely.join(found, key)
    most, rest = F.broadcast(found.where(hot)), found.where(~hot)
    first = likely.join(most, key)
    others = likely.join(most.select(key), key, "left_anti").join(rest, key)
    return first.unionByName(others.select(first.columns))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small; a lower setting of the user stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """Return memory that a Python worker has freed: the allocators would keep a hundred MB or more for the next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
