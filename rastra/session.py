"""Session helpers: shared checkpoint folder and row numbers that need no single task."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder; one of our own only on a single machine that names none."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
        context.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='rastra-')}")
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder that the cluster names in ``spark.checkpoint.dir``."""
    _shared(df.sparkSession)
    return df.checkpoint()


def dense_ids(keys: DataFrame, key: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Distinct ``by`` + ``key`` with ``name``: 1, 2, ... in order of the key within each ``by``.

    The keys are range-partitioned; partitions number their own rows and add the counts of those before.
    """
    by = by or []
    placed = checkpointed(keys.select(*by, key).distinct().repartitionByRange(*[F.col(c) for c in by], F.col(key)).withColumn("__p", F.spark_partition_id()))
    counts = placed.groupBy(*by, "__p").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*by, "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))  # a row for each partition
    inner = Window.partitionBy("__p", *by).orderBy(key)
    numbered = placed.withColumn("__k", F.row_number().over(inner)).join(base, [*by, "__p"])
    return numbered.select(*by, key, (F.col("__base") + F.col("__k")).alias(name))


def scratch_uri(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the shared checkpoint folder."""
    return f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
