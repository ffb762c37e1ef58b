"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

A partial partition is ``shards`` sums.  Repeatedly the two partial partitions of largest spread are
combined, the largest sum of one with the smallest of the other, until one is left.  That runs first over
the groups of each bucket (a few ten thousand groups a task), then over the buckets' partial partitions,
which are ``shards`` numbers a bucket, level by level until one task holds them all.

Defined results: rows of equal text are one group (null texts are one too) and share a shard; a group
larger than an even share keeps a shard of its own; repeated rows each get a slot; null ids are kept; the
query's text_crc32 of a null text is null; an empty table gives no rows.  Columns of the input stay, save those named like an output, which are replaced.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from . import storage

#: Groups one task takes, and partial partitions one task combines.
BUCKET_GROUPS, FAN_IN = 20_000, 2_048


def difference(partials: list[list[tuple[int, object]]], shards: int) -> list[tuple[int, object]]:
    """Combine partial partitions; each is (sum, node) in falling order, absent entries being empty.

    A node is a leaf or a pair of nodes.  The result has the same form, falling, ``shards`` at most.
    """
    heap = []
    for k, x in enumerate(partials):
        spread = x[0][0] - (x[-1][0] if len(x) == shards else 0)
        heap.append((-spread, k, x))
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        spare = shards - len(a)
        if len(b) <= spare:
            c = a + b
        else:  # b's largest meet a's smallest, and those are the empty ones
            c = list(a) + b[:spare]
            rest = b[spare:]
            for k, (size, node) in enumerate(rest):
                at = len(a) - 1 - k
                c[at] = (c[at][0] + size, (c[at][1], node))
        c.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (-(c[0][0] - (c[-1][0] if len(c) == shards else 0)), count, c))
        count += 1
    return heap[0][2] if heap else []


def leaves(node) -> list:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack += x
        else:
            out.append(x)
    return out


def _bucket(shards: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("g", "ascending")])
        sizes = table.column("size").to_pylist()
        slot = np.zeros(len(sizes), "int32")
        sums = np.zeros(len(sizes), "int64")
        for k, (total, node) in enumerate(difference([[(s, i)] for i, s in enumerate(sizes)], shards)):
            at = leaves(node)
            slot[at], sums[at] = k, total
        return pa.table({"g": table.column("g"), "bucket": table.column("bucket"), "slot": pa.array(slot), "sum": pa.array(sums)})

    return run


def _combine(shards: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("child", "ascending"), ("slot", "ascending")])
        child, slot, total = (table.column(c).to_pylist() for c in ("child", "slot", "sum"))
        partials: dict = {}
        for c, k, s in zip(child, slot, total):
            partials.setdefault(c, []).append((s, c * shards + k))
        to = {}
        for k, (total_, node) in enumerate(difference([sorted(x, key=lambda y: -y[0]) for x in partials.values()], shards)):
            to |= {x: (k, total_) for x in leaves(node)}
        found = [to[c * shards + k] for c, k in zip(child, slot)]
        return pa.table({"child": table.column("child"), "slot": table.column("slot"), "parent": table.column("parent"),
                         "up": pa.array([x[0] for x in found], pa.int32()), "sum": pa.array([x[1] for x in found], pa.int64())})

    return run


def group_shards(groups: DataFrame, shards: int, bucket_groups: int = BUCKET_GROUPS, fan_in: int = FAN_IN) -> DataFrame:
    """(g, shard) for distinct groups (g, size)."""
    groups = storage.written(groups, "kk-groups")
    n = groups.count()
    buckets = max(1, -(-n // bucket_groups))
    placed = groups.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets))).groupBy("bucket").applyInArrow(
        _bucket(shards), "g binary, bucket long, slot int, sum long"
    )
    placed = storage.written(placed, "kk-local")
    level = placed.groupBy(F.col("bucket").alias("child"), "slot").agg(F.max("sum").alias("sum"))
    shape = placed.select("g", F.col("bucket").alias("at"), "slot")
    while True:
        parents = max(1, -(-buckets // fan_in))
        combined = storage.written(
            level.withColumn("parent", F.pmod("child", F.lit(parents))).groupBy("parent").applyInArrow(
                _combine(shards), "child long, slot int, parent long, up int, sum long"
            ),
            "kk-combined",
        )
        step = combined.select(F.col("child").alias("at"), "slot", "parent", "up")  # shards rows a bucket
        shape = shape.join(F.broadcast(step) if buckets * shards <= 500_000 else step, ["at", "slot"]).select("g", F.col("parent").alias("at"), F.col("up").alias("slot"))
        if parents == 1:
            return shape.select("g", F.col("slot").alias("shard"))
        level = combined.groupBy(F.col("parent").alias("child"), F.col("up").alias("slot")).agg(F.max("sum").alias("sum"))
        buckets = parents


def shard_documents(docs: DataFrame, shards: int = 24, *, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with size (UTF-8 bytes plus 8; of a null text 8), law, shard, slot and grown_shard."""
    if shards < 1:
        raise ValueError("shards must be positive")
    new = {"size", "law", "shard", "slot", "grown_shard"}
    text = F.col(text_col)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    group = F.unhex(F.coalesce(F.md5(text), F.lit("00")))  # equal texts, told by 128 bits
    docs = docs.select(*[c for c in docs.columns if c not in new], size.alias("size"), group.alias("__g"))
    scratch = storage.Scratch(docs.sparkSession, "kk")
    sizes = scratch.write(docs.groupBy("__g").agg(F.sum("size").alias("size"), F.count("*").alias("__n")))
    to = group_shards(sizes.select(F.col("__g").alias("g"), "size"), shards, **options)
    found = scratch.write(sizes.select("__g", "__n").join(to.withColumnRenamed("g", "__g"), "__g"))
    placed = storage.join_unique(docs, found, "__g", "__n", all_rows=True).drop("__n")
    # Slots: rows are numbered within many chunks of a shard, chunks start where those before them end.
    spark = docs.sparkSession
    chunks = max(1, storage.partitions(spark) // 2)
    placed = placed.withColumn("__chunk", F.pmod(F.xxhash64("__g", id_col), F.lit(chunks)).cast("int"))
    counts = placed.groupBy("shard", "__chunk").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inner = Window.partitionBy("shard", "__chunk").orderBy(F.col(id_col).asc_nulls_first(), "__g")
    out = placed.withColumn("__k", F.row_number().over(inner) - 1).join(F.broadcast(base), ["shard", "__chunk"])  # shards x chunks rows
    return out.withColumns({"law": F.lit("bytes"), "slot": F.col("__base") + F.col("__k"), "grown_shard": F.lit(None).cast("int")}).drop("__g", "__k", "__base", "__chunk")

