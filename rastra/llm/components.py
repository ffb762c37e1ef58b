"""Connected components of a table of links, without gathering links anywhere.

Each round every node takes the smallest node among itself and its neighbours (the first rounds by id, so
that stars vanish at once; then by a hash that changes each round, so that chains halve), and the graph of
the taken nodes replaces the graph.  Rounds are few; each is written, and the one before it deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import storage

#: Chains at least halve in expectation, so that no graph needs so many rounds.
MOST_ROUNDS = 200


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every id that has a link, and the smallest id it can reach."""
    scratch = storage.Scratch(links.sparkSession, "components")
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = scratch.write(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    at = scratch.write(edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct().select("id", F.col("id").alias("root")))
    for turn in range(MOST_ROUNDS):
        if edges.isEmpty():
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if turn < 2:
            take = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        else:
            rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)), F.col(c))
            best = both.groupBy("a").agg(F.min(rank("b")).alias("r"))
            take = best.select("a", F.when(best["r"]["col1"] < F.xxhash64("a", F.lit(turn)), best["r"]["b"]).otherwise(F.col("a")).alias("to"))
        take = scratch.write(take)
        left, right = take.select("a", F.col("to").alias("x")), take.select(F.col("a").alias("b"), F.col("to").alias("y"))
        fewer = scratch.write(edges.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        moved = scratch.write(at.join(take.select(F.col("a").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root")))
        scratch.drop(edges, at, take)
        edges, at = fewer, moved
    else:
        raise RuntimeError(f"components are not settled after {MOST_ROUNDS} rounds")
    least = at.groupBy("root").agg(F.min("id").alias("component"))
    out = scratch.write(at.join(least, "root").select("id", "component"))
    scratch.drop(edges, at)
    return out


def block_pairs(members: DataFrame, size: DataFrame, key: list[str], block: int) -> DataFrame:
    """Deal each key's members (key, id) into blocks, and each block to every pair of blocks it is in.

    ``size`` has the key and ``n``.  Adds i <= j, the pair of blocks, and mine, the member's block.  A pair
    of blocks holds twice ``block`` members or so, however many the key has.
    """
    dealt = members.join(size, key).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *members.columns, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine"
    )
