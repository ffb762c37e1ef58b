"""Classes of rows that share buckets and pass a pairwise test, however large the buckets.

Only ids are grouped by bucket.  First every member of a bucket is tested against the bucket's smallest member
(its hub), which settles groups of copies of any size with one test a member: the members' data are sent to their
hub, a popular hub being copied to as many tasks as its members need.  Only buckets whose members are still in
different classes are then compared within, in pairs of bounded blocks; pairs already in one class are left out,
and a block hands on a spanning forest of its links, not the links.  So no link between two classes is lost, and no
task holds a bucket.  Data of rows that share no bucket go nowhere (``storage.divided``); those of the others are
shuffled whatever their size, so that small tables take the way of large ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import storage
from .components import block_pairs, connected_components

#: Members of one hub that one group of rows holds, if the hub's members are not a HOT_KEYS-th of all.
GROUP = 256


class Forest:
    """Union-find over what one task has met; ``links`` are the unions that joined two parts."""

    def __init__(self):
        self.up: dict = {}
        self.links: list = []

    def root(self, x):
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a, b, link: bool = True) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            if link:
                self.links.append((a, b))


def bins_of(df: DataFrame, key: list[str], rows: int, rows_per_bin: int) -> DataFrame:
    return df.withColumn("bin", F.pmod(F.xxhash64(*key), F.lit(max(1, -(-rows // rows_per_bin)))))


def tested(scratch: storage.Scratch, pairs: DataFrame, payload: DataFrame, test_star) -> DataFrame:
    """The linked pairs (a, b) of distinct ``pairs`` (id, hub); see ``bucket_classes``."""
    counts = scratch.write(pairs.groupBy("hub").agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = F.ceil(F.col("n") / F.lit(float(max(GROUP, total / storage.HOT_KEYS)))).cast("int")
    popular = F.broadcast(counts.where(parts > 1))  # at most HOT_KEYS rows
    members = pairs.join(popular, "hub", "left").select("hub", F.pmod(F.xxhash64("id"), F.coalesce(parts, F.lit(1))).cast("int").alias("part"), F.lit(1).alias("kind"), "id")
    heads = counts.select("hub", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("kind"), F.col("hub").alias("id"))
    wanted = scratch.write(members.unionByName(heads))
    fed = wanted.hint("merge").join(storage.divided(payload, wanted, "id")[0], "id").select("hub", "part", "kind", "id", "data")
    linked = scratch.write(fed.repartition("hub", "part").sortWithinPartitions("hub", "part", "kind").mapInArrow(test_star, "a long, b long"))
    scratch.drop(counts, wanted)
    return linked


def bucket_classes(members: DataFrame, payload: DataFrame, test_star, test_block, *, block: int, rows_per_bin: int, near=None, sift=None) -> DataFrame:
    """(id, component) of every id with a link.

    ``members``: distinct (bucket, id); ``payload``: (id, data).  ``test_star``: mapInArrow function over rows
    (hub, part, kind, id, data), each hub's own row (kind 0) before its members', giving the linked (a, b).
    ``test_block``: function over a pandas frame (bucket, i, j, mine, id, class, data) giving linked pairs as a
    frame (a, b).

    With ``near`` and ``sift`` members also hold a short ``code`` and ``stored``: only buckets with a stored member count;
    data are sent only where ``near``(column, column) holds for a member's and its hub's code, or to blocks for the rows
    that ``sift``, a function over the frame with codes instead of data, returns.
    """
    scratch = storage.Scratch(members.sparkSession, "links")
    code = ["code"] if near else []
    hubs = members.groupBy("bucket").agg(F.min(F.struct("id", *code)).alias("m"), F.count("*").alias("n"), *([F.max("stored").alias("s")] if near else [])).where("n > 1 and s" if near else "n > 1")
    hubs = scratch.write(hubs.select("bucket", "n", F.col("m.id").alias("hub"), *([F.col("m.code").alias("hub_code")] if near else [])))
    shared = scratch.write(storage.join_unique(members.select("bucket", "id", *code), hubs, "bucket", "n"))
    star = shared.where("id <> hub")
    star = scratch.write((star.where(near("code", "hub_code")) if near else star).select("id", "hub").distinct())
    linked = tested(scratch, star, payload, test_star)
    scratch.drop(hubs, star)
    classes = connected_components(linked)
    # In a bucket of two the only pair has been tested.
    seen = scratch.write(shared.where("n > 2").join(classes, "id", "left").select("bucket", "id", *code, F.coalesce("component", "id").alias("class")))
    scratch.drop(shared)
    mixed = scratch.write(seen.groupBy("bucket").agg(F.min("class").alias("c0"), F.max("class").alias("c1"), F.count("*").alias("n")).where("c0 <> c1").select("bucket", "n"))
    dealt = scratch.write(block_pairs(seen, mixed, ["bucket"], block))
    scratch.drop(seen, mixed)
    rows = dealt.count()
    if sift and rows:
        binned = bins_of(dealt, ["bucket", "i", "j"], rows, 4 * rows_per_bin)
        fewer = scratch.write(binned.groupBy("bin").applyInPandas(lambda frame: sift(frame), binned.schema).drop("bin", "code"))
        scratch.drop(dealt)
        dealt, rows = fewer, fewer.count()
    if not rows:
        return classes
    likely = storage.divided(payload, dealt, "id")[0]
    more = bins_of(dealt, ["bucket", "i", "j"], rows, rows_per_bin).hint("merge").join(likely, "id").groupBy("bin").applyInPandas(
        lambda frame: test_block(frame), "a long, b long"
    )
    out = connected_components(linked.union(more))
    scratch.drop(dealt, linked)
    return out


def groups_of(frame):
    """The frame's (bucket, i, j) groups, as row positions of each side; one side is empty-handed if i = j."""
    order = np.lexsort((frame["j"].to_numpy(), frame["i"].to_numpy(), frame["bucket"].to_numpy()))
    keys = np.column_stack([frame[c].to_numpy()[order] for c in ("bucket", "i", "j")])
    cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else []
    mine = frame["mine"].to_numpy()
    for lo, hi in zip(cuts, [*cuts[1:], len(keys)]):
        at = order[lo:hi]
        _, i, j = keys[lo]
        yield (at, at) if i == j else (at[mine[at] == i], at[mine[at] == j])
