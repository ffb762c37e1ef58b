"""Exact top-k inner products: ball trees per shard, branch and bound.

Candidates are packed into shards of a bounded number of vectors.  A shard's ball tree splits its vectors
in halves along the direction of largest spread.  For a query q a ball of centre c and radius r can hold no
score above q.c + |q| r.  A block of queries walks the tree best node first, and gives up a node, inner or leaf, for
each query whose k-th score so far is above the node's bound.  The k-th scores are shared between shards in waves: all
queries search one seed shard, then an eighth of the shards, then the rest, each wave beginning with the k-th
scores of all before it.

Defined results: vectors that are null, hold null or non-finite components, or of another length than the
query take no part, nor do those with components too large for 256 x in a double; a null id takes no part; ties go to
the smaller id; rows that repeat an id count once, by their best score; components are floor(256 x) as integers of
any size, and scores are exact: products that a double can't hold are computed with whole numbers where the bound
leaves room; a score outside a long counts as the nearest long.  An empty table gives no rows.  Other columns are
ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from . import storage

LEAF, SHARD, QUERY_BLOCK = 256, 8192, 256
#: Every eighth shard is searched before the rest.
FIRST_PART = 8
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


class BallTree:
    """Nodes in breadth-first order over rows reordered so that each node is a range."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x
        self.order = np.arange(len(x))
        todo, k = [(0, len(x))], 0
        self.kids: list[tuple[int, int] | None] = []
        centres, radii = [], []
        while k < len(todo):
            lo, hi = todo[k]
            rows = x[self.order[lo:hi]]
            c = rows.mean(0)
            off = rows - c
            far = np.einsum("ij,ij->i", off, off)
            centres.append(c)
            radii.append(np.sqrt(far.max(initial=0)))
            if hi - lo > leaf and radii[-1] > 0:
                along = off @ off[far.argmax()]
                mid = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(along, mid)]
                self.kids.append((len(todo), len(todo) + 1))
                todo += [(lo, lo + mid), (lo + mid, hi)]
            else:
                self.kids.append(None)
            k += 1
        self.range, self.centre, self.radius = todo, np.array(centres), np.array(radii)
        self.reach = np.sqrt(np.einsum("ij,ij->i", self.centre, self.centre)) + self.radius
        self.norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        self.largest = np.abs(x).max(initial=0)

    def bounds(self, node: int, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """No score of the node's vectors is above; rounding is allowed for."""
        return q @ self.centre[node] + norm * self.radius[node] + 1e-9 * norm * self.reach[node] + 0.5


def _scores(q: np.ndarray, norm: np.ndarray, tree: BallTree, rows: np.ndarray, least: np.ndarray):
    """(place in q, place in rows, exact score) of all products that reach ``least``."""
    x = tree.x[rows]
    score = q @ x.T
    if np.abs(q).max(initial=0) * tree.largest * q.shape[1] < 2.0**53:  # every sum is a whole number that a double holds
        i, j = np.nonzero(score >= least[:, None])
        return i, j, score[i, j].astype(np.int64)
    floor = least.astype(float)
    slack = (q.shape[1] + 4) * 2.0**-52 * norm[:, None] * tree.norm[rows] + (2.0**-51 * np.abs(floor))[:, None]
    i, j = np.nonzero(score + slack >= floor[:, None])
    whole = [sum(int(a) * int(b) for a, b in zip(q[m], x[n])) for m, n in zip(i, j)]
    exact = np.array([min(max(s, _LEAST), _MOST) for s in whole], np.int64)
    ok = exact >= least[i]
    return i[ok], j[ok], exact[ok]


def search(tree: BallTree, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, least: np.ndarray, k: int):
    """For each query up to k (score, id) of this shard that may be among the best, the k-th score so far being ``least``."""
    norm = np.sqrt(np.einsum("ij,ij->i", q, q))
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
    least = least.copy()
    queue = [(0.0, 0, np.full(len(q), np.inf))]
    while queue:
        _, node, bound = heapq.heappop(queue)
        need = np.flatnonzero(bound >= least)
        if not len(need):
            continue
        if tree.kids[node]:
            for kid in tree.kids[node]:
                b = np.full(len(q), -np.inf)
                b[need] = tree.bounds(kid, q[need], norm[need])
                queue_key = b[need] - least[need]
                if (queue_key >= 0).any():
                    heapq.heappush(queue, (-float(b[need].max()), kid, b))
            continue
        lo, hi = tree.range[node]
        rows = tree.order[lo:hi]
        at, row, score = _scores(q[need], norm[need], tree, rows, least[need])
        found = ids[rows[row]]
        other = found != q_ids[need][at]
        at, found, score = at[other], found[other], score[other]
        cuts = np.flatnonzero(np.r_[True, np.diff(at) > 0]) if len(at) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(at)]):
            one = need[at[lo]]
            s, d = np.concatenate([best[one][0], score[lo:hi]]), np.concatenate([best[one][1], found[lo:hi]])
            keep = np.lexsort((d, -s.astype(object) if s.min() == _LEAST else -s))
            keep = keep[np.sort(np.unique(d[keep], return_index=True)[1])][:k]  # each id once, at its best score
            best[one] = s[keep], d[keep]
            if len(keep) == k:
                least[one] = max(least[one], s[keep[-1]])
    return best


def _integers(column, ids):
    """(ids, whole numbers as doubles) by length of vector."""
    by: dict[int, list] = {}
    for i, v in zip(ids, column):
        if i is None or v is None or not len(v) or None in v:
            continue
        with np.errstate(over="ignore", invalid="ignore"):
            a = np.floor(256 * np.array(v, float))
        if np.isfinite(a).all():
            by.setdefault(len(a), []).append((i, a))
    return {n: (np.array([x[0] for x in rows], np.int64), np.array([x[1] for x in rows])) for n, rows in by.items()}


_BLOCK = pa.schema([("kind", pa.int32()), ("dim", pa.int32()), ("k", pa.int64()), ("asked", pa.list_(pa.int64())), ("ids", pa.binary()), ("x", pa.binary())])
_FOUND = "query_id long, vec_id long, score long"


def _pack(rows_each: int, query_mod: int):
    """Blocks of vectors as bytes: kind 0 candidates, 1 queries, whose ids are also a list."""

    def out(kind, n, ids, x):
        narrow = np.abs(x).max(initial=0) < 2**31
        return {"kind": kind, "dim": n, "k": int(ids[0]), "asked": ids.tolist() if kind else None, "ids": ids.astype("<i8").tobytes(), "x": x.astype("<i4" if narrow else "<f8").tobytes()}

    def run(batches):
        held: dict = {}

        def block(kind, n):
            return tuple(np.concatenate(z) for z in zip(*held.pop((kind, n))))

        for batch in batches:
            rows = []
            # every candidate goes to a shard, every query to a block of queries as well
            for n, (ids, x) in _integers(batch.column(1).to_pylist(), batch.column(0).to_pylist()).items():
                for kind, take, most in ((0, np.ones(len(ids), bool), rows_each), (1, ids % query_mod == 0, QUERY_BLOCK)):
                    if not take.any():
                        continue
                    held.setdefault((kind, n), []).append((ids[take], x[take]))
                    while sum(len(y[0]) for y in held.get((kind, n), [])) >= most:
                        i, v = block(kind, n)
                        rows.append(out(kind, n, i[:most], v[:most]))
                        if len(i) > most:
                            held[kind, n] = [(i[most:], v[most:])]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _BLOCK)
        rows = [out(*key, *block(*key)) for key in list(held)]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _BLOCK)

    return run


def _arrays(row):
    ids = np.frombuffer(row["ids"], "<i8")
    kind = "<i4" if len(row["x"]) == 4 * len(ids) * row["dim"] else "<f8"
    return ids, np.frombuffer(row["x"], kind).reshape(len(ids), -1).astype(float)


def _search(k: int):
    """Rows of one shard come together, its candidates (kind 0) first, then query blocks."""

    def run(batches):
        at = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    at, (ids, x) = row["shard"], _arrays(row)
                    tree = BallTree(x)
                    continue
                if row["shard"] != at:
                    continue
                q_ids, q = _arrays(row)
                least = np.frombuffer(row["least"], "<i8") if row["least"] else np.full(len(q), _LEAST, np.int64)
                q_of, v, s = [], [], []
                for i, (score, vec) in zip(q_ids, search(tree, ids, q, q_ids, least, k)):
                    q_of += [i] * len(vec)
                    v.append(vec)
                    s.append(score)
                if q_of:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(q_of, np.int64)), pa.array(np.concatenate(v)), pa.array(np.concatenate(s))], ["query_id", "vec_id", "score"])

    return run


def _with_least(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Query blocks with the k-th score that each of their queries has so far among ``found``."""
    kth = _ranked(found, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
    at = queries.select("dim", "k", F.explode("asked").alias("query_id")).distinct()
    known = at.join(kth, "query_id").select(F.col("k").alias("of"), F.col("dim").alias("size"), "query_id", "least")

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        have = dict(zip(right.column("query_id").to_pylist(), right.column("least").to_pylist()))
        rows = left.to_pylist()
        for r in rows:
            r["least"] = np.array([have.get(i, _LEAST) for i in np.frombuffer(r["ids"], "<i8").tolist()], "<i8").tobytes()
        return pa.Table.from_pylist(rows, pa.schema([("dim", pa.int32()), ("k", pa.int64()), ("ids", pa.binary()), ("x", pa.binary()), ("least", pa.binary())]))

    return queries.select("dim", "k", "ids", "x").groupBy("k", "dim").cogroup(known.groupBy("of", "size")).applyInArrow(join, "dim int, k long, ids binary, x binary, least binary")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # an id that rows repeat counts once
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 5, query_mod: int = 50, *, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for ids divisible by ``query_mod``, all other rows being candidates."""
    spark = vectors.sparkSession
    scratch = storage.Scratch(spark, "balltree")
    names = ["shard", "kind", "dim", "k", "ids", "x", "least"]
    no_least = F.lit(None).cast("binary").alias("least")
    packed = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    packed = scratch.write(packed.mapInArrow(_pack(shard_rows, query_mod), "kind int, dim int, k long, asked array<long>, ids binary, x binary"))
    shards = packed.where("kind = 0").withColumn("shard", F.xxhash64("dim", "ids", "x"))  # blocks of equal ids may hold other vectors
    queries = packed.where("kind = 1")
    index = scratch.write(shards.groupBy("dim", "shard").agg(F.lit(None).cast("int").alias("_")).drop("_"))
    first = F.broadcast(index.groupBy("dim").agg(F.min("shard").alias("seed")))  # a row for each length of vectors
    index = index.join(first, "dim").withColumn("wave", F.when(F.col("shard") == F.col("seed"), 0).when(F.pmod(F.xxhash64("shard"), F.lit(FIRST_PART)) == 0, 1).otherwise(2))

    def meet(tables: DataFrame, asked: DataFrame) -> DataFrame:
        both = tables.unionByName(asked.withColumn("kind", F.lit(1)).select(names))
        return scratch.write(both.repartition(storage.partitions(spark), "shard").sortWithinPartitions("shard", "kind", "k").mapInArrow(_search(k), _FOUND))

    # One shard would be one task: the seed is copied once for each query block.
    own = F.xxhash64("dim", "k", "ids").alias("shard")
    seed = shards.join(F.broadcast(index.where("wave = 0").select("dim", "shard")), ["dim", "shard"], "left_semi").select("dim", F.col("kind"), "k", "ids", "x")
    copies = queries.select(own, "dim").join(seed, "dim").select("shard", "kind", "dim", "k", "ids", "x", no_least)
    found = meet(copies, queries.select(own, "dim", "k", "ids", "x", no_least))
    spread = max(1, min(64, storage.partitions(spark)))
    salt = F.pmod(F.xxhash64("shard"), F.lit(spread))
    for wave in (1, 2):
        here = scratch.write(index.where(F.col("wave") == wave).select("dim", "shard", salt.alias("salt")))
        if here.isEmpty():
            continue
        # The stated queries in blocks against all shards: a block goes to every shard once.
        asked = _with_least(queries, found, k).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).join(here, ["dim", "salt"])
        tables = shards.join(here.select("dim", "shard"), ["dim", "shard"], "left_semi").withColumn("least", no_least).select(names)
        found = found.unionByName(meet(tables, asked))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
