"""Near-duplicate vectors by E8 lattice hashing.

Each table projects unit vectors onto directions of a random rotation, eight to a block, and decodes each block to
its nearest point of a scaled E8 lattice; the points of a table's blocks are the cell.  A vector also probes the cells
whose walls are nearest to it.  Whoever meets in a cell is a candidate.  Of candidates, a code of 64 signs along
random directions must agree in 48 (at cosine 0.98 four differ on average, twelve in the worst of 9,000 trials);
the rest is verified by the cosine in double precision.  Links settle the classes (``links.bucket_classes``); within a
class all pairs are then compared in blocks, so that n_links counts every link of the class, not only those a table found.

The cells are those of ``SHAPE`` however many vectors there are, so that a pair is met or missed in a small table as in
a large one.  Of pairs at exactly 0.98 it finds 99.8 % or more; tests/llm/test_lattice.py measures it.  Other shapes are
for callers who name them: coarser ones are cheaper, finer ones keep cells small beyond 100 million vectors.

Defined results: only rows of one non-null label and one length link.  Vectors that are null, empty, zero or
hold null or non-finite components link with nothing: n_links 0, component_id their own, kept.  Rows that
repeat a vec_id are one vector, by the smallest label and vector; a null vec_id gives null component_id and kept.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import storage
from .components import block_pairs
from .links import Forest, bins_of, bucket_classes, groups_of

BLOCK = 1024
#: Differing signs of 64 that candidates may have.
FAR = 16
#: (tables, blocks, probes): whether a pair meets depends on them.
SHAPE = (8, 3, 4)


def shape_for(vectors: int) -> tuple[int, int, int]:
    """The shape for so many vectors: the same for any number, or links would depend on the rows beside them."""
    return SHAPE


def _roots() -> np.ndarray:
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = _roots()


def _d8(x: np.ndarray) -> np.ndarray:
    whole = np.rint(x)
    off = x - whole
    worst, rows = np.abs(off).argmax(1), np.arange(len(x))
    other = whole.copy()
    other[rows, worst] += np.where(off[rows, worst] >= 0, 1, -1)
    return np.where((whole.sum(1) % 2 != 0)[:, None], other, whole)


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: of D8 or of D8 moved by one half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


class Hash:
    """Cells of unit vectors: ``blocks`` E8 points a table; ``codes`` are signs along further random directions."""

    def __init__(self, dim: int, threshold: float, shape: tuple[int, int, int], seed: int = 8):
        self.tables, self.blocks, self.probes = shape
        rng = np.random.default_rng(seed)
        wide = 8 * self.blocks
        self.dim = max(wide, dim)
        axes: list[np.ndarray] = []
        while len(axes) < self.tables:
            q = np.linalg.qr(rng.normal(size=(self.dim, self.dim)))[0]
            axes += [q[:, k : k + wide] for k in range(0, self.dim - wide + 1, wide)]
        self.axes = axes[: self.tables]
        self.scale = 10 * np.sqrt(max(1e-4, 2 * (1 - threshold)) / self.dim)  # walls: a multiple of a close pair's usual distance
        self.mix = rng.integers(1 << 62, size=wide, dtype=np.int64) * 2 + 1
        self.signs = rng.normal(size=(dim, 64))

    def cells(self, unit: np.ndarray):
        """For each table the keys of each row's cell (first column) and of its probes."""
        x = np.zeros((len(unit), self.dim))
        x[:, : unit.shape[1]] = unit
        rows = np.arange(len(x))
        for axes in self.axes:
            y = x @ axes / self.scale
            own, costs, steps = np.zeros(len(y), np.int64), [], []
            with np.errstate(over="ignore"):
                for k in range(0, y.shape[1], 8):
                    part, mix = y[:, k : k + 8], self.mix[k : k + 8]
                    c = decode(part)
                    wall = 1 - (part - c) @ ROOTS.T  # distance to the wall towards each neighbour, times sqrt 2
                    best = np.argpartition(wall, self.probes, axis=1)[:, : self.probes]
                    costs.append(np.take_along_axis(wall, best, 1) ** 2)
                    steps.append((np.rint(2 * ROOTS).astype(np.int64) @ mix)[best])
                    own += np.rint(2 * c).astype(np.int64) @ mix
                cost, step = np.concatenate(costs, 1), np.concatenate(steps, 1)
                # Cells that differ in one block, and, nearest walls of two blocks together, in two.
                for i, j in itertools.combinations(range(self.blocks), 2):
                    a, b = costs[i].argmin(1), costs[j].argmin(1)
                    cost = np.c_[cost, costs[i][rows, a] + costs[j][rows, b]]
                    step = np.c_[step, steps[i][rows, a] + steps[j][rows, b]]
                best = np.argpartition(cost, self.probes - 1, axis=1)[:, : self.probes]
                yield np.c_[own, own[:, None] + np.take_along_axis(step, best, 1)]

    def codes(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.signs > 0, axis=1, bitorder="little").view("<i8")[:, 0]


def unit_rows(data, single: bool) -> np.ndarray:
    x = np.array([np.frombuffer(d, "<f4" if single else "<f8") for d in data]).astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _hash(threshold: float, shape: tuple[int, int, int], single: bool):
    def run(batches):
        made: dict[int, Hash] = {}
        for batch in batches:
            ids, labels, data = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            sizes = np.array([len(d) for d in data])
            for size in np.unique(sizes):
                for rows in np.array_split(np.flatnonzero(sizes == size), max(1, (sizes == size).sum() // 1000)):
                    dim = int(size) // (4 if single else 8)
                    if dim not in made:
                        made[dim] = Hash(dim, threshold, shape)
                    unit = unit_rows([data[r] for r in rows], single)
                    code = made[dim].codes(unit)
                    for t, keys in enumerate(made[dim].cells(unit)):
                        with np.errstate(over="ignore"):
                            salt = (labels[rows].astype(np.int64) * 1_000_003 + t * 131 + dim) * np.int64(0x1F3D5B79A2C4E687)
                            keys = keys ^ salt[:, None]
                        n = keys.shape[1]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys.ravel()), pa.array(np.repeat(ids[rows], n)), pa.array(np.repeat(code, n)), pa.array(np.tile(np.arange(n) == 0, len(rows)))],
                            ["bucket", "id", "code", "stored"],
                        )

    return run


def _test_star(threshold: float, single: bool):
    def run(batches):
        head, of = None, None
        for batch in batches:
            hubs, kinds, ids, data = (batch.column(k) for k in (0, 2, 3, 4))
            hubs, kinds, ids, data = hubs.to_numpy(), kinds.to_numpy(), ids.to_numpy(), data.to_pylist()
            # A run ends where the next hub's own row begins.
            starts = np.unique(np.r_[0, np.flatnonzero(kinds == 0)]) if len(ids) else []
            for lo, hi in zip(starts, [*starts[1:], len(ids)]):
                if kinds[lo] == 0:
                    head, of = hubs[lo], data[lo]
                    lo += 1
                at = np.array([k for k in range(lo, hi) if hubs[k] == head and len(data[k]) == len(of)], int)
                if len(at):
                    cos = unit_rows([data[k] for k in at], single) @ unit_rows([of], single)[0]
                    at = at[cos >= threshold]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(hubs[at])], ["a", "b"])

    return run


def _near_codes(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= FAR


def _sift(frame: pd.DataFrame) -> pd.DataFrame:
    """The rows whose code is near another's of another class in their group."""
    cls, code, near = frame["class"].to_numpy(), frame["code"].to_numpy().view("u8"), np.zeros(len(frame), bool)
    for left, right in groups_of(frame):
        hit = (np.bitwise_count(code[left][:, None] ^ code[right][None]) <= FAR) & (cls[left][:, None] != cls[right][None])
        near[left] |= hit.any(1)
        near[right] |= hit.any(0)
    return frame[near]


def _same_size(frame, p, q):
    size = frame["data"].str.len().to_numpy()
    for n in np.intersect1d(size[p], size[q]):
        yield p[size[p] == n], q[size[q] == n]


def _test_block(threshold: float, single: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, cls, data = frame["id"].to_numpy(), frame["class"].to_numpy(), frame["data"].to_numpy()
        forest = Forest()
        for i, c in zip(ids.tolist(), cls.tolist()):
            forest.join(i, c, link=False)
        for left, right in groups_of(frame):
            for p, q in _same_size(frame, left, right):
                cos = unit_rows(data[p], single) @ unit_rows(data[q], single).T
                for r, s in zip(*np.nonzero((cos >= threshold) & (cls[p][:, None] != cls[q][None]))):
                    forest.join(int(ids[p[r]]), int(ids[q[s]]))
        return pd.DataFrame(forest.links, columns=["a", "b"], dtype="int64")

    return run


def _count_block(threshold: float, single: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, w, data = frame["id"].to_numpy(), frame["w"].to_numpy(), frame["data"].to_numpy()
        n = np.zeros(len(ids), np.int64)
        for left, right in groups_of(frame):
            for p, q in _same_size(frame, left, right):
                hit = unit_rows(data[p], single) @ unit_rows(data[q], single).T >= threshold
                if left is right:
                    np.fill_diagonal(hit, False)
                    n[p] += hit @ w[q]
                else:
                    n[p] += hit @ w[q]
                    n[q] += hit.T @ w[p]
        return pd.DataFrame({"id": ids, "n": n}).groupby("id", as_index=False).sum()

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, *, shape: tuple[int, int, int] = SHAPE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = storage.Scratch(spark, "lattice")
    single = dict(vectors.dtypes)[vector_col] == "array<float>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    named = rows.where("id is not null")
    count = named.agg(F.count("*").alias("n"), F.count_distinct("id").alias("d")).first()
    if count["n"] != count["d"]:
        named = scratch.write(named.groupBy("id").agg(F.min(F.struct("label", "v")).alias("s")).select("id", "s.label", "s.v"))
    fine = F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = scratch.write(named.where(F.col("label").isNotNull() & fine).select("id", "label", "v").mapInArrow(_as_bytes(single), "id long, label long, data binary"))
    good = good.withColumn("key", F.md5(F.concat(F.col("label").cast("string").cast("binary"), F.lit(b"|"), "data")))
    # Equal vectors of one label are compared once: few have a copy, and only their rows need to learn of it.
    copied = scratch.write(good.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    of = scratch.write(storage.join_unique(good.select("id", "key"), copied, "key", "n").select("id", "rep"))
    copies = scratch.write(of.where("id <> rep").select("id"))
    likely, rest = storage.divided(good, copies, "id")
    reps = rest.unionByName(likely.join(copies, "id", "left_anti"))
    payload = good.select("id", "data")  # of copies too, which nobody asks for
    met = scratch.write(reps.select("id", "label", "data").mapInArrow(_hash(threshold, shape, single), "bucket long, id long, code long, stored boolean"))
    classes = bucket_classes(met, payload, _test_star(threshold, single), _test_block(threshold, single), block=BLOCK, rows_per_bin=4096, near=_near_codes, sift=_sift)
    weights = copied.select(F.col("rep").alias("id"), "n")
    inside = scratch.write(classes.join(weights, "id", "left").select(F.col("component").alias("bucket"), "id", F.coalesce("n", F.lit(1)).alias("w")))
    dealt = scratch.write(block_pairs(inside, inside.groupBy("bucket").agg(F.count("*").alias("n")), ["bucket"], BLOCK))
    counted = bins_of(dealt, ["bucket", "i", "j"], dealt.count(), 4096).join(storage.divided(payload, dealt, "id")[0], "id").groupBy("bin").applyInPandas(_count_block(threshold, single), "id long, n long")
    counted = counted.groupBy("id").agg(F.sum("n").alias("others"))
    found = weights.join(classes, "id", "full").join(counted, "id", "left").select(
        F.col("id").alias("rep"), (F.coalesce("others", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    found = scratch.write(found)
    linked = of.join(found, "rep").select("id", "n_links", "component_id").unionByName(
        found.join(weights.withColumnRenamed("id", "rep"), "rep", "left_anti").select(F.col("rep").alias("id"), "n_links", "component_id")
    )
    linked = scratch.write(linked)
    scratch.drop(met, copied, of, inside, dealt, found)
    ids = named.select("id").unionByName(rows.where("id is null").select("id"))
    out = ids.join(linked, "id", "left").select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _as_bytes(single: bool):
    def run(batches):
        for batch in batches:
            v = batch.column(2)
            flat, ends = v.flatten().to_numpy(zero_copy_only=False).astype("<f4" if single else "<f8") + 0, v.offsets.to_numpy()  # no negative zeros
            ends = ends - ends[0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([flat[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], ["id", "label", "data"]
            )

    return run
