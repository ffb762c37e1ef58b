"""Least labels over a grid: tiles relax by themselves and tell their neighbours what changed at their edges.

A cell's label is (cost, tag), the least over all paths from seeds; equal costs go to the smaller tag.
A tile holds its cells and a halo as wide as the longest step.  Each round only tiles that got a message
relax again: a round shuffles and writes their states and the messages, and nothing of the other tiles, whose
states stay in the tables of earlier rounds.  A small table says in which round each tile was last written.  Rounds
are bounded by the tiles along the longest path, and no task holds more than a tile.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed

STEPS = [(-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1)]
STRAIGHT = STEPS[:4]
TILE, EPS = 256, 1e-9
_STATE = "raster_id string, tr int, tc int, state boolean, blob binary"


def length(dr: int, dc: int) -> float:
    return math.sqrt(2) if dr and dc else 1.0


class View:
    """Layers of a tile seen from the cells of its core, moved by (dr, dc)."""

    def __init__(self, arrays: dict[str, np.ndarray], halo: int, h: int, w: int):
        self.arrays, self.halo, self.h, self.w = arrays, halo, h, w

    def at(self, name: str, dr: int = 0, dc: int = 0) -> np.ndarray:
        r, c = self.halo + dr, self.halo + dc
        return self.arrays[name][r : r + self.h, c : c + self.w]


#: cost(view, dr, dc): of the step into each core cell from the cell at (-dr, -dc); infinite where there is none.
Cost = Callable[[View, int, int], np.ndarray]


def _pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as found:
        return {k: found[k] for k in found.files}


def _relax(a: dict[str, np.ndarray], size: int, halo: int, steps, cost: Cost, limit: float) -> None:
    view = View(a, halo, size, size)
    costs = []
    for dr, dc in steps:
        c = np.where((view.at("there") == 1) & (view.at("there", -dr, -dc) == 1), cost(view, dr, dc), np.inf)
        costs.append(np.where(np.isnan(c), np.inf, c))
    label, tag = view.at("label"), view.at("tag")
    more = True
    while more:
        more = False
        for (dr, dc), c in zip(steps, costs):
            new, its = view.at("label", -dr, -dc) + c, view.at("tag", -dr, -dc)
            better = (new < label - EPS) | ((new < label + EPS) & (its < tag) & np.isfinite(new))
            better &= (new < limit) & np.isfinite(new)
            if better.any():
                label[better] = np.minimum(new, label)[better]
                tag[better] = its[better]
                more = True


def _messages(key, size: int, halo: int, a: dict, before: tuple[np.ndarray, np.ndarray]):
    """A message for each neighbour whose halo has changed: absolute cells with their labels."""
    raster, tr, tc = key
    core = slice(halo, halo + size)
    label, tag = a["label"][core, core], a["tag"][core, core]
    changed = (label != before[0]) | (tag != before[1])
    reach = -(-halo // size)
    for dr in range(-reach, reach + 1):
        for dc in range(-reach, reach + 1):
            if not dr and not dc:
                continue
            rows, cols = (np.arange(size) >= size - halo if d > 0 else np.arange(size) < halo if d < 0 else np.ones(size, bool) for d in (dr, dc))
            at = np.nonzero(changed & rows[:, None] & cols[None, :])
            if len(at[0]):
                yield raster, tr + dr, tc + dc, False, _pack(row=at[0] + tr * size, col=at[1] + tc * size, label=label[at], tag=tag[at])


#: Tables of rounds kept before the latest states are put together, and tile keys that are broadcast (about 40 bytes each).
_COMPACT, _KEYS = 12, 500_000


def _small(keys: DataFrame) -> DataFrame:
    """Tile keys, to be broadcast where they are few enough: states then stay where they are."""
    return F.broadcast(keys) if keys.count() <= _KEYS else keys


def _latest(log: list[DataFrame], asked: DataFrame, key: list[str]) -> DataFrame:
    """The states of tiles (key, turn), each from the table of its turn."""
    found = [t.join(_small(asked.where(F.col("turn") == k).select(*key)), key, "left_semi") for k, t in enumerate(log)]
    return reduce(DataFrame.unionByName, found)


def propagate(cells: DataFrame, layers: list[str], cost: Cost, *, steps=STEPS, limit: float = math.inf, tile: int = TILE) -> DataFrame:
    """raster_id, row, col, label, tag of ``cells`` (raster_id, row, col, seed, tag, layers).

    ``seed`` is the label to begin with, null where there is none; ``tag`` (long) goes along with it.
    Cells that no seed reaches have an infinite label and a null tag.
    """
    halo = max(max(abs(r), abs(c)) for r, c in steps)
    size = max(tile, halo)
    names = ["there", "seed", *layers]
    none = np.iinfo(np.int64).max

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(key[1]), int(key[2])
        side = size + 2 * halo
        r, c = frame["row"].to_numpy() - tr * size + halo, frame["col"].to_numpy() - tc * size + halo
        a = {n: np.full((side, side), np.nan) for n in names}
        a["there"][r, c] = 1
        for n in ["seed", *layers]:
            a[n][r, c] = frame[n].astype(float).to_numpy()
        seed = a.pop("seed")
        a["label"] = np.where(np.isnan(seed), np.inf, seed)
        a["tag"] = np.full((side, side), none)
        a["tag"][r, c] = frame["tag"]
        core = slice(halo, halo + size)
        # halo labels wait for messages, so that every seed is told once by its own tile
        mine_l, mine_t = a["label"][core, core].copy(), a["tag"][core, core].copy()
        a["label"][:], a["tag"][:] = np.inf, none
        a["label"][core, core], a["tag"][core, core] = mine_l, mine_t
        before = np.full((size, size), np.inf), np.full((size, size), none)
        _relax(a, size, halo, steps, cost, limit)
        out = [(*key, True, _pack(**a)), *_messages(key, size, halo, a, before)]
        return pd.DataFrame(out, columns=["raster_id", "tr", "tc", "state", "blob"])

    def step(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.loc[frame["state"], "blob"]
        told = frame.loc[~frame["state"], "blob"]
        if not len(own) or not len(told):
            return frame.loc[frame["state"]]
        tr, tc = int(key[1]), int(key[2])
        a = _unpack(own.iloc[0])
        core = slice(halo, halo + size)
        before = a["label"][core, core].copy(), a["tag"][core, core].copy()
        side = size + 2 * halo
        for m in map(_unpack, told):
            r, c = m["row"] - tr * size + halo, m["col"] - tc * size + halo
            ok = (r >= 0) & (r < side) & (c >= 0) & (c < side)
            a["label"][r[ok], c[ok]], a["tag"][r[ok], c[ok]] = m["label"][ok], m["tag"][ok]
        _relax(a, size, halo, steps, cost, limit)
        out = [(*key, True, _pack(**a)), *_messages(key, size, halo, a, before)]
        return pd.DataFrame(out, columns=["raster_id", "tr", "tc", "state", "blob"])

    def finish(batches):
        for frame in batches:
            for raster, tr, tc, _, blob in frame.itertuples(index=False):
                a = _unpack(blob)
                core = slice(halo, halo + size)
                r, c = np.nonzero(a["there"][core, core] == 1)
                label, tag = a["label"][core, core][r, c], a["tag"][core, core][r, c]
                yield pd.DataFrame({"raster_id": raster, "row": r + tr * size, "col": c + tc * size, "label": label, "tag": pd.array(np.where(tag == none, -1, tag), "Int64")})

    def tiles(c: str):
        return F.explode(F.sequence(F.floor((F.col(c) - halo) / size).cast("int"), F.floor((F.col(c) + halo) / size).cast("int")))

    tag = F.coalesce(F.when(F.col("seed").isNotNull(), F.col("tag")), F.lit(none)).cast("long")
    dealt = cells.withColumn("tag", tag).withColumn("tr", tiles("row")).withColumn("tc", tiles("col"))
    key = ["raster_id", "tr", "tc"]
    now = checkpointed(dealt.select(*key, "row", "col", "seed", "tag", *layers).groupBy(*key).applyInPandas(build, _STATE))
    log, current = [now.where("state")], checkpointed(now.where("state").select(*key, F.lit(0).alias("turn")))
    while True:
        told = now.where("not state")
        # Messages to places beyond the raster find no tile.
        asked = checkpointed(told.select(*key).distinct().join(current, key))
        if asked.isEmpty():
            break
        now = checkpointed(_latest(log, asked, key).unionByName(told.join(_small(asked.select(*key)), key, "left_semi")).groupBy(*key).applyInPandas(step, _STATE))
        log.append(now.where("state"))
        written = asked.select(*key, F.lit(len(log) - 1).alias("new"))
        current = checkpointed(current.join(written, key, "left").select(*key, F.coalesce("new", "turn").alias("turn")))
        if len(log) == _COMPACT:  # a plan reads no more than so many tables
            log, current = [checkpointed(_latest(log, current, key))], checkpointed(current.select(*key, F.lit(0).alias("turn")))
    # one tile at a time: a blob is some MB
    out = _latest(log, current, key).groupBy(*key).applyInPandas(lambda f: pd.concat(list(finish([f]))), "raster_id string, row int, col int, label double, tag long")
    return out.withColumn("tag", F.when(F.col("tag") >= 0, F.col("tag")))


# Costs.  Layers: open (1 may be entered), blocked (0 free, 1 obstacle, NaN unknown), weight, value.


def octile(v: View, dr: int, dc: int) -> np.ndarray:
    return np.where((v.at("open") == 1) & (v.at("open", -dr, -dc) == 1), length(dr, dc), np.inf)


def any_cell(v: View, dr: int, dc: int) -> np.ndarray:
    return np.full((v.h, v.w), length(dr, dc))


def _corner(v: View, dr: int, dc: int) -> np.ndarray:
    """Whether a diagonal step may pass between the two cells that it has in common with both ends."""
    p, q = v.at("blocked", -dr, 0), v.at("blocked", 0, -dc)
    return ~(np.isnan(p) | np.isnan(q)) & ~((p != 0) & (q != 0))


def around_obstacles(v: View, dr: int, dc: int) -> np.ndarray:
    ok = v.at("blocked") == 0
    return np.where(ok & _corner(v, dr, dc) if dr and dc else ok, length(dr, dc), np.inf)


def past_obstacles(v: View, dr: int, dc: int) -> np.ndarray:
    return np.where(v.at("blocked") == 0, length(dr, dc), np.inf)


def mean_weight(v: View, dr: int, dc: int) -> np.ndarray:
    return length(dr, dc) / 2 * (v.at("weight") + v.at("weight", -dr, -dc))


def entered_weight(v: View, dr: int, dc: int) -> np.ndarray:
    return np.where(np.isnan(v.at("weight", -dr, -dc)), np.inf, length(dr, dc) * v.at("weight"))


def same_value(v: View, dr: int, dc: int) -> np.ndarray:
    return np.where((v.at("value") > 0) & (v.at("value") == v.at("value", -dr, -dc)), 0.0, np.inf)


def both_positive(v: View, dr: int, dc: int) -> np.ndarray:
    return np.where((v.at("value") > 0) & (v.at("value", -dr, -dc) > 0), 0.0, np.inf)


def same_value_around(v: View, dr: int, dc: int) -> np.ndarray:
    free = (v.at("blocked") == 0) & (v.at("blocked", -dr, -dc) == 0)
    return np.where(free & _corner(v, dr, dc) if dr and dc else free, same_value(v, dr, dc), np.inf)


def same_value_in_sight(v: View, dr: int, dc: int) -> np.ndarray:
    """King's moves from a to b, diagonal ones first, must be free of obstacles; both lie in one open area."""
    ok = (v.at("area") == v.at("area", -dr, -dc)) & (v.at("blocked") == 0) & (v.at("blocked", -dr, -dc) == 0)
    r, c = -dr, -dc
    while r or c:
        sr, sc = (r < 0) - (r > 0), (c < 0) - (c > 0)
        if sr and sc:
            ok &= ~((v.at("blocked", r, c + sc) != 0) & (v.at("blocked", r + sr, c) != 0))
        r, c = r + sr, c + sc
        ok &= v.at("blocked", r, c) == 0
    return np.where(ok, same_value(v, dr, dc), np.inf)
