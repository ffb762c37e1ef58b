"""Recall of planted links by shape, and near-duplicate vectors held against all pairs."""

import numpy as np
import pytest

from rastra.llm import lattice


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pairs_at(cosine, n, dim, rng):
    x = unit(rng.normal(size=(n, dim)))
    side = rng.normal(size=(n, dim))
    side = unit(side - (side * x).sum(1, keepdims=True) * x)
    return x, cosine * x + np.sqrt(1 - cosine**2) * side


@pytest.mark.parametrize("dim", [16, 64, 256])
@pytest.mark.parametrize("vectors", [1000, 10**7, 10**10])
def test_recall_of_links_at_the_threshold(vectors, dim):
    x, y = pairs_at(0.98, 2000, dim, np.random.default_rng(1))
    h = lattice.Hash(dim, 0.98, lattice.shape_for(vectors))
    met = np.zeros(len(x), bool)
    for a, b in zip(h.cells(x), h.cells(y)):
        met |= (b == a[:, :1]).any(1) | (a == b[:, :1]).any(1)
    met &= np.bitwise_count((h.codes(x) ^ h.codes(y)).view("u8")) <= lattice.FAR
    assert met.mean() >= 0.995


def brute(rows):
    """n_links and component of each (id, label, vector) by all pairs."""
    ids = [r[0] for r in rows]
    x = unit(np.array([r[2] for r in rows], np.float64))
    label = np.array([r[1] for r in rows])
    link = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    part = list(ids)
    changed = True
    while changed:
        new = [min([part[k], *(part[j] for j in np.flatnonzero(link[k]))]) for k in range(len(ids))]
        changed, part = new != part, new
    return {i: (int(n), p) for i, n, p in zip(ids, link.sum(1), part)}


def test_planted_links_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows, at = [], 0
    for cosine in (0.9805, 0.985, 0.995, 0.97, 0.979):
        for a, b in zip(*pairs_at(cosine, 60, 64, rng)):
            rows += [(at, at % 3, a), (at + 1, at % 3 if at % 7 else (at + 1) % 3, b)]
            at += 2
    hub = unit(rng.normal(size=(1, 64)))
    for k in range(300):  # one crowded cell: many near copies of one vector, and exact ones
        side = unit(rng.normal(size=(1, 64)))
        rows.append((at + k, 1, unit(hub + rng.uniform(0.05, 0.25) * side)[0] if k % 3 else hub[0]))
    rows = [(i, c, [float(np.float32(z)) for z in v]) for i, c, v in rows]
    want = brute(rows)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(7)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice.near_duplicates(df).collect()}
    linked = [i for i in want if want[i][0]]
    assert len(linked) > 400 and set(got) == set(want)
    assert np.mean([got[i] == want[i] for i in linked]) >= 0.99
    assert all(got[i] == want[i] for i in want if not want[i][0])


def met_by(shape, x, y):
    """Which pairs of rows share a cell of ``shape`` and have near codes."""
    h, out = lattice.Hash(x.shape[1], 0.98, shape), []
    for at in range(0, len(x), 1000):
        p, q = x[at : at + 1000], y[at : at + 1000]
        met = np.zeros(len(p), bool)
        for a, b in zip(h.cells(p), h.cells(q)):
            met |= (b == a[:, :1]).any(1) | (a == b[:, :1]).any(1)
        out.append(met & (np.bitwise_count((h.codes(p) ^ h.codes(q)).view("u8")) <= lattice.FAR))
    return np.concatenate(out)


def test_links_do_not_depend_on_the_number_of_rows(spark):
    """Pairs that a coarser shape misses and that of large tables finds, or the other way: small tables do as large ones."""
    assert len({lattice.shape_for(n) for n in (2, 100_000, 100_001, 10**8, 10**8 + 1, 10**10)}) == 1
    x, y = pairs_at(0.9801, 10_000, 16, np.random.default_rng(5))
    large, coarse = met_by((8, 3, 4), x, y), met_by((5, 2, 3), x, y)
    odd = np.flatnonzero(large != coarse).tolist()
    assert any(large[k] for k in odd)
    rows = [(2 * k + side, k, v[k].tolist()) for k in odd for side, v in enumerate((x, y))]
    got = {r["vec_id"]: r["n_links"] for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert got == {2 * k + side: int(large[k]) for k in odd for side in (0, 1)}
