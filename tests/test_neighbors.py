"""Nearest neighbours of uneven and clustered points against brute force."""

import numpy as np
import pytest

from vertexflow.operators import neighbors


def brute(asks, points, k, same):
    out = set()
    for mesh, i, q in asks:
        near = sorted((float(((p - q) ** 2).sum()), j) for m, j, p in points if m == mesh and not (same and i == j))[:k]
        out |= {(mesh, i, r, j) for r, (_, j) in enumerate(near, 1)}
    return out


def uneven(width, seed=0):
    """Clusters, a crowd of equal points, one far outlier and a second, tiny mesh."""
    rng = np.random.default_rng(seed)
    middle = 30 * rng.normal(size=(8, width))
    p = np.concatenate([middle[rng.integers(0, 8, 500)] + rng.normal(size=(500, width)), np.full((40, width), 3.0), 1e5 * rng.normal(size=(1, width))])
    return [(0, i, x) for i, x in enumerate(p)] + [(1, i, x) for i, x in enumerate(p[:4])]


@pytest.mark.parametrize("width", [2, 3, 12])
@pytest.mark.parametrize("same", [True, False])
def test_blocks_find_what_brute_force_finds(spark, monkeypatch, width, same):
    monkeypatch.setattr(neighbors, "BLOCK", 64)
    rows, compared = uneven(width), []
    whole = neighbors._compared
    monkeypatch.setattr(neighbors, "_compared", lambda a, b, pairs, *rest: compared.append(pairs.count()) or whole(a, b, pairs, *rest))
    df = spark.createDataFrame([(m, i, x.tolist()) for m, i, x in rows], "mesh_id int, v long, p array<double>")
    asks = df if same else df.where("v % 3 = 0")
    got = {(r["mesh_id"], r["center"], r["rank"], r["neighbor"]) for r in neighbors.nearest(asks, df, 6, same, small=50).collect()}
    assert got == brute([x for x in rows if same or x[1] % 3 == 0], rows, 6, same)
    assert not same or sum(compared) < 0.75 * compared[0] ** 2  # the first pass has each block once


def test_product_and_differences_agree_on_ties(spark):
    rng = np.random.default_rng(4)
    p = rng.integers(0, 3, (150, 5)) + 1e6
    rows = [(0, i, x) for i, x in enumerate(p)]
    df = spark.createDataFrame([(m, i, x.tolist()) for m, i, x in rows], "mesh_id int, v long, p array<double>")
    got = {(r["mesh_id"], r["center"], r["rank"], r["neighbor"]) for r in neighbors.knn(df, 7).collect()}
    assert got == brute(rows, rows, 7, True)


def test_groups_of_wide_blocks_return_only_the_best_and_are_written_once(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 16)
    put = []
    whole = neighbors.Scratch.put
    monkeypatch.setattr(neighbors.Scratch, "put", lambda self, df: put.append(whole(self, df)) or put[-1])
    p = np.random.default_rng(5).normal(size=(320, 12))  # nothing to rule out: every block meets every other
    df = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(p)], "mesh_id int, v long, p array<double>")
    got = {(r["mesh_id"], r["center"], r["rank"], r["neighbor"]) for r in neighbors.nearest(df, df, 5, True, small=50).collect()}
    assert got == brute([(0, i, x) for i, x in enumerate(p)], [(0, i, x) for i, x in enumerate(p)], 5, True)
    assert set(put[-1].columns) == {"mesh_id", "center", "block", "neighbor", "d2"}  # pairs of blocks before
    assert put[-1].count() <= 8 * 5 * len(p)  # k a query and group at most, not k a query and block
