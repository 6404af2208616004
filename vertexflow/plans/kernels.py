"""Numeric kernels of one mesh, run by ``applyInPandas`` on its operators.

Matrices are sparse triplets, so a mesh needs memory in proportion to its entries; only
spectra of small meshes go through a dense solver. The relational operators around the
kernels have no bound by mesh at all.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Meshes of up to this many vertices get their spectrum from a dense solver.
DENSE = 1500
#: Relative residual beyond which a solve has failed.
LOST = 0.5


class Sparse:
    """Triplets sorted by row; entries at one place add up in products."""

    def __init__(self, i: np.ndarray, j: np.ndarray, val: np.ndarray, shape: tuple[int, int]):
        order = np.argsort(i, kind="stable")
        self.i, self.j, self.val, self.shape = np.asarray(i)[order], np.asarray(j)[order], np.asarray(val, float)[order], shape
        self.rows, self.starts = np.unique(self.i, return_index=True)

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[0], *x.shape[1:]))
        if len(self.i):
            weight = self.val.reshape(-1, *[1] * (x.ndim - 1))
            out[self.rows] = np.add.reduceat(weight * x[self.j], self.starts, axis=0)
        return out

    @property
    def T(self) -> Sparse:  # noqa: N802
        return Sparse(self.j, self.i, self.val, self.shape[::-1])

    def diagonal(self) -> np.ndarray:
        on = self.i == self.j
        return np.bincount(self.i[on], self.val[on], self.shape[0])

    def plus_diagonal(self, extra: np.ndarray, factor: float = 1.0) -> Sparse:
        """``factor`` times the matrix and a diagonal."""
        n = np.arange(self.shape[0])
        return Sparse(np.concatenate([self.i, n]), np.concatenate([self.j, n]), np.concatenate([factor * self.val, np.broadcast_to(extra, n.shape)]), self.shape)

    def dense(self) -> np.ndarray:
        out = np.zeros(self.shape)
        np.add.at(out, (self.i, self.j), self.val)
        return out


def indexed(coo: pd.DataFrame, ids: np.ndarray) -> Sparse:
    """The triplets (i, j, val) over the places of ``ids``."""
    at = pd.Index(ids)
    return Sparse(at.get_indexer(coo.i), at.get_indexer(coo.j), coo.val.to_numpy(), (len(ids), len(ids)))


def dense(coo: pd.DataFrame, ids: np.ndarray) -> np.ndarray:
    return indexed(coo, ids).dense()


def solve(a: Sparse, b: np.ndarray, tol: float = 1e-12, rounds: int | None = None, start: np.ndarray | None = None) -> np.ndarray:
    """a x = b for a symmetric positive (semi-)definite matrix, by conjugate gradients scaled by the diagonal; b may have columns.

    Raises where a residual stays above ``LOST`` of its right-hand side, as it does for matrices that are not positive.
    """
    flat = b.ndim == 1
    b = b[:, None] if flat else b
    d = a.diagonal()
    scale = (1 / np.where(np.abs(d) > 1e-300, d, 1.0))[:, None]
    x = np.zeros_like(b, dtype=float) if start is None else (start[:, None] if flat else start).astype(float)
    r = b - a @ x
    z = scale * r
    p, rz = z.copy(), (r * z).sum(0)
    goal = tol * np.maximum(np.linalg.norm(b, axis=0), 1e-300)
    for _ in range(rounds or 10 * len(b)):
        if (np.linalg.norm(r, axis=0) <= goal).all():
            break
        q = a @ p
        step = rz / np.where((p * q).sum(0) > 0, (p * q).sum(0), np.inf)
        x, r = x + step * p, r - step * q
        z = scale * r
        new = (r * z).sum(0)
        p, rz = z + new / np.where(rz > 0, rz, np.inf) * p, new
    left = float((np.linalg.norm(b - a @ x, axis=0) / np.maximum(np.linalg.norm(b, axis=0), 1e-300)).max(initial=0))
    if not left <= LOST:
        raise ArithmeticError(f"conjugate gradients end with a relative residual of {left:.2g}")
    return x[:, 0] if flat else x


def generalized_eigh(stiff: np.ndarray, mass: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest pairs of S v = l M v, M diagonal; vectors are M-orthonormal."""
    root = 1 / np.sqrt(mass)
    value, vector = np.linalg.eigh(root[:, None] * (stiff + stiff.T) / 2 * root)
    return value[:k], root[:, None] * vector[:, :k]


def sparse_eigh(stiff: Sparse, mass: np.ndarray, k: int, tol: float = 1e-9, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The same by inverse iteration on a subspace; the shift keeps the matrix positive definite, and a failure to settle falls back to the dense solver."""
    n = len(mass)
    width = min(n, k + max(8, k // 2))
    shift = 1e-4 * max(float(np.abs(stiff.diagonal()).mean() / mass.mean()), 1e-12)
    a = stiff.plus_diagonal(shift * mass)
    x = np.random.default_rng(0).normal(size=(n, width))
    x[:, 0] = 1
    last = np.full(k, np.inf)
    for _ in range(rounds):
        y = solve(a, mass[:, None] * x, 1e-10)
        # Rayleigh-Ritz in a basis that is orthonormal under the masses
        g = y.T @ (mass[:, None] * y)
        w, q = np.linalg.eigh((g + g.T) / 2)
        y = y @ (q / np.sqrt(np.maximum(w, w.max() * 1e-14)))
        s = y.T @ (stiff @ y)
        value, q = np.linalg.eigh((s + s.T) / 2)
        x = y @ q
        if np.abs(value[:k] - last).max() <= tol * max(np.abs(value[:k]).max(), 1e-12):
            return value[:k], x[:, :k]
        last = value[:k]
    return generalized_eigh(stiff.dense(), mass, k)


def spectrum(stiff: Sparse, mass: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    k = min(k, len(mass))
    return generalized_eigh(stiff.dense(), mass, k) if len(mass) <= DENSE else sparse_eigh(stiff, mass, k)


def eigenpairs(coo: DataFrame, mass: DataFrame, k: int) -> DataFrame:
    """(mesh_id, m, lam, v, phi) of every mesh, ascending; unit masses give the standard problem."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("i")
        ids, area = b.i.to_numpy(), b.area.to_numpy(float)
        value, vector = spectrum(indexed(a, ids), area, k)
        m = np.arange(len(value))
        return pd.DataFrame({"mesh_id": b.mesh_id.iloc[0], "m": np.repeat(m, len(ids)), "lam": np.repeat(value, len(ids)), "v": np.tile(ids, len(m)), "phi": vector.T.ravel()})

    kind = mass.schema["mesh_id"].dataType.simpleString()
    coo = coo.select(F.col("mesh_id").alias("of"), F.col("i").alias("i"), F.col("j").alias("j"), F.col("val").alias("val"))
    return coo.groupBy("of").cogroup(mass.groupBy("mesh_id")).applyInPandas(run, f"mesh_id {kind}, m int, lam double, v long, phi double")


def greens_function(stiff: Sparse, mass: np.ndarray, source: int, eps: float = 1e-6) -> tuple[np.ndarray, float]:
    """Solution of (L + e M) g = delta less its mass-weighted mean, scaled to [0, 1], and the relative residual of the raw one."""
    e = eps * max(np.abs(stiff.diagonal()).mean(), 1e-4)
    delta = np.zeros(len(mass))
    delta[source] = 1
    g = solve(stiff.plus_diagonal(e * mass), delta)
    residual = float(np.linalg.norm(stiff @ g - delta))
    g = g - (mass @ g) / mass.sum()
    g = g - g.min()
    return (g / g.max() if g.max() > 0 else g), residual


def heat_distance(stiff: Sparse, mass: np.ndarray, grad: Sparse, weight: np.ndarray, source: int, t: float, signs: bool = False) -> np.ndarray:
    """Distances by heat flow. ``grad`` has rows 3 i + d, ``weight`` the area of each of its places.

    ``signs`` tries both signs of the divergence and keeps the one with fewer values below
    the source's; else the source is shifted to 0 and then the least value.
    """
    delta = np.zeros(len(mass))
    delta[source] = 1
    u = solve(stiff.plus_diagonal(mass, t), delta)
    x = (grad @ u).reshape(-1, 3)
    x = -x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
    phi = solve(stiff.plus_diagonal(1e-8), grad.T @ (weight[:, None] * x).ravel())
    if signs and (phi < phi[source]).sum() >= (-phi < -phi[source]).sum():
        phi = -phi
    return phi - phi.min()


def edge_distance(i: np.ndarray, j: np.ndarray, length: np.ndarray, n: int, source: int) -> np.ndarray:
    """Shortest paths along edges: an upper bound of the distance on the surface; infinite where there is no path."""
    order = np.argsort(i, kind="stable")
    j, length, starts = j[order], length[order], np.searchsorted(i[order], np.arange(n + 1))
    best, heap = np.full(n, np.inf), [(0.0, source)]
    best[source] = 0.0
    while heap:
        d, v = heapq.heappop(heap)
        if d > best[v]:
            continue
        for e in range(starts[v], starts[v + 1]):
            far = d + length[e]
            if far < best[j[e]]:
                best[j[e]] = far
                heapq.heappush(heap, (far, int(j[e])))
    return best


def rotations(covariances: np.ndarray) -> np.ndarray:
    """The closest rotation to each 3 x 3 covariance (det not above 0: the weakest direction flips; a zero one keeps the identity)."""
    u, _, vt = np.linalg.svd(covariances)
    r = np.swapaxes(vt, 1, 2) @ np.swapaxes(u, 1, 2)
    flip = np.linalg.det(r) <= 0
    vt[flip, 2] *= -1
    out = np.swapaxes(vt, 1, 2) @ np.swapaxes(u, 1, 2)
    out[np.abs(covariances).max((1, 2)) == 0] = np.eye(3)
    return out


def arap(rest: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, targets: dict[int, np.ndarray], rounds: int = 20, tol: float = 1e-6) -> np.ndarray:
    """As-rigid-as-possible positions over directed edges (i, j) of weight w: local rotations and a global solve take turns."""
    n, fixed = len(rest), np.array(sorted(targets), np.int64)
    free = np.setdiff1d(np.arange(n), fixed)
    p, last = rest.astype(float).copy(), np.inf
    p[fixed] = np.stack([targets[k] for k in fixed])
    if not len(free):
        return p
    place = np.full(n, -1)
    place[free] = np.arange(len(free))
    inner = (place[i] >= 0) & (place[j] >= 0)
    total = np.bincount(i, w, n)
    system = Sparse(place[i[inner]], place[j[inner]], -w[inner], (len(free), len(free))).plus_diagonal(total[free])
    held = (place[i] >= 0) & (place[j] < 0)
    edge = rest[i] - rest[j]

    def by_vertex(values: np.ndarray) -> np.ndarray:
        flat = values.reshape(len(i), -1)
        return np.stack([np.bincount(i, flat[:, c], n) for c in range(flat.shape[1])], 1).reshape(n, *values.shape[1:])

    for _ in range(rounds):
        r = rotations(by_vertex(w[:, None, None] * edge[:, :, None] * (p[i] - p[j])[:, None, :]))
        side = by_vertex(0.5 * w[:, None] * np.einsum("eab,eb->ea", r[i] + r[j], edge))[free]
        np.add.at(side, place[i[held]], w[held, None] * p[j[held]])
        new = solve(system, side, start=p[free])
        step = np.linalg.norm(new - p[free])
        p[free] = new
        if abs(last - step) < tol:
            break
        last = step
    return p


def farthest_points(points: np.ndarray, n: int) -> list[int]:
    """The point nearest to the centroid, then always the one farthest from those chosen."""
    chosen = [int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))]
    near = np.full(len(points), np.inf)
    while len(chosen) < min(n, len(points)):
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(np.argmax(near)))
    return chosen


def random_rotation(rng: np.random.Generator) -> np.ndarray:
    q, r = np.linalg.qr(rng.normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    if np.linalg.det(q) < 0:
        q[:, 0] *= -1
    return q


def fingerprints(stiff: Sparse, mass: np.ndarray, landmarks: list[int], scales: list[float]) -> np.ndarray:
    """Rows of (S + a M)^-1 M at the landmarks for every a, of unit length."""
    e = np.zeros((len(mass), len(landmarks)))
    e[landmarks, np.arange(len(landmarks))] = 1
    out = np.concatenate([solve(stiff.plus_diagonal(a * mass), mass[:, None] * e) for a in scales], 1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
