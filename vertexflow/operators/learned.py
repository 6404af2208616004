"""Operators that a transformer's weights give a mesh: patches, inference and assembly in one place."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import kernels, transformer
from . import geodesics, neighbors, patches, sparse, spectral
from .graphs import checkpointed


class Operators(NamedTuple):
    """Stiffness (mesh_id, i, j, val), masses (mesh_id, i, area) and, in gradient mode, the gradient (mesh_id, i, d, j, val)."""

    stiffness: DataFrame
    masses: DataFrame
    gradient: DataFrame | None


def operators(vertices: DataFrame, weights: dict[str, np.ndarray], k: int = 20, heads: int = 4, gradient: bool = False, laplacian: str = "stiffness", k_train: int | None = None) -> Operators:
    """Operators of all meshes of ``vertices(mesh_id, v, x, y, z)``; inference runs once and its rows are kept.

    ``laplacian``: ``stiffness`` by the weights, or in gradient mode ``anisotropic``, the
    gradient's own, or ``anisotropic_sparse``, that one on the neighbour graph. ``k_train``
    corrects weights for another number of neighbours than the model was trained with.
    """
    from ..plans.options import checked

    checked(operator_mode="gradient" if gradient else "stiffness", laplacian_mode=laplacian)
    near = neighbors.grid_knn(vertices, k)
    rows = checkpointed(transformer.infer(patches.padded(patches.extract(near, vertices), k), weights, heads, gradient))
    if k_train is not None:
        rows = rows.withColumn("w", F.col("w") / (k / k_train))
    areas = rows.where("rank = 1").select("mesh_id", "center", "area")
    masses = sparse.mass(areas, vertices)
    g = sparse.gradient(rows) if gradient else None
    if laplacian == "stiffness":
        return Operators(sparse.stiffness(rows), masses, g)
    whole = sparse.anisotropic(rows, areas)
    return Operators(sparse.one_hop(whole, rows) if laplacian == "anisotropic_sparse" else whole, masses, g)


def basis(weights: dict[str, np.ndarray], neighbors_: int = 20, heads: int = 4, gradient: bool = False):
    """An eigenbasis provider (``operators.spectral.PROVIDERS``) of these weights."""

    def provide(faces: DataFrame | None, vertices: DataFrame, k: int):
        own = operators(vertices, weights, neighbors_, heads, gradient)
        both = kernels.eigenpairs(own.stiffness, own.masses, k)
        return both.select("mesh_id", "m", "lam").distinct(), both.select("mesh_id", "v", "m", "phi"), own.masses

    return provide


def validation(vertices: DataFrame, faces: DataFrame, weights: dict[str, np.ndarray], modes: int = 50, k: int = 20, heads: int = 4, gradient: bool = False, sources: int = 5) -> DataFrame:
    """A row a mesh: spectra against the mesh's own operators, and in gradient mode distances against exact ones."""
    own = operators(vertices, weights, k, heads, gradient)
    both = checkpointed(kernels.eigenpairs(own.stiffness, own.masses, modes))
    values, vectors, _ = spectral.mesh_basis(faces, vertices, modes)
    out = spectral.comparison(values, both.select("mesh_id", "m", "lam").distinct(), vectors, both.select("mesh_id", "v", "m", "phi"))
    if not gradient:
        return out
    return out.join(geodesics.validated(own.stiffness, own.masses, own.gradient, faces, vertices, sources), "mesh_id")


def averaged(rows: DataFrame) -> DataFrame:
    """(name, value): every metric of ``validation`` averaged over the meshes that have it."""
    from .metrics import mean_by_name

    names = [c for c in rows.columns if c != "mesh_id"]
    return mean_by_name(rows.select(F.explode(F.create_map(*(x for n in names for x in (F.lit(n), F.col(n).cast("double"))))).alias("name", "value")).where("value is not null"))
