"""Laplacians of poor meshes and of bare point clouds: intrinsic Delaunay triangulations of a tufted double cover.

Triangles of a cloud come from every point's own neighbourhood, point by point over the
cluster; the triangulation of a mesh is flipped in one task (``plans.intrinsic``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import intrinsic
from ..scratch import Scratch
from .sparse import stiffness

#: Neighbours whose tangent plane a point's triangles are found in.
NEIGHBORS = 30


def _operators(triangles: DataFrame, vertices: DataFrame, slack: float, tufted: bool, share: float) -> tuple[DataFrame, DataFrame]:
    """(mesh_id, i, j, val) and (mesh_id, i, area) of ``triangles(mesh_id, a, b, c)``."""
    none = F.lit(None).cast("double")
    rows = triangles.select("mesh_id", *(F.col(c).cast("long").alias(c) for c in "abc"), *(none.alias(n) for n in "xyz"))
    rows = rows.unionByName(vertices.select("mesh_id", F.col("v").cast("long").alias("a"), *(F.lit(None).cast("long").alias(c) for c in "bc"), *(F.col(n).cast("double").alias(n) for n in "xyz")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        v, f = frame[frame.b.isna()].sort_values("a"), frame[frame.b.notna()].sort_values(["a", "b", "c"])
        ids = v.a.to_numpy()
        at = pd.Index(ids)
        faces = np.stack([at.get_indexer(f[c].astype(np.int64)) for c in "abc"], 1)
        i, j, w, mass = intrinsic.robust_laplacian(v[["x", "y", "z"]].to_numpy(float), faces, slack, tufted)
        fine = i != j
        masses = pd.DataFrame({"mesh_id": frame.mesh_id.iloc[0], "center": ids, "neighbor": -1, "w": mass * share, "mass": True})
        return pd.concat([pd.DataFrame({"mesh_id": frame.mesh_id.iloc[0], "center": ids[i[fine]], "neighbor": ids[j[fine]], "w": w[fine] * share, "mass": False}), masses])

    kind = vertices.schema["mesh_id"].dataType.simpleString()
    found = Scratch(vertices.sparkSession, "robust").put(rows.groupBy("mesh_id").applyInPandas(run, f"mesh_id {kind}, center long, neighbor long, w double, mass boolean"))
    masses = found.where("mass")
    least = masses.groupBy("mesh_id").agg((1e-9 * F.greatest(F.avg("w"), F.lit(1e-300))).alias("least"))  # vertices without a triangle
    masses = masses.join(least, "mesh_id").select("mesh_id", F.col("center").alias("i"), F.greatest("w", "least").alias("area"))
    return stiffness(found.where("not mass").select("mesh_id", "center", "neighbor", "w")), masses


def mesh_operators(faces: DataFrame, vertices: DataFrame, slack: float = intrinsic.SLACK, tufted: bool = True) -> tuple[DataFrame, DataFrame]:
    """Stiffness and masses of meshes with needles, boundaries or edges of many faces; ``tufted=False`` flips a manifold mesh itself."""
    return _operators(faces.select("mesh_id", F.col("v0").alias("a"), F.col("v1").alias("b"), F.col("v2").alias("c")).where("a <> b and b <> c and c <> a"), vertices, slack, tufted, 1.0)


def cloud_triangles(vertices: DataFrame, neighbors: int = NEIGHBORS) -> DataFrame:
    """(mesh_id, a, b, c): the Delaunay triangles of each point a with its neighbours, in their common tangent plane. A triangle that its three corners agree on is there three times."""
    from .neighbors import grid_knn

    near = grid_knn(vertices, neighbors)
    place = lambda n: vertices.select("mesh_id", F.col("v").alias(n), *(F.col(c).cast("double").alias(f"{n[0]}{c}") for c in "xyz"))
    met = near.select("mesh_id", "center", "neighbor").join(place("center"), ["mesh_id", "center"]).join(place("neighbor"), ["mesh_id", "neighbor"])
    patch = met.groupBy("mesh_id", "center").agg(F.sort_array(F.collect_list(F.struct("neighbor", *((F.col(f"n{c}") - F.col(f"c{c}")).alias(c) for c in "xyz")))).alias("near"))  # ``neighbors`` at most
    kind = vertices.schema["mesh_id"].dataType.simpleString()

    def run(frames):
        for frame in frames:
            rows = []
            for mesh, center, cloud in frame.itertuples(index=False):
                ids, p = [q["neighbor"] for q in cloud], np.array([(q["x"], q["y"], q["z"]) for q in cloud])
                _, axes = np.linalg.eigh(p.T @ p)
                rows += [(mesh, center, ids[x], ids[y]) for x, y in intrinsic.stars(p @ axes[:, 1:]).tolist()]
            yield pd.DataFrame(rows, columns=["mesh_id", "a", "b", "c"])

    return patch.mapInPandas(run, f"mesh_id {kind}, a long, b long, c long")


def cloud_operators(vertices: DataFrame, neighbors: int = NEIGHBORS, slack: float = intrinsic.SLACK) -> tuple[DataFrame, DataFrame]:
    """Stiffness and masses of point clouds, a third of those of all points' own triangles."""
    return _operators(cloud_triangles(vertices, neighbors), vertices, slack, True, 1 / 3)
