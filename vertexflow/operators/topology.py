"""Triangle meshes: ``faces(mesh_id, f, v0, v1, v2)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .points import norm


def corners(faces: DataFrame) -> DataFrame:
    return faces.select("mesh_id", "f", F.explode(F.array("v0", "v1", "v2")).alias("v"))


def edges(faces: DataFrame) -> DataFrame:
    """(mesh_id, a, b, faces, kind) with a < b: boundary (1 face), interior (2) or non-manifold (more)."""
    sides = F.array(*(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))
    found = faces.select("mesh_id", F.explode(sides).alias("e")).groupBy("mesh_id", "e.a", "e.b").agg(F.count("*").alias("faces"))
    return found.withColumn("kind", F.when(F.col("faces") == 1, "boundary").when(F.col("faces") == 2, "interior").otherwise("non-manifold"))


def one_ring(faces: DataFrame) -> DataFrame:
    e = edges(faces)
    return e.select("mesh_id", F.col("a").alias("v"), F.col("b").alias("neighbor")).unionByName(e.select("mesh_id", F.col("b").alias("v"), F.col("a").alias("neighbor")))


def boundary_vertices(faces: DataFrame) -> DataFrame:
    return edges(faces).where("faces = 1").select("mesh_id", F.explode(F.array("a", "b")).alias("v")).distinct()


def with_corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """``faces`` with the places x0 .. z2 of their corners; faces that have them already, as a written table of this function, are not joined again."""
    if "z2" in faces.columns:
        return faces
    out = faces
    for k in range(3):
        out = out.join(vertices.select("mesh_id", F.col("v").alias(f"v{k}"), *(F.col(a).alias(f"{a}{k}") for a in "xyz")), ["mesh_id", f"v{k}"])
    return out


def _side(p: int, q: int):
    return norm(*(F.col(f"{a}{p}") - F.col(f"{a}{q}") for a in "xyz"))


def _measured(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    placed = with_corners(faces, vertices).withColumns({"a": _side(1, 2), "b": _side(2, 0), "c": _side(0, 1)})
    s = (F.col("a") + F.col("b") + F.col("c")) / 2
    # floored under the root: a degenerate face has an area of 1e-6
    return placed.withColumn("area", F.sqrt(F.greatest(s * (s - F.col("a")) * (s - F.col("b")) * (s - F.col("c")), F.lit(1e-12))))


def face_areas(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    return _measured(faces, vertices).select("mesh_id", "f", "v0", "v1", "v2", "area")


def cotangent_laplacian(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """D - W as (mesh_id, i, j, val), half a cotangent for each side's opposite angle, by Heron areas."""
    from .sparse import summed, transposed, with_zero_rows

    m = _measured(faces, vertices)
    square = {x: F.col(x) * F.col(x) for x in "abc"}
    sides = (("v1", "v2", square["b"] + square["c"] - square["a"]), ("v2", "v0", square["a"] + square["c"] - square["b"]), ("v0", "v1", square["a"] + square["b"] - square["c"]))
    entries = F.array(*(F.struct(F.col(p).alias("i"), F.col(q).alias("j"), (-x / (8 * F.col("area"))).alias("val")) for p, q, x in sides))
    off = m.select("mesh_id", F.explode(entries).alias("e")).select("mesh_id", "e.i", "e.j", "e.val")
    return with_zero_rows(summed(off, transposed(off)))


def barycentric_mass(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    m = _measured(faces, vertices).select("mesh_id", (F.col("area") / 3).alias("third"), F.explode(F.array("v0", "v1", "v2")).alias("i"))
    return m.groupBy("mesh_id", "i").agg(F.sum("third").alias("area"))


def mean_edge_length(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Over the directed edges of all faces."""
    m = with_corners(faces, vertices).select("mesh_id", F.explode(F.array(_side(1, 2), _side(2, 0), _side(0, 1))).alias("length"))
    return m.groupBy("mesh_id").agg(F.avg("length").alias("length"))


def face_to_vertex(values: DataFrame, faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mesh_id, v, val): area-weighted mean of ``values(mesh_id, f, val)`` over a vertex's faces."""
    m = _measured(faces, vertices).join(values, ["mesh_id", "f"]).select("mesh_id", "area", "val", F.explode(F.array("v0", "v1", "v2")).alias("v"))
    sums = m.groupBy("mesh_id", "v").agg(F.sum(F.col("area") * F.col("val")).alias("s"), F.sum("area").alias("w"))
    return sums.select("mesh_id", "v", (F.col("s") / F.greatest("w", F.lit(1e-16))).alias("val"))
