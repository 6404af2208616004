"""Point clouds: ``vertices(mesh_id, v, x, y, z)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def norm(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def _per_mesh(vertices: DataFrame, **aggregates: Column) -> DataFrame:
    """One row a mesh, joined back: the aggregates are partial, so a huge mesh isn't one task."""
    return vertices.groupBy("mesh_id").agg(*(a.alias(n) for n, a in aggregates.items()))


def centred(vertices: DataFrame) -> DataFrame:
    """Each mesh's centroid moved to the origin."""
    means = _per_mesh(vertices, **{f"m{a}": F.avg(a) for a in AXES})
    return vertices.join(means, "mesh_id").select("mesh_id", "v", *((F.col(a) - F.col(f"m{a}")).alias(a) for a in AXES))


def normalized(vertices: DataFrame, guarded: bool = True) -> DataFrame:
    """Centred and scaled into the unit sphere; guarded: a mesh of equal points is only centred."""
    points = centred(vertices)
    far = _per_mesh(points, far=F.max(norm(*map(F.col, AXES))))
    scale = F.when(F.col("far") > 0, F.col("far")).otherwise(1.0 if guarded else F.lit(float("nan")))
    return points.join(far, "mesh_id").select("mesh_id", "v", *((F.col(a) / scale).alias(a) for a in AXES))


def bounding_diagonal(vertices: DataFrame) -> DataFrame:
    spans = _per_mesh(vertices, **{a: F.max(a) - F.min(a) for a in AXES})
    return spans.select("mesh_id", norm(*map(F.col, AXES)).alias("diagonal"))


def position_colors(vertices: DataFrame) -> DataFrame:
    """Axis values scaled to [0, 1] as red, green and blue; an axis of no extent counts as 1 wide."""
    spans = _per_mesh(vertices, **{f"lo{a}": F.min(a) for a in AXES}, **{f"hi{a}": F.max(a) for a in AXES})

    def scaled(a):
        width = F.col(f"hi{a}") - F.col(f"lo{a}")
        return (F.col(a) - F.col(f"lo{a}")) / F.when(width < 1e-8, 1.0).otherwise(width)

    return vertices.join(spans, "mesh_id").select("mesh_id", "v", *(scaled(a).alias(c) for a, c in zip(AXES, ("red", "green", "blue"))))


def rotated(vertices: DataFrame, rotation, shift=(0.0, 0.0, 0.0)) -> DataFrame:
    """(p + shift) times the transposed 3 x 3 ``rotation``."""
    moved = [F.col(a) + float(t) for a, t in zip(AXES, shift)]
    return vertices.select("mesh_id", "v", *(sum((m * float(r) for m, r in zip(moved[1:], row[1:])), moved[0] * float(row[0])).alias(a) for a, row in zip(AXES, rotation)))


def normal_to_z(normal: tuple[Column, Column, Column]) -> list[list[Column]]:
    """Rows x, y, z of the rotation that takes a unit normal to +Z."""
    zx, zy, zz = normal
    steep = F.abs(zx) > 0.9
    rx, ry = F.when(steep, 0.0).otherwise(1.0), F.when(steep, 1.0).otherwise(0.0)
    x = [ry * zz, -rx * zz, rx * zy - ry * zx]  # (rx, ry, 0) times z
    length = norm(*x)
    x = [c / length for c in x]
    y = [zy * x[2] - zz * x[1], zz * x[0] - zx * x[2], zx * x[1] - zy * x[0]]
    return [x, y, [zx, zy, zz]]


def rodrigues(rx: Column, ry: Column, rz: Column) -> list[list[Column]]:
    """The rotation matrix of an axis-angle vector."""
    angle = F.greatest(norm(rx, ry, rz), F.lit(1e-8))
    x, y, z = rx / angle, ry / angle, rz / angle
    c, s = F.cos(angle), F.sin(angle)
    d = 1 - c
    return [[c + x * x * d, x * y * d - z * s, x * z * d + y * s], [y * x * d + z * s, c + y * y * d, y * z * d - x * s], [z * x * d - y * s, z * y * d + x * s, c + z * z * d]]


def unit(parts: list[Column], default: tuple[float, ...] | None = None, eps: float = 0.0) -> list[Column]:
    """A vector over its length; where that is ``eps`` or less, ``default`` or the vector itself."""
    length = norm(*parts)
    return [F.when(length > eps, p / length).otherwise(p if default is None else F.lit(default[i])) for i, p in enumerate(parts)]


def patch_positions(patches: DataFrame) -> DataFrame:
    """Place of each row within its patch, from 0, in the order of ``rank``."""
    order = Window.partitionBy("mesh_id", "patch").orderBy("rank", "neighbor")
    return patches.withColumn("pos", F.row_number().over(order) - 1)


def extremes(vertices: DataFrame, axis: str, k: int) -> DataFrame:
    """The k lowest (fixed) and the k highest (handles) vertices of each mesh along an axis."""

    def ends(order, role):
        w = Window.partitionBy("mesh_id").orderBy(order, "v")
        return vertices.withColumn("i", F.row_number().over(w)).where(F.col("i") <= k).select("mesh_id", "v", F.lit(role).alias("role"))

    return ends(F.col(axis), "fixed").unionByName(ends(F.col(axis).desc(), "handle"))


def nearest_to_centroid(vertices: DataFrame) -> DataFrame:
    d = norm(*map(F.col, AXES))
    return centred(vertices).groupBy("mesh_id").agg(F.min_by("v", F.struct(d, F.col("v"))).alias("source"))
