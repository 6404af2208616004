"""Vertices moved so that a mesh's spectrum becomes a given one.

An eigenvalue's derivative is that of the energy of its own vector, so no automatic
differentiation is needed: on a face with hat functions' gradients b, area A and a vector's
gradient g, moving a corner changes A |g|^2 by A (|g|^2 b - 2 g (g . b)) and the area by A b.
The modes of a face add up to one symmetric matrix, so the gradient is a few grouped sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import kernels
from ..scratch import Scratch
from .geodesics import face_gradient
from .neighbors import nearest
from .topology import barycentric_mass, cotangent_laplacian, face_areas

AXES = "xyz"


def objective(faces: DataFrame, vertices: DataFrame, targets: DataFrame, modes: int, initial: DataFrame | None = None, alpha: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """((mesh_id, spectral, proximity, loss), (mesh_id, v, gx, gy, gz)) for ``targets(mesh_id, m, lam)``.

    The spectral loss is the mean squared difference of eigenvalues 1 to ``modes`` - 1; ``alpha`` adds that
    much of the chamfer distance to ``initial`` vertices. The gradient is that of the loss.
    """
    scratch = Scratch(vertices.sparkSession, "isospectral")
    pairs = scratch.put(kernels.eigenpairs(cotangent_laplacian(faces, vertices), barycentric_mass(faces, vertices), modes))
    values = pairs.select("mesh_id", "m", "lam").distinct().where("m > 0")
    off = values.join(targets.select("mesh_id", "m", F.col("lam").alias("want")), ["mesh_id", "m"])
    spectral = off.groupBy("mesh_id").agg(F.avg((F.col("lam") - F.col("want")) * (F.col("lam") - F.col("want"))).alias("spectral"), F.count("*").alias("n"))
    slope = off.join(spectral, "mesh_id").select("mesh_id", "m", "lam", (2 * (F.col("lam") - F.col("want")) / F.col("n")).alias("slope"))
    hats = face_gradient(faces, vertices).groupBy("mesh_id", "i", "j").agg(*(F.sum(F.when(F.col("d") == d, F.col("val"))).alias(f"b{a}") for d, a in enumerate(AXES)))
    met = hats.join(pairs.select("mesh_id", F.col("v").alias("j"), "m", "phi"), ["mesh_id", "j"])
    face = met.groupBy("mesh_id", "i", "m").agg(*(F.sum(F.col("phi") * F.col(f"b{a}")).alias(f"g{a}") for a in AXES), F.sum(F.col("phi") * F.col("phi")).alias("q"))
    face = face.join(slope, ["mesh_id", "m"]).join(face_areas(faces, vertices).select("mesh_id", F.col("f").alias("i"), "area"), ["mesh_id", "i"])
    square = sum(F.col(f"g{a}") * F.col(f"g{a}") for a in AXES)
    size = F.col("slope") * F.col("area")
    whole = F.sum(size * (square - F.col("lam") * F.col("q") / 3)).alias("whole")
    tensor = face.groupBy("mesh_id", "i").agg(whole, *(F.sum(-2 * size * F.col(f"g{a}") * F.col(f"g{b}")).alias(f"{a}{b}") for a in AXES for b in AXES if a <= b))
    at = hats.join(tensor, ["mesh_id", "i"])
    entry = lambda a: F.col("whole") * F.col(f"b{a}") + sum(F.col(min(a, b) + max(a, b)) * F.col(f"b{b}") for b in AXES)
    gradient = at.groupBy("mesh_id", F.col("j").alias("v")).agg(*(F.sum(entry(a)).alias(f"g{a}") for a in AXES))
    loss = spectral.select("mesh_id", "spectral", F.lit(0.0).alias("proximity"))
    if alpha:
        loss, pull = _proximity(vertices, initial, alpha)
        loss = spectral.select("mesh_id", "spectral").join(loss, "mesh_id")
        gradient = gradient.unionByName(pull).groupBy("mesh_id", "v").agg(*(F.sum(f"g{a}").alias(f"g{a}") for a in AXES))
    return loss.withColumn("loss", F.col("spectral") + alpha * F.col("proximity")), gradient


def _proximity(vertices: DataFrame, initial: DataFrame, alpha: float) -> tuple[DataFrame, DataFrame]:
    """((mesh_id, proximity), (mesh_id, v, gx, gy, gz)): the chamfer distance, and ``alpha`` times its gradient with the nearest points held."""
    p, q = (d.select("mesh_id", F.col("v").cast("long").alias("v"), F.array(*(F.col(a).cast("double") for a in AXES)).alias("p")) for d in (vertices, initial))
    out = None
    for asks, points, moved in ((p, q, "center"), (q, p, "neighbor")):
        near = nearest(asks, points, 1, False)
        place = lambda d, n: d.select("mesh_id", F.col("v").alias(n), F.col("p").alias(f"{n}_p"))
        near = near.join(place(asks, "center"), ["mesh_id", "center"]).join(place(points, "neighbor"), ["mesh_id", "neighbor"])
        count = asks.groupBy("mesh_id").agg(F.count("*").alias("n"))
        held = "neighbor" if moved == "center" else "center"
        one = near.join(count, "mesh_id").select("mesh_id", F.col(moved).alias("v"), (F.col("dist") * F.col("dist") / F.col("n")).alias("d"), *((2 * (F.col(f"{moved}_p")[i] - F.col(f"{held}_p")[i]) / F.col("n")).alias(f"g{a}") for i, a in enumerate(AXES)))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("mesh_id").agg(F.sum("d").alias("proximity")), out.groupBy("mesh_id", "v").agg(*((alpha * F.sum(f"g{a}")).alias(f"g{a}") for a in AXES))


def descended(faces: DataFrame, vertices: DataFrame, targets: DataFrame, modes: int, steps: int, rate: float = 1e-3, alpha: float = 0.0, clip: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """((mesh_id, v, x, y, z), (mesh_id, step, spectral, proximity, loss)) after ``steps`` of Adam; a mesh's gradient is cut to the length ``clip``."""
    scratch = Scratch(vertices.sparkSession, "descent")
    zeros = [F.lit(0.0).alias(f"{n}{a}") for n in "mu" for a in AXES]
    state, log = scratch.put(vertices.select("mesh_id", F.col("v").cast("long").alias("v"), *(F.col(a).cast("double").alias(a) for a in AXES), *zeros)), None
    first = state
    for step in range(1, steps + 1):
        loss, gradient = objective(faces, state, targets, modes, first, alpha)
        loss = scratch.put(loss.withColumn("step", F.lit(step)))
        log = loss if log is None else log.unionByName(loss)
        length = gradient.groupBy("mesh_id").agg(F.sqrt(F.sum(sum(F.col(f"g{a}") * F.col(f"g{a}") for a in AXES))).alias("length"))
        cut = gradient.join(length, "mesh_id").select("mesh_id", "v", *((F.col(f"g{a}") * F.least(F.lit(1.0), clip / (F.col("length") + 1e-6))).alias(f"g{a}") for a in AXES))
        met = state.join(cut, ["mesh_id", "v"], "left").fillna(0.0, [f"g{a}" for a in AXES])
        for a in AXES:
            met = met.withColumn(f"m{a}", 0.9 * F.col(f"m{a}") + 0.1 * F.col(f"g{a}")).withColumn(f"u{a}", 0.999 * F.col(f"u{a}") + 0.001 * F.col(f"g{a}") * F.col(f"g{a}"))
            met = met.withColumn(a, F.col(a) - rate * F.col(f"m{a}") / (1 - 0.9**step) / (F.sqrt(F.col(f"u{a}") / (1 - 0.999**step)) + 1e-8))
        old, state = state, scratch.put(met.select(state.columns))
        if old is not first:
            scratch.drop(old)
    return state.select("mesh_id", "v", *AXES), log.select("mesh_id", "step", "spectral", "proximity", "loss")
