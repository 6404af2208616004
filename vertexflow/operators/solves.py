"""Spectra, heat distances and Green's functions of meshes that no worker has to hold.

The systems go through ``plans.dissection``: one factor a matrix, solved up and down a tree
of vertices. All that surrounds them, gradients, divergences, products, Gram matrices and
combinations, are joins and grouped sums, and what is kept for a mesh as a whole are
matrices of a few dozen columns. Vertices need coordinates; the operators may be of any
origin as long as they join near vertices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dissection import LEAF, Factor
from ..scratch import Scratch


def shifted(stiff: DataFrame, masses: DataFrame, by: DataFrame) -> DataFrame:
    """Per mesh ``s`` times the stiffness plus ``m`` times the masses plus ``c`` on the diagonal; ``by(mesh_id, s, m, c)``."""
    diagonal = masses.join(by, "mesh_id").select("mesh_id", "i", F.col("i").alias("j"), (F.col("m") * F.col("area") + F.col("c")).alias("val"))
    scaled = stiff.join(by, "mesh_id").select("mesh_id", "i", "j", (F.col("s") * F.col("val")).alias("val"))
    return scaled.unionByName(diagonal).groupBy("mesh_id", "i", "j").agg(F.sum("val").alias("val"))


def _numbered(sources: DataFrame) -> tuple[DataFrame, int]:
    """(mesh_id, source, c): a mesh's sources as columns, and the most columns of a mesh."""
    s = sources.select("mesh_id", F.col("source").cast("long").alias("source")).distinct()
    s = s.withColumn("c", F.row_number().over(Window.partitionBy("mesh_id").orderBy("source")) - 1)
    return s, int(s.agg(F.max("c")).first()[0] or 0) + 1


def _columns(df: DataFrame, value: str, width: int, out: str) -> DataFrame:
    """(mesh_id, v, ``out``) arrays of ``df(mesh_id, v, c, value)``, zeros where a column has no row."""
    sums = [F.coalesce(F.sum(F.when(F.col("c") == k, F.col(value))), F.lit(0.0)).alias(f"c{k}") for k in range(width)]
    return df.groupBy("mesh_id", "v").agg(*sums).select("mesh_id", "v", F.array(*(f"c{k}" for k in range(width))).alias(out))


def _long(x: DataFrame, value: str = "x") -> DataFrame:
    return x.select("mesh_id", "v", F.posexplode(value).alias("c", "val"))


def _diagonals(stiff: DataFrame, masses: DataFrame) -> DataFrame:
    """(mesh_id, stiff, mass): mean absolute diagonal of the stiffness and mean mass."""
    d = stiff.where("i = j").groupBy("mesh_id", "i").agg(F.sum("val").alias("val")).groupBy("mesh_id").agg(F.avg(F.abs("val")).alias("stiff"))
    return masses.groupBy("mesh_id").agg(F.avg("area").alias("mass")).join(d, "mesh_id")


def greens_functions(stiff: DataFrame, masses: DataFrame, vertices: DataFrame, sources: DataFrame, eps: float = 1e-6, leaf: int = LEAF) -> DataFrame:
    """(mesh_id, source, v, g, residual): solutions of (L + e M) g = delta less their weighted mean, scaled to [0, 1], and the largest relative residual of the raw ones."""
    of, width = _numbered(sources)
    by = _diagonals(stiff, masses).select("mesh_id", F.lit(1.0).alias("s"), (eps * F.greatest("stiff", F.lit(1e-4))).alias("m"), F.lit(0.0).alias("c"))
    factor = Factor(shifted(stiff, masses, by), vertices, leaf)
    delta = _columns(of.select("mesh_id", F.col("source").alias("v"), "c", F.lit(1.0).alias("one")), "one", width, "b")
    x = factor.solve(delta)
    left = factor.scratch.put(factor.residuals(x, delta))
    factor.close()
    g = _long(x).join(of, ["mesh_id", "c"])
    ends = g.groupBy("mesh_id", "c").agg(F.min("val").alias("least"), F.max("val").alias("most"))
    spread = F.col("most") - F.col("least")
    return g.join(ends, ["mesh_id", "c"]).join(left, "mesh_id").select("mesh_id", "source", "v", F.when(spread > 0, (F.col("val") - F.col("least")) / spread).otherwise(F.lit(0.0)).alias("g"), "residual")


def heat_geodesics(stiff: DataFrame, masses: DataFrame, grad: DataFrame, weights: DataFrame, vertices: DataFrame, sources: DataFrame, t: str = "mass", signs: bool = False, leaf: int = LEAF) -> DataFrame:
    """(mesh_id, source, v, dist, residual): distances by heat flow, as ``geodesics.heat_geodesics`` defines them, with the larger relative residual of the two solves."""
    of, width = _numbered(sources)
    time = weights.groupBy("mesh_id").agg((1.52**2 * F.avg("area")).alias("s")) if t == "face" else masses.groupBy("mesh_id").agg(F.avg("area").alias("s"))
    warm = Factor(shifted(stiff, masses, time.select("mesh_id", "s", F.lit(1.0).alias("m"), F.lit(0.0).alias("c"))), vertices, leaf)
    delta = _columns(of.select("mesh_id", F.col("source").alias("v"), "c", F.lit(1.0).alias("one")), "one", width, "b")
    u = warm.solve(delta)
    first = warm.scratch.put(warm.residuals(u, delta))
    warm.close()
    g = grad.select("mesh_id", "i", "d", "j", "val").withColumnRenamed("val", "of")
    flow = _long(u).withColumnRenamed("v", "j").join(g, ["mesh_id", "j"]).withColumn("x", F.col("of") * F.col("val"))
    flow = flow.groupBy("mesh_id", "i", "c").agg(*(F.sum(F.when(F.col("d") == d, F.col("x")).otherwise(0.0)).alias(f"g{d}") for d in range(3)))
    size = F.greatest(F.sqrt(sum(F.col(f"g{d}") * F.col(f"g{d}") for d in range(3))), F.lit(1e-10))
    flow = flow.join(weights.select("mesh_id", "i", "area"), ["mesh_id", "i"]).select("mesh_id", "i", "c", F.posexplode(F.array(*(-F.col("area") * F.col(f"g{d}") / size for d in range(3)))).alias("d", "flow"))
    spread = flow.join(g, ["mesh_id", "i", "d"]).select("mesh_id", F.col("j").alias("v"), "c", (F.col("flow") * F.col("of")).alias("b"))
    b = warm.scratch.put(_columns(spread, "b", width, "b"))
    flat = Factor(shifted(stiff, masses, masses.select("mesh_id").distinct().select("mesh_id", F.lit(1.0).alias("s"), F.lit(0.0).alias("m"), F.lit(1e-8).alias("c"))), vertices, leaf)
    phi = flat.solve(b)
    second = flat.residuals(phi, b).withColumnRenamed("residual", "other")
    left = flat.scratch.put(first.join(second, "mesh_id").select("mesh_id", F.greatest("residual", "other").alias("residual")))
    flat.close()
    p = _long(phi).join(of, ["mesh_id", "c"])
    if signs:
        at = p.where("v = source").select("mesh_id", "c", F.col("val").alias("own"))
        below = p.join(at, ["mesh_id", "c"]).groupBy("mesh_id", "c").agg(F.when(F.count(F.when(F.col("val") < F.col("own"), 1)) >= F.count(F.when(F.col("val") > F.col("own"), 1)), -1.0).otherwise(1.0).alias("sign"))
        p = p.join(below, ["mesh_id", "c"]).withColumn("val", F.col("val") * F.col("sign"))
    least = p.groupBy("mesh_id", "c").agg(F.min("val").alias("least"))
    return p.join(least, ["mesh_id", "c"]).join(left, "mesh_id").select("mesh_id", "source", "v", (F.col("val") - F.col("least")).alias("dist"), "residual")


def mesh_geodesics(faces: DataFrame, vertices: DataFrame, sources: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Heat distances on meshes by their cotangent operators."""
    from .geodesics import face_gradient
    from .topology import barycentric_mass, cotangent_laplacian, face_areas

    areas = face_areas(faces, vertices).select("mesh_id", F.col("f").alias("i"), "area")
    return heat_geodesics(cotangent_laplacian(faces, vertices), barycentric_mass(faces, vertices), face_gradient(faces, vertices), areas, vertices, sources, "face", leaf=leaf)


def eigenpairs(stiff: DataFrame, masses: DataFrame, vertices: DataFrame, k: int, tol: float = 1e-9, rounds: int = 40, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """((mesh_id, m, lam, residual), (mesh_id, v, m, phi)): the k smallest pairs of S v = l M v with their relative residuals.

    Inverse iteration on a subspace of more than k vectors, by a factor of S plus a little M
    that is made once. It gets on by how much the wanted values plus the shift differ from the
    others, so the shift falls with the square of a mesh's size, as the least values of a
    curve do; those of surfaces fall more slowly. A vertex's row holds its part of all vectors; Gram matrices are summed
    up from rows, and one small problem a mesh gives the combinations for the next round.
    Rounds end when no mesh's values move by ``tol`` of the k-th; an error is raised where
    they still do after ``rounds``.
    """
    width = k + max(8, k // 2)
    scratch = Scratch(stiff.sparkSession, "spectrum")
    kind = stiff.schema["mesh_id"].dataType.simpleString()
    sizes = masses.groupBy("mesh_id").agg(F.count("*").alias("n"))
    part = F.greatest(F.least(F.lit(1e-5), 1 / (F.col("n").cast("double") * F.col("n"))), F.lit(1e-12))
    d = scratch.put(_diagonals(stiff, masses).join(sizes, "mesh_id").select("mesh_id", (part * F.greatest(F.col("stiff") / F.col("mass"), F.lit(1e-12))).alias("shift")))
    factor = Factor(shifted(stiff, masses, d.select("mesh_id", F.lit(1.0).alias("s"), F.col("shift").alias("m"), F.lit(0.0).alias("c"))), vertices, leaf)
    start = F.array(F.lit(1.0), *(F.hash(F.lit(c), "i") / float(1 << 31) for c in range(1, width)))
    state = scratch.put(masses.join(d, "mesh_id").select("mesh_id", F.col("i").cast("long").alias("v"), "area", "shift", start.alias("x"), F.array().cast("array<double>").alias("sx")))
    theta = None
    for turn in range(rounds + 1):
        y = factor.solve(state.select("mesh_id", "v", F.transform("x", lambda x: x * F.col("area")).alias("b")), width)
        # S y is M x less the shift, by what y solves
        sy = F.zip_with("x", "y", lambda x, y: F.col("area") * (x - F.col("shift") * y))
        met = state.join(y.withColumnRenamed("x", "y"), ["mesh_id", "v"]).select("mesh_id", "v", "area", "shift", "y", sy.alias("sy"))
        last, theta = theta, scratch.put(met.mapInPandas(_grams, f"mesh_id {kind}, m array<double>, s array<double>").groupBy("mesh_id").applyInPandas(_ritz(width), f"mesh_id {kind}, theta array<double>, turn array<double>"))
        old, state = state, scratch.put(met.join(theta, "mesh_id").mapInPandas(_turned(width), f"mesh_id {kind}, v long, area double, shift double, x array<double>, sx array<double>"))
        scratch.drop(old)
        factor.scratch.drop(y)
        if last is not None:
            both = theta.join(last.select("mesh_id", F.col("theta").alias("was")), "mesh_id")
            moves = F.slice(F.zip_with("theta", "was", lambda a, b: F.abs(a - b)), 1, k)
            if both.where(F.array_max(moves) > tol * F.greatest(F.array_max(F.slice("theta", 1, k)), F.lit(1e-12))).isEmpty():
                break
    else:
        raise ValueError(f"spectra still move after {rounds} rounds")
    factor.close()
    values = theta.join(sizes, "mesh_id").select("mesh_id", "n", F.posexplode("theta").alias("m", "lam")).where((F.col("m") < k) & (F.col("m") < F.col("n"))).drop("n")
    parts = state.join(theta.select("mesh_id", "theta"), "mesh_id").select("mesh_id", "area", F.posexplode(F.arrays_zip("x", "sx", "theta")).alias("m", "e")).where(F.col("m") < k)
    off = F.col("e.sx") - F.col("e.theta") * F.col("area") * F.col("e.x")
    # in the norm of the inverse masses, where the size of M v is 1; relative to the shifted value
    left = parts.groupBy("mesh_id", "m").agg(F.sqrt(F.sum(off * off / F.col("area"))).alias("off"), F.max("e.theta").alias("value")).join(d, "mesh_id")
    left = left.select("mesh_id", "m", (F.col("off") / (F.abs("value") + F.col("shift"))).alias("residual"))
    vectors = state.select("mesh_id", "v", F.posexplode("x").alias("m", "phi")).join(values.select("mesh_id", "m"), ["mesh_id", "m"]).select("mesh_id", "v", "m", "phi")
    return values.join(left, ["mesh_id", "m"]), vectors


def _grams(frames):
    for f in frames:
        for mesh, g in f.groupby("mesh_id"):
            y, sy = np.stack(g.y.to_list()), np.stack(g.sy.to_list())
            yield pd.DataFrame({"mesh_id": [mesh], "m": [(y.T @ (g.area.to_numpy()[:, None] * y)).ravel()], "s": [(y.T @ sy).ravel()]})


def _ritz(width: int):
    """The best combinations of a mesh's vectors; a mesh with fewer vertices has zeros behind."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        m, s = (np.sum([np.asarray(a) for a in f[c]], axis=0).reshape(width, width) for c in "ms")
        scale = 1 / np.sqrt(np.maximum(np.diag(m), 1e-300))
        value, vector = np.linalg.eigh(scale[:, None] * (m + m.T) / 2 * scale)
        fine = value > value.max() * 1e-12
        basis = scale[:, None] * vector[:, fine] / np.sqrt(value[fine])
        theta, q = np.linalg.eigh(basis.T @ (s + s.T) / 2 @ basis)
        turn, short = basis @ q, width - len(theta)
        return pd.DataFrame({"mesh_id": f.mesh_id.iloc[:1], "theta": [np.pad(theta, (0, short))], "turn": [np.pad(turn, ((0, 0), (0, short))).ravel()]})

    return run


def _turned(width: int):
    def run(frames):
        for f in frames:
            for _, g in f.groupby("mesh_id"):
                c = np.asarray(g.turn.iloc[0]).reshape(width, width)
                yield g[["mesh_id", "v", "area", "shift"]].assign(x=list(np.stack(g.y.to_list()) @ c), sx=list(np.stack(g.sy.to_list()) @ c))

    return run


def deformed(vertices: DataFrame, weights: DataFrame, targets: DataFrame, rounds: int = 20, tol: float = 1e-6, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """((mesh_id, v, x, y, z), (mesh_id, round, step, change)): vertices as rigid as possible while ``targets(mesh_id, v, x, y, z)`` are met, and how far each round moved them.

    ``weights(mesh_id, i, j, w)`` holds both directions of each edge. The reduced system of the
    free vertices is factored once for all rounds and all three coordinates; a round sums up
    each vertex's covariances, takes their rotations batch by batch and solves. A mesh stays as
    it is once two rounds' steps differ by less than ``tol``.
    """
    scratch = Scratch(vertices.sparkSession, "deformed")
    kind = vertices.schema["mesh_id"].dataType.simpleString()
    rest = scratch.put(vertices.select("mesh_id", F.col("v").cast("long").alias("v"), *(F.col(a).cast("double").alias(a) for a in "xyz")))
    held = scratch.put(targets.select("mesh_id", F.col("v").cast("long").alias("v"), *(F.col(a).cast("double").alias(f"t{a}") for a in "xyz")))
    at = lambda d, n, p: d.select("mesh_id", F.col("v").alias(n), *(F.col(a).alias(f"{p}{a}") for a in "xyz"))
    edges = weights.select("mesh_id", "i", "j", "w").join(at(rest, "i", "a"), ["mesh_id", "i"]).join(at(rest, "j", "b"), ["mesh_id", "j"])
    edges = scratch.put(edges.select("mesh_id", "i", "j", "w", *((F.col(f"a{a}") - F.col(f"b{a}")).alias(f"e{a}") for a in "xyz")))
    free = scratch.put(rest.join(held, ["mesh_id", "v"], "left_anti"))
    ids = lambda n: free.select("mesh_id", F.col("v").alias(n))
    inner = edges.join(ids("i"), ["mesh_id", "i"], "left_semi")
    diagonal = inner.groupBy("mesh_id", "i").agg(F.sum("w").alias("val")).select("mesh_id", "i", F.col("i").alias("j"), "val")
    off = inner.join(ids("j"), ["mesh_id", "j"], "left_semi").select("mesh_id", "i", "j", (-F.col("w")).alias("val"))
    factor = Factor(off.unionByName(diagonal).groupBy("mesh_id", "i", "j").agg(F.sum("val").alias("val")), free, leaf)
    pull = inner.join(held.withColumnRenamed("v", "j"), ["mesh_id", "j"]).select("mesh_id", F.col("i").alias("v"), *((F.col("w") * F.col(f"t{a}")).alias(f"s{a}") for a in "xyz"))
    pull = scratch.put(pull)
    p = rest.join(held, ["mesh_id", "v"], "left").select("mesh_id", "v", *(F.coalesce(f"t{a}", a).alias(a) for a in "xyz"))
    p, log, last = scratch.put(p), None, None
    for turn in range(rounds):
        both = edges.join(at(p, "i", "p"), ["mesh_id", "i"]).join(at(p, "j", "q"), ["mesh_id", "j"])
        sums = [F.sum(F.col("w") * F.col(f"e{a}") * (F.col(f"p{b}") - F.col(f"q{b}"))).alias(f"c{a}{b}") for a in "xyz" for b in "xyz"]
        turns = both.groupBy("mesh_id", F.col("i").alias("v")).agg(*sums).mapInPandas(_rotations, f"mesh_id {kind}, v long, r array<double>")
        turned = lambda n, c: turns.select("mesh_id", F.col("v").alias(n), F.col("r").alias(c))  # noqa: E731, B023
        met = edges.join(ids("i"), ["mesh_id", "i"], "left_semi").join(turned("i", "ri"), ["mesh_id", "i"]).join(turned("j", "rj"), ["mesh_id", "j"])
        side = [(0.5 * F.col("w") * sum((F.col("ri")[3 * a + b] + F.col("rj")[3 * a + b]) * F.col(f"e{c}") for b, c in enumerate("xyz"))).alias(f"s{n}") for a, n in enumerate("xyz")]
        rhs = met.select("mesh_id", F.col("i").alias("v"), *side).unionByName(pull).groupBy("mesh_id", "v").agg(F.array(*(F.sum(f"s{a}") for a in "xyz")).alias("b"))
        x = factor.solve(rhs, 3)
        new = p.join(x.withColumnRenamed("x", "new"), ["mesh_id", "v"], "left")
        moved = new.where("new is not null").groupBy("mesh_id").agg(F.sqrt(F.sum(sum((F.col("new")[i] - F.col(a)) * (F.col("new")[i] - F.col(a)) for i, a in enumerate("xyz")))).alias("step"))
        if last is None:
            state = moved.select("mesh_id", "step", F.lit(float("inf")).alias("change"), F.lit(False).alias("rested"))
        else:
            was = last.select("mesh_id", F.col("step").alias("before"), (F.col("rested") | (F.col("change") < tol)).alias("rested"))
            state = moved.join(was, "mesh_id").select("mesh_id", "step", F.abs(F.col("step") - F.col("before")).alias("change"), "rested")
        last = scratch.put(state)
        go = last.where("not rested").select("mesh_id", F.lit(True).alias("go"))
        old, p = p, scratch.put(new.join(go, "mesh_id", "left").select("mesh_id", "v", *(F.when(F.col("go") & F.col("new").isNotNull(), F.col("new")[i]).otherwise(F.col(a)).alias(a) for i, a in enumerate("xyz"))))
        scratch.drop(old)
        factor.scratch.drop(x)
        one = last.where("not rested").select("mesh_id", F.lit(turn + 1).alias("round"), "step", "change")
        log = one if log is None else log.unionByName(one)
        if last.where(~F.col("rested") & (F.col("change") >= tol)).isEmpty():
            break
    factor.close()
    return p, log


def _rotations(frames):
    from ..plans.kernels import rotations

    for f in frames:
        c = f[[f"c{a}{b}" for a in "xyz" for b in "xyz"]].to_numpy(float).reshape(-1, 3, 3)
        yield pd.DataFrame({"mesh_id": f.mesh_id, "v": f.v, "r": list(rotations(c).reshape(-1, 9))})
