"""Distances, Green's functions and deformations of meshes: per-mesh solves between relational operators and metrics.

Operators of a mesh reach its worker as one table of parts, (mesh_id, part, a, b, d, val):
stiffness entries (S), masses (M), gradient entries (G) with the area of their place (W) and
the sources (Q), so one grouped call holds what a solve needs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import exact, kernels
from ..scratch import Scratch
from .metrics import distance_metrics, finite, pearson
from .points import centred, norm
from .topology import face_areas, with_corners

def _part(df: DataFrame, part: str, a, b=None, d=None, val=None) -> DataFrame:
    none = F.lit(0).cast("long")
    return df.select("mesh_id", F.lit(part).alias("part"), F.col(a).cast("long").alias("a"), (F.col(b).cast("long") if b else none).alias("b"), (F.col(d).cast("long") if d else none).alias("d"), (F.col(val).cast("double") if val else F.lit(0.0)).alias("val"))


def _solved(parts: list[DataFrame], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("mesh_id").applyInPandas(run, f"mesh_id {rows.schema['mesh_id'].dataType.simpleString()}, {schema}")


def _matrices(frame: pd.DataFrame):
    of = {k: g for k, g in frame.groupby("part")}
    masses = of["M"].sort_values("a")
    ids = masses.a.to_numpy()
    s = of["S"]
    stiff = kernels.indexed(pd.DataFrame({"i": s.a, "j": s.b, "val": s.val}), ids)
    return of, ids, stiff, masses.val.to_numpy()


def heat_geodesics(stiff: DataFrame, masses: DataFrame, grad: DataFrame, weights: DataFrame, sources: DataFrame, t: str = "mass", signs: bool = False) -> DataFrame:
    """(mesh_id, source, v, dist) from ``sources(mesh_id, source)`` by heat flow.

    ``grad(mesh_id, i, d, j, val)`` with ``weights(mesh_id, i, area)`` of its places: vertices
    for a learned or point-cloud gradient, faces for a mesh. The time is the mean mass, or
    1.52 squared times the mean weight for ``t='face'``. ``signs`` picks the sign under which
    fewer values lie below the source's.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        of, ids, s, mass = _matrices(frame)
        w = of["W"].sort_values("a")
        places, g = pd.Index(w.a), of["G"]
        matrix = kernels.Sparse(places.get_indexer(g.a) * 3 + g.d.to_numpy(), pd.Index(ids).get_indexer(g.b), g.val.to_numpy(), (3 * len(w), len(ids)))
        area = w.val.to_numpy()
        time = 1.52**2 * area.mean() if t == "face" else mass.mean()
        out = []
        for q in of["Q"].a if "Q" in of else []:
            d = kernels.heat_distance(s, mass, matrix, area, int(np.searchsorted(ids, q)), time, signs)
            out.append(pd.DataFrame({"mesh_id": frame.mesh_id.iloc[0], "source": q, "v": ids, "dist": np.where(np.isfinite(d), d, np.nan)}))
        return pd.concat(out) if out else pd.DataFrame({"mesh_id": [], "source": [], "v": [], "dist": []})

    parts = [_part(stiff, "S", "i", "j", val="val"), _part(masses, "M", "i", val="area"), _part(grad, "G", "i", "j", "d", "val"), _part(weights, "W", "i", val="area"), _part(sources, "Q", "source")]
    return _solved(parts, run, "source long, v long, dist double")


def face_gradient(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """grad(mesh_id, i, d, j, val) of linear functions on faces i: normal times opposite edge over twice the area."""
    one, two = ([F.col(f"{a}{k}") - F.col(f"{a}0") for a in "xyz"] for k in (1, 2))
    cross = [one[1] * two[2] - one[2] * two[1], one[2] * two[0] - one[0] * two[2], one[0] * two[1] - one[1] * two[0]]
    placed = with_corners(faces, vertices).withColumns({f"c{a}": c for a, c in zip("xyz", cross)})
    square = F.greatest(F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy") + F.col("cz") * F.col("cz"), F.lit(1e-24))
    n = [F.col("cx"), F.col("cy"), F.col("cz")]
    entries = []
    for k in range(3):
        p, q = (k + 1) % 3, (k + 2) % 3
        e = [F.col(f"{a}{q}") - F.col(f"{a}{p}") for a in "xyz"]
        g = [n[1] * e[2] - n[2] * e[1], n[2] * e[0] - n[0] * e[2], n[0] * e[1] - n[1] * e[0]]
        entries += [F.struct(F.lit(d).alias("d"), F.col(f"v{k}").alias("j"), (c / square).alias("val")) for d, c in enumerate(g)]
    return placed.select("mesh_id", F.col("f").alias("i"), F.explode(F.array(*entries)).alias("e")).select("mesh_id", "i", "e.d", "e.j", "e.val")


def mesh_geodesics(faces: DataFrame, vertices: DataFrame, sources: DataFrame) -> DataFrame:
    """Heat distances on a mesh by its cotangent operators."""
    from .topology import barycentric_mass, cotangent_laplacian

    areas = face_areas(faces, vertices).select("mesh_id", F.col("f").alias("i"), "area")
    return heat_geodesics(cotangent_laplacian(faces, vertices), barycentric_mass(faces, vertices), face_gradient(faces, vertices), areas, sources, "face")


def learned_geodesics(stiff: DataFrame, masses: DataFrame, grad: DataFrame, sources: DataFrame) -> DataFrame:
    """Heat distances by a learned gradient, whose places are the vertices."""
    return heat_geodesics(stiff, masses, grad, masses, sources)


def tangent_gradient(tokens: DataFrame) -> DataFrame:
    """(mesh_id, center, neighbor, gx, gy, gz) of point clouds: the least-squares gradient in each patch's tangent plane.

    The plane is spanned by the two main directions of the patch; ``operators.patches.padded`` rows go through in Arrow batches.
    """
    kind = tokens.schema["mesh_id"].dataType.simpleString()

    def run(frames):
        for frame in frames:
            sizes = frame["size"].to_numpy()
            mask = np.arange(sizes.max(initial=0))[None] < sizes[:, None]
            p = np.zeros((*mask.shape, 3))
            p[mask] = [(t["px"], t["py"], t["pz"]) for row in frame.tokens for t in row]
            cov = np.einsum("bka,bkc->bac", p, p)
            value, vector = np.linalg.eigh(cov)
            inverse = np.where(value[:, 1:] > 1e-12 * value[:, 2:], 1 / np.maximum(value[:, 1:], 1e-300), 0.0)
            g = np.einsum("bkc,bcm,bm,bdm->bkd", p, vector[:, :, 1:], inverse, vector[:, :, 1:])[mask]
            yield pd.DataFrame({"mesh_id": np.repeat(frame.mesh_id.to_numpy(), sizes), "center": np.repeat(frame.patch.to_numpy(), sizes), "neighbor": [t["neighbor"] for row in frame.tokens for t in row], **{f"g{a}": g[:, i] for i, a in enumerate("xyz")}})

    return tokens.select("mesh_id", "patch", "size", "tokens").mapInPandas(run, f"mesh_id {kind}, center long, neighbor long, gx double, gy double, gz double")


def cloud_geodesics(stiff: DataFrame, masses: DataFrame, grad: DataFrame, sources: DataFrame) -> DataFrame:
    """Heat distances on a point cloud; the divergence's sign is the one that puts the source lowest."""
    return heat_geodesics(stiff, masses, grad, masses, sources, signs=True)


def edge_geodesics(faces: DataFrame, vertices: DataFrame, sources: DataFrame) -> DataFrame:
    """(mesh_id, source, v, dist) along mesh edges: an upper bound of exact distances; infinite where no path leads."""
    from .topology import edges

    at = lambda n: vertices.select("mesh_id", F.col("v").alias(n), *(F.col(a).alias(f"{n}{a}") for a in "xyz"))
    e = edges(faces).join(at("a"), ["mesh_id", "a"]).join(at("b"), ["mesh_id", "b"])
    e = e.withColumn("length", norm(*(F.col(f"a{a}") - F.col(f"b{a}") for a in "xyz")))
    weightless = vertices.select("mesh_id", "v")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        of = {k: g for k, g in frame.groupby("part")}
        ids = np.sort(of["M"].a.to_numpy())
        place, s = pd.Index(ids), of.get("S", frame.iloc[:0])
        i, j = place.get_indexer(s.a), place.get_indexer(s.b)
        out = [pd.DataFrame({"mesh_id": frame.mesh_id.iloc[0], "source": q, "v": ids, "dist": kernels.edge_distance(np.concatenate([i, j]), np.concatenate([j, i]), np.tile(s.val.to_numpy(), 2), len(ids), int(place.get_loc(q)))}) for q in (of["Q"].a if "Q" in of else [])]
        return pd.concat(out) if out else pd.DataFrame({"mesh_id": [], "source": [], "v": [], "dist": []})

    return _solved([_part(e, "S", "a", "b", val="length"), _part(weightless, "M", "v"), _part(sources, "Q", "source")], run, "source long, v long, dist double")


def exact_geodesics(faces: DataFrame, vertices: DataFrame, sources: DataFrame) -> DataFrame:
    """(mesh_id, source, v, dist) over the surface itself: the shortest paths across faces, infinite where none leads.

    A task has one mesh and one source; meshes may have boundaries and edges of several faces.
    """
    none = F.lit(None).cast("double")
    corner = faces.select("mesh_id", F.col("v0").cast("long").alias("a"), F.col("v1").cast("long").alias("b"), F.col("v2").cast("long").alias("c"), *(none.alias(n) for n in "xyz"))
    place = vertices.select("mesh_id", F.col("v").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("c"), *(F.col(n).cast("double").alias(n) for n in "xyz"))
    asked = sources.select("mesh_id", F.col("source").cast("long").alias("source")).distinct()
    kind = vertices.schema["mesh_id"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        v, f = frame[frame.b.isna()].sort_values("a"), frame[frame.b.notna()]
        ids = v.a.to_numpy()
        at = pd.Index(ids)
        source = int(frame.source.iloc[0])
        if source not in at:
            return pd.DataFrame({"mesh_id": [], "source": [], "v": [], "dist": []})
        surface = exact.Surface(v[["x", "y", "z"]].to_numpy(float), np.stack([at.get_indexer(f[c].astype(np.int64)) for c in "abc"], 1))
        return pd.DataFrame({"mesh_id": frame.mesh_id.iloc[0], "source": source, "v": ids, "dist": exact.distances(surface, int(at.get_loc(source)))})

    return corner.unionByName(place).join(asked, "mesh_id").groupBy("mesh_id", "source").applyInPandas(run, f"mesh_id {kind}, source long, v long, dist double")


def mesh_distances(faces: DataFrame, vertices: DataFrame, sources: DataFrame) -> DataFrame:
    """(mesh_id, source, v, dist, method): exact where a path leads, else by heat flow, else in a straight line."""
    return first_known(exact_geodesics(faces, vertices, sources), mesh_geodesics(faces, vertices, sources), euclidean(vertices, sources))


def first_known(*distances: DataFrame) -> DataFrame:
    """(mesh_id, source, v, dist, method): each vertex's distance by the first method, in order, that gives a finite one."""
    out = None
    for i, d in enumerate(distances):
        one = d.select("mesh_id", "source", "v", F.when(finite(F.col("dist")), F.col("dist")).alias(f"d{i}"))
        out = one if out is None else out.join(one, ["mesh_id", "source", "v"], "full")
    names = [f"d{i}" for i in range(len(distances))]
    method = F.coalesce(*(F.when(F.col(n).isNotNull(), i) for i, n in enumerate(names)))
    return out.select("mesh_id", "source", "v", F.coalesce(*names).alias("dist"), method.alias("method"))


def euclidean(vertices: DataFrame, sources: DataFrame) -> DataFrame:
    """(mesh_id, source, v, dist) in a straight line."""
    at = vertices.select("mesh_id", F.col("v").alias("source"), *(F.col(a).alias(f"s{a}") for a in "xyz"))
    from_ = sources.join(at, ["mesh_id", "source"])
    return vertices.join(from_, "mesh_id").select("mesh_id", "source", "v", norm(*(F.col(a) - F.col(f"s{a}") for a in "xyz")).alias("dist"))


def monotonicity(pairs: DataFrame, keys: list[str], samples: int = 5000, seed: int = 0) -> DataFrame:
    """(keys, monotonicity): share of drawn vertex pairs, without ties in ``b``, that ``a`` puts in the same order.

    ``pairs(keys, v, a, b)``, whose vertices are numbered in order of v. Pairs are drawn by a hash of group, draw and
    seed, ``samples`` or all n (n - 1) / 2 if fewer; 0 where that is 100 or less. A side has a row for each vertex of
    each group, so it is merged and never broadcast through the driver.
    """
    pairs = pairs.withColumn("v", F.row_number().over(Window.partitionBy(*keys).orderBy("v")) - 1)
    sizes = pairs.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("draws", F.least(F.lit(samples), F.floor(F.col("n") * (F.col("n") - 1) / 2)).cast("int"))
    draws = sizes.where("draws > 100").select(*keys, "n", F.explode(F.sequence(F.lit(1), F.col("draws"))).alias("i"))
    ends = [F.pmod(F.xxhash64(F.lit(seed), F.lit(s), *keys, "i"), F.col("n")).alias(s) for s in ("p", "q")]
    drawn = draws.select(*keys, *ends).where("p <> q")
    side = lambda n: pairs.select(*keys, F.col("v").alias(n), F.col("a").alias(f"a{n}"), F.col("b").alias(f"b{n}"))
    met = drawn.join(side("p").hint("merge"), [*keys, "p"]).join(side("q").hint("merge"), [*keys, "q"])
    for c in ("ap", "aq", "bp", "bq"):
        met = met.where(finite(F.col(c)))
    same = ((F.col("bp") > F.col("bq")) & (F.col("ap") > F.col("aq"))) | ((F.col("bq") > F.col("bp")) & (F.col("aq") > F.col("ap")))
    scored = met.where(F.abs(F.col("bp") - F.col("bq")) > 1e-8).groupBy(*keys).agg(F.avg(same.cast("double")).alias("monotonicity"))
    return sizes.select(*keys).join(scored, keys, "left").fillna({"monotonicity": 0.0})


def geodesic_metrics(computed: DataFrame, exact: DataFrame, samples: int = 5000, seed: int = 0) -> DataFrame:
    """(mesh_id, source, correlation, mean_error, max_error, monotonicity) of distances against exact ones.

    The joined distances are written once: each of the metrics reads them, and their solves are neither planned nor run again.
    They are merged: AQE would broadcast them, packed they are small, and the driver would hold them unpacked.
    """
    keys = ["mesh_id", "source"]
    both = computed.select(*keys, "v", F.col("dist").alias("a")).join(exact.select(*keys, "v", F.col("dist").alias("b")).hint("merge"), [*keys, "v"])
    both = Scratch(both.sparkSession, "distances").put(both)
    return distance_metrics(both, keys).join(monotonicity(both, keys, samples, seed), keys)


def multi_source(metrics: DataFrame, meshes: DataFrame) -> DataFrame:
    """A row a mesh: means over sources and the deviation of the correlation; 0, 0, 1, 1, 0 and no sources where all failed."""
    out = metrics.groupBy("mesh_id").agg(
        F.avg("correlation").alias("mean_correlation"), F.stddev_pop("correlation").alias("std_correlation"), F.avg("mean_error").alias("mean_mae"),
        F.avg("max_error").alias("mean_max_error"), F.avg("monotonicity").alias("mean_monotonicity"), F.count("*").alias("sources"),
    )
    empty = {"mean_correlation": 0.0, "std_correlation": 0.0, "mean_mae": 1.0, "mean_max_error": 1.0, "mean_monotonicity": 0.0, "sources": 0}
    return meshes.select("mesh_id").distinct().join(out, "mesh_id", "left").fillna(empty)


def compared(methods: dict[str, DataFrame], exact: DataFrame, samples: int = 5000, seed: int = 0) -> DataFrame:
    """Metrics of several methods against exact distances, one long table with a ``method`` column."""
    return reduce(DataFrame.unionByName, (geodesic_metrics(d, exact, samples, seed).withColumn("method", F.lit(m)) for m, d in methods.items()))


def farthest_sources(vertices: DataFrame, count: int) -> DataFrame:
    """(mesh_id, rank, source): farthest points, the first nearest to the centroid; a mesh's positions go to one worker."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("v")
        chosen = kernels.farthest_points(frame[["x", "y", "z"]].to_numpy(float), count)
        return pd.DataFrame({"mesh_id": frame.mesh_id.iloc[0], "rank": np.arange(len(chosen)), "source": frame.v.to_numpy()[chosen]})

    return vertices.select("mesh_id", "v", "x", "y", "z").groupBy("mesh_id").applyInPandas(run, f"mesh_id {vertices.schema['mesh_id'].dataType.simpleString()}, rank int, source long")


def drawn_sources(vertices: DataFrame, count: int, seed: int, centroid_first: bool = False) -> DataFrame:
    """(mesh_id, rank, source): vertices drawn by a hash, without repeats; the first is the one nearest to the centroid if asked."""
    order = [F.xxhash64(F.lit(seed), "mesh_id", "v"), F.col("v")]
    rows = vertices.select("mesh_id", "v")
    if centroid_first:
        middle = centred(vertices).groupBy("mesh_id").agg(F.min_by("v", F.struct(norm(*map(F.col, "xyz")), F.col("v"))).alias("first"))
        rows = rows.join(middle, "mesh_id")
        order = [(F.col("v") != F.col("first")).cast("int"), *order]
    rank = F.row_number().over(Window.partitionBy("mesh_id").orderBy(*order))
    return rows.withColumn("rank", rank - 1).where(F.col("rank") < count).select("mesh_id", F.col("rank").cast("int").alias("rank"), F.col("v").alias("source"))


def greens_functions(stiff: DataFrame, masses: DataFrame, sources: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(mesh_id, source, v, g, residual): Green's functions scaled to [0, 1], and the residual of the raw solution."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        of, ids, s, mass = _matrices(frame)
        out = []
        for q in of["Q"].a if "Q" in of else []:
            g, residual = kernels.greens_function(s, mass, int(np.searchsorted(ids, q)), eps)
            out.append(pd.DataFrame({"mesh_id": frame.mesh_id.iloc[0], "source": q, "v": ids, "g": g, "residual": residual}))
        return pd.concat(out) if out else pd.DataFrame({"mesh_id": [], "source": [], "v": [], "g": [], "residual": []})

    return _solved([_part(stiff, "S", "i", "j", val="val"), _part(masses, "M", "i", val="area"), _part(sources, "Q", "source")], run, "source long, v long, g double, residual double")


def maximum_principle(greens: DataFrame, distances: DataFrame, truth: DataFrame | None = None, samples: int = 5000, seed: int = 0) -> DataFrame:
    """A row for each (mesh_id, source): whether the maximum is at the source, violations above it, decay with distance, and agreement with ``truth``.

    Decay is the correlation with the distance and the share of drawn pairs whose nearer vertex has the larger value.
    """
    keys = ["mesh_id", "source"]
    rows = greens.select(*keys, "v", "g").join(distances.select(*keys, "v", F.col("dist").alias("d")), [*keys, "v"], "left")
    own = rows.where("v = source").select(*keys, F.col("g").alias("at_source"))
    rows = rows.join(own, keys)
    if truth is not None:
        rows = rows.join(truth.select(*keys, "v", F.col("g").alias("true")), [*keys, "v"], "left")
    else:
        rows = rows.withColumn("true", F.lit(None).cast("double"))
    usable = finite(F.col("d"))
    out = rows.groupBy(*keys).agg(
        F.min("g").alias("least"), F.max("g").alias("largest"), F.avg("g").alias("mean"), F.first("at_source").alias("at_source"),
        F.max_by("v", F.struct(F.col("g"), -F.col("v"))).alias("max_vertex"), F.min_by("v", F.struct("g", "v")).alias("min_vertex"),
        F.count(F.when(F.col("g") > F.col("at_source") + 1e-10, 1)).alias("violations"), F.max(F.col("g") - F.col("at_source")).alias("worst"),
        F.coalesce(F.try_divide(F.covar_pop(F.when(usable, F.col("g")), F.when(usable, F.col("d"))), F.stddev_pop(F.when(usable, F.col("g"))) * F.stddev_pop(F.when(usable, F.col("d")))), F.lit(0.0)).alias("distance_correlation"),
        F.when(F.count("true") > 0, pearson("g", "true")).alias("truth_correlation"),
    )
    order = monotonicity(rows.select(*keys, "v", (-F.col("g")).alias("a"), F.col("d").alias("b")), keys, samples, seed)
    return out.join(order, keys).withColumn("max_at_source", F.col("max_vertex") == F.col("source"))


def all_pass(checks: DataFrame) -> DataFrame:
    """(method, sources, passed, all_passed) of maximum-principle rows with a ``method`` column."""
    return checks.groupBy("method").agg(F.count("*").alias("sources"), F.count(F.when(F.col("max_at_source"), 1)).alias("passed"), F.bool_and("max_at_source").alias("all_passed"))


def scalar_gradient(grad: DataFrame, field: DataFrame) -> DataFrame:
    """(mesh_id, i, gx, gy, gz): the gradient of ``field(mesh_id, v, val)`` at each place of ``grad``."""
    x = field.select("mesh_id", F.col("v").alias("j"), F.col("val").alias("x"))
    sums = grad.join(x, ["mesh_id", "j"]).groupBy("mesh_id", "i").agg(*(F.sum(F.when(F.col("d") == d, F.col("val") * F.col("x")).otherwise(0.0)).alias(f"g{a}") for d, a in enumerate("xyz")))
    return sums


def vertex_gradient(faces: DataFrame, vertices: DataFrame, field: DataFrame) -> DataFrame:
    """(mesh_id, v, gx, gy, gz): face gradients averaged over a vertex's faces by area."""
    g = scalar_gradient(face_gradient(faces, vertices), field).withColumnRenamed("i", "f")
    m = face_areas(faces, vertices).join(g, ["mesh_id", "f"]).select("mesh_id", "area", "gx", "gy", "gz", F.explode(F.array("v0", "v1", "v2")).alias("v"))
    sums = m.groupBy("mesh_id", "v").agg(F.greatest(F.sum("area"), F.lit(1e-16)).alias("w"), *(F.sum(F.col("area") * F.col(f"g{a}")).alias(f"s{a}") for a in "xyz"))
    return sums.select("mesh_id", "v", *((F.col(f"s{a}") / F.col("w")).alias(f"g{a}") for a in "xyz"))


def fingerprints(stiff: DataFrame, masses: DataFrame, landmarks: DataFrame, scales: list[float]) -> DataFrame:
    """(mesh_id, v, descriptor): diffusion from each landmark (mesh_id, source) at each scale, of unit length."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        of, ids, s, mass = _matrices(frame)
        at = np.searchsorted(ids, np.sort(of["Q"].a.to_numpy())).tolist()
        return pd.DataFrame({"mesh_id": frame.mesh_id.iloc[0], "v": ids, "descriptor": list(kernels.fingerprints(s, mass, at, scales))})

    return _solved([_part(stiff, "S", "i", "j", val="val"), _part(masses, "M", "i", val="area"), _part(landmarks, "Q", "source")], run, "v long, descriptor array<double>")


def edge_weights(stiff: DataFrame) -> DataFrame:
    """(mesh_id, i, j, w): the directed edges of a Laplacian, weighted by minus its entries."""
    return stiff.where("i <> j and val <> 0").select("mesh_id", "i", "j", (-F.col("val")).alias("w"))


def edge_vectors(weights: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mesh_id, i, j, w, ex, ey, ez): p_i - p_j along every edge."""
    at = lambda n: vertices.select("mesh_id", F.col("v").alias(n), *(F.col(a).alias(f"{n}{a}") for a in "xyz"))
    return weights.join(at("i"), ["mesh_id", "i"]).join(at("j"), ["mesh_id", "j"]).select("mesh_id", "i", "j", "w", *((F.col(f"i{a}") - F.col(f"j{a}")).alias(f"e{a}") for a in "xyz"))


def arap_side(edges: DataFrame, turns: DataFrame) -> DataFrame:
    """(mesh_id, v, x, y, z): half the weighted sum of both ends' rotations (mesh_id, v, r00 .. r22) times each edge."""
    at = lambda n: turns.select("mesh_id", F.col("v").alias(n), *(F.col(f"r{i}{j}").alias(f"{n}{i}{j}") for i in range(3) for j in range(3)))
    rows = edges.join(at("i"), ["mesh_id", "i"]).join(at("j"), ["mesh_id", "j"])
    e = [F.col("ex"), F.col("ey"), F.col("ez")]
    parts = [sum(((F.col(f"i{a}{b}") + F.col(f"j{a}{b}")) * e[b] for b in (1, 2)), (F.col(f"i{a}0") + F.col(f"j{a}0")) * e[0]) for a in range(3)]
    return rows.groupBy("mesh_id", F.col("i").alias("v")).agg(*(F.sum(0.5 * F.col("w") * p).alias(n) for p, n in zip(parts, "xyz")))


def constraints(vertices: DataFrame, wanted: DataFrame, ratio: float = 0.1) -> DataFrame:
    """``wanted(mesh_id, v, ...)`` less vertices that a mesh doesn't have; a mesh left without any holds the first ``ratio`` of its vertices."""
    there = wanted.join(vertices.select("mesh_id", "v"), ["mesh_id", "v"], "left_semi")
    bare = vertices.join(there.select("mesh_id").distinct(), "mesh_id", "left_anti")
    sizes = bare.groupBy("mesh_id").agg(F.ceil(F.count("*") * ratio).alias("n"))
    return there.select("mesh_id", "v").unionByName(bare.join(sizes, "mesh_id").where("v < n").select("mesh_id", "v"))


def unknowns(vertices: DataFrame, fixed: DataFrame) -> DataFrame:
    """The vertices that a deformation solves for."""
    return vertices.join(fixed.select("mesh_id", "v"), ["mesh_id", "v"], "left_anti")


def deformed(vertices: DataFrame, weights: DataFrame, targets: DataFrame, rounds: int = 20, tol: float = 1e-6) -> DataFrame:
    """vertices(mesh_id, v, x, y, z) deformed as rigidly as possible so that ``targets(mesh_id, v, x, y, z)`` are met."""

    def xyz(df: DataFrame, part: str) -> DataFrame:
        long = df.select("mesh_id", "v", F.posexplode(F.array("x", "y", "z")).alias("d", "val"))
        return _part(long, part, "v", d="d", val="val")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        of = {k: g for k, g in frame.groupby("part")}
        p = of["P"].pivot(index="a", columns="d", values="val").sort_index()
        place, e = pd.Index(p.index), of["E"]
        held = of["T"].pivot(index="a", columns="d", values="val") if "T" in of else p.iloc[:0]
        new = kernels.arap(p.to_numpy(), place.get_indexer(e.a), place.get_indexer(e.b), e.val.to_numpy(), {int(place.get_loc(k)): v for k, v in zip(held.index, held.to_numpy())}, rounds, tol)
        return pd.DataFrame({"mesh_id": frame.mesh_id.iloc[0], "v": p.index, "x": new[:, 0], "y": new[:, 1], "z": new[:, 2]})

    parts = [xyz(vertices, "P"), _part(weights, "E", "i", "j", val="w"), xyz(targets, "T")]
    return _solved(parts, run, "v long, x double, y double, z double")


def validated(stiff: DataFrame, masses: DataFrame, grad: DataFrame | None, faces: DataFrame, vertices: DataFrame, count: int = 5, samples: int = 5000, seed: int = 0) -> DataFrame:
    """A row a mesh: distances of predicted operators (by the mesh's own face gradient without ``grad``) against exact ones, over farthest-point sources.

    A mesh whose solves fail has the values of no sources; other errors are raised.
    """
    sources = Scratch(vertices.sparkSession, "sources").put(farthest_sources(vertices, count).select("mesh_id", "source"))
    if grad is None:
        areas = face_areas(faces, vertices).select("mesh_id", F.col("f").alias("i"), "area")
        computed = heat_geodesics(stiff, masses, face_gradient(faces, vertices), areas, sources, "face")
    else:
        computed = learned_geodesics(stiff, masses, grad, sources)
    known = computed.where(finite(F.col("dist")))
    return multi_source(geodesic_metrics(known, exact_geodesics(faces, vertices, sources), samples, seed), vertices)


def mesh_diagnostics(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """A row a mesh: vertices, faces, edges by kind, components of its edges, boundary loops and Euler characteristic of what its faces use."""
    from . import graphs
    from .topology import corners, edges

    e = edges(faces)
    used = corners(faces).select("mesh_id", "v").distinct()
    counted = lambda d, name: d.groupBy("mesh_id").agg(F.count("*").alias(name))
    kinds = e.groupBy("mesh_id").agg(F.count("*").alias("edges"), *(F.count(F.when(F.col("kind") == k, 1)).alias(n) for k, n in (("boundary", "boundary_edges"), ("non-manifold", "non_manifold_edges"))))
    parts = graphs.component_sizes(graphs.components(e.select("mesh_id", "a", "b"), used))
    loops = graphs.component_sizes(graphs.boundary_loops(faces))
    out = counted(vertices, "vertices")
    for d in (counted(used, "used"), counted(faces, "faces"), kinds, counted(parts, "components"), counted(loops, "loops")):
        out = out.join(d, "mesh_id", "left")
    out = out.fillna(0)
    return out.withColumn("euler", F.col("used") - F.col("edges") + F.col("faces")).drop("used")


def greens_report(methods: dict[str, tuple[DataFrame, DataFrame]], faces: DataFrame, vertices: DataFrame, samples: int = 5000, seed: int = 0) -> DataFrame:
    """One long table of methods' Green's functions on the same meshes: the maximum-principle checks of each (greens, distances) by ``method``, with the mesh's diagnostics in every row."""
    rows = [maximum_principle(g, d, samples=samples, seed=seed).withColumn("method", F.lit(m)) for m, (g, d) in methods.items()]
    return reduce(DataFrame.unionByName, rows).join(mesh_diagnostics(faces, vertices), "mesh_id", "left")
