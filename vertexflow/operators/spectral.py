"""Spectra and functional maps: ``eigval(mesh_id, m, lam)``, ``eigvec(mesh_id, v, m, phi)``, compared as joins and grouped sums."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import medians, pearson
from .neighbors import nearest


def _by_mode(one: DataFrame, two: DataFrame, keys: list[str], a: str, b: str, value: str) -> DataFrame:
    return one.withColumnRenamed(value, a).join(two.select(*keys, F.col(value).alias(b)), keys)


def cosines(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(mesh_id, m, similarity): |cosine| of equal modes; the sign of a mode doesn't count."""
    both = _by_mode(gt, pred, ["mesh_id", "m", "v"], "a", "b", "phi")
    sums = both.groupBy("mesh_id", "m").agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    return sums.select("mesh_id", "m", F.abs(F.col("ab") / ((F.sqrt("aa") + 1e-8) * (F.sqrt("bb") + 1e-8))).alias("similarity"))


def comparison(gt_values: DataFrame, pred_values: DataFrame, gt_vectors: DataFrame, pred_vectors: DataFrame) -> DataFrame:
    """A row a mesh: relative squared error without mode 0, gap ratio, correlation (over more than two modes), first ratio, similarities and spectral distance."""
    v = _by_mode(gt_values, pred_values, ["mesh_id", "m"], "gt", "pred", "lam")
    relative = (F.col("pred") - F.col("gt")) / (F.col("gt") + 1e-6)
    at = lambda c, m: F.max(F.when(F.col("m") == m, F.col(c)))
    values = v.groupBy("mesh_id").agg(
        F.avg(F.when(F.col("m") > 0, relative * relative)).alias("eigenvalue_rel_mse"), F.avg(relative * relative).alias("_all"),
        (F.coalesce(at("pred", 1) - at("pred", 0), F.lit(0.0)) / (F.coalesce(at("gt", 1) - at("gt", 0), F.lit(1.0)) + 1e-6)).alias("spectral_gap_ratio"),
        F.when(F.count("*") > 2, pearson("gt", "pred")).alias("eigenvalue_correlation"), (at("pred", 1) / (at("gt", 1) + 1e-6)).alias("lambda1_ratio"),
    )
    c = cosines(gt_vectors, pred_vectors).groupBy("mesh_id").agg(F.avg("similarity").alias("eigenvector_similarity_mean"), F.avg(F.when(F.col("m") > 0, F.col("similarity"))).alias("eigenvector_similarity_mean_skip0"))
    return values.join(c, "mesh_id").withColumn("spectral_distance", F.col("_all") + 1 - F.col("eigenvector_similarity_mean")).drop("_all")


def eigenvalue_report(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """A row a mesh: mean and largest absolute error, correlation, Fiedler value and gap of the prediction."""
    v = _by_mode(gt, pred, ["mesh_id", "m"], "gt", "pred", "lam")
    off = F.abs(F.col("pred") - F.col("gt"))
    at = lambda m: F.max(F.when(F.col("m") == m, F.col("pred")))
    return v.groupBy("mesh_id").agg(F.avg(off).alias("mae"), F.max(off).alias("max_error"), pearson("gt", "pred").alias("correlation"), at(1).alias("fiedler"), (at(1) - at(0)).alias("gap"))


def mode_products(one: DataFrame, two: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(mesh_id, i, j, n, a, b, aa, bb, ab): sums over vertices of all pairs of modes that both have a value.

    A vertex's modes meet as two arrays, so rows stay as many as vertices; a batch's products are
    matrices, and only they are added up. Without ``pairs(mesh_id, v, w)`` equal vertices meet.
    Bases are (mesh_id, v, m, phi) with one row a vertex and mode.
    """
    listed = lambda d, v, out: d.where("phi is not null").groupBy("mesh_id", F.col("v").alias(v)).agg(F.collect_list(F.struct(F.col("m").cast("int").alias("m"), F.col("phi").cast("double").alias("phi"))).alias(out))
    if pairs is None:
        met = listed(one, "v", "left").join(listed(two, "v", "right"), ["mesh_id", "v"])
    else:
        met = pairs.select("mesh_id", "v", "w").join(listed(one, "v", "left"), ["mesh_id", "v"]).join(listed(two, "w", "right"), ["mesh_id", "w"])
    kind = one.schema["mesh_id"].dataType

    def matrices(column: pa.ListArray, rows: np.ndarray):
        some = column.take(pa.array(rows))
        flat, sizes = some.flatten(), np.asarray(some.value_lengths())
        modes, place = np.unique(np.asarray(flat.field(0)), return_inverse=True)
        value, there = np.zeros((len(rows), len(modes))), np.zeros((len(rows), len(modes)))
        at = np.repeat(np.arange(len(rows)), sizes), place
        value[at], there[at] = np.asarray(flat.field(1)), 1
        return modes, value, there

    def run(batches):
        for batch in batches:
            keys = batch.column(0).dictionary_encode()
            codes = np.asarray(keys.indices)
            for code, key in enumerate(keys.dictionary):
                i, x, in_x = matrices(batch.column(1), np.flatnonzero(codes == code))
                j, y, in_y = matrices(batch.column(2), np.flatnonzero(codes == code))
                sums = [in_x.T @ in_y, x.T @ in_y, in_x.T @ y, (x * x).T @ in_y, in_x.T @ (y * y), x.T @ y]
                columns = [np.repeat(i, len(j)).astype(np.int32), np.tile(j, len(i)).astype(np.int32), *(s.ravel() for s in sums)]
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(columns[0]), batch.schema.field(0).type), *map(pa.array, columns)], ["mesh_id", "i", "j", *names])

    names = ["n", "a", "b", "aa", "bb", "ab"]
    parts = met.select("mesh_id", "left", "right").mapInArrow(run, f"mesh_id {kind.simpleString()}, i int, j int, " + ", ".join(f"{c} double" for c in names))
    return parts.groupBy("mesh_id", "i", "j").agg(*(F.sum(c).alias(c) for c in names))


def cross_correlation(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(mesh_id, i, j, r): |Pearson correlation| of every mode of one basis with every mode of the other; 0 for a constant mode."""
    n, a, b, aa, bb, ab = map(F.col, ("n", "a", "b", "aa", "bb", "ab"))
    spread = [F.greatest(n * q - s * s, F.lit(0.0)) for q, s in ((aa, a), (bb, b))]
    constant = (spread[0] <= 1e-14 * n * aa) | (spread[1] <= 1e-14 * n * bb)
    r = F.when(constant, 0.0).otherwise(F.abs(n * ab - a * b) / F.sqrt(spread[0] * spread[1]))
    return mode_products(gt, pred).select("mesh_id", "i", "j", F.least(r, F.lit(1.0)).alias("r"))


def best_matches(correlations: DataFrame) -> DataFrame:
    """(mesh_id, i, match, r): each mode's best counterpart, the smaller mode on ties."""
    best = F.max(F.struct("r", (-F.col("j")).alias("back"))).alias("best")
    return correlations.groupBy("mesh_id", "i").agg(best).select("mesh_id", "i", (-F.col("best.back")).alias("match"), F.col("best.r").alias("r"))


def diagonal_summary(correlations: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Mean, least and largest correlation of equal modes, and how many exceed the threshold."""
    return correlations.where("i = j").groupBy("mesh_id").agg(F.avg("r").alias("mean"), F.min("r").alias("least"), F.max("r").alias("largest"), F.count(F.when(F.col("r") > threshold, 1)).alias("high"))


def area_weighted_coefficients(vectors: DataFrame, masses: DataFrame, field: DataFrame) -> DataFrame:
    """(mesh_id, m, axis, c): the mass-weighted products of each mode with ``field(mesh_id, v, axis, val)``."""
    w = field.join(masses.select("mesh_id", F.col("i").alias("v"), "area"), ["mesh_id", "v"])
    return vectors.join(w, ["mesh_id", "v"]).groupBy("mesh_id", "m", "axis").agg(F.sum(F.col("phi") * F.col("area") * F.col("val")).alias("c"))


def reconstruction(vectors: DataFrame, coefficients: DataFrame) -> DataFrame:
    """(mesh_id, v, axis, m, val): the sum of modes up to m."""
    from pyspark.sql import Window

    w = Window.partitionBy("mesh_id", "v", "axis").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    terms = vectors.join(coefficients, ["mesh_id", "m"]).select("mesh_id", "v", "axis", "m", (F.col("phi") * F.col("c")).alias("t"))
    return terms.select("mesh_id", "v", "axis", "m", F.sum("t").over(w).alias("val"))


def least_squares_coefficients(vectors: DataFrame, field: DataFrame) -> DataFrame:
    """(mesh_id, upto, m, axis, c): for every number of modes the coefficients of the best fit, by the modes' products.

    The products are grouped sums; only the k x k system of a mesh goes to a worker, which
    solves it, or takes the pseudo-inverse where it is singular.
    """
    gram = mode_products(vectors, vectors).select("mesh_id", "i", "j", F.col("ab").alias("g"))
    sides = vectors.join(field, ["mesh_id", "v"]).groupBy("mesh_id", "m", "axis").agg(F.sum(F.col("phi") * F.col("val")).alias("s"))
    kind = vectors.schema["mesh_id"].dataType.simpleString()

    def solve(g: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        matrix = g.pivot(index="i", columns="j", values="g").sort_index().sort_index(axis=1)
        side = s.pivot(index="m", columns="axis", values="s").reindex(matrix.index).fillna(0.0)
        rows = []
        for n in range(1, len(matrix) + 1):
            a, b = matrix.to_numpy()[:n, :n], side.to_numpy()[:n]
            try:
                c = np.linalg.solve(a, b)
            except np.linalg.LinAlgError:
                c = np.linalg.pinv(a) @ b
            rows += [(g.mesh_id.iloc[0], int(matrix.index[n - 1]), int(matrix.index[i]), axis, c[i, x]) for i in range(n) for x, axis in enumerate(side.columns)]
        return pd.DataFrame(rows, columns=["mesh_id", "upto", "m", "axis", "c"])

    gram = gram.withColumnRenamed("mesh_id", "of").select(F.col("of"), "i", "j", "g", F.col("of").alias("mesh_id"))
    return gram.groupBy("of").cogroup(sides.groupBy("mesh_id")).applyInPandas(solve, f"mesh_id {kind}, upto int, m int, axis string, c double")


def reconstructed(vectors: DataFrame, field: DataFrame, masses: DataFrame | None = None) -> DataFrame:
    """(mesh_id, v, axis, m, val) from the first modes up to m: mass-weighted where masses are given, else by least squares."""
    if masses is not None:
        return reconstruction(vectors, area_weighted_coefficients(vectors, masses, field))
    c = least_squares_coefficients(vectors, field)
    return vectors.join(c, ["mesh_id", "m"]).groupBy("mesh_id", "v", "axis", F.col("upto").alias("m")).agg(F.sum(F.col("phi") * F.col("c")).alias("val"))


def projected(fmap: DataFrame, vectors: DataFrame) -> DataFrame:
    """(pair_id, v, p): each vertex's spectral coordinates carried by the map (pair_id, r, c, val), as an array in mode order."""
    x = vectors.select("pair_id", "v", F.col("m").alias("c"), "phi").join(fmap, ["pair_id", "c"]).groupBy("pair_id", "v", "r").agg(F.sum(F.col("val") * F.col("phi")).alias("x"))
    return coordinates(x.withColumnRenamed("r", "m").withColumnRenamed("x", "phi"))


def coordinates(vectors: DataFrame) -> DataFrame:
    """(pair_id, v, p): a vertex's modes as one array of bounded length."""
    return vectors.groupBy("pair_id", "v").agg(F.transform(F.sort_array(F.collect_list(F.struct("m", "phi"))), lambda s: s["phi"]).alias("p"))


def pointwise(fmap: DataFrame, vectors_a: DataFrame, vectors_b: DataFrame, k: int = 1) -> DataFrame:
    """(pair_id, va, rank, vb): the k vertices of B that are nearest to each vertex of A in B's spectral coordinates."""
    asks, points = projected(fmap, vectors_a), coordinates(vectors_b)
    near = nearest(asks.withColumnRenamed("pair_id", "mesh_id"), points.withColumnRenamed("pair_id", "mesh_id"), k, False)
    return near.select(F.col("mesh_id").alias("pair_id"), F.col("center").alias("va"), "rank", F.col("neighbor").alias("vb"))


def correspondence_metrics(matches: DataFrame, truth: DataFrame, vertices_b: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """A row a pair: accuracy, top-k shares, mean, median and largest Euclidean error, and both over B's bounding-box diagonal.

    ``matches(pair_id, va, rank, vb)``, ``truth(pair_id, va, gt)``, ``vertices_b(pair_id, v, x, y, z)``.
    """
    hits = matches.join(truth, ["pair_id", "va"])
    hit = F.col("vb") == F.col("gt")
    top = hits.groupBy("pair_id", "va").agg(F.max(F.when(hit & (F.col("rank") == 1), 1.0).otherwise(0.0)).alias("h1"), *(F.max(F.when(hit & (F.col("rank") <= k), 1.0).otherwise(0.0)).alias(f"h{k}") for k in ks))
    shares = top.groupBy("pair_id").agg(F.avg("h1").alias("accuracy"), *(F.avg(f"h{k}").alias(f"top{k}_acc") for k in ks))
    one, two = (vertices_b.select("pair_id", F.col("v").alias(n), *(F.col(a).alias(f"{p}{a}") for a in "xyz")) for n, p in (("vb", "p"), ("gt", "t")))
    off = hits.where("rank = 1").join(one, ["pair_id", "vb"]).join(two, ["pair_id", "gt"])
    d = F.sqrt(sum(((F.col(f"p{a}") - F.col(f"t{a}")) * (F.col(f"p{a}") - F.col(f"t{a}")) for a in "yz"), (F.col("px") - F.col("tx")) * (F.col("px") - F.col("tx"))))
    errors = off.select("pair_id", d.alias("d")).groupBy("pair_id").agg(F.avg("d").alias("mean_error"), F.median("d").alias("median_error"), F.max("d").alias("max_error"))
    spans = [F.max(a) - F.min(a) for a in "xyz"]
    box = vertices_b.groupBy("pair_id").agg(F.sqrt(sum((s * s for s in spans[1:]), spans[0] * spans[0])).alias("diagonal"))
    out = shares.join(errors, "pair_id").join(box, "pair_id")
    return out.withColumns({"mean_error_normalized": F.col("mean_error") / F.col("diagonal"), "median_error_normalized": F.col("median_error") / F.col("diagonal")})


def map_quality(fmap: DataFrame) -> DataFrame:
    """A row a pair of ``fmap(pair_id, r, c, val)``: distances of C'C, CC' and C from the identity, and the diagonal's share of the energy."""

    def distance(rows: DataFrame, p: str, q: str, x: str, name: str) -> DataFrame:
        off = F.col(x) - F.when(F.col(p) == F.col(q), 1.0).otherwise(0.0)
        return rows.groupBy("pair_id").agg(F.sqrt(F.sum(off * off)).alias(name))

    def gram(shared: str, kept: str, name: str) -> DataFrame:
        one, two = (fmap.select("pair_id", shared, F.col(kept).alias(n), F.col("val").alias(x)) for n, x in (("p", "x"), ("q", "y")))
        return distance(one.join(two, ["pair_id", shared]).groupBy("pair_id", "p", "q").agg(F.sum(F.col("x") * F.col("y")).alias("g")), "p", "q", "g", name)

    square = F.col("val") * F.col("val")
    ratio = fmap.groupBy("pair_id").agg((F.sum(F.when(F.col("r") == F.col("c"), square).otherwise(0.0)) / (F.sum(square) + 1e-10)).alias("diagonal_ratio"))
    return gram("r", "c", "orthogonality_error").join(gram("c", "r", "bijectivity_error"), "pair_id").join(distance(fmap, "r", "c", "val", "identity_error"), "pair_id").join(ratio, "pair_id")


def functional_maps(corr: DataFrame, vectors_a: DataFrame, vectors_b: DataFrame, masses_b: DataFrame) -> DataFrame:
    """``fmap(pair_id, r, c, val)`` of every pair at once: B's mass-weighted modes against A's, carried by ``corr(pair_id, va, vb)``."""
    weighted = vectors_b.join(masses_b, ["pair_id", "v"]).select(F.col("pair_id").alias("mesh_id"), "v", "m", (F.col("phi") * F.col("area")).alias("phi"))
    carried = corr.select(F.col("pair_id").alias("mesh_id"), F.col("va").alias("v"), F.col("vb").alias("w"))
    met = mode_products(vectors_a.withColumnRenamed("pair_id", "mesh_id"), weighted, carried)
    return met.select(F.col("mesh_id").alias("pair_id"), F.col("j").alias("r"), F.col("i").alias("c"), F.col("ab").alias("val"))


def dense_truth(corr: DataFrame, points_a: DataFrame) -> DataFrame:
    """(mesh_id, v, target) for every vertex of A: the last row of ``corr(mesh_id, ref, va, vb)`` that names it (largest ref), else its nearest named vertex's."""
    from .neighbors import fill_from_nearest

    known = corr.groupBy("mesh_id", F.col("va").alias("v")).agg(F.max_by("vb", "ref").alias("target"))
    return fill_from_nearest(known, points_a)


#: Eigenbasis providers by name: a function of (faces, vertices, k) to (eigval, eigvec, masses).
PROVIDERS: dict[str, Callable] = {}


def provider(name: str):
    def add(f):
        PROVIDERS[name] = f
        return f

    return add


@provider("mesh")
def mesh_basis(faces: DataFrame, vertices: DataFrame, k: int):
    from ..plans.kernels import eigenpairs
    from .topology import barycentric_mass, cotangent_laplacian

    masses = barycentric_mass(faces, vertices)
    both = eigenpairs(cotangent_laplacian(faces, vertices), masses, k)
    return both.select("mesh_id", "m", "lam").distinct(), both.select("mesh_id", "v", "m", "phi"), masses


@provider("points")
def point_basis(faces: DataFrame | None, vertices: DataFrame, k: int, neighbors: int = 12):
    """Heat-kernel weights over nearest neighbours, all masses equal."""
    from ..plans.kernels import eigenpairs
    from .neighbors import grid_knn
    from .sparse import stiffness

    near = grid_knn(vertices, neighbors)
    width = near.groupBy("mesh_id").agg(F.avg(F.col("dist") * F.col("dist")).alias("t"))
    w = near.join(width, "mesh_id").withColumn("w", F.exp(-F.col("dist") * F.col("dist") / F.greatest("t", F.lit(1e-12))))
    sizes = vertices.groupBy("mesh_id").agg((1.0 / F.count("*")).alias("area"))
    masses = vertices.select("mesh_id", F.col("v").alias("i")).join(sizes, "mesh_id")
    both = eigenpairs(stiffness(w), masses, k)
    return both.select("mesh_id", "m", "lam").distinct(), both.select("mesh_id", "v", "m", "phi"), masses


def _robust_basis(operators: tuple[DataFrame, DataFrame], k: int):
    from ..plans.kernels import eigenpairs

    both = eigenpairs(*operators, k)
    return both.select("mesh_id", "m", "lam").distinct(), both.select("mesh_id", "v", "m", "phi"), operators[1]


@provider("robust mesh")
def robust_mesh_basis(faces: DataFrame, vertices: DataFrame, k: int):
    """The ground truth of validations: mollified, tufted and flipped."""
    from .robust import mesh_operators

    return _robust_basis(mesh_operators(faces, vertices), k)


@provider("robust points")
def robust_point_basis(faces: DataFrame | None, vertices: DataFrame, k: int, neighbors: int = 30):
    from .robust import cloud_operators

    return _robust_basis(cloud_operators(vertices, neighbors), k)


def evaluated_pairs(corr: DataFrame, basis_a: tuple, basis_b: tuple, vertices_b: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """A row a pair: the quality of its functional map and of the pointwise map read off it."""
    to_pair = lambda d: d.withColumnRenamed("mesh_id", "pair_id")
    va, vb = to_pair(basis_a[1]), to_pair(basis_b[1])
    masses = to_pair(basis_b[2]).withColumnRenamed("i", "v")
    fmap = functional_maps(corr, va, vb, masses)
    return map_quality(fmap).join(correspondence_metrics(pointwise(fmap, va, vb, k), truth, to_pair(vertices_b)), "pair_id")


def experiment(results: dict[str, DataFrame], metric_columns: list[str]) -> DataFrame:
    """(method, metric, mean, median) over pairs, one long table of all methods; pivot it by method for a report."""
    parts = []
    for method, df in results.items():
        names = F.create_map(*(x for c in metric_columns for x in (F.lit(c), F.col(c).cast("double"))))
        parts.append(df.select(F.lit(method).alias("method"), F.explode(names).alias("metric", "value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    keys = ["method", "metric"]
    return out.groupBy(*keys).agg(F.avg("value").alias("mean")).join(medians(out, keys), keys, "left")


def epoch_summary(log: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and median of each column by epoch."""
    return log.groupBy("epoch").agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("median", F.median))))


def similarity(a: Column, b: Column) -> Column:
    """Cosine of two array columns, without sign; 0 where either is shorter than 1e-12."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    length = [F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)) for c in (a, b)]
    return F.when((length[0] < 1e-12) | (length[1] < 1e-12), 0.0).otherwise(F.abs(dot) / (length[0] * length[1]))
