"""Patches: the neighbourhood of every centre as rows (mesh_id, patch, rank, neighbor, px, py, pz)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .points import norm, normal_to_z

KEYS = ["mesh_id", "patch"]
PARTS = ("px", "py", "pz")


def extract(near: DataFrame, vertices: DataFrame) -> DataFrame:
    """Positions of ``near(mesh_id, center, rank, neighbor)`` relative to their centre, with the neighbours' normals where vertices have any."""
    normals = [c for c in ("nx", "ny", "nz") if c in vertices.columns]
    at = vertices.select("mesh_id", "v", "x", "y", "z")
    if normals:
        near = near.join(vertices.select("mesh_id", F.col("v").alias("neighbor"), *normals), ["mesh_id", "neighbor"])
    ends = near.join(at.withColumnRenamed("v", "neighbor"), ["mesh_id", "neighbor"])
    own = at.select("mesh_id", F.col("v").alias("center"), *(F.col(a).alias(f"c{a}") for a in "xyz"))
    return ends.join(own, ["mesh_id", "center"]).select("mesh_id", F.col("center").alias("patch"), "rank", "neighbor", *((F.col(a) - F.col(f"c{a}")).alias(f"p{a}") for a in "xyz"), *normals)


def scaled(patches: DataFrame, features: list[str] = list(PARTS)) -> DataFrame:
    """``features`` over the patch's scale, its largest distance (1e-8 at least), and ``scale`` itself; areas are scaled back by its square."""
    far = patches.groupBy(*KEYS).agg(F.greatest(F.max(norm(*map(F.col, PARTS))), F.lit(1e-8)).alias("scale"))
    return patches.join(far, KEYS).withColumns({f: F.col(f) / F.col("scale") for f in features})


def xyz(rows: DataFrame) -> Column:
    return F.array(*PARTS)


#: Feature extractors by name: rows to an array column. Others are added by ``register_features``.
EXTRACTORS: dict[str, Callable[[DataFrame], Column]] = {"xyz": xyz}


def register_features(name: str, extractor: Callable[[DataFrame], Column]) -> None:
    EXTRACTORS[name] = extractor


def vectorized(function: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[DataFrame], Column]:
    """An extractor of a function of positions (n, 3) and normals (n, 3) to features (n, d), run on Arrow batches; rows without nx, ny and nz have zeros as normals."""

    @F.pandas_udf("array<double>")
    def run(px: pd.Series, py: pd.Series, pz: pd.Series, nx: pd.Series, ny: pd.Series, nz: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(function(np.stack([px, py, pz], 1), np.stack([nx, ny, nz], 1)), float)))

    return lambda rows: run(*map(F.col, PARTS), *((F.col(c) if c in rows.columns else F.lit(0.0)).cast("double") for c in ("nx", "ny", "nz")))


def with_features(patches: DataFrame, name: str = "xyz") -> DataFrame:
    """``features`` by a registered extractor; positions where it gives null."""
    return patches.withColumn("features", F.coalesce(EXTRACTORS[name](patches), F.array(*PARTS)))


def padded(patches: DataFrame, most: int) -> DataFrame:
    """(mesh_id, patch, size, tokens): the first ``most`` rows of each patch in rank order, as one bounded array."""
    order = Window.partitionBy(*KEYS).orderBy("rank", "neighbor")
    first = patches.withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") < most)
    tokens = F.sort_array(F.collect_list(F.struct("pos", "neighbor", *PARTS)))
    return first.groupBy(*KEYS).agg(F.count("*").alias("size"), tokens.alias("tokens"))


def mean_pooled(rows: DataFrame, value: str) -> DataFrame:
    """Mean of an array column over the real rows of each patch; ragged rows need no mask."""
    each = rows.select(*KEYS, F.posexplode(value).alias("d", "x")).groupBy(*KEYS, "d").agg(F.avg("x").alias("x"))
    return each.groupBy(*KEYS).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias(value))


def max_pooled(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.max(c).alias(c) for c in columns))


def mean_curvature_vectors(patches: DataFrame, areas: DataFrame, gradient: bool = False) -> DataFrame:
    """(mesh_id, patch, hx, hy, hz): the weighted sum of positions over the area.

    Weights are the column ``w``, or in gradient mode the products of each row's
    coefficients with minus the patch's sum of coefficients.
    """
    rows = patches
    if gradient:
        total = patches.groupBy(*KEYS).agg(*(F.sum(f"g{a}").alias(f"s{a}") for a in "xyz"))
        rows = patches.join(total, KEYS).withColumn("w", -(F.col("sx") * F.col("gx") + F.col("sy") * F.col("gy") + F.col("sz") * F.col("gz")))
    sums = rows.groupBy(*KEYS).agg(*(F.sum(F.col("w") * F.col(f"p{a}")).alias(a) for a in "xyz"))
    return sums.join(areas.select(*KEYS, "area"), KEYS).select(*KEYS, *((F.col(a) / F.col("area")).alias(f"h{a}") for a in "xyz"))


def random_patches(patches: DataFrame, count: int, seed: int) -> DataFrame:
    """All rows of ``count`` patches of each mesh, drawn by a hash of patch and seed; all of them where there are fewer."""
    order = Window.partitionBy("mesh_id").orderBy(F.xxhash64(F.lit(seed), "patch"), "patch")
    drawn = patches.select(*KEYS).distinct().withColumn("i", F.row_number().over(order)).where(F.col("i") <= count).select(*KEYS)
    return patches.join(drawn, KEYS, "left_semi")


def resized_weights(weights: DataFrame, k: int, k_train: int | None = None) -> DataFrame:
    """Weights (mesh_id, center, rank, neighbor, w) for another k: cut after k, or padded with the centre's mean weight.

    Padding rows have a null neighbour. ``k_train`` divides by the ratio of k to it.
    """
    whole, inside = Window.partitionBy("mesh_id", "center"), F.col("rank") <= k
    kinds = {c: weights.schema[c].dataType for c in ("rank", "neighbor")}
    # a filter right over the ranks would sort each input task's rows before the shuffle as well; counts of all of a centre's rows come first
    count = F.count(F.when(inside, 1))
    n, nth, mean = count.over(whole), count.over(whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.avg(F.when(inside, F.col("w"))).over(whole)
    cut = weights.select("mesh_id", "center", "rank", "neighbor", F.col("w").cast("double").alias("w"), n.cast("int").alias("n"), nth.alias("nth"), mean.alias("mean")).where(inside)
    own = F.array(F.struct("rank", "neighbor", "w"))
    missing = F.transform(F.sequence(F.col("n") + 1, F.lit(k)), lambda r: F.struct(r.cast(kinds["rank"]).alias("rank"), F.lit(None).cast(kinds["neighbor"]).alias("neighbor"), F.col("mean").alias("w")))
    rows = F.when((F.col("nth") == F.col("n")) & (F.col("n") < k), F.concat(own, missing)).otherwise(own)
    out = cut.select("mesh_id", "center", F.explode(rows).alias("row")).select("mesh_id", "center", "row.*")
    return out if k_train is None else out.withColumn("w", F.col("w") / (k / k_train))


# Pose transformers: rows of points and vectors to (shift, rotation) columns, applied one after another.

Pose = tuple[tuple[Column, Column, Column], list[list[Column]]]


def random_rotation(seed: int) -> Callable[[DataFrame], Pose]:
    """A uniform rotation for each patch, from four Gaussians drawn by mesh and patch (a unit quaternion)."""

    def pose(rows: DataFrame) -> Pose:
        from .surface_rows import _gaussian

        q = [_gaussian(seed, F.lit(i), *(F.col(k) for k in KEYS)) for i in range(4)]
        length = norm(*q)
        w, x, y, z = (c / length for c in q)
        turn = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
        return (F.lit(0.0), F.lit(0.0), F.lit(0.0)), turn

    return pose


def align_normal(rows: DataFrame) -> Pose:
    """The rotation that takes the normal (nx, ny, nz) to +Z."""
    n = [F.col(f"n{a}") for a in "xyz"]
    length = F.greatest(norm(*n), F.lit(1e-12))
    return (F.lit(0.0), F.lit(0.0), F.lit(0.0)), normal_to_z(tuple(c / length for c in n))


def axis_rotation(axis: str, angle: Column) -> list[list[Column]]:
    """The rotation about a coordinate axis."""
    c, s, o, z = F.cos(angle), F.sin(angle), F.lit(1.0), F.lit(0.0)
    return {"x": [[o, z, z], [z, c, -s], [z, s, c]], "y": [[c, z, s], [z, o, z], [-s, z, c]], "z": [[c, -s, z], [s, c, z], [z, z, o]]}[axis]


def swing(largest: float, t: Column) -> Column:
    """An angle or displacement that swings between its ends once as t goes from 0 to 1."""
    return largest * F.sin(2 * np.pi * t)


def axis_shift(axis: str, amount: Column) -> tuple[Column, Column, Column]:
    return tuple(amount if a == axis else F.lit(0.0) for a in "xyz")


TRANSFORMERS: dict[str, Callable] = {"random_rotation": random_rotation, "align_normal": lambda: align_normal}


def posed(rows: DataFrame, transformers: list[Callable[[DataFrame], Pose]], vectors: tuple[str, ...] = ("n",)) -> DataFrame:
    """Positions (px, py, pz) become (p + shift) R', and every named vector v R', by each transformer in turn."""
    for transformer in transformers:
        shift, turn = transformer(rows)
        keep = rows.columns
        rows = rows.withColumns({f"_r{i}{j}": turn[i][j] for i in range(3) for j in range(3)} | {f"_t{i}": shift[i] for i in range(3)})

        def turned(parts: list[Column]) -> list[Column]:
            return [sum((F.col(f"_r{i}{j}") * parts[j] for j in (1, 2)), F.col(f"_r{i}0") * parts[0]) for i in range(3)]

        new = dict(zip(PARTS, turned([F.col(c) + F.col(f"_t{i}") for i, c in enumerate(PARTS)])))
        for v in vectors:
            if f"{v}x" in keep:
                new |= dict(zip((f"{v}x", f"{v}y", f"{v}z"), turned([F.col(f"{v}{a}") for a in "xyz"])))
        rows = rows.withColumns(new).select(*keep)
    return rows
