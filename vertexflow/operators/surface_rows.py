"""Families of polynomial surfaces as rows: ``surfaces(surface_id, terms array<struct<i, j, c>>, ox, oy)``.

Derivatives are made batch by batch with numpy, all else is columns over a row's own
derivatives, so a table of surfaces joined with a table of samplings is one pass.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..plans import intrinsic
from .points import norm, unit
from .surfaces import pairs

TERMS_TYPE = "array<struct<i:int,j:int,c:double>>"


def _seeded(seed: int, *keys) -> Column:
    """A uniform number in [0, 1) that depends on the keys alone, not on the order of rows."""
    h = F.xxhash64(F.lit(seed), *keys)
    return F.shiftrightunsigned(h, 11).cast("double") * 2.0**-53


def _gaussian(seed: int, *keys) -> Column:
    return F.sqrt(-2 * F.log(1 - _seeded(seed, F.lit("r"), *keys))) * F.cos(2 * math.pi * _seeded(seed, F.lit("a"), *keys))


def sampled_parameter(values: list[float], seed: int, *keys) -> Column:
    """The only value of a list of one, else uniform between its two ends."""
    return F.lit(float(values[0])) if len(values) == 1 else F.lit(float(values[0])) + float(values[1] - values[0]) * _seeded(seed, *keys)


def sampled_surfaces(spark: SparkSession, count: int, orders: tuple[int, int], scale: float, seed: int, kind: str = "uniform", offset: float = 0.0) -> DataFrame:
    """``count`` surfaces of an order in [lo, hi]; coefficients are uniform in [-scale, scale] or normal, each drawn by surface and exponents."""
    if kind not in ("uniform", "normal"):
        raise ValueError(f"unknown kind of coefficients: {kind}")
    order = F.floor(_seeded(seed, F.lit("order"), F.col("surface_id")) * (orders[1] - orders[0] + 1)) + orders[0]
    every = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs(orders[1])))

    def term(p):
        keys = (F.col("surface_id"), p["i"], p["j"])
        c = 2 * (_seeded(seed, *keys) - 0.5) * scale if kind == "uniform" else _gaussian(seed, *keys) * scale
        return F.struct(p["i"].alias("i"), p["j"].alias("j"), c.alias("c"))

    rows = spark.range(count).select(F.col("id").alias("surface_id")).withColumn("order", order)
    terms = F.transform(F.filter(every, lambda p: p["i"] + p["j"] <= F.col("order")), term)
    place = [((2 * _seeded(seed, F.lit(a), F.col("surface_id")) - 1) * offset).alias(a) for a in ("ox", "oy")]
    return rows.select("surface_id", terms.alias("terms"), *place)


def derivative(dx: int = 0, dy: int = 0, terms: str = "terms", x: str = "x", y: str = "y") -> Column:
    """A row's z, or its derivative, at (x + ox, y + oy)."""
    at_x, at_y = F.col(x) + F.coalesce(F.col("ox"), F.lit(0.0)), F.col(y) + F.coalesce(F.col("oy"), F.lit(0.0))

    def falling(p: Column, n: int) -> Column:
        out = F.lit(1.0)
        for k in range(n):
            out = out * (p - k)
        return out

    def add(total, t):
        value = t["c"] * falling(t["i"], dx) * falling(t["j"], dy) * F.pow(at_x, t["i"] - dx) * F.pow(at_y, t["j"] - dy)
        return total + F.when((t["i"] >= dx) & (t["j"] >= dy), value).otherwise(0.0)

    return F.aggregate(terms, F.lit(0.0), add)


#: The derivatives that the quantities need, by name.
_NEEDED = {"z": (0, 0), "zx": (1, 0), "zy": (0, 1), "zxx": (2, 0), "zxy": (1, 1), "zyy": (0, 2), "zxxx": (3, 0), "zxxy": (2, 1), "zxyy": (1, 2), "zyyy": (0, 3)}


#: The derivatives at the surface's origin that tell the sign of its mean curvature.
_AT_ORIGIN = {"ozx": (1, 0), "ozy": (0, 1), "ozxx": (2, 0), "ozxy": (1, 1), "ozyy": (0, 2)}


def with_derivatives(points: DataFrame, needed: dict[str, tuple[int, int]] = _NEEDED, at_origin: dict[str, tuple[int, int]] = {}) -> DataFrame:
    """``points`` with z and its derivatives at (x + ox, y + oy) by name, and those of ``at_origin`` at (ox, oy); the powers of a batch's places are made once for all of them."""
    names, given = [*needed, *at_origin], points.columns
    at = {c: given.index(c) for c in ("terms", "x", "y", "ox", "oy")}

    def run(batches):
        for batch in batches:
            col = {c: batch.column(i) for c, i in at.items()}
            shift = [np.nan_to_num(np.asarray(col[o].cast(pa.float64())), nan=0.0) for o in ("ox", "oy")]
            place = [s + np.asarray(col[c].cast(pa.float64())) for s, c in zip(shift, "xy")]
            flat = col["terms"].flatten()
            i, j, c = (np.asarray(flat.field(k)) for k in range(3))
            sizes = np.nan_to_num(np.asarray(col["terms"].value_lengths().cast(pa.float64())), nan=0.0).astype(int)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            out = []
            for where, wanted in ((place, needed), (shift, at_origin)):
                if not wanted:
                    continue
                px, py = (v[:, None] ** np.arange(max(int(e.max(initial=0)), 0) + 1) for v, e in zip(where, (i, j), strict=True))
                for dx, dy in wanted.values():
                    fine = np.flatnonzero((i >= dx) & (j >= dy))
                    value = c[fine] * px[row[fine], i[fine] - dx] * py[row[fine], j[fine] - dy]
                    for e, d in ((i[fine], dx), (j[fine], dy)):
                        for k in range(d):
                            value = value * (e - k)
                    out.append(pa.array(np.bincount(row[fine], value, batch.num_rows).astype(float)))  # counts of no terms are integers
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*given, *names])

    return points.mapInArrow(run, StructType([*points.schema.fields, *(StructField(n, DoubleType()) for n in names)]))


def differential(points: DataFrame, flip_normals: bool = False) -> DataFrame:
    """``points(surface_id, p, x, y, terms, ox, oy)`` with derivatives, normal, shape operator, curvatures, directions, their gradients and signature.

    k1 >= k2; at an umbilic the directions are the x and y axes. ``flip_normals`` turns the
    normals of surfaces whose mean curvature at the origin is negative.
    """
    d = with_derivatives(points, at_origin=_AT_ORIGIN if flip_normals else {})
    c = {n: F.col(n) for n in _NEEDED}
    w = 1 + c["zx"] * c["zx"] + c["zy"] * c["zy"]
    root = F.sqrt(w)
    d = d.withColumns({"w": w, "s11": ((1 + c["zy"] * c["zy"]) * c["zxx"] - c["zx"] * c["zy"] * c["zxy"]) / (w * root), "s12": ((1 + c["zy"] * c["zy"]) * c["zxy"] - c["zx"] * c["zy"] * c["zyy"]) / (w * root),
                       "s21": ((1 + c["zx"] * c["zx"]) * c["zxy"] - c["zx"] * c["zy"] * c["zxx"]) / (w * root), "s22": ((1 + c["zx"] * c["zx"]) * c["zyy"] - c["zx"] * c["zy"] * c["zxy"]) / (w * root)})
    s11, s12, s21, s22 = (F.col(f"s{i}") for i in (11, 12, 21, 22))
    h, k = (s11 + s22) / 2, s11 * s22 - s12 * s21
    d = d.withColumns({"H": h, "K": k}).withColumn("gap", F.sqrt(F.greatest(F.col("H") * F.col("H") - F.col("K"), F.lit(0.0))))
    d = d.withColumns({"k1": F.col("H") + F.col("gap"), "k2": F.col("H") - F.col("gap")})

    def direction(value: str, default: tuple[float, float]) -> list[Column]:
        one, two = (s12, F.col(value) - s11), (F.col(value) - s22, s21)
        long = norm(*one) >= norm(*two)
        v = [F.when(long, a).otherwise(b) for a, b in zip(one, two)]
        return unit(v, default, 1e-12)

    directions = {f"v{n}{a}": e for n, default in ((1, (1.0, 0.0)), (2, (0.0, 1.0))) for a, e in zip("xy", direction(f"k{n}", default))}
    d = d.withColumns(directions)

    wx = 2 * (c["zx"] * c["zxx"] + c["zy"] * c["zxy"])
    wy = 2 * (c["zx"] * c["zxy"] + c["zy"] * c["zyy"])
    a = (1 + c["zy"] * c["zy"]) * c["zxx"] - 2 * c["zx"] * c["zy"] * c["zxy"] + (1 + c["zx"] * c["zx"]) * c["zyy"]

    def along(xx, xy, yy, first, second):
        """The derivative of ``a`` by x or y: zx' = first, zy' = second, and the third derivatives in place."""
        cross = (first * c["zy"] + c["zx"] * second) * c["zxy"] + c["zx"] * c["zy"] * xy
        return 2 * c["zy"] * second * c["zxx"] + (1 + c["zy"] * c["zy"]) * xx - 2 * cross + 2 * c["zx"] * first * c["zyy"] + (1 + c["zx"] * c["zx"]) * yy

    ax, ay = along(c["zxxx"], c["zxxy"], c["zxyy"], c["zxx"], c["zxy"]), along(c["zxxy"], c["zxyy"], c["zyyy"], c["zxy"], c["zyy"])
    b = c["zxx"] * c["zyy"] - c["zxy"] * c["zxy"]
    bx = c["zxxx"] * c["zyy"] + c["zxx"] * c["zxyy"] - 2 * c["zxy"] * c["zxxy"]
    by = c["zxxy"] * c["zyy"] + c["zxx"] * c["zyyy"] - 2 * c["zxy"] * c["zxyy"]
    w_, r_ = F.col("w"), F.sqrt(F.col("w"))
    d = d.withColumns({"Hx": ax / (2 * w_ * r_) - 3 * a * wx / (4 * w_ * w_ * r_), "Hy": ay / (2 * w_ * r_) - 3 * a * wy / (4 * w_ * w_ * r_),
                       "Kx": bx / (w_ * w_) - 2 * b * wx / (w_ * w_ * w_), "Ky": by / (w_ * w_) - 2 * b * wy / (w_ * w_ * w_)})

    def lifted(u: str, v: str) -> list[Column]:
        return [F.col(u), F.col(v), c["zx"] * F.col(u) + c["zy"] * F.col(v)]

    d = d.withColumns({f"{name}_3{axis}": e for name, (u, v) in {"v1": ("v1x", "v1y"), "v2": ("v2x", "v2y"), "gH": ("Hx", "Hy"), "gK": ("Kx", "Ky")}.items() for axis, e in zip("xyz", lifted(u, v))})

    def slope(gradient: str, vector: str) -> Column:
        g, v = ([F.col(f"{n}_3{axis}") for axis in "xyz"] for n in (gradient, vector))
        return sum((p * q for p, q in zip(g[1:], v[1:])), g[0] * v[0]) / norm(*v)

    signature = F.array("H", "K", slope("gH", "v1"), slope("gH", "v2"), slope("gK", "v1"), slope("gK", "v2"))
    normal = [-c["zx"] / r_, -c["zy"] / r_, 1 / r_]
    d = d.withColumns({"signature": signature, **{f"n{axis}": e for axis, e in zip("xyz", normal)}})
    if not flip_normals:
        return d
    # each row holds its surface's terms, so the origin is a place more in its own row and needs no join
    zx, zy, zxx, zxy, zyy = map(F.col, _AT_ORIGIN)
    w0 = 1 + zx * zx + zy * zy
    t11, t22 = ((1 + zy * zy) * zxx - zx * zy * zxy) / (w0 * F.sqrt(w0)), ((1 + zx * zx) * zyy - zx * zy * zxy) / (w0 * F.sqrt(w0))
    return d.withColumns({f"n{axis}": F.when((t11 + t22) / 2 < 0, -F.col(f"n{axis}")).otherwise(F.col(f"n{axis}")) for axis in "xyz"}).drop(*_AT_ORIGIN)


def origin_rows(surfaces: DataFrame) -> DataFrame:
    """Every quantity of each surface at (0, 0)."""
    return differential(surfaces.select("surface_id", F.lit(-1).cast("long").alias("p"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "terms", "ox", "oy"))


def centred_at_origin(points: DataFrame, origins: DataFrame) -> DataFrame:
    """Points (surface_id, p, x, y, z) less their surface's origin; one without an origin row keeps its place."""
    at = origins.select("surface_id", *(F.col(a).alias(f"o{a}_") for a in "xyz"))
    moved = points.join(at, "surface_id", "left")
    return moved.withColumns({a: F.col(a) - F.coalesce(F.col(f"o{a}_"), F.lit(0.0)) for a in "xyz"}).drop(*(f"o{a}_" for a in "xyz"))


def with_origin(points: DataFrame, low: float, high: float, tolerance: float = 1e-6) -> DataFrame:
    """Samplings (surface_id, p, x, y) with an ``origin`` flag: the point at the origin, or a new one after the last; none where the range leaves 0 out."""
    if not low <= 0 <= high:
        return points.withColumn("origin", F.lit(False))
    square = F.col("x") * F.col("x") + F.col("y") * F.col("y")
    nearest = points.groupBy("surface_id").agg(F.min(F.struct(square.alias("d"), "p")).alias("least"), F.max("p").alias("last"))
    flagged = points.join(nearest, "surface_id").withColumn("origin", (F.col("least.d") < tolerance**2) & (F.col("p") == F.col("least.p"))).select(*points.columns, "origin")
    added = nearest.where(F.col("least.d") >= tolerance**2).select("surface_id", (F.col("last") + 1).alias("p"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(True).alias("origin"))
    return flagged.unionByName(added)


def regular_sampler(points: int):
    """A sampler of floor(sqrt(points))^2 places of a regular grid."""
    g = math.isqrt(points)

    def sample(surfaces: DataFrame, radius: float) -> DataFrame:
        step = 2 * radius / (g - 1) if g > 1 else 0.0
        rows = surfaces.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(g * g - 1).cast("long"))))
        return rows.withColumns({"x": F.floor(F.col("p") / g) * step - radius, "y": F.col("p") % g * step - radius})

    return sample


def random_sampler(least: int, most: int, seed: int):
    """A sampler of between ``least`` and ``most`` places, drawn by surface and point, so partitions don't matter."""
    if least < 3:
        raise ValueError("a sampling needs three points or more")

    def sample(surfaces: DataFrame, radius: float) -> DataFrame:
        n = F.floor(_seeded(seed, F.lit("n"), F.col("surface_id")) * (most - least + 1)) + least
        rows = surfaces.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
        return rows.withColumns({a: (2 * _seeded(seed, F.lit(a), F.col("surface_id"), F.col("p")) - 1) * radius for a in "xy"})

    return sample


SAMPLERS = {"regular": regular_sampler, "random": random_sampler}


def samplings(surfaces: DataFrame, samplers: list, radius: float) -> DataFrame:
    """Every surface under every sampler: (surface_id, sampler, p, x, y, terms, ox, oy), one projection each and no join."""
    parts = [s(surfaces, radius).withColumn("sampler", F.lit(i)) for i, s in enumerate(samplers)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rescaled(surfaces: DataFrame, scale: Column) -> DataFrame:
    """Surfaces scaled by a column about the origin; with 1 / sqrt(area) they have unit area."""
    return surfaces.withColumn("terms", F.transform("terms", lambda t: F.struct(t["i"].alias("i"), t["j"].alias("j"), (t["c"] * F.pow(scale, 1.0 - t["i"] - t["j"])).alias("c"))))


def areas(surfaces: DataFrame, points: int, radius: float) -> DataFrame:
    """(surface_id, area) by quadrature over the regular grid."""
    g = math.isqrt(points)
    step = 2 * radius / (g - 1)
    d = with_derivatives(regular_sampler(points)(surfaces, radius).select("surface_id", "terms", "x", "y", "ox", "oy"), {"zx": (1, 0), "zy": (0, 1)})
    return d.select("surface_id", norm(F.lit(1.0), F.col("zx"), F.col("zy")).alias("s")).groupBy("surface_id").agg((F.sum("s") * step * step).alias("area"))


def grid_faces(surfaces: DataFrame, side: int) -> DataFrame:
    """faces(surface_id, f, v0, v1, v2): the closed-form Delaunay split of a regular grid's cells."""
    cell = surfaces.select("surface_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((side - 1) ** 2 - 1).cast("long"))).alias("c"))
    a = F.floor(F.col("c") / (side - 1)) * side + F.col("c") % (side - 1)
    two = F.array(F.struct(F.lit(0).alias("k"), a.alias("v0"), (a + 1).alias("v1"), (a + side).alias("v2")), F.struct(F.lit(1).alias("k"), (a + 1).alias("v0"), (a + side + 1).alias("v1"), (a + side).alias("v2")))
    return cell.select("surface_id", "c", F.explode(two).alias("t")).select("surface_id", (F.col("c") * 2 + F.col("t.k")).alias("f"), "t.v0", "t.v1", "t.v2")


def triangulate(xy: np.ndarray) -> np.ndarray:
    """Delaunay triangles of plane points."""
    if len(xy) < 3:
        raise ValueError("a triangulation needs three points or more")
    return intrinsic.delaunay(xy)


def delaunay(points: DataFrame) -> DataFrame:
    """faces(surface_id, f, v0, v1, v2) of each surface's scattered points (surface_id, p, x, y), which one worker holds."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("p")
        f = frame.p.to_numpy()[triangulate(frame[["x", "y"]].to_numpy(float))]
        return pd.DataFrame({"surface_id": frame.surface_id.iloc[0], "f": np.arange(len(f)), "v0": f[:, 0], "v1": f[:, 1], "v2": f[:, 2]})

    return points.select("surface_id", "p", "x", "y").groupBy("surface_id").applyInPandas(run, f"surface_id {points.schema['surface_id'].dataType.simpleString()}, f long, v0 long, v1 long, v2 long")
