"""Sparse operators as tables: ``coo(mesh_id, i, j, val)`` and ``mass(mesh_id, i, area)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Coefficients of a gradient by axis.
AXES = ("gx", "gy", "gz")
#: What a pair of vertices is: an entry of the product, an edge of the graph.
_ENTRY, _EDGE = 1, 2


def summed(*parts: DataFrame) -> DataFrame:
    """The sum of matrices: entries at one place add up."""
    return reduce(DataFrame.unionByName, (p.select("mesh_id", "i", "j", "val") for p in parts)).groupBy("mesh_id", "i", "j").agg(F.sum("val").alias("val"))


def transposed(coo: DataFrame) -> DataFrame:
    return coo.select("mesh_id", F.col("j").alias("i"), F.col("i").alias("j"), "val")


def with_zero_rows(off: DataFrame) -> DataFrame:
    """Add the diagonal that makes every row sum to zero."""
    diagonal = off.groupBy("mesh_id", "i").agg((-F.sum("val")).alias("val")).select("mesh_id", "i", F.col("i").alias("j"), "val")
    return off.unionByName(diagonal)


def stiffness(weights: DataFrame) -> DataFrame:
    """S of ``weights(mesh_id, center, neighbor, w)``: -w at (c, n) and (n, c), +w at (c, c) and (n, n), so the row sums vanish.

    All four entries come from one pass over the weights, and one aggregate adds them up.
    """
    c, n, w = F.col("center"), F.col("neighbor"), F.col("w")
    entries = F.array(*(F.struct(i.alias("i"), j.alias("j"), x.alias("val")) for i, j, x in ((c, n, -w), (n, c, -w), (c, c, w), (n, n, w))))
    return summed(weights.select("mesh_id", F.explode(entries).alias("e")).select("mesh_id", "e.i", "e.j", "e.val"))


def mass(areas: DataFrame, every: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Mean area of each centre in ``areas(mesh_id, center, area)``; a vertex without any has ``floor``."""
    mean = areas.groupBy("mesh_id", F.col("center").alias("i")).agg(F.avg("area").alias("area"))
    return every.select("mesh_id", F.col("v").alias("i")).join(mean, ["mesh_id", "i"], "left").select("mesh_id", "i", F.coalesce("area", F.lit(floor)).alias("area"))


def matvec(coo: DataFrame, field: DataFrame) -> DataFrame:
    """(mesh_id, v, val): the matrix times ``field(mesh_id, v, val)``."""
    x = field.select("mesh_id", F.col("v").alias("j"), F.col("val").alias("x"))
    return coo.join(x, ["mesh_id", "j"]).groupBy("mesh_id", F.col("i").alias("v")).agg(F.sum(F.col("val") * F.col("x")).alias("val"))


def _by_center(coefficients: DataFrame) -> DataFrame:
    """(mesh_id, i, j, gx, gy, gz): coefficients summed by place, dealt by centre, so that a centre's sums need no second shuffle."""
    dealt = coefficients.select("mesh_id", F.col("center").alias("i"), F.col("neighbor").alias("j"), "gx", "gy", "gz").repartition("mesh_id", "i")
    return dealt.groupBy("mesh_id", "i", "j").agg(*(F.sum(c).alias(c) for c in AXES))


def _own(placed: DataFrame) -> DataFrame:
    """The centre's row (i, i) that makes each axis sum to zero."""
    return placed.groupBy("mesh_id", "i").agg(*((-F.sum(c)).alias(c) for c in AXES)).select("mesh_id", "i", F.col("i").alias("j"), *AXES)


def gradient(coefficients: DataFrame) -> DataFrame:
    """G of ``coefficients(mesh_id, center, neighbor, gx, gy, gz)``: rows (i, d) with a centre entry that makes them sum to zero.

    Coefficients are shuffled once, a row for all three axes; both parts read that shuffle.
    """
    placed = _by_center(coefficients)
    axes = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.col(c).alias("val")) for d, c in enumerate(AXES)))).alias("e")
    long = lambda d: d.select("mesh_id", "i", "j", axes).select("mesh_id", "i", "e.d", "j", "e.val")
    return long(placed).unionByName(long(_own(placed)).where("val <> 0"))


def anisotropic(coefficients: DataFrame, areas: DataFrame) -> DataFrame:
    """Transposed G times the areas times G: each patch's Gram products over all axes, scattered by vertex pairs, dealt by row.

    A pair's sum needs one shuffle, by its row, and so do sums over a row.
    """
    placed = _by_center(coefficients)
    sums = [(-F.sum(c)).alias(f"s{c}") for c in AXES]
    area = areas.select("mesh_id", F.col("center").alias("i"), "area")
    scaled = placed.groupBy("mesh_id", "i").agg(*sums).join(area, ["mesh_id", "i"])
    own = scaled.select("mesh_id", "i", F.col("i").alias("a"), *(F.col(f"s{c}").alias(f"p{c}") for c in AXES), "area", *(F.col(f"s{c}") for c in AXES))
    near = placed.join(scaled, ["mesh_id", "i"]).select("mesh_id", "i", F.col("j").alias("a"), *(F.col(c).alias(f"p{c}") for c in AXES), "area", *(f"s{c}" for c in AXES))
    dot = lambda left, right: sum((F.coalesce(F.col(f"{left}{c}") * F.col(f"{right}{c}"), F.lit(0.0)) for c in AXES), F.lit(0.0))
    met = near.join(placed.select("mesh_id", "i", F.col("j").alias("b"), *(F.col(c).alias(f"q{c}") for c in AXES)), ["mesh_id", "i"])
    pairs = met.select("mesh_id", F.col("a").alias("i"), F.col("b").alias("j"), (F.col("area") * dot("p", "q")).alias("val"))
    # a neighbour with its centre goes both ways
    product = (F.col("area") * dot("p", "s")).alias("val")
    ways = F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("i").alias("j")), F.struct(F.col("i").alias("i"), F.col("a").alias("j")))).alias("e")
    cross = near.select("mesh_id", product, ways).select("mesh_id", "e.i", "e.j", "val")
    parts = pairs.unionByName(cross).unionByName(own.select("mesh_id", "i", F.col("a").alias("j"), product))
    return parts.repartition("mesh_id", "i").groupBy("mesh_id", "i", "j").agg(F.sum("val").alias("val"))


def one_hop(coo: DataFrame, graph: DataFrame) -> DataFrame:
    """Keep off-diagonal entries between neighbours of ``graph(mesh_id, center, neighbor)`` in either direction; rebuild the diagonal."""
    edges = graph.select("mesh_id", F.col("center").alias("i"), F.col("neighbor").alias("j"))
    both = edges.unionByName(edges.select("mesh_id", F.col("j").alias("i"), F.col("i").alias("j")))
    return with_zero_rows(coo.where("i <> j").join(both, ["mesh_id", "i", "j"], "left_semi"))


def anisotropic_one_hop(coefficients: DataFrame, areas: DataFrame) -> DataFrame:
    """``one_hop`` of ``anisotropic`` over the coefficients' own graph, without the products that it drops.

    Coefficients and areas are dealt by centre in one shuffle, and a centre's row holds its neighbours. The matrix is
    symmetric: a pair of vertices is shuffled once, with its lesser vertex first, and a centre's product with a
    neighbour marks the edge, so pairs need neither a second shuffle nor a join to be told apart.
    """
    none = F.lit(None).cast("double")
    near = coefficients.select("mesh_id", F.col("center").cast("long").alias("i"), F.col("neighbor").cast("long").alias("j"), *(F.col(c).cast("double").alias(c) for c in AXES), none.alias("area"), F.lit(0).alias("there"))
    own = areas.select("mesh_id", F.col("center").cast("long").alias("i"), F.lit(None).cast("long").alias("j"), *(none.alias(c) for c in AXES), F.col("area").cast("double").alias("area"), F.lit(_ENTRY).alias("there"))
    placed = near.unionByName(own).repartition("mesh_id", "i").groupBy("mesh_id", "i", "j").agg(*(F.sum(c).alias(c) for c in (*AXES, "area")), F.max("there").alias("there"))
    row = F.struct("j", *AXES)
    rows = placed.groupBy("mesh_id", "i").agg(*((-F.sum(c)).alias(f"s{c}") for c in AXES), F.sum("area").alias("area"), F.max("there").alias("there"), F.collect_list(F.when(F.col("j").isNotNull(), row)).alias("js"))
    centre = F.struct(F.col("i").alias("j"), *(F.col(f"s{c}").alias(c) for c in AXES))
    met = rows.select("mesh_id", "i", "area", "there", "js", centre.alias("own"), F.explode("js").alias("a"))
    met = met.select("mesh_id", "i", "area", "there", "a", F.posexplode(F.concat(F.array("own"), "js")).alias("at", "b"))
    # the first is the centre, whose product goes both ways; one without an area has edges and no entries
    edge = F.col("at") == 0
    met = met.where((edge & (F.col("a.j") != F.col("i"))) | (~edge & (F.col("there") == _ENTRY) & (F.col("a.j") < F.col("b.j"))))
    dot = sum((F.coalesce(F.col(f"a.{c}") * F.col(f"b.{c}"), F.lit(0.0)) for c in AXES), F.lit(0.0))
    pairs = met.select("mesh_id", F.least("a.j", "b.j").alias("lo"), F.greatest("a.j", "b.j").alias("hi"), (F.col("area") * dot).alias("val"), F.when(edge, F.col("there").bitwiseOR(F.lit(_EDGE))).otherwise(F.col("there")).alias("kind"))
    sums = pairs.repartition("mesh_id", "lo").groupBy("mesh_id", "lo", "hi").agg(F.sum("val").alias("val"), F.bit_or("kind").alias("kind"))
    ways = F.explode(F.array(F.struct(F.col("lo").alias("i"), F.col("hi").alias("j")), F.struct(F.col("hi").alias("i"), F.col("lo").alias("j")))).alias("e")
    both = sums.where(F.col("kind") == (_EDGE | _ENTRY)).select("mesh_id", "val", ways).select("mesh_id", "e.i", "e.j", "val").repartition("mesh_id", "i")
    # the diagonal comes from the same shuffle
    parts = F.explode(F.array(F.struct("j", "val"), F.struct(F.col("i").alias("j"), (-F.col("val")).alias("val")))).alias("e")
    return both.select("mesh_id", "i", parts).groupBy("mesh_id", "i", "e.j").agg(F.sum("e.val").alias("val"))


def sparsity(coo: DataFrame, every: DataFrame) -> DataFrame:
    """(mesh_id, nnz, rows, avg_row, max_row, min_row, density %) of the stored entries; ``every(mesh_id, v)`` names all rows, also those without entries."""
    row = coo.groupBy("mesh_id", F.col("i").alias("v")).agg(F.count("*").alias("n"))
    row = every.select("mesh_id", "v").join(row, ["mesh_id", "v"], "left").select("mesh_id", F.coalesce("n", F.lit(0)).alias("n"))
    out = row.groupBy("mesh_id").agg(F.sum("n").alias("nnz"), F.count("*").alias("rows"), F.avg("n").alias("avg_row"), F.max("n").alias("max_row"), F.min("n").alias("min_row"))
    return out.withColumn("density", 100.0 * F.col("nnz") / (F.col("rows").cast("double") * F.col("rows")))


def mean_curvature(stiff: DataFrame, masses: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mesh_id, v, h, nx, ny, nz) of the mass-inverse times S r; +Z where the vector vanishes."""
    from .points import norm, unit

    r = vertices.select("mesh_id", F.col("v").alias("j"), "x", "y", "z")
    sums = stiff.join(r, ["mesh_id", "j"]).groupBy("mesh_id", "i").agg(*(F.sum(F.col("val") * F.col(a)).alias(a) for a in "xyz"))
    scaled_ = sums.join(masses, ["mesh_id", "i"]).select("mesh_id", F.col("i").alias("v"), *((F.col(a) / F.col("area")).alias(a) for a in "xyz"))
    parts = [F.col(a) for a in "xyz"]
    return scaled_.select("mesh_id", "v", norm(*parts).alias("h"), *(u.alias(f"n{a}") for u, a in zip(unit(parts, (0.0, 0.0, 1.0), 1e-10), "xyz")))
