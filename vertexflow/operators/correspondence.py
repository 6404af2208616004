"""Correspondences: ``corr(pair_id, ref, va, vb)``, template maps ``vts(ref, v)`` and bridges ``(ref_src, ref_dst)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_template(a: DataFrame, b: DataFrame) -> DataFrame:
    """Vertices of two poses that the template gives one reference id."""
    return a.select("ref", F.col("v").alias("va")).join(b.select("ref", F.col("v").alias("vb")), "ref")


def by_bridge(a: DataFrame, bridge: DataFrame, b: DataFrame) -> DataFrame:
    source = a.select(F.col("ref").alias("ref_src"), F.col("v").alias("va"))
    target = b.select(F.col("ref").alias("ref_dst"), F.col("v").alias("vb"))
    return source.join(bridge, "ref_src").join(target, "ref_dst").select(F.col("ref_src").alias("ref"), "va", "vb")


def inverted(bridge: DataFrame) -> DataFrame:
    """Many-to-one maps turned round: the last source wins."""
    return bridge.groupBy("ref_dst").agg(F.max("ref_src").alias("source")).select(F.col("ref_dst").alias("ref_src"), F.col("source").alias("ref_dst"))


def two_hops(first: DataFrame, second: DataFrame) -> DataFrame:
    """Source references through a hub; null where either hop is undefined."""
    hop = second.select(F.col("ref_src").alias("hub"), F.col("ref_dst"))
    return first.select("ref_src", F.col("ref_dst").alias("hub")).join(hop, "hub", "left").select("ref_src", "ref_dst")


def bijective(corr: DataFrame) -> DataFrame:
    """Rows whose both ends occur once. Counts are joined back, so a target of many rows isn't one task."""
    once_a = corr.groupBy("va").agg(F.count("*").alias("n")).where("n = 1").select("va")
    once_b = corr.groupBy("vb").agg(F.count("*").alias("n")).where("n = 1").select("vb")
    return corr.join(once_a, "va", "left_semi").join(once_b, "vb", "left_semi")


def in_range(corr: DataFrame, na: int, nb: int) -> DataFrame:
    return corr.where(F.col("va").between(0, na - 1) & F.col("vb").between(0, nb - 1))


def transfer(corr: DataFrame, field: DataFrame, targets: DataFrame, default: float) -> DataFrame:
    """A's values at the vertices of B in ``targets(v)``; the last row of ``corr`` (largest ref) wins, ``default`` where there is none."""
    won = corr.join(field.select(F.col("v").alias("va"), "val"), "va").groupBy(F.col("vb").alias("v")).agg(F.max_by("val", F.struct("ref", "va")).alias("val"))
    return targets.select("v").join(won, "v", "left").select("v", F.coalesce("val", F.lit(default)).alias("val"))


def functional_map(corr: DataFrame, phi_a: DataFrame, phi_b: DataFrame, mass_b: DataFrame) -> DataFrame:
    """(r, c, val): B's basis, weighted by mass, against A's basis carried over by ``corr(va, vb)``; bases are (v, m, phi)."""
    from .spectral import functional_maps

    one = lambda d: d.withColumn("pair_id", F.lit(0))
    return functional_maps(one(corr), one(phi_a), one(phi_b), one(mass_b)).select("r", "c", "val")


def _from_identity(p: str, q: str, value: str):
    off = F.col(value) - F.when(F.col(p) == F.col(q), 1.0).otherwise(0.0)
    return F.sqrt(F.sum(off * off))


def map_errors(fmap: DataFrame) -> DataFrame:
    """column_error |C'C - I|, row_error |CC' - I|, identity_error |C - I| and diag_ratio (share of the energy on the diagonal) of one square map."""

    def gram(shared, kept, name):
        left = fmap.select(shared, F.col(kept).alias("p"), F.col("val").alias("x"))
        right = fmap.select(shared, F.col(kept).alias("q"), F.col("val").alias("y"))
        return left.join(right, shared).groupBy("p", "q").agg(F.sum(F.col("x") * F.col("y")).alias("g")).agg(_from_identity("p", "q", "g").alias(name))

    square = F.col("val") * F.col("val")
    ratio = F.sum(F.when(F.col("r") == F.col("c"), square).otherwise(0.0)) / (F.sum(square) + 1e-10)
    own = fmap.agg(_from_identity("r", "c", "val").alias("identity_error"), ratio.alias("diag_ratio"))
    return gram("r", "c", "column_error").crossJoin(gram("c", "r", "row_error")).crossJoin(own)  # one row each


def progressive(coefficients: DataFrame, phi: DataFrame) -> DataFrame:
    """(v, m, val): reconstruction from the first modes up to m, running along each vertex."""
    terms = phi.join(coefficients, "m").select("v", "m", (F.col("phi") * F.col("c")).alias("t"))
    w = Window.partitionBy("v").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    return terms.select("v", "m", F.sum("t").over(w).alias("val"))
