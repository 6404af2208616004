"""Queries of solves, spectra and distances with known answers over the driver's tables, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from .mesh_queries import rounded
from .operators import geodesics, isospectral, robust, solves, sparse, topology
from .plans import dissection, kernels
from .queries import FACES, query, strip_faces, strip_vertices, table


@query(f"WITH {FACES} SELECT mesh_id, v, round(x, 6) + 0.0 AS x, round(y - z, 6) + 0.0 AS y FROM places WHERE v IN (SELECT unnest([v0, v1, v2]) FROM faces)")
def factored_fields(spark, sf_dir):
    """Two fields on all strips, multiplied by stiffness and masses and found again by one factor of that matrix."""
    v, f = strip_vertices(spark, sf_dir), strip_faces(spark, sf_dir)
    masses = topology.barycentric_mass(f, v)
    one = masses.select("mesh_id").distinct().select("mesh_id", F.lit(0.05).alias("s"), F.lit(1.0).alias("m"), F.lit(0.0).alias("c"))
    factor = dissection.Factor(solves.shifted(topology.cotangent_laplacian(f, v), masses, one), v, 128)
    field = v.join(masses.select("mesh_id", F.col("i").alias("v")), ["mesh_id", "v"], "left_semi").select("mesh_id", "v", F.array(F.col("x"), F.col("y") - F.col("z")).alias("x"))
    out = factor.solve(factor.times(field).withColumnRenamed("x", "b"), 2)
    factor.close()
    return rounded(out.select("mesh_id", "v", F.col("x")[0].alias("x"), F.col("x")[1].alias("y")), 6)


# -- rings: the embeddings of a label, in order of their ids, around a circle; spectra and Green's functions have closed forms

RING = "ring AS (SELECT label AS mesh_id, vec_id AS v, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))"


def ring(spark, sf_dir):
    """Stiffness with a weight of one between neighbours, unit masses, vertices and the first vertex of each ring."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("mesh_id"), F.col("vec_id").alias("v"))
    whole = Window.partitionBy("mesh_id")
    e = e.select("mesh_id", "v", (F.row_number().over(whole.orderBy("v")) - 1).alias("r"), F.count("*").over(whole).alias("n"))
    turn = 2 * math.pi * F.col("r") / F.col("n")
    vertices = e.select("mesh_id", "v", F.cos(turn).alias("x"), F.sin(turn).alias("y"), F.lit(0.0).alias("z"))
    after = e.select("mesh_id", F.col("v").alias("neighbor"), F.pmod(F.col("r") - 1, F.col("n")).alias("r"))
    weights = e.join(after, ["mesh_id", "r"]).select("mesh_id", F.col("v").alias("center"), "neighbor", F.lit(1.0).alias("w"))
    return sparse.stiffness(weights), e.select("mesh_id", F.col("v").alias("i"), F.lit(1.0).alias("area")), vertices, e.where("r = 0").select("mesh_id", F.col("v").alias("source"))


@query(f"WITH {RING}, k AS (SELECT DISTINCT mesh_id, n FROM ring) SELECT mesh_id, CAST(m AS INTEGER) AS m, round(2 - 2 * cos(2 * pi() * ((m + 1) // 2) / n), 8) AS lam FROM k, (SELECT unnest(generate_series(0, 5)) AS m) WHERE m < n")
def ring_spectra(spark, sf_dir):
    """The six smallest eigenvalues of every ring."""
    stiff, masses, vertices, _ = ring(spark, sf_dir)
    values, _ = solves.eigenpairs(stiff, masses, vertices, 6)
    return rounded(values.select("mesh_id", "m", "lam"), 8)


@query(f"WITH {RING}, q AS (SELECT 1.05 - sqrt(0.1 + 0.0025) AS q), h AS (SELECT mesh_id, v, pow(q, r) + pow(q, n - r) AS h FROM ring, q) SELECT mesh_id, v, round((h - min(h) OVER w) / (max(h) OVER w - min(h) OVER w), 7) AS g FROM h WINDOW w AS (PARTITION BY mesh_id)")
def ring_greens(spark, sf_dir):
    """Green's functions from the first vertex of every ring, in SQL by the powers of the recurrence's root."""
    g = solves.greens_functions(*ring(spark, sf_dir), eps=0.05)
    return rounded(g.select("mesh_id", "v", "g"), 7)


# -- ribbons: strips of unit squares, folded along their rungs by angles from the embeddings; distances are those of the flat strip

RIBBON = "p AS (SELECT vec_id // 300 AS mesh_id, vec_id AS v, vec_id % 300 // 2 AS s, vec_id % 2 AS y FROM embeddings)"


def ribbon_vertices(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 300).alias("mesh_id"), F.col("vec_id").alias("v"), F.floor(F.col("vec_id") % 300 / 2).alias("s"), (F.col("vec_id") % 2).cast("double").alias("y"), (3.0 * F.col("embedding")[0].cast("double")).alias("turn"))
    before = Window.partitionBy("mesh_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)  # 150 rungs
    rungs = e.where("y = 0").select("mesh_id", "s", *(F.coalesce(F.sum(f("turn")).over(before), F.lit(0.0)).alias(n) for n, f in (("x", F.cos), ("z", F.sin))))
    return e.join(rungs, ["mesh_id", "s"]).select("mesh_id", "v", "x", "y", "z")


@query(f"WITH {RIBBON} SELECT a.mesh_id, a.v AS source, b.v, round(sqrt((a.s - b.s) ** 2 + (a.y - b.y) ** 2), 8) AS dist, 0 AS method FROM p a JOIN p b USING (mesh_id) WHERE a.v % 150 = 0")
def ribbon_distances(spark, sf_dir):
    """Distances over folded ribbons from two vertices each, by the first method that knows them."""
    v = ribbon_vertices(spark, sf_dir)
    sources = v.where("v % 150 = 0").select("mesh_id", F.col("v").alias("source"))
    return rounded(geodesics.mesh_distances(strip_faces(spark, sf_dir), v, sources), 8)


@query("WITH p AS (SELECT vec_id // 300 AS mesh_id, count(*) AS n FROM embeddings GROUP BY 1) SELECT mesh_id, round((n - 2) / 2.0, 6) AS area, CAST(0 AS BIGINT) AS negative, CAST(0 AS BIGINT) AS unbalanced FROM p")
def sheared_ribbons(spark, sf_dir):
    """Flat ribbons sheared so that every rung is flipped: the area of the masses, negative weights and rows that don't sum to zero."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 300).alias("mesh_id"), F.col("vec_id").alias("v"), (F.col("vec_id") % 2).cast("double").alias("y"), F.floor(F.col("vec_id") % 300 / 2).alias("s"))
    v = e.select("mesh_id", "v", (F.col("s") + F.col("y") * (1.3 + F.col("mesh_id") % 5 / 4)).alias("x"), "y", F.lit(0.0).alias("z"))
    stiff, masses = robust.mesh_operators(strip_faces(spark, sf_dir).where("f % 2 = 0"), v)
    rows = stiff.groupBy("mesh_id", "i").agg(F.count(F.when((F.col("i") != F.col("j")) & (F.col("val") > 1e-9), 1)).alias("negative"), F.abs(F.sum("val")).alias("off"))
    rows = rows.groupBy("mesh_id").agg(F.sum("negative").alias("negative"), F.count(F.when(F.col("off") > 1e-9, 1)).alias("unbalanced"))
    return masses.groupBy("mesh_id").agg(F.round(F.sum("area"), 6).alias("area")).join(rows, "mesh_id").select("mesh_id", "area", "negative", "unbalanced")


@query("SELECT DISTINCT vec_id // 300 AS mesh_id, 1.0::DOUBLE AS loss, 0.0::DOUBLE AS fx, 0.0::DOUBLE AS fy, 0.0::DOUBLE AS fz FROM embeddings")
def isospectral_forces(spark, sf_dir):
    """Ribbons whose wanted eigenvalues all lie one above their own: the loss is one, and as moving a whole mesh changes nothing, its vertices' gradients cancel."""
    v, f = ribbon_vertices(spark, sf_dir), strip_faces(spark, sf_dir).where("f % 2 = 0")
    own = kernels.eigenpairs(topology.cotangent_laplacian(f, v), topology.barycentric_mass(f, v), 6)
    loss, gradient = isospectral.objective(f, v, own.select("mesh_id", "m", (F.col("lam") + 1).alias("lam")).distinct(), 6)
    forces = gradient.groupBy("mesh_id").agg(*(F.sum(f"g{a}").alias(f"f{a}") for a in "xyz"))
    return rounded(loss.select("mesh_id", "loss").join(forces, "mesh_id"), 6)


@query(f"WITH {FACES} SELECT mesh_id, v, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM places")
def resting_strips(spark, sf_dir):
    """Strips held where they are at every fifth vertex: a deformation leaves all others at rest too."""
    v, f = strip_vertices(spark, sf_dir), strip_faces(spark, sf_dir)
    weights = geodesics.edge_weights(topology.cotangent_laplacian(f, v)).withColumn("w", F.abs("w"))
    out, _ = solves.deformed(v, weights, v.where("v % 5 = 0"), rounds=2)
    return rounded(out, 6)
