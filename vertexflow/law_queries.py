"""Queries of draws, poses, gradients and checks, held against laws that their results must obey."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .mesh_queries import CORNERS, LINES, SURFACE, _sampled, lines, order_areas, rounded
from .operators import geodesics, losses, patches, sampling, sparse, surface_rows, topology
from .queries import FACES, SPACE, query, space, strip_faces, strip_vertices, table

# -- poses


@query(f"WITH {LINES} SELECT patch, round(sum(px*px+py*py+pz*pz), 5) AS squares, round(sum(px)**2+sum(py)**2+sum(pz)**2, 5) AS sum_square FROM l GROUP BY patch")
def rotated_patches(spark, sf_dir):
    """A random rotation of each patch keeps its rows' lengths and that of their sum."""
    turned = patches.posed(lines(spark, sf_dir), [patches.random_rotation(11)])
    sums = [F.sum(f"p{a}") for a in "xyz"]
    return turned.groupBy("patch").agg(F.round(F.sum(sum(F.col(f"p{a}") * F.col(f"p{a}") for a in "xyz")), 5).alias("squares"), F.round(sum(s * s for s in sums), 5).alias("sum_square"))


@query(f"WITH {SPACE} SELECT mesh_id, v, round(-y, 7) + 0.0 AS px, round(x + 2, 7) + 0.0 AS py, round(z, 7) + 0.0 AS pz FROM space")
def turned_points(spark, sf_dir):
    """Points shifted along x and turned by a right angle about z."""
    p = space(spark, sf_dir).select("mesh_id", "v", *(F.col(a).alias(f"p{a}") for a in "xyz"))
    return rounded(patches.posed(p, [lambda rows: (patches.axis_shift("x", F.lit(2.0)), patches.axis_rotation("z", F.lit(math.pi / 2)))]), 7)


# -- gradients of patches: an order is a centre, its lines' parts are neighbours, and a vertex's value is its number modulo 13


def _coefficients(spark, sf_dir):
    return lines(spark, sf_dir).select("mesh_id", F.col("patch").alias("center"), "neighbor", "gx", "gy", "gz")


GRADIENT = f"{LINES}, gf AS (SELECT patch, sum(gx * (neighbor % 13 - patch % 13)) AS x, sum(gy * (neighbor % 13 - patch % 13)) AS y, sum(gz * (neighbor % 13 - patch % 13)) AS z FROM l GROUP BY patch)"


@query(f"WITH {GRADIENT} SELECT patch AS center, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM gf")
def gradient_products(spark, sf_dir):
    g = sparse.gradient(_coefficients(spark, sf_dir)).withColumn("val", F.col("val") * (F.col("j") % 13))
    parts = [F.coalesce(F.sum(F.when(F.col("d") == d, F.col("val"))), F.lit(0.0)).alias(a) for d, a in enumerate("xyz")]
    return rounded(g.groupBy("mesh_id", F.col("i").alias("center")).agg(*parts).drop("mesh_id"), 6)


@query(f"WITH {GRADIENT}, t AS (SELECT neighbor AS v, area * (gx*x + gy*y + gz*z) AS t FROM l JOIN gf USING (patch) JOIN area USING (patch) UNION ALL SELECT patch, -area * (gx*x + gy*y + gz*z) FROM l JOIN gf USING (patch) JOIN area USING (patch)) SELECT v, round(sum(t), 5) + 0.0 AS val FROM t GROUP BY v")
def anisotropic_products(spark, sf_dir):
    """The anisotropic Laplacian times the field, in SQL by the transposed gradient of its gradient."""
    areas = order_areas(spark, sf_dir).select("mesh_id", F.col("patch").alias("center"), "area")
    a = sparse.anisotropic(_coefficients(spark, sf_dir), areas)
    return rounded(a.groupBy("mesh_id", F.col("i").alias("v")).agg(F.sum(F.col("val") * (F.col("j") % 13)).alias("val")).drop("mesh_id"), 5)


@query(f"WITH {LINES}, e AS (SELECT patch AS i, neighbor AS j FROM l UNION SELECT neighbor, patch FROM l) SELECT i AS v, count(*) FILTER (i <> j) AS neighbors, 0.0::DOUBLE AS row_sum FROM e GROUP BY i HAVING count(*) FILTER (i <> j) > 0")
def one_hop_rows(spark, sf_dir):
    """Entries of the anisotropic Laplacian between neighbours alone, whose rows still sum to zero."""
    areas = order_areas(spark, sf_dir).select("mesh_id", F.col("patch").alias("center"), "area")
    c = _coefficients(spark, sf_dir)
    rows = sparse.anisotropic_one_hop(c, areas).groupBy(F.col("i").alias("v")).agg(F.count(F.when(F.col("i") != F.col("j"), 1)).alias("neighbors"), F.sum("val").alias("row_sum"))
    return rounded(rows, 5)


@query(f"""WITH {FACES}, {CORNERS}, e AS (SELECT mesh_id, v1 i, v2 j, ((x1-x0)*(x2-x0)+(y1-y0)*(y2-y0)+(z1-z0)*(z2-z0))/twice/2 w FROM u UNION ALL SELECT mesh_id, v2, v0, ((x2-x1)*(x0-x1)+(y2-y1)*(y0-y1)+(z2-z1)*(z0-z1))/twice/2 FROM u UNION ALL SELECT mesh_id, v0, v1, ((x0-x2)*(x1-x2)+(y0-y2)*(y1-y2)+(z0-z2)*(z1-z2))/twice/2 FROM u),
  b AS (SELECT mesh_id, i, j, w FROM e UNION ALL SELECT mesh_id, j, i, w FROM e), c AS (SELECT unnest([v0, v1, v2]) AS i, twice / 6 AS third FROM u), m AS (SELECT i, sum(third) AS area FROM c GROUP BY i),
  s AS (SELECT b.mesh_id, b.i, sum(w*(p.x-q.x)) x, sum(w*(p.y-q.y)) y, sum(w*(p.z-q.z)) z FROM b JOIN places p ON p.v = b.i JOIN places q ON q.v = b.j GROUP BY 1, 2)
  SELECT s.mesh_id, i AS v, round(ln(1 + sqrt(x*x+y*y+z*z) / area), 5) AS h FROM s JOIN m USING (i)""")
def strip_curvatures(spark, sf_dir):
    """Mean curvatures of the strips by stiffness and masses, in SQL by differences along edges."""
    v, f = strip_vertices(spark, sf_dir), strip_faces(spark, sf_dir)
    h = sparse.mean_curvature(topology.cotangent_laplacian(f, v), topology.barycentric_mass(f, v), v)
    return h.select("mesh_id", "v", F.round(F.log(1 + F.col("h")), 5).alias("h"))


@query(f"WITH {SURFACE}, c AS (SELECT surface_id, p, (max(hh) FILTER (dx > 0) - max(hh) FILTER (dx < 0)) / 2e-4 AS hx, (max(hh) FILTER (dy > 0) - max(hh) FILTER (dy < 0)) / 2e-4 AS hy, max(zx) FILTER (dx = 0 AND dy = 0) AS zx, max(zy) FILTER (dx = 0 AND dy = 0) AS zy FROM h GROUP BY 1, 2) SELECT surface_id, p, round(zx * hx + zy * hy, 2) + 0.0 AS rise FROM c")
def lifted_gradients(spark, sf_dir):
    """How the mean curvature's gradient rises when it is lifted to the surface."""
    d = surface_rows.differential(_sampled(spark, sf_dir))
    return rounded(d.select("surface_id", "p", F.col("gH_3z").alias("rise")), 2)


# -- draws: their sizes, and what none of them may break


@query(f"WITH {LINES} SELECT CAST(least(500, count(DISTINCT patch)) AS BIGINT) AS patches, CAST(0 AS BIGINT) AS broken FROM l")
def drawn_patches(spark, sf_dir):
    """Five hundred patches drawn with all of their rows."""
    every = lines(spark, sf_dir)
    sizes = every.groupBy("patch").agg(F.count("*").alias("whole"))
    drawn = patches.random_patches(every, 500, 3).groupBy("patch").agg(F.count("*").alias("n")).join(sizes, "patch")
    return drawn.agg(F.count("*").alias("patches"), F.count(F.when(F.col("n") != F.col("whole"), 1)).alias("broken"))


@query("SELECT label AS mesh_id, CAST(least(40, count(*)) AS BIGINT) AS drawn, CAST(least(40, count(*)) AS BIGINT) AS different FROM embeddings GROUP BY label")
def drawn_landmarks(spark, sf_dir):
    drawn = sampling.landmarks(space(spark, sf_dir).select("mesh_id", "v"), "v", 40, 5, ["mesh_id"])
    return drawn.groupBy("mesh_id").agg(F.count("*").alias("drawn"), F.count_distinct("v").alias("different"))


@query("SELECT label AS pair_id, vec_id AS ref, row_number() OVER w - 1 AS va, row_number() OVER w - 1 AS vb FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)")
def renumbered_pairs(spark, sf_dir):
    """The identity in the numbers of a subsample that keeps every vertex."""
    v = space(spark, sf_dir).select("mesh_id", "v")
    kept = sampling.subsampled(v, 1 << 30, 7).withColumnRenamed("mesh_id", "pair_id")
    return sampling.remapped(sampling.identity(v), kept, kept)


@query("SELECT label AS pair_id, label % 2 = 0 AS identity FROM embeddings GROUP BY label")
def identity_pairs(spark, sf_dir):
    """Every mesh matched with itself, with a wrong row in odd ones."""
    v = space(spark, sf_dir).select("mesh_id", "v")
    first = v.groupBy("mesh_id").agg(F.min("v").alias("first"))
    corr = sampling.identity(v).join(first.withColumnRenamed("mesh_id", "pair_id"), "pair_id")
    corr = corr.withColumn("vb", F.when((F.col("pair_id") % 2 == 1) & (F.col("va") == F.col("first")), F.col("vb") + 1).otherwise(F.col("vb"))).drop("first")
    return sampling.is_identity(corr, v.groupBy(F.col("mesh_id").alias("pair_id")).agg(F.count("*").alias("n")))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS batch FROM orders")
def ordered_batches(spark, sf_dir):
    return sampling.batches(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 64)


@query("SELECT mesh_id, v FROM (SELECT label AS mesh_id, vec_id AS v, count(*) OVER (PARTITION BY label) AS n FROM embeddings) WHERE (mesh_id % 2 = 0 AND v % 10 <> 0) OR (mesh_id % 2 = 1 AND v >= ceil(n * 0.1))")
def free_vertices(spark, sf_dir):
    """Meshes that hold what is wanted, and those without any of it, which hold their first vertices."""
    v = space(spark, sf_dir).select("mesh_id", "v")
    wanted = v.where("mesh_id % 2 = 0 and v % 10 = 0").unionByName(v.select("mesh_id", (F.col("v") + 10**9).alias("v")))
    return geodesics.unknowns(v, geodesics.constraints(v, wanted))


BRIDGES = "n AS (SELECT n_nationkey AS k, n_name AS c FROM nation), b AS (SELECT p.c AS src, q.c AS dst FROM n p JOIN n q ON q.k = (p.k + 3) % 25), links AS (SELECT src, dst FROM b UNION SELECT dst, src FROM b)"


def nation_bridges(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    one = n.select(F.col("n_name").alias("src"), ((F.col("n_nationkey") + 3) % 25).alias("k"))
    two = n.select(F.col("n_name").alias("dst"), F.col("n_nationkey").alias("k"))
    return one.join(two, "k").select("src", "dst", F.lit(0).cast("long").alias("ref_src"), F.lit(0).cast("long").alias("ref_dst"))


@query(f"WITH {BRIDGES}, two AS (SELECT a.src, z.dst, min(a.dst) AS hub FROM links a JOIN links z ON a.dst = z.src WHERE a.src <> z.dst GROUP BY 1, 2) SELECT src, dst, CAST(NULL AS VARCHAR) AS hub FROM links UNION ALL SELECT two.src, two.dst, two.hub FROM two WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.src = two.src AND l.dst = two.dst)")
def bridge_hubs(spark, sf_dir):
    """Nations bridged with the third one after them: each ordered pair directly, or by the first hub of several."""
    return sampling.hubs(nation_bridges(spark, sf_dir))


@query(f"""WITH {BRIDGES}, t AS (SELECT n_name AS c FROM nation WHERE n_regionkey < 3), v AS (SELECT n_name AS c FROM nation WHERE n_regionkey >= 3),
  x AS (SELECT a.c a, b.c b, 'cross' AS role FROM t a, t b WHERE a.c < b.c UNION ALL SELECT a.c, b.c, 'val' FROM t a, v b WHERE a.c <> b.c UNION ALL SELECT a.c, b.c, 'val' FROM v a, v b WHERE a.c < b.c)
  SELECT c AS a, c AS b, 'same' AS role FROM t UNION ALL SELECT a, b, role FROM x WHERE EXISTS (SELECT 1 FROM links WHERE src = a AND dst = b)""")
def nation_pairs(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("category"), "n_regionkey")
    return sampling.category_pairs(n.where("n_regionkey < 3"), n.where("n_regionkey >= 3"), sampling.both_ways(nation_bridges(spark, sf_dir)))


# -- checks and reports


@query("SELECT label AS mesh_id, sign, CASE WHEN sign > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS monotonicity FROM (SELECT DISTINCT label FROM embeddings), (SELECT unnest([1, -1]) AS sign)")
def monotone_scores(spark, sf_dir):
    """Values against their cubes, and against the cubes' negatives."""
    s = space(spark, sf_dir)
    rows = s.select("mesh_id", F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign"), "v", "x")
    return geodesics.monotonicity(rows.select("mesh_id", "sign", "v", F.col("x").alias("a"), (F.col("sign") * F.pow("x", F.lit(3))).alias("b")), ["mesh_id", "sign"])


@query("SELECT label AS mesh_id, min(vec_id) AS source, method, 1.0::DOUBLE AS correlation, 0.0::DOUBLE AS mean_error, 0.0::DOUBLE AS max_error, 1.0::DOUBLE AS monotonicity FROM embeddings, (SELECT unnest(['doubled', 'moved']) AS method) GROUP BY label, method")
def compared_methods(spark, sf_dir):
    """Distances doubled and moved by one agree with themselves once both are scaled."""
    s = space(spark, sf_dir)
    first = s.groupBy("mesh_id").agg(F.min("v").alias("source"))
    d = geodesics.euclidean(s, first)
    other = {"doubled": d.withColumn("dist", 2 * F.col("dist")), "moved": d.withColumn("dist", F.col("dist") + 1)}
    return rounded(geodesics.compared(other, d), 7)


@query("SELECT event_type AS method, count(*) AS sources, count(*) FILTER (value > 0.01) AS passed, bool_and(value > 0.01) AS all_passed FROM events GROUP BY 1")
def passed_checks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return geodesics.all_pass(e.select(F.col("event_type").alias("method"), (F.col("value") > 0.01).alias("max_at_source")))


@query(f"""WITH {FACES}, k AS (SELECT mesh_id, count(*) AS edges, count(*) FILTER (faces = 1) AS boundary_edges, count(*) FILTER (faces > 2) AS non_manifold_edges FROM edges GROUP BY 1),
  f AS (SELECT mesh_id, count(*) AS faces FROM faces GROUP BY 1), p AS (SELECT mesh_id, count(*) AS vertices FROM places GROUP BY 1)
  SELECT mesh_id, vertices, faces, edges, boundary_edges, non_manifold_edges, CAST(1 AS BIGINT) AS components, vertices - edges + faces AS euler FROM p JOIN f USING (mesh_id) JOIN k USING (mesh_id)""")
def strip_diagnostics(spark, sf_dir):
    """Counts and topology of the strips, each of which hangs together."""
    return geodesics.mesh_diagnostics(strip_faces(spark, sf_dir), strip_vertices(spark, sf_dir)).drop("loops")


@query("""WITH c AS (SELECT event_type AS name, avg(value) AS value FROM events GROUP BY 1), w AS (SELECT name, value, 1.0 / (SELECT count(*) FROM c) AS weight FROM c)
  SELECT name, round(value, 6) AS value FROM c UNION ALL SELECT 'weighted_' || name, round(value * weight, 6) FROM w UNION ALL SELECT 'loss', round(sum(value * weight), 6) FROM w
  UNION ALL SELECT 'area_mean', round(avg(1 + o_totalprice / 100000), 6) FROM orders UNION ALL SELECT 'area_std', round(stddev_samp(1 + o_totalprice / 100000), 6) FROM orders""")
def training_step(spark, sf_dir):
    """What a step logs: event types as components of equal weight, orders as patches with areas."""
    c = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("value"))
    names = [r["name"] for r in c.select("name").collect()]  # event types
    return rounded(losses.step_metrics(c, {n: 1.0 for n in names}, order_areas(spark, sf_dir)), 6)


@query("SELECT round(sum((l_extendedprice - 1000 * l_quantity) ** 2) / sum((1000 * l_quantity) ** 2), 8) AS proximity FROM lineitem")
def weight_proximity(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.lit("w").alias("name"), F.col("l_orderkey").alias("i"), F.col("l_extendedprice").alias("value"), (1000 * F.col("l_quantity")).alias("start"))
    return rounded(losses.parameter_proximity(rows), 8)
