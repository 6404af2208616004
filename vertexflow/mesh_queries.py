"""Queries of patches, losses, spectra, meshes, surfaces and distances over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import scalars
from .operators import correspondence, geodesics, graphs, learned, losses, metrics, patches, points, sampling, sparse, spectral, surface_rows, topology
from .plans import transformer
from .queries import FACES, FOLD, NEXT, SPACE, folded, next_vectors, query, space, strip_faces, strip_vertices, table
from .scratch import Scratch


def rounded(df, digits=9, *, keep=()):
    """Doubles rounded; -0.0 becomes 0.0."""
    kinds = dict(df.dtypes)
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if kinds[c] == "double" and c not in keep else F.col(c) for c in df.columns))


# -- patches and losses: an order is a patch, its lines are the neighbours

LINES = """
  l AS (SELECT 0 AS mesh_id, l_orderkey AS patch, l_linenumber AS rank, l_partkey AS neighbor, l_quantity / 50 AS px, l_discount * 10 - 0.5 AS py, l_tax * 10 - 0.4 AS pz,
               l_extendedprice / 50000 AS gx, l_discount * 5 AS gy, (l_partkey % 11) / 11.0 - 0.5 AS gz FROM lineitem),
  area AS (SELECT o_orderkey AS patch, 1 + o_totalprice / 100000 AS area FROM orders)"""


def lines(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        F.lit(0).alias("mesh_id"), c("l_orderkey").alias("patch"), c("l_linenumber").alias("rank"), c("l_partkey").alias("neighbor"), (c("l_quantity") / 50).alias("px"), (c("l_discount") * 10 - 0.5).alias("py"),
        (c("l_tax") * 10 - 0.4).alias("pz"), (c("l_extendedprice") / 50000).alias("gx"), (c("l_discount") * 5).alias("gy"), ((c("l_partkey") % 11) / 11.0 - 0.5).alias("gz"),
    )


def order_areas(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.lit(0).alias("mesh_id"), F.col("o_orderkey").alias("patch"), (1 + F.col("o_totalprice") / 100000).alias("area"))


@query(f"WITH {LINES} SELECT patch, count(*) AS size, round(max(scale), 9) AS scale, round(sum(px / scale), 7) AS sx FROM (SELECT *, greatest(max(sqrt(px*px+py*py+pz*pz)) OVER (PARTITION BY patch), 1e-8) AS scale FROM l) GROUP BY patch")
def patch_scales(spark, sf_dir):
    s = patches.scaled(lines(spark, sf_dir))
    return s.groupBy("patch").agg(F.count("*").alias("size"), F.round(F.max("scale"), 9).alias("scale"), F.round(F.sum("px"), 7).alias("sx"))


@query(f"WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY patch ORDER BY rank, neighbor) AS i FROM l) SELECT patch, count(*) AS size, string_agg(CAST(neighbor AS VARCHAR), ',' ORDER BY i) AS neighbors FROM r WHERE i <= 4 GROUP BY patch")
def padded_patches(spark, sf_dir):
    """At most four tokens a patch, in rank order."""
    p = patches.padded(lines(spark, sf_dir), 4)
    return p.select("patch", "size", F.array_join(F.transform("tokens", lambda t: t["neighbor"].cast("string")), ",").alias("neighbors"))


@query(f"WITH {LINES} SELECT patch, round(sum(gx*px)/max(area), 7) AS hx, round(sum(gx*py)/max(area), 7) AS hy, round(sum(gx*pz)/max(area), 7) AS hz FROM l JOIN area USING (patch) GROUP BY patch")
def patch_curvature(spark, sf_dir):
    out = patches.mean_curvature_vectors(lines(spark, sf_dir).withColumn("w", F.col("gx")), order_areas(spark, sf_dir))
    return rounded(out.drop("mesh_id"), 7)


@query(f"WITH {LINES}, p AS (SELECT a.patch, -(a.gx*b.gx + a.gy*b.gy + a.gz*b.gz) AS w, b.px, b.py, b.pz FROM l a JOIN l b USING (patch)) SELECT patch, round(sum(w*px)/max(area), 6) AS hx, round(sum(w*py)/max(area), 6) AS hy, round(sum(w*pz)/max(area), 6) AS hz FROM p JOIN area USING (patch) GROUP BY patch")
def gradient_patch_curvature(spark, sf_dir):
    return rounded(patches.mean_curvature_vectors(lines(spark, sf_dir), order_areas(spark, sf_dir), gradient=True).drop("mesh_id"), 6)


@query(f"WITH {LINES}, m AS (SELECT patch, avg(px) px, avg(py) py FROM l GROUP BY patch) SELECT patch, round(px, 9) AS px, round(py, 9) AS py FROM m")
def pooled_patches(spark, sf_dir):
    out = patches.mean_pooled(lines(spark, sf_dir).withColumn("f", F.array("px", "py")), "f")
    return rounded(out.select("patch", F.col("f")[0].alias("px"), F.col("f")[1].alias("py")))


@query(f"WITH {LINES}, r AS (SELECT patch, gx, row_number() OVER (PARTITION BY patch ORDER BY rank, neighbor, gx) AS i FROM l), k AS (SELECT patch, count(*) n, sum(gx) s, avg(gx) m FROM r WHERE i <= 5 GROUP BY patch) SELECT patch, CAST(5 AS BIGINT) AS rows, round((s + (5 - n) * m) / (5::DOUBLE / 7), 9) AS total FROM k")
def resized_patch_weights(spark, sf_dir):
    """Weights cut or padded to five neighbours and corrected for seven."""
    # named before the window, so that ranks, counts and sums share one shuffle and one sort
    rows = lines(spark, sf_dir).select("mesh_id", F.col("patch").alias("center"), "rank", "neighbor", F.col("gx").alias("w"))
    w = rows.withColumn("rank", F.row_number().over(Window.partitionBy("mesh_id", "center").orderBy("rank", "neighbor", "w")))
    out = patches.resized_weights(w, 5, 7)
    return out.groupBy(F.col("center").alias("patch")).agg(F.count("*").alias("rows"), F.round(F.sum("w"), 9).alias("total"))


@query(f"WITH {LINES}, n AS (SELECT o_orderkey AS patch, sin(o_custkey) nx, cos(o_custkey) ny, 0.5 + 0 * o_custkey nz FROM orders), u AS (SELECT patch, nx/sqrt(nx*nx+ny*ny+nz*nz) nx, ny/sqrt(nx*nx+ny*ny+nz*nz) ny, nz/sqrt(nx*nx+ny*ny+nz*nz) nz FROM n), s AS (SELECT patch, sum(gx*px) xx, sum(gx*py) xy, sum(gx*pz) xz, sum(gy*px) yx, sum(gy*py) yy, sum(gy*pz) yz, sum(gz*px) zx, sum(gz*py) zy, sum(gz*pz) zz FROM l GROUP BY patch) SELECT patch, round(((xx-1+nx*nx)**2 + (xy+nx*ny)**2 + (xz+nx*nz)**2 + (yx+ny*nx)**2 + (yy-1+ny*ny)**2 + (yz+ny*nz)**2 + (zx+nz*nx)**2 + (zy+nz*ny)**2 + (zz-1+nz*nz)**2) / 9, 6) AS loss FROM s JOIN u USING (patch)")
def tangent_projector_loss(spark, sf_dir):
    n = table(spark, sf_dir, "orders").select(F.lit(0).alias("mesh_id"), F.col("o_orderkey").alias("patch"), F.sin("o_custkey").alias("nx"), F.cos("o_custkey").alias("ny"), F.lit(0.5).alias("nz"))
    return rounded(losses.tangent_projector(lines(spark, sf_dir), n).drop("mesh_id"), 6)


@query(f"WITH {LINES}, s AS (SELECT patch, unnest([{{'s': sx, 'g': ax}}, {{'s': sy, 'g': ay}}, {{'s': sz, 'g': az}}]) e FROM (SELECT patch, sum((gx*gx+gy*gy+gz*gz)*px*px) sx, sum((gx*gx+gy*gy+gz*gz)*py*py) sy, sum((gx*gx+gy*gy+gz*gz)*pz*pz) sz, max(area)*(sum(gx*px)**2+sum(gy*px)**2+sum(gz*px)**2) ax, max(area)*(sum(gx*py)**2+sum(gy*py)**2+sum(gz*py)**2) ay, max(area)*(sum(gx*pz)**2+sum(gy*pz)**2+sum(gz*pz)**2) az FROM l JOIN area USING (patch) GROUP BY patch)) SELECT patch, round(avg((e.s-e.g)**2/(e.s**2+1e-2)), 5) AS loss FROM s GROUP BY patch")
def dirichlet_loss(spark, sf_dir):
    return rounded(losses.dirichlet_consistency(lines(spark, sf_dir), order_areas(spark, sf_dir), "coordinates", eps=1e-2).drop("mesh_id"), 5)


@query(f"WITH {LINES}, i AS (SELECT *, row_number() OVER (PARTITION BY patch ORDER BY rank, neighbor) n FROM l), o AS (SELECT a.patch, sum((a.gx*b.gx+a.gy*b.gy+a.gz*b.gz)**2) FILTER (a.n <> b.n) AS off FROM i a JOIN i b USING (patch) GROUP BY 1), w AS (SELECT patch, sum(gx*gx+gy*gy+gz*gz) w FROM l GROUP BY patch) SELECT patch, round(coalesce(off, 0) / (w*w + 1e-8), 7) AS loss FROM o JOIN w USING (patch)")
def gram_loss(spark, sf_dir):
    return rounded(losses.gram_off_diagonal(lines(spark, sf_dir)).drop("mesh_id"), 7)


@query(f"WITH {NEXT} SELECT label, round(avg(((ux-wx)**2+(uy-wy)**2+(uz-wz)**2)/3), 9) AS direction_mse FROM u GROUP BY label")
def direction_losses(spark, sf_dir):
    return rounded(losses.direction_mse(next_vectors(spark, sf_dir), ["label"]))


TRADE = "trade AS (SELECT c_nationkey a, s_nationkey b, sum(l_extendedprice) p FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), sim AS (SELECT a, b, p / (SELECT max(p) FROM trade) AS sim FROM trade)"


def trade(spark, sf_dir):
    """(a, b, sim): trade between customers' and suppliers' nations over the largest; a match is trade within one nation."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sums = rows.groupBy(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).agg(F.sum("l_extendedprice").alias("p"))
    return sums.crossJoin(F.broadcast(sums.agg(F.max("p").alias("most")))).select("a", "b", (F.col("p") / F.col("most")).alias("sim"))  # one row


def _contrastive_sql(kind):
    keep = "true" if kind == "infonce" else "a <> b"
    w = "(2 - n * softmax)" if kind == "dclw" else "1"
    return f"""WITH {TRADE}, s AS (SELECT a, b, sim / 0.07 AS s FROM sim),
      r AS (SELECT a AS v, ln(sum(exp(s)) FILTER ({keep})) - max(s) FILTER (a = b) AS one FROM s GROUP BY a HAVING max(s) FILTER (a = b) IS NOT NULL),
      c AS (SELECT b AS v, ln(sum(exp(s)) FILTER ({keep})) - max(s) FILTER (a = b) AS two FROM s GROUP BY b HAVING max(s) FILTER (a = b) IS NOT NULL),
      m AS (SELECT a AS v, exp(sim / 0.5) / sum(exp(sim / 0.5)) OVER () AS softmax, count(*) OVER () AS n FROM sim WHERE a = b),
      k AS (SELECT a AS v, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank, b FROM sim),
      h AS (SELECT avg((rank = 1)::INT) accuracy, avg((rank <= 3)::INT) top3, avg((rank <= 5)::INT) top5, avg((rank <= 10)::INT) top10 FROM k WHERE v = b)
      SELECT round(0.5 * (avg({w} * one) + avg({w} * two)), 7) AS loss, max(accuracy) AS accuracy, max(top3) AS top3, max(top5) AS top5, max(top10) AS top10 FROM r JOIN c USING (v) JOIN m USING (v), h"""


def _contrastive(kind):
    return lambda spark, sf_dir: losses.contrastive(trade(spark, sf_dir), kind).withColumn("loss", F.round("loss", 7))


for _kind in ("infonce", "dcl", "dclw"):
    _f = _contrastive(_kind)
    _f.__name__ = f"{_kind}_loss"
    query(_contrastive_sql(_kind))(_f)


@query("WITH c AS (SELECT event_type AS name, avg(value) AS value FROM events GROUP BY 1), w AS (SELECT name, value, CASE name WHEN 'error' THEN NULL WHEN 'click' THEN 0.75 ELSE 0.25 / (SELECT count(*) - 2 FROM c) END AS weight FROM c) SELECT name, round(value, 7) AS value, round(weight, 7) AS weight, round(weight * value, 7) AS weighted FROM w")
def weighted_losses(spark, sf_dir):
    """Components weighted so that the weights sum to 1; ``error`` is only logged."""
    c = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("value"))
    names = [r["name"] for r in c.select("name").collect()]  # event types
    others = [n for n in names if n not in ("error", "click")]
    weights = {"error": None, "click": 3.0, **{n: 1.0 / len(others) for n in others}}
    return rounded(losses.weighted(c, weights), 7)


# -- spectra: the dimensions of embeddings are modes, and the next embedding is the prediction

MODES = "g AS (SELECT label AS mesh_id, vec_id AS v, unnest(generate_series(0, len(embedding) - 1)) AS m, unnest(embedding)::DOUBLE AS phi FROM embeddings), p AS (SELECT g.mesh_id, g.v, g.m, g.phi + 0.3 * n.phi AS phi FROM g JOIN g n ON n.v = (g.v + 1) % (SELECT count(*) FROM embeddings) AND n.m = g.m)"


def modes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    g = e.select(F.col("label").alias("mesh_id"), F.col("vec_id").alias("v"), F.posexplode(F.col("embedding").cast("array<double>")).alias("m", "phi"))
    after = e.select(F.pmod(F.col("vec_id") - 1, F.lit(n)).alias("v"), F.posexplode(F.col("embedding").cast("array<double>")).alias("m", "next"))
    return g, g.join(after, ["v", "m"]).select("mesh_id", "v", "m", (F.col("phi") + 0.3 * F.col("next")).alias("phi"))


VALUES = "ev AS (SELECT l_linenumber AS m, l_returnflag AS mesh_id, sum(l_quantity) / 1000 * l_linenumber AS gt, sum(l_quantity * (1 + l_tax)) / 1000 * l_linenumber AS pred FROM lineitem GROUP BY 1, 2), z AS (SELECT mesh_id, m - 1 AS m, gt, pred FROM ev)"


def eigenvalues(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("mesh_id"), (F.col("l_linenumber") - 1).alias("m"))
    both = rows.agg(F.sum("l_quantity").alias("a"), F.sum(F.col("l_quantity") * (1 + F.col("l_tax"))).alias("b"))
    return tuple(both.select("mesh_id", "m", (F.col(c) / 1000 * (F.col("m") + 1)).alias("lam")) for c in "ab")


@query(f"WITH {MODES} SELECT mesh_id, CAST(m AS INTEGER) AS m, round(abs(sum(g.phi*p.phi) / ((sqrt(sum(g.phi*g.phi))+1e-8)*(sqrt(sum(p.phi*p.phi))+1e-8))), 9) AS similarity FROM g JOIN p USING (mesh_id, v, m) GROUP BY mesh_id, m")
def mode_similarities(spark, sf_dir):
    return rounded(spectral.cosines(*modes(spark, sf_dir)))


@query(f"""WITH {MODES}, z AS (SELECT mesh_id, m, m + sum(g.phi*g.phi) AS gt, m + sum(p.phi*p.phi) AS pred, abs(sum(g.phi*p.phi) / ((sqrt(sum(g.phi*g.phi))+1e-8)*(sqrt(sum(p.phi*p.phi))+1e-8))) AS s FROM g JOIN p USING (mesh_id, v, m) GROUP BY 1, 2)
  SELECT mesh_id, round(avg(((pred-gt)/(gt+1e-6))**2) FILTER (m > 0), 8) AS eigenvalue_rel_mse, round((max(pred) FILTER (m=1) - max(pred) FILTER (m=0)) / (max(gt) FILTER (m=1) - max(gt) FILTER (m=0) + 1e-6), 6) AS spectral_gap_ratio, round(corr(gt, pred), 7) AS eigenvalue_correlation, round(max(pred) FILTER (m=1) / (max(gt) FILTER (m=1) + 1e-6), 8) AS lambda1_ratio,
         round(avg(s), 8) AS eigenvector_similarity_mean, round(avg(s) FILTER (m > 0), 8) AS eigenvector_similarity_mean_skip0, round(avg(((pred-gt)/(gt+1e-6))**2) + 1 - avg(s), 8) AS spectral_distance FROM z GROUP BY mesh_id""")
def spectral_comparison(spark, sf_dir):
    """The embeddings' dimensions as modes; a mode's value is its number and its squared length."""
    g, p = modes(spark, sf_dir)
    gt, pred = (x.groupBy("mesh_id", "m").agg((F.col("m") + F.sum(F.col("phi") * F.col("phi"))).alias("lam")) for x in (g, p))
    out = spectral.comparison(gt, pred, g, p)
    return out.select("mesh_id", *(F.round(c, {"spectral_gap_ratio": 6, "eigenvalue_correlation": 7}.get(c, 8)).alias(c) for c in out.columns[1:]))


@query(f"WITH {VALUES} SELECT mesh_id, round(avg(abs(pred-gt)), 7) AS mae, round(max(abs(pred-gt)), 7) AS max_error, round(corr(gt, pred), 7) AS correlation, round(max(pred) FILTER (m=1), 7) AS fiedler, round(max(pred) FILTER (m=1) - max(pred) FILTER (m=0), 6) AS gap FROM z GROUP BY mesh_id")
def eigenvalue_reports(spark, sf_dir):
    out = spectral.eigenvalue_report(*eigenvalues(spark, sf_dir))
    return out.select("mesh_id", *(F.round(c, 6 if c == "gap" else 7).alias(c) for c in out.columns[1:]))


@query(f"WITH {MODES}, c AS (SELECT g.mesh_id, g.m AS i, p.m AS j, abs(corr(g.phi, p.phi)) AS r FROM g JOIN p ON g.mesh_id = p.mesh_id AND g.v = p.v GROUP BY 1, 2, 3), b AS (SELECT mesh_id, i, arg_max(j, r) AS match, max(r) AS r FROM c GROUP BY 1, 2) SELECT mesh_id, CAST(i AS INTEGER) AS i, CAST(match AS INTEGER) AS match, round(r, 8) AS r FROM b")
def mode_matches(spark, sf_dir):
    return rounded(spectral.best_matches(spectral.cross_correlation(*modes(spark, sf_dir))), 8)


@query(f"WITH {MODES}, c AS (SELECT g.mesh_id, g.m AS i, abs(corr(g.phi, p.phi)) AS r FROM g JOIN p ON g.mesh_id = p.mesh_id AND g.v = p.v AND g.m = p.m GROUP BY 1, 2) SELECT mesh_id, round(avg(r), 8) AS mean, round(min(r), 8) AS least, round(max(r), 8) AS largest, count(*) FILTER (r > 0.96) AS high FROM c GROUP BY 1")
def mode_diagonals(spark, sf_dir):
    return rounded(spectral.diagonal_summary(spectral.cross_correlation(*modes(spark, sf_dir)), 0.96), 8)


@query(f"WITH {MODES}, f AS (SELECT vec_id AS v, unnest(['x', 'y', 'z']) AS axis, unnest([x, y, z]) AS val FROM (SELECT vec_id, {FOLD} FROM embeddings)), c AS (SELECT g.mesh_id, m, axis, sum(phi * (0.01 + (g.v % 5) / 100.0) * val) AS c FROM g JOIN f USING (v) GROUP BY 1, 2, 3) SELECT mesh_id, axis, v, round(sum(phi * c), 7) AS val FROM g JOIN c USING (mesh_id, m) GROUP BY 1, 2, 3")
def area_weighted_reconstruction(spark, sf_dir):
    """Positions rebuilt from all modes; the running sums of the last mode."""
    g, _ = modes(spark, sf_dir)
    f = table(spark, sf_dir, "embeddings").select(F.col("label").alias("mesh_id"), F.col("vec_id").alias("v"), *folded())
    field = f.select("mesh_id", "v", F.explode(F.create_map(*(x for a in "xyz" for x in (F.lit(a), F.col(a))))).alias("axis", "val"))
    mass = f.select("mesh_id", F.col("v").alias("i"), (0.01 + (F.col("v") % 5) / 100.0).alias("area"))
    out = spectral.reconstructed(g, field, mass)
    last = g.agg(F.max("m").alias("last"))
    return out.crossJoin(F.broadcast(last)).where("m = last").select("mesh_id", "axis", "v", F.round("val", 7).alias("val"))  # one row


PAIR = f"{MODES}, fm AS (SELECT g.mesh_id, q.m AS r, g.m AS c, sum(0.02 * q.phi * g.phi) AS val FROM g JOIN p q USING (mesh_id, v) GROUP BY 1, 2, 3)"


def pair_map(spark, sf_dir):
    g, p = (x.withColumnRenamed("mesh_id", "pair_id") for x in modes(spark, sf_dir))
    corr = g.select("pair_id", F.col("v").alias("va"), F.col("v").alias("vb")).distinct()
    mass = corr.select("pair_id", F.col("va").alias("v"), F.lit(0.02).alias("area"))
    return spectral.functional_maps(corr, g, p, mass), g, p


@query(f"WITH {PAIR}, a AS (SELECT x.mesh_id, x.c p, y.c q, sum(x.val*y.val) g FROM fm x JOIN fm y USING (mesh_id, r) GROUP BY 1, 2, 3), b AS (SELECT x.mesh_id, x.r p, y.r q, sum(x.val*y.val) g FROM fm x JOIN fm y USING (mesh_id, c) GROUP BY 1, 2, 3) SELECT mesh_id AS pair_id, round(o, 6) AS orthogonality_error, round(bj, 6) AS bijectivity_error, round(i, 6) AS identity_error, round(d, 8) AS diagonal_ratio FROM (SELECT mesh_id, sqrt(sum((g - (p=q)::INT)**2)) o FROM a GROUP BY 1) JOIN (SELECT mesh_id, sqrt(sum((g - (p=q)::INT)**2)) bj FROM b GROUP BY 1) USING (mesh_id) JOIN (SELECT mesh_id, sqrt(sum((val - (r=c)::INT)**2)) i, sum(CASE WHEN r=c THEN val*val ELSE 0 END)/(sum(val*val)+1e-10) d FROM fm GROUP BY 1) USING (mesh_id)")
def functional_map_quality(spark, sf_dir):
    out = spectral.map_quality(pair_map(spark, sf_dir)[0])
    return out.select("pair_id", *(F.round(c, 8 if c == "diagonal_ratio" else 6).alias(c) for c in ("orthogonality_error", "bijectivity_error", "identity_error", "diagonal_ratio")))


@query(f"WITH {PAIR}, a AS (SELECT g.mesh_id, g.v, fm.r AS m, sum(fm.val*g.phi) AS x FROM g JOIN fm ON g.mesh_id = fm.mesh_id AND g.m = fm.c GROUP BY 1, 2, 3), a2 AS (SELECT mesh_id, v, list(x ORDER BY m) x FROM a GROUP BY 1, 2), b2 AS (SELECT mesh_id, v, list(phi ORDER BY m) x FROM p GROUP BY 1, 2), d AS (SELECT a2.mesh_id, a2.v va, b2.v vb, list_distance(a2.x, b2.x) d FROM a2 JOIN b2 USING (mesh_id)), k AS (SELECT *, row_number() OVER (PARTITION BY mesh_id, va ORDER BY d, vb) rank FROM d), t AS (SELECT vec_id v, {FOLD} FROM embeddings), e AS (SELECT mesh_id, sqrt((s.x-t.x)**2+(s.y-t.y)**2+(s.z-t.z)**2) err FROM k JOIN t s ON vb = s.v JOIN t ON va = t.v WHERE rank = 1), q AS (SELECT mesh_id, va, max((va=vb AND rank=1)::INT) h1, max((va=vb AND rank<=3)::INT) h3, max((va=vb AND rank<=5)::INT) h5, max((va=vb AND rank<=10)::INT) h10 FROM k WHERE rank <= 10 GROUP BY 1, 2), box AS (SELECT label mesh_id, sqrt((max(x)-min(x))**2+(max(y)-min(y))**2+(max(z)-min(z))**2) diag FROM (SELECT label, {FOLD} FROM embeddings) GROUP BY 1) SELECT mesh_id AS pair_id, round(accuracy, 9) AS accuracy, round(top3, 9) AS top3_acc, round(top5, 9) AS top5_acc, round(top10, 9) AS top10_acc, round(mean_error, 7) AS mean_error, round(median_error, 7) AS median_error, round(max_error, 7) AS max_error, round(mean_error/diag, 7) AS mean_error_normalized, round(median_error/diag, 7) AS median_error_normalized FROM (SELECT mesh_id, avg(h1) accuracy, avg(h3) top3, avg(h5) top5, avg(h10) top10 FROM q GROUP BY 1) JOIN (SELECT mesh_id, avg(err) mean_error, median(err) median_error, max(err) max_error FROM e GROUP BY 1) USING (mesh_id) JOIN box USING (mesh_id)")
def pointwise_correspondence(spark, sf_dir):
    fmap, g, p = pair_map(spark, sf_dir)
    b = space(spark, sf_dir).withColumnRenamed("mesh_id", "pair_id")
    truth = b.select("pair_id", F.col("v").alias("va"), F.col("v").alias("gt"))
    out = spectral.correspondence_metrics(spectral.pointwise(fmap, g, p, 10), truth, b)
    return out.drop("diagonal").select("pair_id", *(F.round(c, 9 if "acc" in c else 7).alias(c) for c in out.columns if c not in ("pair_id", "diagonal")))


@query("SELECT l_returnflag AS epoch, round(avg(l_quantity), 7) AS mean_l_quantity, median(l_quantity) AS median_l_quantity, round(avg(l_discount), 7) AS mean_l_discount, median(l_discount) AS median_l_discount FROM lineitem GROUP BY 1")
def epoch_summaries(spark, sf_dir):
    log = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "epoch")
    out = spectral.epoch_summary(log, ["l_quantity", "l_discount"])
    return out.select("epoch", *(F.round(c, 7).alias(c) if c.startswith("mean") else F.col(c) for c in out.columns[1:]))


@query("SELECT method, metric, round(avg(value), 6) AS mean, median(value) AS median FROM (SELECT 'lines' AS method, unnest(['price', 'tax']) AS metric, unnest([l_extendedprice, l_tax]) AS value FROM lineitem UNION ALL SELECT 'orders', unnest(['price', 'tax']), unnest([o_totalprice, 0.5]) FROM orders) GROUP BY 1, 2")
def experiment_table(spark, sf_dir):
    one = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"))
    two = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("price"), F.lit(0.5).alias("tax"))
    return spectral.experiment({"lines": one, "orders": two}, ["price", "tax"]).select("method", "metric", F.round("mean", 6).alias("mean"), "median")


# -- meshes: strips of triangles over all embeddings

CORNERS = "t AS (SELECT f.mesh_id, f.f, v0, v1, v2, p.x x0, p.y y0, p.z z0, q.x x1, q.y y1, q.z z1, r.x x2, r.y y2, r.z z2 FROM faces f JOIN places p ON v0 = p.v JOIN places q ON v1 = q.v JOIN places r ON v2 = r.v), u AS (SELECT *, sqrt(((y1-y0)*(z2-z0)-(z1-z0)*(y2-y0))**2 + ((z1-z0)*(x2-x0)-(x1-x0)*(z2-z0))**2 + ((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0))**2) AS twice FROM t)"


@query(f"WITH {FACES}, {CORNERS}, e AS (SELECT mesh_id, v1 i, v2 j, ((x1-x0)*(x2-x0)+(y1-y0)*(y2-y0)+(z1-z0)*(z2-z0))/twice/2 w FROM u UNION ALL SELECT mesh_id, v2, v0, ((x2-x1)*(x0-x1)+(y2-y1)*(y0-y1)+(z2-z1)*(z0-z1))/twice/2 FROM u UNION ALL SELECT mesh_id, v0, v1, ((x0-x2)*(x1-x2)+(y0-y2)*(y1-y2)+(z0-z2)*(z1-z2))/twice/2 FROM u), b AS (SELECT mesh_id, i, j, w FROM e UNION ALL SELECT mesh_id, j, i, w FROM e) SELECT mesh_id, i, j, round(sum(-w), 6) AS val FROM b GROUP BY 1, 2, 3 UNION ALL SELECT mesh_id, i, i, round(sum(w), 6) FROM b GROUP BY 1, 2")
def cotangent_entries(spark, sf_dir):
    return rounded(topology.cotangent_laplacian(strip_faces(spark, sf_dir), strip_vertices(spark, sf_dir)), 6)


@query(f"WITH {FACES}, {CORNERS}, c AS (SELECT mesh_id, unnest([v0, v1, v2]) AS i, twice / 6 AS third FROM u) SELECT mesh_id, i, round(sum(third), 8) AS area FROM c GROUP BY 1, 2")
def barycentric_masses(spark, sf_dir):
    return rounded(topology.barycentric_mass(strip_faces(spark, sf_dir), strip_vertices(spark, sf_dir)), 8)


@query(f"WITH {FACES}, {CORNERS}, s AS (SELECT mesh_id, unnest([sqrt((x1-x2)**2+(y1-y2)**2+(z1-z2)**2), sqrt((x2-x0)**2+(y2-y0)**2+(z2-z0)**2), sqrt((x0-x1)**2+(y0-y1)**2+(z0-z1)**2)]) AS length FROM u) SELECT mesh_id, round(avg(length), 9) AS length FROM s GROUP BY 1")
def mean_edge_lengths(spark, sf_dir):
    return rounded(topology.mean_edge_length(strip_faces(spark, sf_dir), strip_vertices(spark, sf_dir)))


@query(f"WITH {FACES}, {CORNERS}, m AS (SELECT mesh_id, unnest([v0, v1, v2]) AS v, twice, (f % 17)::DOUBLE AS val FROM u) SELECT mesh_id, v, round(sum(twice * val) / sum(twice), 7) AS val FROM m GROUP BY 1, 2")
def face_means(spark, sf_dir):
    f = strip_faces(spark, sf_dir)
    values = f.select("mesh_id", "f", (F.col("f") % 17).cast("double").alias("val"))
    return rounded(topology.face_to_vertex(values, f, strip_vertices(spark, sf_dir)), 7)


@query(f"WITH {FACES}, {CORNERS}, h AS (SELECT mesh_id, f, unnest([0, 1, 2]) AS k, v0, v1, v2, x1-x0 ax, y1-y0 ay, z1-z0 az, x2-x0 bx, y2-y0 by_, z2-z0 bz, (x1*x1+y1-z1)-(x0*x0+y0-z0) da, (x2*x2+y2-z2)-(x0*x0+y0-z0) db, twice FROM u), s AS (SELECT *, ax*ax+ay*ay+az*az aa, ax*bx+ay*by_+az*bz ab, bx*bx+by_*by_+bz*bz bb FROM h), c AS (SELECT *, (da*bb-db*ab)/(aa*bb-ab*ab) ca, (db*aa-da*ab)/(aa*bb-ab*ab) cb FROM s), g AS (SELECT mesh_id, CASE k WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END AS v, twice, ca*ax+cb*bx gx, ca*ay+cb*by_ gy, ca*az+cb*bz gz FROM c) SELECT mesh_id, v, round(sum(twice*gx)/sum(twice), 5) AS gx, round(sum(twice*gy)/sum(twice), 5) AS gy, round(sum(twice*gz)/sum(twice), 5) AS gz FROM g GROUP BY 1, 2")
def vertex_gradients(spark, sf_dir):
    """The gradient of x^2 + y - z, in SQL by each face's own metric."""
    v = strip_vertices(spark, sf_dir)
    field = v.select("mesh_id", "v", (F.col("x") * F.col("x") + F.col("y") - F.col("z")).alias("val"))
    return rounded(geodesics.vertex_gradient(strip_faces(spark, sf_dir), v, field), 5)


@query("SELECT 0 AS mesh_id, vec_id AS v, CASE WHEN vec_id % 7 = 6 THEN vec_id ELSE vec_id - vec_id % 7 END AS component FROM embeddings")
def graph_components(spark, sf_dir):
    """Components of chunks of consecutive embeddings, linked in both orders."""
    e = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("mesh_id"), F.col("vec_id").alias("v"))
    links = e.where("v % 7 < 5").select("mesh_id", F.when(F.col("v") % 2 == 0, F.col("v")).otherwise(F.col("v") + 1).alias("a"), F.when(F.col("v") % 2 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("b"))
    inside = links.join(e.select(F.col("v").alias("a")), "a", "left_semi").join(e.select(F.col("v").alias("b")), "b", "left_semi")
    return graphs.components(inside, e)


@query(f"WITH {FACES} SELECT mesh_id, count(*) AS faces, min(f) AS component FROM faces GROUP BY mesh_id")
def face_groups(spark, sf_dir):
    """A strip's faces are one component, named by its first face."""
    out = graphs.face_components(strip_faces(spark, sf_dir))
    return out.groupBy("mesh_id", "component").agg(F.count("*").alias("faces"))


@query(f"WITH {FACES}, r AS (SELECT DISTINCT mesh_id, unnest([a, b]) AS v FROM edges WHERE faces = 1) SELECT mesh_id, count(*) AS vertices FROM r GROUP BY mesh_id")
def boundary_loop_sizes(spark, sf_dir):
    """Vertices on boundaries, over all loops of a mesh."""
    loops = graphs.component_sizes(graphs.boundary_loops(strip_faces(spark, sf_dir)))
    return loops.groupBy("mesh_id").agg(F.sum("size").alias("vertices"))


@query("WITH r AS (SELECT label AS mesh_id, vec_id AS v, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)) SELECT mesh_id, v AS component, CASE WHEN n % 2 = 0 THEN n // 2 ELSE n END AS size FROM r WHERE n > 4 AND (r = 0 OR r = 1 AND n % 2 = 0)")
def band_loops(spark, sf_dir):
    """Each label's embeddings as a closed band of triangles: an even number has two boundary loops, an odd one's band is twisted and has one."""
    whole = Window.partitionBy("mesh_id")
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("mesh_id"), F.col("vec_id").alias("v"))
    e = e.select("mesh_id", "v", (F.row_number().over(whole.orderBy("v")) - 1).alias("r"), F.count("*").over(whole).alias("n")).where("n > 4")
    ahead = lambda k: e.select("mesh_id", F.col("v").alias(f"v{k}"), F.pmod(F.col("r") - k, F.col("n")).alias("r"))
    faces = e.select("mesh_id", F.col("v").alias("v0"), "r").join(ahead(1), ["mesh_id", "r"]).join(ahead(2), ["mesh_id", "r"]).select("mesh_id", F.col("r").alias("f"), "v0", "v1", "v2")
    return graphs.component_sizes(graphs.boundary_loops(faces))


@query(f"WITH {SPACE}, s AS (SELECT *, CASE WHEN v % 5 = 0 THEN 'nan'::DOUBLE WHEN v % 3 = 0 THEN NULL ELSE x END AS dist FROM space) SELECT mesh_id, v AS source, v, coalesce(CASE WHEN isnan(dist) THEN NULL ELSE dist END, y) AS dist, CASE WHEN dist IS NULL OR isnan(dist) THEN 1 ELSE 0 END AS method FROM s")
def first_distances(spark, sf_dir):
    s = space(spark, sf_dir)
    one = s.select("mesh_id", F.col("v").alias("source"), "v", F.when(F.col("v") % 5 == 0, float("nan")).when(F.col("v") % 3 == 0, None).otherwise(F.col("x")).alias("dist"))
    return geodesics.first_known(one, s.select("mesh_id", F.col("v").alias("source"), "v", F.col("y").alias("dist")))


@query("WITH m AS (SELECT event_type AS mesh_id, user_id AS source, avg(value) AS c, max(value) AS x FROM events GROUP BY 1, 2), k AS (SELECT DISTINCT event_type AS mesh_id FROM events UNION SELECT 'none') SELECT mesh_id, round(coalesce(avg(c), 0), 7) AS mean_correlation, round(coalesce(stddev_pop(c), 0), 7) AS std_correlation, round(coalesce(avg(x), 1), 7) AS mean_mae, count(c) AS sources FROM k LEFT JOIN m USING (mesh_id) GROUP BY 1")
def multi_source_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = e.groupBy(F.col("event_type").alias("mesh_id"), F.col("user_id").alias("source")).agg(F.avg("value").alias("correlation"), F.max("value").alias("mean_error"), F.max("value").alias("max_error"), F.avg("value").alias("monotonicity"))
    every = e.select(F.col("event_type").alias("mesh_id")).distinct().union(spark.range(1).select(F.lit("none")))
    out = geodesics.multi_source(m, every)
    return rounded(out.select("mesh_id", "mean_correlation", "std_correlation", "mean_mae", "sources"), 7)


@query(f"WITH {SPACE}, c AS (SELECT mesh_id, arg_max(v, x) AS source FROM space GROUP BY 1), g AS (SELECT mesh_id, source, v, y AS g, sqrt(x*x+z*z) AS d FROM space JOIN c USING (mesh_id)), o AS (SELECT mesh_id, g AS at_source FROM g WHERE v = source) SELECT mesh_id, source, round(min(g), 9) AS least, round(max(g), 9) AS largest, round(avg(g), 9) AS mean, count(*) FILTER (g > at_source + 1e-10) AS violations, round(corr(g, d), 7) AS distance_correlation, arg_max(v, g) = source AS max_at_source FROM g JOIN o USING (mesh_id) GROUP BY mesh_id, source")
def maximum_principle(spark, sf_dir):
    """The checks on y as a field, from each label's vertex of the largest x; the monotonicity is drawn by hash and has no SQL."""
    s = space(spark, sf_dir)
    at = s.join(s.groupBy("mesh_id").agg(F.max_by("v", "x").alias("source")), "mesh_id")
    out = geodesics.maximum_principle(at.select("mesh_id", "source", "v", F.col("y").alias("g")), at.select("mesh_id", "source", "v", F.sqrt(F.col("x") * F.col("x") + F.col("z") * F.col("z")).alias("dist")))
    return out.select("mesh_id", "source", *(F.round(c, 9).alias(c) for c in ("least", "largest", "mean")), "violations", F.round("distance_correlation", 7).alias("distance_correlation"), "max_at_source")


# -- surfaces: a part is a surface of order three

COEFFICIENTS = [(1, 0, 0.01), (0, 1, -0.007), (2, 0, 0.02), (1, 1, 0.004), (0, 2, -0.015), (3, 0, 0.003), (2, 1, 0.002), (1, 2, -0.001), (0, 3, 0.0025)]


def part_surfaces(spark, sf_dir):
    terms = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col("p_size") * c + F.col("p_retailprice") * c / 1000).alias("c")) for i, j, c in COEFFICIENTS))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("surface_id"), terms.alias("terms"), ((F.col("p_partkey") % 7) / 10.0).alias("ox"), ((F.col("p_partkey") % 5) / 10.0).alias("oy"))


def _poly(dx, dy):
    import math

    parts = [f"kk * ({c * math.perm(i, dx) * math.perm(j, dy)}) * xx**{i - dx} * yy**{j - dy}" for i, j, c in COEFFICIENTS if i >= dx and j >= dy]
    return " + ".join(parts) or "0"


# the SQL reads curvature off the fundamental forms, and its gradients off central differences of H and K
SURFACE = f"""s AS (SELECT p_partkey AS surface_id, p_size + p_retailprice / 1000 AS kk, (p_partkey % 7) / 10.0 AS ox, (p_partkey % 5) / 10.0 AS oy FROM part),
  grid AS (SELECT i AS p, (i // 3) * 0.5 - 0.5 AS x, (i % 3) * 0.5 - 0.5 AS y FROM (SELECT unnest(generate_series(0, 8)) AS i)),
  pts AS (SELECT surface_id, p, x, y, kk, x + ox + dx AS xx, y + oy + dy AS yy, dx, dy FROM s, grid, (SELECT unnest([0, 1e-4, -1e-4, 0, 0]) AS dx, unnest([0, 0, 0, 1e-4, -1e-4]) AS dy)),
  d AS (SELECT *, {_poly(0, 0)} AS z, {_poly(1, 0)} AS zx, {_poly(0, 1)} AS zy, {_poly(2, 0)} AS zxx, {_poly(1, 1)} AS zxy, {_poly(0, 2)} AS zyy FROM pts),
  f AS (SELECT *, 1+zx*zx AS e1, zx*zy AS f1, 1+zy*zy AS g1, zxx/sqrt(1+zx*zx+zy*zy) AS l2, zxy/sqrt(1+zx*zx+zy*zy) AS m2, zyy/sqrt(1+zx*zx+zy*zy) AS n2 FROM d),
  h AS (SELECT *, (e1*n2 - 2*f1*m2 + g1*l2) / (2*(e1*g1-f1*f1)) AS hh, (l2*n2-m2*m2)/(e1*g1-f1*f1) AS gg FROM f)"""


def _sampled(spark, sf_dir):
    return surface_rows.regular_sampler(9)(part_surfaces(spark, sf_dir), 0.5)


@query(f"WITH {SURFACE} SELECT surface_id, p, round(z, 12) AS z, round(hh, 7) AS mean_curvature, round(gg, 7) AS gauss_curvature, round(hh + sqrt(greatest(hh*hh-gg, 0)), 7) AS k1, round(hh - sqrt(greatest(hh*hh-gg, 0)), 7) AS k2 FROM h WHERE dx = 0 AND dy = 0")
def part_curvatures(spark, sf_dir):
    d = surface_rows.differential(_sampled(spark, sf_dir))
    return d.select("surface_id", "p", F.round("z", 12).alias("z"), F.round("H", 7).alias("mean_curvature"), F.round("K", 7).alias("gauss_curvature"), F.round("k1", 7).alias("k1"), F.round("k2", 7).alias("k2"))


@query(f"WITH {SURFACE}, e AS (SELECT surface_id, p, dx, dy, hh, gg FROM h), c AS (SELECT surface_id, p, (max(hh) FILTER (dx > 0) - max(hh) FILTER (dx < 0)) / 2e-4 AS hx, (max(hh) FILTER (dy > 0) - max(hh) FILTER (dy < 0)) / 2e-4 AS hy, (max(gg) FILTER (dx > 0) - max(gg) FILTER (dx < 0)) / 2e-4 AS gx, (max(gg) FILTER (dy > 0) - max(gg) FILTER (dy < 0)) / 2e-4 AS gy FROM e GROUP BY 1, 2) SELECT surface_id, p, round(hx, 3) + 0.0 AS hx, round(hy, 3) + 0.0 AS hy, round(gx, 3) + 0.0 AS gx, round(gy, 3) + 0.0 AS gy FROM c")
def part_curvature_gradients(spark, sf_dir):
    d = surface_rows.differential(_sampled(spark, sf_dir))
    return rounded(d.select("surface_id", "p", F.col("Hx").alias("hx"), F.col("Hy").alias("hy"), F.col("Kx").alias("gx"), F.col("Ky").alias("gy")), 3)


@query(f"WITH {SURFACE}, o AS (SELECT surface_id, {_poly(1, 0)} AS zx, {_poly(0, 1)} AS zy, {_poly(2, 0)} AS zxx, {_poly(1, 1)} AS zxy, {_poly(0, 2)} AS zyy FROM (SELECT surface_id, kk, ox AS xx, oy AS yy FROM s)), w AS (SELECT surface_id, sign((1+zy*zy)*zxx - 2*zx*zy*zxy + (1+zx*zx)*zyy) AS turn FROM o) SELECT surface_id, p, round(-zx/sqrt(1+zx*zx+zy*zy) * CASE WHEN turn < 0 THEN -1 ELSE 1 END, 8) + 0.0 AS nx, round(1/sqrt(1+zx*zx+zy*zy) * CASE WHEN turn < 0 THEN -1 ELSE 1 END, 8) AS nz FROM h JOIN w USING (surface_id) WHERE dx = 0 AND dy = 0")
def flipped_normals(spark, sf_dir):
    d = surface_rows.differential(_sampled(spark, sf_dir), flip_normals=True)
    return rounded(d.select("surface_id", "p", "nx", "nz"), 8)


@query(f"WITH {SURFACE} SELECT surface_id, round(sum(sqrt(1+zx*zx+zy*zy)) * 0.25, 7) AS area FROM h WHERE dx = 0 AND dy = 0 GROUP BY 1")
def part_areas(spark, sf_dir):
    return rounded(surface_rows.areas(part_surfaces(spark, sf_dir), 9, 0.5), 7)


@query("SELECT p_partkey AS surface_id, CAST(CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 9 END AS BIGINT) AS points, 4 AS origin FROM part")
def origins_in_grids(spark, sf_dir):
    """Grids of four points get the origin added, grids of nine have it."""
    s = part_surfaces(spark, sf_dir)
    g = surface_rows.regular_sampler(4)(s.where("surface_id % 2 = 0"), 0.5).unionByName(surface_rows.regular_sampler(9)(s.where("surface_id % 2 = 1"), 0.5))
    out = surface_rows.with_origin(g.select("surface_id", "p", "x", "y"), -0.5, 0.5)
    return out.groupBy("surface_id").agg(F.count("*").alias("points"), F.max(F.when(F.col("origin"), F.col("p"))).cast("int").alias("origin"))


# -- correspondences and scalar functions

@query("WITH b AS (SELECT ps.vec_id AS ref_src, (ps.vec_id * 3 + 1) % n AS ref_dst FROM embeddings ps, (SELECT count(*) n FROM embeddings)), a AS (SELECT vec_id AS ref, vec_id * 2 AS va FROM embeddings), t AS (SELECT vec_id AS ref, vec_id + 5 AS vb FROM embeddings), j AS (SELECT a.ref, va, vb FROM a JOIN b ON a.ref = b.ref_src JOIN t ON t.ref = b.ref_dst) SELECT ref, va, vb FROM j, (SELECT count(*) n FROM embeddings) WHERE va BETWEEN 0 AND n - 1 AND vb BETWEEN 0 AND n - 1")
def bridged_matches(spark, sf_dir):
    """Matches over a bridge, less those out of either mesh's range."""
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    bridge = e.select(F.col("vec_id").alias("ref_src"), ((F.col("vec_id") * 3 + 1) % n).alias("ref_dst"))
    a, b = e.select(F.col("vec_id").alias("ref"), (F.col("vec_id") * 2).alias("v")), e.select(F.col("vec_id").alias("ref"), (F.col("vec_id") + 5).alias("v"))
    return correspondence.in_range(correspondence.by_bridge(a, bridge, b), n, n)


@query(f"WITH {SPACE}, c AS (SELECT v AS ref, v AS va, v * 3 % ((SELECT count(*) FROM space) // 2 + 1) AS vb FROM space), w AS (SELECT vb, arg_max(x, ref) AS val FROM c JOIN space ON va = v GROUP BY vb) SELECT v, round(coalesce(val, -1), 9) AS val FROM space LEFT JOIN w ON v = vb")
def transferred_values(spark, sf_dir):
    s = space(spark, sf_dir)
    corr = s.select(F.col("v").alias("ref"), F.col("v").alias("va"), (F.col("v") * 3 % (s.count() // 2 + 1)).alias("vb"))
    return rounded(correspondence.transfer(corr, s.select("v", F.col("x").alias("val")), s.select("v"), -1.0))


@query(f"WITH {SPACE}, k AS (SELECT mesh_id, v, v + 1000 AS target FROM space WHERE v % 3 <> 0), d AS (SELECT a.mesh_id, a.v, k.target, (a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2 AS d, b.v AS n FROM space a JOIN k ON a.mesh_id = k.mesh_id JOIN space b ON k.v = b.v WHERE a.v % 3 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY mesh_id, v ORDER BY d, n) AS i FROM d) SELECT mesh_id, v, target FROM k UNION ALL SELECT mesh_id, v, target FROM r WHERE i = 1")
def imputed_targets(spark, sf_dir):
    """Every third vertex takes the target of the nearest one that has any; rows of one vertex: the last wins."""
    s = space(spark, sf_dir)
    some = s.where("v % 3 <> 0")
    corr = some.select("mesh_id", F.lit(0).alias("ref"), F.col("v").alias("va"), F.col("v").alias("vb")).unionByName(some.select("mesh_id", F.lit(1).alias("ref"), F.col("v").alias("va"), (F.col("v") + 1000).alias("vb")))
    return spectral.dense_truth(corr, s.select("mesh_id", "v", F.array("x", "y", "z").alias("p")))


@query(f"WITH {SPACE}, c AS (SELECT *, min(x) OVER w x0, max(x) OVER w x1, min(y) OVER w y0, max(y) OVER w y1, min(z) OVER w z0, max(z) OVER w z1 FROM space WINDOW w AS (PARTITION BY mesh_id)) SELECT mesh_id, v, round((x-x0)/(x1-x0), 9) AS red, round((y-y0)/(y1-y0), 9) AS green, round((z-z0)/(z1-z0), 9) AS blue FROM c")
def vertex_colors(spark, sf_dir):
    return rounded(points.position_colors(space(spark, sf_dir)))


@query(f"WITH {SPACE}, n AS (SELECT mesh_id, v, x/sqrt(x*x+y*y+z*z) nx, y/sqrt(x*x+y*y+z*z) ny, z/sqrt(x*x+y*y+z*z) nz FROM space) SELECT mesh_id, v, round(sqrt(1 - nz*nz), 8) AS length_before, 0.0::DOUBLE AS px, 0.0::DOUBLE AS py, 1.0::DOUBLE AS pz FROM n")
def aligned_normals(spark, sf_dir):
    """Unit vectors under the rotation that takes them to +Z: they end there."""
    s = space(spark, sf_dir)
    n = points.unit([F.col(a) for a in "xyz"])
    rows = s.select("mesh_id", F.col("v").alias("patch"), F.lit(0).alias("neighbor"), *(c.alias(f"n{a}") for c, a in zip(n, "xyz")), *(c.alias(f"p{a}") for c, a in zip(n, "xyz")), F.round(F.sqrt(1 - n[2] * n[2]), 8).alias("length_before"))
    out = patches.posed(rows, [patches.align_normal])
    return out.select("mesh_id", F.col("patch").alias("v"), "length_before", *((F.abs(F.round(f"p{a}", 7))).alias(f"p{a}") for a in "xyz"))


@query(f"WITH {SPACE}, r AS (SELECT mesh_id, v, row_number() OVER (PARTITION BY mesh_id ORDER BY z, v) AS lo, row_number() OVER (PARTITION BY mesh_id ORDER BY z DESC, v) AS hi FROM space) SELECT mesh_id, v, 'fixed' AS role FROM r WHERE lo <= 5 UNION ALL SELECT mesh_id, v, 'handle' FROM r WHERE hi <= 5")
def constraint_vertices(spark, sf_dir):
    return points.extremes(space(spark, sf_dir), "z", 5)


@query(f"WITH {SPACE}, c AS (SELECT mesh_id, v, x - avg(x) OVER w x, y - avg(y) OVER w y, z - avg(z) OVER w z FROM space WINDOW w AS (PARTITION BY mesh_id)) SELECT mesh_id, arg_min(v, x*x+y*y+z*z) AS source FROM c GROUP BY 1")
def centroid_sources(spark, sf_dir):
    return points.nearest_to_centroid(space(spark, sf_dir))


@query("SELECT l_orderkey AS patch, l_linenumber AS rank, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS pos FROM lineitem")
def places_in_patches(spark, sf_dir):
    return points.patch_positions(lines(spark, sf_dir)).select("patch", "rank", "pos")


@query("SELECT p_partkey AS center, round(coalesce(avg(l_quantity), 1e-6), 9) AS area FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1")
def mass_diagonal(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.lit(0).alias("mesh_id"), F.col("l_partkey").alias("center"), F.col("l_quantity").alias("area"))
    every = table(spark, sf_dir, "part").select(F.lit(0).alias("mesh_id"), F.col("p_partkey").alias("v"))
    return rounded(sparse.mass(rows, every).select(F.col("i").alias("center"), "area"))


@query("SELECT event_id, round(CASE WHEN value > 30 THEN value ELSE ln(1 + exp(value)) END, 9) AS softplus, round(degrees(acos(least(abs(sin(value)), 1))), 6) AS angle, round(0.1 + 0.9 * least(greatest(value / 20, 0), 1), 9) AS ramp, round(0.5 * (0.01 + 0.99 * 0.5 * (1 + cos(least(value / 100, 1) * pi()))), 9) AS rate FROM events")
def scalar_functions(spark, sf_dir):
    v = F.col("value")
    return rounded(table(spark, sf_dir, "events").select("event_id", scalars.softplus(v).alias("softplus"), F.round(scalars.angle_degrees(F.sin(v)), 6).alias("angle"), scalars.ramp(v, 0.1, 1.0, 20).alias("ramp"), scalars.cosine_rate(v, 100, 0.5).alias("rate")))


@query("SELECT event_type AS name, round(avg(value), 9) AS value FROM events GROUP BY 1")
def averaged_metrics(spark, sf_dir):
    return rounded(metrics.mean_by_name(table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "value")))


@query("SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def nation_union(spark, sf_dir):
    c, s = (table(spark, sf_dir, t).select(F.col(f"{t[0]}_nationkey").alias("k")) for t in ("customer", "supplier"))
    return sampling.union_sorted(c, s, "k")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def remaining_keys(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return sampling.without(table(spark, sf_dir, "orders").select("o_orderkey"), returned, ["o_orderkey"])


# -- kernels and inference: no SQL, held against numpy in the tests


@query()
def heat_distances(spark, sf_dir):
    """Heat distances from each strip's vertex nearest to its centroid, with their metrics against exact ones."""
    v, f = strip_vertices(spark, sf_dir), strip_faces(spark, sf_dir)
    sources = points.nearest_to_centroid(v)
    return geodesics.geodesic_metrics(geodesics.mesh_geodesics(f, v, sources), geodesics.exact_geodesics(f, v, sources))


@query()
def greens_checks(spark, sf_dir):
    v, f = strip_vertices(spark, sf_dir), strip_faces(spark, sf_dir)
    sources = points.nearest_to_centroid(v)
    g = geodesics.greens_functions(topology.cotangent_laplacian(f, v), topology.barycentric_mass(f, v), sources)
    return geodesics.maximum_principle(g, geodesics.exact_geodesics(f, v, sources))


@query()
def deformed_strips(spark, sf_dir):
    """Strips bent by moving the highest vertices up and holding the lowest."""
    v, f = strip_vertices(spark, sf_dir), strip_faces(spark, sf_dir)
    ends = points.extremes(v, "z", 5).join(v, ["mesh_id", "v"])
    targets = ends.select("mesh_id", "v", "x", "y", (F.col("z") + F.when(F.col("role") == "handle", 0.5).otherwise(0.0)).alias("z"))
    positive = geodesics.edge_weights(topology.cotangent_laplacian(f, v)).withColumn("w", F.abs("w"))
    return geodesics.deformed(v, positive, targets, rounds=5)


@query()
def learned_operator(spark, sf_dir):
    """The stiffness matrix that a seeded transformer gives every label's points, times their x."""
    v = space(spark, sf_dir)
    own = learned.operators(v, transformer.seeded_weights(0, outputs=3), 8, 4, gradient=True)
    return sparse.matvec(own.stiffness, v.select("mesh_id", "v", F.col("x").alias("val")))


@query(f"WITH {SPACE}, d AS (SELECT a.mesh_id, a.v AS center, b.v AS neighbor, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2 FROM space a JOIN space b ON a.mesh_id = b.mesh_id AND a.v <> b.v) SELECT mesh_id, center, CAST(rank AS INTEGER) AS rank, neighbor, round(sqrt(d2), 9) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id, center ORDER BY d2, neighbor) AS rank FROM d) WHERE rank <= 6")
def grid_neighbors(spark, sf_dir):
    """The six nearest neighbours of every vertex by grid cells."""
    from .operators import neighbors

    return rounded(neighbors.grid_knn(space(spark, sf_dir), 6))


@query("WITH r AS (SELECT l_returnflag AS method, l_linestatus AS phase, min(l_extendedprice) AS best FROM lineitem GROUP BY 1, 2) SELECT method, phase, best, round(best / sum(best) OVER (PARTITION BY method), 9) AS share FROM r")
def fastest_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("phase"), F.col("l_orderkey").alias("repeat"), F.col("l_extendedprice").alias("seconds"))
    return rounded(metrics.timings(runs))


@query("SELECT event_id, round(abs(value - user_id), 9) AS abs_error, round(100 * abs(value - user_id) / (abs(user_id) + 1e-10), 6) AS percent_error FROM events")
def estimate_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return metrics.curvature_errors(e, "user_id", "value").select("event_id", F.round("abs_error", 9).alias("abs_error"), F.round("percent_error", 6).alias("percent_error"))


@query()
def distance_validation(spark, sf_dir):
    """Every strip's heat distances from five farthest points, against exact ones.

    Faces are written with their corners' places: four operators and the exact distances read them, and one plan
    with all of their joins would broadcast the vertices thirty times.
    """
    scratch = Scratch(spark, "strips")
    v = scratch.put(strip_vertices(spark, sf_dir))
    f = scratch.put(topology.with_corners(strip_faces(spark, sf_dir), v.hint("merge")))
    return geodesics.validated(topology.cotangent_laplacian(f, v), topology.barycentric_mass(f, v), None, f, v)
