"""Queries over the driver's tables, one or more for each operator family, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .operators import correspondence, metrics, neighbors, points, sparse, topology
from .plans import kernels

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud(spark, sf_dir):
    """Embeddings as points of one mesh."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit(0).alias("mesh_id"), F.col("vec_id").alias("v"), F.col("embedding").cast("array<double>").alias("p"), "label")


def folded(embedding: str = "embedding"):
    """x, y and z of an embedding: the sums of every third dimension."""
    part = lambda d: F.aggregate(F.transform(F.col(embedding), lambda x, i: F.when(i % 3 == d, x.cast("double")).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return [part(d).alias(a) for d, a in enumerate("xyz")]


def space(spark, sf_dir):
    """Embeddings folded into three dimensions as vertices, a mesh per label."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("mesh_id"), F.col("vec_id").alias("v"), *folded())


def weights(spark, sf_dir, k=10):
    near = neighbors.knn(cloud(spark, sf_dir).drop("label"), k)
    return near.withColumn("w", 1 / (F.col("dist") * F.col("dist") + 1e-8))


def strip_vertices(spark, sf_dir):
    """All embeddings, folded, in meshes of STRIP consecutive ones."""
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / STRIP).alias("mesh_id"), F.col("vec_id").alias("v"), *folded())


def strip_faces(spark, sf_dir):
    v = strip_vertices(spark, sf_dir).select("mesh_id", "v")
    last = v.select(F.col("mesh_id"), (F.col("v") - 2).alias("v"))
    copies = F.explode(F.when(F.col("v") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("k")
    return v.join(last, ["mesh_id", "v"]).select("mesh_id", "v", copies).select("mesh_id", (2 * F.col("v") + F.col("k")).alias("f"), F.col("v").alias("v0"), (F.col("v") + 1).alias("v1"), (F.col("v") + 2).alias("v2"))


FOLD = ", ".join(f"list_sum([CAST(embedding[k] AS DOUBLE) for k in generate_series({d + 1}, len(embedding), 3)]) AS {a}" for d, a in enumerate("xyz"))
SPACE = f"space AS (SELECT label AS mesh_id, vec_id AS v, {FOLD} FROM embeddings)"
KNN = """
  d AS (SELECT a.vec_id AS center, b.vec_id AS neighbor, list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d2
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
  knn AS (SELECT center, neighbor, sqrt(d2) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY center ORDER BY d2, neighbor) AS rank FROM d) WHERE rank <= 10),
  w AS (SELECT center, neighbor, 1 / (dist * dist + 1e-8) AS w FROM knn),
  off AS (SELECT i, j, sum(val) AS val FROM (SELECT center i, neighbor j, -w val FROM w UNION ALL SELECT neighbor, center, -w FROM w) GROUP BY i, j),
  s AS (SELECT * FROM off UNION ALL SELECT i, i, -sum(val) FROM off GROUP BY i)"""
#: Strips of triangles over consecutive embeddings, in meshes of STRIP vertices; every tenth face is doubled, so some edges have more than two.
STRIP = 300
FACES = f"""
  places AS (SELECT vec_id // {STRIP} AS mesh_id, vec_id AS v, {FOLD} FROM embeddings),
  faces AS (SELECT a.mesh_id, 2 * a.v + k AS f, a.v AS v0, a.v + 1 AS v1, a.v + 2 AS v2 FROM places a JOIN places b ON b.v = a.v + 2 AND a.mesh_id = b.mesh_id, (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR a.v % 10 = 0),
  sides AS (SELECT mesh_id, f, least(p, q) a, greatest(p, q) b FROM (SELECT mesh_id, f, v0 p, v1 q FROM faces UNION ALL SELECT mesh_id, f, v1, v2 FROM faces UNION ALL SELECT mesh_id, f, v2, v0 FROM faces)),
  edges AS (SELECT mesh_id, a, b, count(*) AS faces FROM sides GROUP BY mesh_id, a, b)"""


@query(f"WITH {KNN}, f AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) x, label FROM embeddings), sf AS (SELECT i, sum(val * x) AS sfx, count(*) AS nnz FROM s JOIN f ON s.j = f.vec_id GROUP BY i) SELECT label, count(*) AS n, round(sum(sfx), 4) AS sum_sf, round(avg(nnz), 6) AS avg_nnz FROM sf JOIN f ON sf.i = f.vec_id GROUP BY label")
def knn_stiffness_by_label(spark, sf_dir):
    base = cloud(spark, sf_dir)
    s = sparse.stiffness(weights(spark, sf_dir))
    field = base.select("mesh_id", "v", F.col("p")[0].alias("val"))
    out = sparse.matvec(s, field).join(s.groupBy(F.col("i").alias("v")).agg(F.count("*").alias("nnz")), "v").join(base.select("v", "label"), "v")
    return out.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("val"), 4).alias("sum_sf"), F.round(F.avg("nnz"), 6).alias("avg_nnz"))


@query(f"WITH {KNN} SELECT center, CAST(rank AS INTEGER) AS rank, neighbor, round(dist, 9) AS dist FROM knn")
def knn_edges(spark, sf_dir):
    return weights(spark, sf_dir).select("center", "rank", "neighbor", F.round("dist", 9).alias("dist"))


@query("WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), r AS (SELECT o_orderkey, count(l_partkey) n FROM orders LEFT JOIN e ON o_orderkey = l_orderkey GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS nnz, round(avg(n), 9) AS avg_row, max(n) AS max_row, min(n) AS min_row, round(100.0 * sum(n) / (count(*)::DOUBLE * count(*)), 9) AS density FROM r")
def lineitem_sparsity(spark, sf_dir):
    coo = table(spark, sf_dir, "lineitem").select(F.lit(0).alias("mesh_id"), F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("val"))
    every = table(spark, sf_dir, "orders").select(F.lit(0).alias("mesh_id"), F.col("o_orderkey").alias("v"))
    return sparse.sparsity(sparse.summed(coo), every).select("nnz", F.round("avg_row", 9).alias("avg_row"), "max_row", "min_row", F.round("density", 9).alias("density"))


@query("SELECT l_orderkey AS v, round(sum(l_quantity * p_size), 6) AS val FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def lineitem_matvec(spark, sf_dir):
    coo = table(spark, sf_dir, "lineitem").select(F.lit(0).alias("mesh_id"), F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("val"))
    x = table(spark, sf_dir, "part").select(F.lit(0).alias("mesh_id"), F.col("p_partkey").alias("v"), F.col("p_size").cast("double").alias("val"))
    return sparse.matvec(coo, x).select("v", F.round("val", 6).alias("val"))


@query(f"WITH {SPACE}, c AS (SELECT mesh_id, v, x - avg(x) OVER w x, y - avg(y) OVER w y, z - avg(z) OVER w z FROM space WINDOW w AS (PARTITION BY mesh_id)), m AS (SELECT *, max(sqrt(x*x+y*y+z*z)) OVER (PARTITION BY mesh_id) far FROM c) SELECT mesh_id, v, round(x/far, 8) x, round(y/far, 8) y, round(z/far, 8) z FROM m")
def normalized_points(spark, sf_dir):
    return points.normalized(space(spark, sf_dir)).select("mesh_id", "v", *(F.round(a, 8).alias(a) for a in "xyz"))


@query(f"WITH {SPACE} SELECT mesh_id, round(sqrt((max(x)-min(x))**2 + (max(y)-min(y))**2 + (max(z)-min(z))**2), 9) AS diagonal FROM space GROUP BY mesh_id")
def bounding_diagonals(spark, sf_dir):
    return points.bounding_diagonal(space(spark, sf_dir)).select("mesh_id", F.round("diagonal", 9).alias("diagonal"))


@query(f"WITH {SPACE}, a AS (SELECT * FROM space WHERE v % 2 = 0), b AS (SELECT * FROM space WHERE v % 2 = 1), d AS (SELECT a.mesh_id, a.v av, b.v bv, (a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2 d FROM a JOIN b USING (mesh_id)), p AS (SELECT mesh_id, avg(m) m FROM (SELECT mesh_id, av, min(d) m FROM d GROUP BY 1, 2) GROUP BY 1), q AS (SELECT mesh_id, avg(m) m FROM (SELECT mesh_id, bv, min(d) m FROM d GROUP BY 1, 2) GROUP BY 1) SELECT mesh_id, round(p.m + q.m, 9) AS chamfer FROM p JOIN q USING (mesh_id)")
def chamfer_halves(spark, sf_dir):
    s = space(spark, sf_dir).select("mesh_id", "v", F.array("x", "y", "z").alias("p"))
    return neighbors.chamfer(s.where("v % 2 = 0"), s.where("v % 2 = 1")).select("mesh_id", F.round("chamfer", 9).alias("chamfer"))


@query(f"WITH {SPACE} SELECT a.mesh_id, a.v AS a, b.v AS b FROM space a JOIN space b ON a.mesh_id = b.mesh_id AND a.v < b.v WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.5 * 0.5")
def radius_pairs(spark, sf_dir):
    return neighbors.close_pairs(space(spark, sf_dir), 0.5)


@query(f"WITH {FACES} SELECT mesh_id, a, b, faces, CASE WHEN faces = 1 THEN 'boundary' WHEN faces = 2 THEN 'interior' ELSE 'non-manifold' END AS kind FROM edges")
def mesh_edges(spark, sf_dir):
    return topology.edges(strip_faces(spark, sf_dir))


@query(f"WITH {FACES} SELECT DISTINCT mesh_id, unnest([a, b]) AS v FROM edges WHERE faces = 1")
def mesh_boundary(spark, sf_dir):
    return topology.boundary_vertices(strip_faces(spark, sf_dir))


@query(f"WITH {FACES} SELECT v, count(*) AS degree FROM (SELECT a v FROM edges UNION ALL SELECT b FROM edges) GROUP BY v")
def mesh_degrees(spark, sf_dir):
    return topology.one_ring(strip_faces(spark, sf_dir)).groupBy("v").agg(F.count("*").alias("degree"))


#: Folded embeddings against the next one; every seventh pair is parallel and tiny, which a product of lengths would floor wrongly.
NEXT = f"f AS (SELECT vec_id, label, {FOLD} FROM embeddings), s AS (SELECT *, CASE WHEN vec_id % 7 = 0 THEN 1e-5 ELSE 1 END k FROM f), q AS (SELECT a.label, a.k*a.x px, a.k*a.y py, a.k*a.z pz, CASE WHEN a.vec_id % 7 = 0 THEN 10*a.k*a.x ELSE b.x END tx, CASE WHEN a.vec_id % 7 = 0 THEN 10*a.k*a.y ELSE b.y END ty, CASE WHEN a.vec_id % 7 = 0 THEN 10*a.k*a.z ELSE b.z END tz FROM s a JOIN s b ON b.vec_id = a.vec_id + 1), n AS (SELECT *, sqrt(px*px+py*py+pz*pz) lp, sqrt(tx*tx+ty*ty+tz*tz) lt FROM q), u AS (SELECT *, px/greatest(lp,1e-8) ux, py/greatest(lp,1e-8) uy, pz/greatest(lp,1e-8) uz, tx/greatest(lt,1e-8) wx, ty/greatest(lt,1e-8) wy, tz/greatest(lt,1e-8) wz FROM n)"


@query(f"WITH {NEXT} SELECT label, round(avg(((px-tx)**2+(py-ty)**2+(pz-tz)**2)/3), 9) vector_mse, round(avg(1-(ux*wx+uy*wy+uz*wz)), 9) direction_cosine, round(avg((lp-lt)**2), 9) magnitude_mse, round(avg(((lp-lt)/(lt+1e-8))**2), 6) relative_magnitude, round(avg((ln(lp+1e-8)-ln(lt+1e-8))**2), 9) log_magnitude FROM u GROUP BY label")
def vector_losses(spark, sf_dir):
    out = metrics.vector_losses(next_vectors(spark, sf_dir), ["label"])
    return out.select("label", *(F.round(c, 6 if c == "relative_magnitude" else 9).alias(c) for c in out.columns[1:]))


def next_vectors(spark, sf_dir):
    """(label, px .. pz, tx .. tz): folded embeddings and the next one, with tiny parallel pairs."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", *folded())
    tiny = F.col("vec_id") % 7 == 0
    k = F.when(tiny, 1e-5).otherwise(1.0)
    one = e.select("label", "vec_id", *((k * F.col(a)).alias(f"p{a}") for a in "xyz"))
    two = e.select((F.col("vec_id") - 1).alias("vec_id"), *(F.col(a).alias(f"t{a}") for a in "xyz"))
    return one.join(two, "vec_id").select("label", *(f"p{a}" for a in "xyz"), *(F.when(tiny, 10 * F.col(f"p{a}")).otherwise(F.col(f"t{a}")).alias(f"t{a}") for a in "xyz"))


@query("WITH r AS (SELECT event_type, value a, value * value + user_id b FROM events), s AS (SELECT event_type, (a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) a, (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) b FROM r WINDOW w AS (PARTITION BY event_type)) SELECT event_type, round(corr(a, b), 6) AS correlation, round(avg(abs(a-b)), 9) AS mean_error, round(max(abs(a-b)), 9) AS max_error FROM s GROUP BY event_type")
def distance_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("a"), (F.col("value") * F.col("value") + F.col("user_id")).alias("b"))
    return metrics.distance_metrics(e, ["event_type"]).select("event_type", F.round("correlation", 6).alias("correlation"), F.round("mean_error", 9).alias("mean_error"), F.round("max_error", 9).alias("max_error"))


@query("WITH n AS (SELECT count(*) n FROM embeddings), a AS (SELECT vec_id AS ref, vec_id * 7 % (n - n // 5) AS va FROM embeddings, n), b AS (SELECT vec_id AS ref, vec_id * 5 % (n - n // 7) AS vb FROM embeddings, n), c AS (SELECT ref, va, vb FROM a JOIN b USING (ref)) SELECT ref, va, vb FROM c WHERE va IN (SELECT va FROM c GROUP BY va HAVING count(*) = 1) AND vb IN (SELECT vb FROM c GROUP BY vb HAVING count(*) = 1)")
def bijective_matches(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    n = e.count()  # so that unique and repeated targets occur at every size
    a, b = (e.select(F.col("vec_id").alias("ref"), (F.col("vec_id") * m % (n - n // p)).alias("v")) for m, p in ((7, 5), (5, 7)))
    return correspondence.bijective(correspondence.by_template(a, b)).select("ref", "va", "vb")


@query("WITH f AS (SELECT vec_id ref_src, vec_id * 3 % ((SELECT count(*) FROM embeddings) // 5 * 2 + 1) ref_dst FROM embeddings), i AS (SELECT ref_dst ref_src, max(ref_src) ref_dst FROM f GROUP BY ref_dst), h AS (SELECT vec_id ref_src, vec_id % ((SELECT count(*) FROM embeddings) // 3 + 1) AS hub FROM embeddings) SELECT h.ref_src, i.ref_dst FROM h LEFT JOIN i ON h.hub = i.ref_src")
def two_hop_bridge(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    f = e.select(F.col("vec_id").alias("ref_src"), (F.col("vec_id") * 3 % (n // 5 * 2 + 1)).alias("ref_dst"))
    return correspondence.two_hops(e.select(F.col("vec_id").alias("ref_src"), (F.col("vec_id") % (n // 3 + 1)).alias("ref_dst")), correspondence.inverted(f))


BASIS = "b AS (SELECT vec_id v, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) m, embedding FROM embeddings), phi AS (SELECT v, m, CAST(embedding[m + 1] AS DOUBLE) phi FROM b)"


def basis(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("v"), F.posexplode(F.col("embedding").cast("array<double>")).alias("m", "phi"))


@query(f"WITH {BASIS}, c AS (SELECT vec_id va, (vec_id * 13 + 5) % (SELECT count(*) FROM embeddings) vb FROM embeddings) SELECT q.m AS r, p.m AS c, round(sum(0.5 * q.phi * p.phi), 8) AS val FROM c JOIN phi p ON c.va = p.v JOIN phi q ON c.vb = q.v GROUP BY 1, 2")
def functional_map(spark, sf_dir):
    e, phi = table(spark, sf_dir, "embeddings"), basis(spark, sf_dir)
    n = e.count()
    corr = e.select(F.col("vec_id").alias("va"), ((F.col("vec_id") * 13 + 5) % n).alias("vb"))
    mass = e.select(F.col("vec_id").alias("v"), F.lit(0.5).alias("area"))
    return correspondence.functional_map(corr, phi, phi, mass).select("r", "c", F.round("val", 8).alias("val"))


@query(f"WITH {BASIS} SELECT v, m, round(sum(phi * (m + 1)) OVER (PARTITION BY v ORDER BY m), 8) AS val FROM phi")
def progressive_reconstruction(spark, sf_dir):
    c = spark.range(64).select(F.col("id").cast("int").alias("m"), (F.col("id") + 1.0).alias("c"))
    return correspondence.progressive(c, basis(spark, sf_dir)).select("v", "m", F.round("val", 8).alias("val"))


@query("SELECT event_id, CAST(CAST('0x' || substr(sha256(event_type || '-' || event_id), 57, 8) AS BIGINT) & 2147483647 AS BIGINT) AS h FROM events")
def stable_hashes(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.stable_hash(F.concat_ws("-", "event_type", F.col("event_id").cast("string"))).alias("h"))


@query("SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best, value >= max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS improved FROM events")
def running_best(spark, sf_dir):
    return metrics.running_best(table(spark, sf_dir, "events"), "value", "event_id", ["user_id"]).select("user_id", "event_id", "best", "improved")


@query(f"""WITH {FACES},
  t AS (SELECT f.mesh_id, f.f, v0, v1, v2, p.x x0, p.y y0, p.z z0, q.x x1, q.y y1, q.z z1, r.x x2, r.y y2, r.z z2 FROM faces f JOIN places p ON v0 = p.v JOIN places q ON v1 = q.v JOIN places r ON v2 = r.v),
  u AS (SELECT *, unnest([{{'i': v1, 'j': v2, 'dot': (x1-x0)*(x2-x0)+(y1-y0)*(y2-y0)+(z1-z0)*(z2-z0)}}, {{'i': v2, 'j': v0, 'dot': (x2-x1)*(x0-x1)+(y2-y1)*(y0-y1)+(z2-z1)*(z0-z1)}}, {{'i': v0, 'j': v1, 'dot': (x0-x2)*(x1-x2)+(y0-y2)*(y1-y2)+(z0-z2)*(z1-z2)}}]) e,
        sqrt(((y1-y0)*(z2-z0)-(z1-z0)*(y2-y0))**2 + ((z1-z0)*(x2-x0)-(x1-x0)*(z2-z0))**2 + ((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0))**2) AS twice FROM t),
  w AS (SELECT mesh_id, i, j, sum(w) w FROM (SELECT mesh_id, e.i, e.j, e.dot / twice / 2 w FROM u UNION ALL SELECT mesh_id, e.j, e.i, e.dot / twice / 2 FROM u) GROUP BY mesh_id, i, j),
  mass AS (SELECT mesh_id, v, sum(twice) / 6 AS area FROM (SELECT mesh_id, unnest([v0, v1, v2]) v, f, twice FROM (SELECT DISTINCT mesh_id, f, v0, v1, v2, twice FROM u)) GROUP BY mesh_id, v),
  d AS (SELECT w.mesh_id, i, sum(w) d FROM w GROUP BY w.mesh_id, i)
  SELECT d.mesh_id, count(*) AS modes, round(sum(d / area), 3) AS trace, round(sum(d * d / area / area) + max(o.o), 1) AS squares
  FROM d JOIN mass ON d.i = mass.v AND d.mesh_id = mass.mesh_id JOIN (SELECT w.mesh_id, sum(w.w * w.w / a.area / b.area) o FROM w JOIN mass a ON w.i = a.v JOIN mass b ON w.j = b.v GROUP BY w.mesh_id) o ON o.mesh_id = d.mesh_id GROUP BY d.mesh_id""")
def mesh_spectrum(spark, sf_dir):
    """Of every mesh's whole spectrum, the sums of the eigenvalues and of their squares: the trace of M^-1 S and of its square."""
    v, f = strip_vertices(spark, sf_dir), strip_faces(spark, sf_dir)
    lam = kernels.eigenpairs(topology.cotangent_laplacian(f, v), topology.barycentric_mass(f, v), STRIP).select("mesh_id", "m", "lam").distinct()
    return lam.groupBy("mesh_id").agg(F.count("*").alias("modes"), F.round(F.sum("lam"), 3).alias("trace"), F.round(F.sum(F.col("lam") * F.col("lam")), 1).alias("squares"))
