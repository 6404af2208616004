"""Solves and spectra across workers, exact distances and intrinsic triangulations against dense algebra and closed forms."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_kernels import cotangent, grid, tables

from vertexflow.operators import geodesics, isospectral, robust, solves, sparse, spectral, topology
from vertexflow.plans import dissection, exact, intrinsic, kernels


@pytest.fixture(scope="module")
def two(spark):
    """Two bumpy meshes and their operators; the first one's last vertex lies far out, and the second has two at one place."""
    (p, f), (q, g) = grid(13), grid(7, 1)
    p[-1] = (40.0, 40.0, 1.0)
    q[3] = q[2] + 1e-9
    (v, t), (w, u) = tables(spark, p, f), tables(spark, q, g, 1)
    v, t = v.unionByName(w), t.unionByName(u)
    return [(p, f), (q, g)], v, t, topology.cotangent_laplacian(t, v), topology.barycentric_mass(t, v)


def test_tree_puts_every_edge_on_one_branch(spark, two):
    meshes, v, t, stiff, _ = two
    at = {(r["mesh_id"], r["v"]): (r["level"], r["prefix"]) for r in dissection.tree(stiff, v, 10).collect()}
    assert len(at) == sum(len(p) for p, _ in meshes) and max(level for level, _ in at.values()) > 3
    for mesh, (_, faces) in enumerate(meshes):
        for f in faces:
            for i, j in itertools.combinations(f, 2):
                (a, x), (b, y) = sorted((at[mesh, i], at[mesh, j]))
                assert y >> (b - a) == x


def test_factor_solves_as_dense_algebra_does(spark, two):
    meshes, v, _, stiff, masses = two
    by = masses.select("mesh_id").distinct().select("mesh_id", F.lit(0.3).alias("s"), F.lit(1.0).alias("m"), F.lit(0.01).alias("c"))
    factor = dissection.Factor(solves.shifted(stiff, masses, by), v, 32)
    rhs = v.where("v % 3 <> 1").select("mesh_id", "v", F.array(F.col("x"), F.sin("v"), F.lit(1.0)).alias("b"))
    x = factor.solve(rhs)
    got = {(r["mesh_id"], r["v"]): r["x"] for r in x.collect()}
    for mesh, (p, f) in enumerate(meshes):
        n = np.arange(len(p))
        b = np.where((n % 3 != 1)[:, None], np.stack([p[:, 0], np.sin(n), np.ones(len(p))], 1), 0)
        dense = np.zeros((len(p), len(p)))
        for r in stiff.where(F.col("mesh_id") == mesh).collect():
            dense[r["i"], r["j"]] += 0.3 * r["val"]
        area = np.array([r["area"] for r in masses.where(F.col("mesh_id") == mesh).orderBy("i").collect()])
        want = np.linalg.solve(dense + np.diag(area + 0.01), b)
        assert np.allclose([got[mesh, i] for i in n], want, rtol=1e-8, atol=1e-10)
    assert all(r["residual"] < 1e-10 for r in factor.residuals(x, rhs).collect())
    factor.close()


def test_factor_names_a_matrix_that_is_not_positive(spark, two):
    _, v, _, stiff, masses = two
    by = masses.select("mesh_id").distinct().select("mesh_id", F.lit(1.0).alias("s"), F.lit(-50.0).alias("m"), F.lit(-5.0).alias("c"))
    with pytest.raises(Exception, match="is not positive definite"):
        dissection.Factor(solves.shifted(stiff, masses, by), v, 32)


def test_eigenpairs_of_meshes_cut_into_many_leaves(spark):
    (p, f), (q, g) = grid(12), grid(3, 1)
    (v, t), (w, u) = tables(spark, p, f), tables(spark, q, g, 1)
    v, t = v.unionByName(w), t.unionByName(u)
    values, vectors = solves.eigenpairs(topology.cotangent_laplacian(t, v), topology.barycentric_mass(t, v), v, 5, leaf=72)
    rows, phi = values.orderBy("mesh_id", "m").collect(), vectors.toPandas()
    for mesh, (points, faces) in enumerate(((p, f), (q, g))):
        s, m = cotangent(points, faces)
        want, _ = kernels.generalized_eigh(s, m, 5)
        got = [r["lam"] for r in rows if r["mesh_id"] == mesh]
        assert np.allclose(got, want, rtol=1e-7, atol=1e-8) and all(r["residual"] < 1e-3 for r in rows)
        x = phi[phi.mesh_id == mesh].pivot(index="v", columns="m", values="phi").sort_index().to_numpy()
        assert np.allclose(x.T @ (m[:, None] * x), np.eye(5), atol=1e-8) and np.allclose(x.T @ s @ x, np.diag(want), atol=1e-4 * want[-1])


def test_heat_and_greens_are_those_of_one_worker(spark):
    p, f = grid(9)
    v, t = tables(spark, p, f)
    sources = spark.createDataFrame([(0, 3), (0, 40)], "mesh_id int, source long")
    pairs = [(solves.mesh_geodesics(t, v, sources, leaf=40), geodesics.mesh_geodesics(t, v, sources), "dist")]
    stiff, masses = topology.cotangent_laplacian(t, v), topology.barycentric_mass(t, v)
    pairs.append((solves.greens_functions(stiff, masses, v, sources, leaf=40), geodesics.greens_functions(stiff, masses, sources), "g"))
    for ours, theirs, c in pairs:
        both = ours.toPandas().merge(theirs.toPandas(), on=["mesh_id", "source", "v"])
        assert len(both) == 2 * 81 and np.allclose(both[f"{c}_x"], both[f"{c}_y"], atol=1e-6)
        assert both.filter(like="residual").iloc[:, 0].max() < 1e-7


def test_deformation_by_one_factor_is_that_of_one_worker(spark):
    p, f = grid(6)
    v, t = tables(spark, p, f)
    s, _ = cotangent(p, f)
    i, j = np.nonzero(s - np.diag(np.diag(s)))
    w = spark.createDataFrame([(0, int(a), int(b), float(-s[a, b])) for a, b in zip(i, j)], "mesh_id int, i long, j long, w double")
    held = {k: p[k] + [0, 0, 0.3 * (k % 6)] for k in [*range(6), *range(30, 36)]}
    targets = spark.createDataFrame([(0, k, *map(float, x)) for k, x in held.items()], "mesh_id int, v long, x double, y double, z double")
    new, log = solves.deformed(v, w, targets, rounds=4, leaf=12)
    want = kernels.arap(p, i, j, -s[i, j], held, 4)
    assert np.allclose(new.orderBy("v").select("x", "y", "z").toPandas().to_numpy(), want, atol=1e-8)
    steps = [r["step"] for r in log.orderBy("round").collect()]
    assert len(steps) == 4 and steps[-1] < steps[0]


def test_isospectral_gradient_and_descent(spark):
    p, f = grid(5)
    p[:, 2] *= 4
    v, t = tables(spark, p, f)
    rng = np.random.default_rng(0)
    q = p + 0.02 * rng.normal(size=p.shape)
    spectrum = lambda x: kernels.generalized_eigh(*cotangent(x, f), 6)[0]
    want = spectrum(q)
    targets = spark.createDataFrame([(0, m, float(x)) for m, x in enumerate(want)], "mesh_id int, m int, lam double")
    first, _ = tables(spark, p + 0.01 * rng.normal(size=p.shape), f)
    start = first.orderBy("v").select("x", "y", "z").toPandas().to_numpy()

    def whole(x, alpha=0.0):
        d = ((x[:, None] - start[None]) ** 2).sum(2)
        return ((spectrum(x)[1:] - want[1:]) ** 2).mean() + alpha * (d.min(0).mean() + d.min(1).mean())

    for alpha in (0.0, 50.0):
        loss, gradient = isospectral.objective(t, v, targets, 6, first, alpha)
        assert np.isclose(loss.first()["loss"], whole(p, alpha))
        g = gradient.orderBy("v").select("gx", "gy", "gz").toPandas().to_numpy()
        for k, c in ((0, 0), (7, 1), (12, 2), (18, 2)):
            e = np.zeros_like(p)
            e[k, c] = 1e-6
            assert np.isclose(g[k, c], (whole(p + e, alpha) - whole(p - e, alpha)) / 2e-6, rtol=1e-4, atol=1e-4)
    _, log = isospectral.descended(t, v, targets, 6, 3, rate=2e-3)
    losses = [r["loss"] for r in log.orderBy("step").collect()]
    assert losses[0] > losses[1] > losses[2]


def flat(side):
    p, f = grid(side)
    p[:, 2] = 0
    return p, f


def cube(m):
    points, faces = {}, []
    for axis, side, i, j in itertools.product(range(3), (0, 1), range(m), range(m)):
        x = []
        for a, b in ((i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)):
            q = [0.0] * 3
            q[axis], q[(axis + 1) % 3], q[(axis + 2) % 3] = side, a / m, b / m
            x.append(points.setdefault(tuple(np.round(q, 9)), len(points)))
        faces += [[x[0], x[1], x[2]], [x[0], x[2], x[3]]] if side else [[x[0], x[2], x[1]], [x[0], x[3], x[2]]]
    return np.array(list(points)), np.array(faces)


def test_exact_distances_of_flat_grids_and_a_cube():
    p, f = flat(12)
    for source in (0, 77, 143):
        assert np.allclose(exact.distances(exact.Surface(p, np.concatenate([f, f[::3, ::-1]])), source), np.linalg.norm(p - p[source], axis=1))
    p, f = cube(5)
    at = lambda *q: int(np.abs(p - q).sum(1).argmin())
    assert abs(exact.distances(exact.Surface(p, f), at(0, 0, 0))[at(1, 1, 1)] - 5**0.5) < 1e-12
    p, f = cube(4)
    assert abs(exact.distances(exact.Surface(p, f), at(0.5, 0.5, 0))[at(0.5, 0.5, 1)] - 2) < 1e-12


def test_exact_distances_bend_at_an_inner_corner():
    """An L of squares: the way between its ends touches the corner."""
    p, f = flat(9)
    p = p * 9
    f = f[~((p[f].min(1)[:, 0] >= 4) & (p[f].min(1)[:, 1] >= 4))]
    d = exact.distances(exact.Surface(p, f), 8)
    a, b, corner = p[8], p[72], np.array([4.0, 4.0, 0.0])
    assert abs(d[72] - np.linalg.norm(a - corner) - np.linalg.norm(b - corner)) < 1e-9
    assert np.isinf(d[80])


def test_exact_distances_are_symmetric_and_between_their_bounds(spark):
    p, f = grid(11, 5)
    p[:, 2] *= 3
    v, t = tables(spark, p, f)
    sources = spark.createDataFrame([(0, 0), (0, 60), (0, 120), (0, 999)], "mesh_id int, source long")
    d = geodesics.exact_geodesics(t, v, sources).toPandas()
    assert sorted(d.source.unique()) == [0, 60, 120]
    along = geodesics.edge_geodesics(t, v, sources.where("source < 999")).toPandas().merge(d, on=["mesh_id", "source", "v"])
    straight = geodesics.euclidean(v, sources).toPandas().merge(d, on=["mesh_id", "source", "v"])
    assert (along.dist_y <= along.dist_x + 1e-9).all() and (straight.dist_y >= straight.dist_x - 1e-9).all() and (along.dist_y < along.dist_x - 1e-3).any()
    table = d.pivot(index="v", columns="source", values="dist")
    assert abs(table.loc[60, 0] - table.loc[0, 60]) < 1e-9 and abs(table.loc[120, 60] - table.loc[60, 120]) < 1e-9


def glued(cover):
    after = np.roll(cover.start.reshape(-1, 3), -1, 1).ravel()
    on = np.flatnonzero(cover.glue >= 0)
    return (cover.glue[cover.glue[on]] == on).all() and (cover.start[on] == after[cover.glue[on]]).all() and np.allclose(cover.length[on], cover.length[cover.glue[on]])


@pytest.mark.parametrize("tufted", [False, True])
def test_flips_end_with_a_delaunay_triangulation(tufted):
    p, f = grid(10, 2)
    sides = np.linalg.norm(p[f] - p[np.roll(f, -1, 1)], axis=2)
    cover = intrinsic.tufted_cover(p, f, sides) if tufted else intrinsic.single_cover(f, sides)
    assert glued(cover)
    s, m = cotangent(p, f)
    i, j, w, mass = cover.laplacian(len(p))
    dense = np.zeros_like(s)
    for a, b, x in ((i, j, -w), (j, i, -w), (i, i, w), (j, j, w)):
        np.add.at(dense, (a, b), x)
    assert np.allclose(dense / (1 + tufted), s) and np.allclose(mass / (1 + tufted), m)
    area = cover.areas().sum()
    assert cover.flip_to_delaunay() > 0 and glued(cover) and np.isclose(cover.areas().sum(), area)
    cot = cover.corner_cotangents()
    on = cover.glue >= 0
    assert (cot[on] + cot[cover.glue[on]]).min() > -1e-9


def test_flat_spectrum_is_kept_and_poor_triangles_are_safe(spark):
    p, f = flat(8)
    rng = np.random.default_rng(3)
    q = np.concatenate([rng.normal(size=(40, 2)), 1e-12 * rng.normal(size=(40, 1))], 1)
    g = np.array([[a, a + 1, a + 2] for a in range(38)] + [[0, 20, 39], [0, 20, 33], [5, 5, 6]])
    (v, t), (w, u) = tables(spark, p, f), tables(spark, q, g, 1)
    stiff, masses = robust.mesh_operators(t.unionByName(u), v.unionByName(w))
    a = np.zeros((2, 64, 64))
    for r in stiff.collect():
        a[r["mesh_id"], r["i"], r["j"]] += r["val"]
    s, m = cotangent(p, f)
    area = np.array([r["area"] for r in masses.where("mesh_id = 0").orderBy("i").collect()])
    assert np.allclose(kernels.generalized_eigh(a[0], area, 10)[0], kernels.generalized_eigh(s, m, 10)[0], rtol=1e-6, atol=1e-9)
    assert np.isfinite(a).all() and np.abs(a.sum(2)).max() < 1e-8 * np.abs(a).max() and np.linalg.eigvalsh(a[1])[0] > -1e-8 * np.abs(a).max()
    assert masses.count() == 64 + 40 and masses.where("area <= 0").isEmpty()
    off = a - a * np.eye(64)
    assert off.max() < 1e-9 * np.abs(a).max()


def test_stars_are_the_delaunay_triangles_of_the_plane():
    p = np.random.default_rng(1).random((30, 2))
    found = set()
    for a in range(30):
        found |= {tuple(sorted((a, x, y))) for x, y in intrinsic.stars(p - p[a]).tolist()}

    def empty(t):
        a, b, c = p[list(t)]
        turn = np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
        return all(turn * np.linalg.det([[*(q - p[d]), ((q - p[d]) ** 2).sum()] for q in (a, b, c)]) <= 1e-14 for d in set(range(30)) - set(t))

    assert found == {t for t in itertools.combinations(range(30), 3) if empty(t)}
    assert intrinsic.stars(np.zeros((4, 2))).shape == (0, 2) and intrinsic.stars(np.array([[1.0, 0], [2.0, 0]])).shape == (0, 2)


def test_plane_triangulations_of_many_and_of_awkward_points():
    rng = np.random.default_rng(2)
    p = rng.random((60, 2))
    want = {tuple(sorted((a, x, y))) for a in range(60) for x, y in intrinsic.stars(p - p[a]).tolist()}
    assert {tuple(sorted(t)) for t in intrinsic.delaunay(p).tolist()} == want
    area = lambda q, t: ((q[t[:, 1]] - q[t[:, 0]]) * (q[t[:, 2]] - q[t[:, 0]])[:, ::-1] @ [1, -1]) / 2
    i, j = np.divmod(np.arange(400), 20)
    grid_ = np.stack([i, j], 1) / 19
    many = rng.random((5000, 2))
    for q, whole in ((grid_, 1.0), (np.concatenate([grid_, grid_[:7]]), 1.0), (np.array([[0, 0], [1, 0], [2, 0], [3, 0], [1.0, 1]]), 1.5), (many, None)):
        t = intrinsic.delaunay(q)
        assert (area(q, t) > 0).all() and (whole is None or np.isclose(area(q, t).sum(), whole))
    assert len(t) > 9900 and len(np.unique(t)) == 5000
    assert len(intrinsic.delaunay(np.array([[0, 0], [1, 1], [2, 2.0]]))) == 0


def test_cloud_laplacian_has_a_spheres_spectrum(spark):
    n = 400
    z = 1 - (2 * np.arange(n) + 1) / n
    turn = np.pi * (3 - 5**0.5) * np.arange(n)
    p = np.stack([np.sqrt(1 - z * z) * np.cos(turn), np.sqrt(1 - z * z) * np.sin(turn), z], 1)
    v, _ = tables(spark, p, np.array([[0, 1, 2]]))
    values, _, masses = spectral.PROVIDERS["robust points"](None, v, 9)
    got = [r["lam"] for r in values.orderBy("m").collect()]
    assert abs(masses.agg(F.sum("area")).first()[0] - 4 * np.pi) < 0.2
    assert np.allclose(got, [0, 2, 2, 2, 6, 6, 6, 6, 6], rtol=0.05, atol=1e-6)


def test_plans_of_a_solve_stay_small_at_any_depth(spark, monkeypatch):
    """No written table's plan holds the levels below and above it: the driver's memory doesn't grow with the depth's cube."""
    from vertexflow.scratch import Scratch

    lengths, put = [], Scratch.put
    monkeypatch.setattr(Scratch, "put", lambda self, df: lengths.append(len(df._jdf.queryExecution().optimizedPlan().toString())) or put(self, df))
    n = 64
    v = spark.range(n).select(F.lit(0).alias("mesh_id"), F.col("id").alias("v"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    coo = spark.createDataFrame([(0, i, j, 3.0 if i == j else -1.0) for i in range(n) for j in range(n) if abs(i - j) < 2], "mesh_id int, i long, j long, val double")
    rhs = v.select("mesh_id", "v", F.array(F.col("x")).alias("b"))
    most = []
    for leaf in (16, 4):
        factor = dissection.Factor(coo, v, leaf)
        lengths.clear()
        x = factor.solve(rhs, 1)
        got = np.array([r["x"][0] for r in x.orderBy("v").collect()])
        assert np.allclose(3 * got - np.r_[got[1:], 0] - np.r_[0, got[:-1]], np.arange(n))
        most.append(max(lengths))
        factor.close()
    assert most[1] < 3 * most[0]


def test_curve_is_a_short_expression(spark):
    rows = [(0, k, float(x), float(y), float(z)) for k, (x, y, z) in enumerate(np.random.default_rng(2).integers(0, 1 << 20, (40, 3)))] + [(0, 98, 0.0, 0.0, 0.0), (0, 99, float(1 << 20), 0.0, 0.0)]
    out = dissection.curve(spark.createDataFrame(rows, "mesh_id int, v long, x double, y double, z double"))
    assert len(out._jdf.queryExecution().analyzed().toString()) < 20_000
    code = {r["v"]: r["code"] for r in out.collect()}
    for _, v, *p in rows[:40]:
        assert code[v] == sum(((int(c) >> b) & 1) << (3 * b + 2 - a) for a, c in enumerate(p) for b in range(20))


def test_metrics_of_distances_solve_once(spark):
    from vertexflow.queries import strip_faces, strip_vertices

    v, f = strip_vertices(spark, "/root/testdata/sf0.001"), strip_faces(spark, "/root/testdata/sf0.001")
    v, f = v.where("v < 60"), f.where("v2 < 60")
    sources = v.where("v = 7").select("mesh_id", F.col("v").alias("source"))
    d = geodesics.exact_geodesics(f, v, sources)
    out = geodesics.geodesic_metrics(d, d)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().analyzed().toString()
    assert out.first()["max_error"] == 0


def test_operators_of_placed_faces_and_metrics_broadcast_no_vertices(spark):
    from vertexflow.queries import strip_faces, strip_vertices

    v, f = strip_vertices(spark, "/root/testdata/sf0.001").where("v < 60"), strip_faces(spark, "/root/testdata/sf0.001").where("v2 < 60")
    placed = topology.with_corners(f, v).localCheckpoint()
    for op in (topology.cotangent_laplacian, topology.barycentric_mass, topology.face_areas, geodesics.face_gradient):
        out, plain = op(placed, v), op(f, v)
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert out.columns == plain.columns and out.count() == plain.count()
        value = out.columns[-1]
        assert abs(out.agg(F.sum(F.abs(value))).first()[0] / plain.agg(F.sum(F.abs(value))).first()[0] - 1) < 1e-9
    pairs = v.select("mesh_id", F.lit(0).alias("source"), "v", F.col("x").alias("a"), F.col("x").alias("b"))
    order = geodesics.monotonicity(pairs, ["mesh_id", "source"])
    assert order._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") == 2
    assert [r["monotonicity"] for r in order.collect()] == [1.0]


def test_eigenpairs_of_a_long_ring_need_few_rounds(spark):
    n = 6000
    e = spark.range(n).select(F.lit(0).alias("mesh_id"), F.col("id").alias("v"))
    turn = 2 * np.pi * F.col("v") / n
    v = e.select("mesh_id", "v", F.cos(turn).alias("x"), F.sin(turn).alias("y"), F.lit(0.0).alias("z"))
    s = sparse.stiffness(e.select("mesh_id", F.col("v").alias("center"), ((F.col("v") + 1) % n).alias("neighbor"), F.lit(1.0).alias("w")))
    values, _ = solves.eigenpairs(s, e.select("mesh_id", F.col("v").alias("i"), F.lit(1.0).alias("area")), v, 6, rounds=7, leaf=1024)
    for r in values.collect():
        assert abs(r["lam"] - 4 * np.sin(np.pi * ((r["m"] + 1) // 2) / n) ** 2) < 1e-12
        assert r["residual"] < 1e-5
