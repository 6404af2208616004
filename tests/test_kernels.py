"""Per-mesh kernels, inference and deformation against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexflow.operators import bodies, geodesics, patches, points, spectral, topology
from vertexflow.plans import kernels, transformer


def grid(side, seed=0):
    """A bumpy square mesh: positions (n, 3) and triangles."""
    rng = np.random.default_rng(seed)
    i, j = np.divmod(np.arange(side * side), side)
    p = np.stack([i / side, j / side, 0.05 * rng.normal(size=side * side)], 1)
    a = (i * side + j).reshape(side, side)[:-1, :-1].ravel()
    return p, np.concatenate([np.stack([a, a + 1, a + side], 1), np.stack([a + 1, a + side + 1, a + side], 1)])


def tables(spark, p, f, mesh=0):
    v = spark.createDataFrame([(mesh, i, *map(float, x)) for i, x in enumerate(p)], "mesh_id int, v long, x double, y double, z double")
    return v, spark.createDataFrame([(mesh, i, *map(int, t)) for i, t in enumerate(f)], "mesh_id int, f long, v0 long, v1 long, v2 long")


def cotangent(p, f):
    n = len(p)
    s, m = np.zeros((n, n)), np.zeros(n)
    for t in f:
        area = np.linalg.norm(np.cross(p[t[1]] - p[t[0]], p[t[2]] - p[t[0]])) / 2
        m[t] += area / 3
        for k in range(3):
            o, i, j = t[k], t[(k + 1) % 3], t[(k + 2) % 3]
            w = 0.5 * ((p[i] - p[o]) @ (p[j] - p[o])) / (2 * area)
            s[i, j] -= w
            s[j, i] -= w
            s[i, i] += w
            s[j, j] += w
    return s, m


def sparse(a):
    i, j = np.nonzero(a)
    return kernels.Sparse(i, j, a[i, j], a.shape)


def test_sparse_products_and_solves():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(7, 5)) * (rng.random((7, 5)) < 0.4)
    x = rng.normal(size=(5, 2))
    assert np.allclose(sparse(a) @ x, a @ x) and np.allclose(sparse(a).T @ np.ones(7), a.T @ np.ones(7)) and np.allclose(sparse(a).dense(), a)
    s, m = cotangent(*grid(6))
    b = rng.normal(size=(36, 3))
    assert np.allclose(kernels.solve(sparse(s).plus_diagonal(m), b), np.linalg.solve(s + np.diag(m), b), atol=1e-8)


def test_spectra():
    s, m = cotangent(*grid(9))
    value, vector = kernels.generalized_eigh(s, m, 6)
    assert np.allclose(s @ vector, m[:, None] * vector * value, atol=1e-9) and np.allclose(vector.T @ (m[:, None] * vector), np.eye(6))
    other, basis = kernels.sparse_eigh(sparse(s), m, 6)
    assert np.allclose(other, value, atol=1e-6) and np.allclose(np.abs(np.diag(basis.T @ (m[:, None] * vector))), 1, atol=1e-4)


def test_greens_function_and_fingerprints():
    s, m = cotangent(*grid(7))
    g, residual = kernels.greens_function(sparse(s), m, 24)
    e = 1e-6 * np.abs(np.diag(s)).mean()
    want = np.linalg.solve(s + e * np.diag(m), np.eye(49)[24])
    want -= (m @ want) / m.sum()
    want -= want.min()
    assert np.allclose(g, want / want.max(), atol=1e-5) and g.argmax() == 24 and residual < 1
    d = kernels.fingerprints(sparse(s), m, [0, 48], [0.5, 2.0])
    want = np.concatenate([np.linalg.solve(s + a * np.diag(m), m[:, None] * np.eye(49)[:, [0, 48]]) for a in (0.5, 2.0)], 1)
    assert np.allclose(d, want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-6)


def test_heat_distance_of_a_flat_mesh(spark):
    p, f = grid(15)
    p[:, 2] = 0
    v, faces = tables(spark, p, f)
    sources = spark.createDataFrame([(0, 112)], "mesh_id int, source long")
    got = np.array([r["dist"] for r in geodesics.mesh_geodesics(faces, v, sources).orderBy("v").collect()])
    true = np.linalg.norm(p - p[112], axis=1)
    assert got.argmin() == 112 and np.corrcoef(got, true)[0, 1] > 0.98
    along = np.array([r["dist"] for r in geodesics.edge_geodesics(faces, v, sources).orderBy("v").collect()])
    assert (along >= true - 1e-9).all() and along[112] == 0


def test_edge_distance_against_all_paths():
    rng = np.random.default_rng(2)
    i, j = rng.integers(0, 12, (2, 18))
    w = rng.random(18)
    d = np.full((12, 12), np.inf)
    np.fill_diagonal(d, 0)
    for a, b, x in zip(i, j, w):
        d[a, b] = min(d[a, b], x)
        d[b, a] = min(d[b, a], x)
    for k in range(12):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    for source in range(12):
        assert np.allclose(kernels.edge_distance(np.r_[i, j], np.r_[j, i], np.r_[w, w], 12, source), d[source])


def test_face_gradient_of_linear_functions(spark):
    p, f = grid(5, 3)
    v, faces = tables(spark, p, f)
    field = v.select("mesh_id", "v", (2 * F.col("x") - F.col("y") + 3 * F.col("z")).alias("val"))
    for r in geodesics.scalar_gradient(geodesics.face_gradient(faces, v), field).collect():
        a, b = p[f[r["i"]][1]] - p[f[r["i"]][0]], p[f[r["i"]][2]] - p[f[r["i"]][0]]
        n = np.cross(a, b) / np.linalg.norm(np.cross(a, b))
        g = np.array([2.0, -1.0, 3.0])
        assert np.allclose([r["gx"], r["gy"], r["gz"]], g - (g @ n) * n)


def test_tangent_gradient_and_cloud_distances(spark):
    rng = np.random.default_rng(4)
    p = np.c_[rng.random((150, 2)), np.zeros(150)]
    v, _ = tables(spark, p, [])
    from vertexflow.operators import neighbors, sparse as ops

    near = neighbors.knn(v.select("mesh_id", "v", F.array("x", "y", "z").alias("p")), 10)
    g = geodesics.tangent_gradient(patches.padded(patches.extract(near, v), 10))
    grad = ops.gradient(g.where("abs(gx) + abs(gy) + abs(gz) > 0"))
    field = v.select("mesh_id", "v", (2 * F.col("x") - F.col("y")).alias("val"))
    assert all(np.allclose([r["gx"], r["gy"], r["gz"]], [2, -1, 0], atol=1e-6) for r in geodesics.scalar_gradient(grad, field).collect())
    _, vectors, masses = spectral.point_basis(None, v, 4)
    w = near.withColumn("w", 1 / (F.col("dist") * F.col("dist") + 1e-3))
    sources = spark.createDataFrame([(0, 7)], "mesh_id int, source long")
    rows = geodesics.cloud_geodesics(ops.stiffness(w), masses, grad, sources).orderBy("v").collect()
    assert min(r["dist"] for r in rows) == 0 and len(rows) == 150 and vectors.count() == 600


def test_rigid_motion_is_kept(spark):
    p, f = grid(5, 5)
    turn = kernels.random_rotation(np.random.default_rng(6))
    v, faces = tables(spark, p, f)
    w = geodesics.edge_weights(topology.cotangent_laplacian(faces, v)).withColumn("w", F.abs("w") + 0.1)
    held = [(0, i, *map(float, turn @ p[i])) for i in (0, 4, 20, 24, 12)]
    targets = spark.createDataFrame(held, "mesh_id int, v long, x double, y double, z double")
    got = np.array([[r["x"], r["y"], r["z"]] for r in geodesics.deformed(v, w, targets, 400, 1e-13).orderBy("v").collect()])
    assert np.allclose(got, p @ turn.T, atol=1e-2)
    free = geodesics.unknowns(v, geodesics.constraints(v, targets.union(spark.createDataFrame([(0, 99, 0.0, 0.0, 0.0)], targets.schema))))
    assert free.count() == 20


def test_arap_side(spark):
    p, f = grid(4, 7)
    v, faces = tables(spark, p, f)
    w = geodesics.edge_weights(topology.cotangent_laplacian(faces, v))
    rng = np.random.default_rng(8)
    turns = [kernels.random_rotation(rng) for _ in p]
    t = spark.createDataFrame([(0, i, *map(float, r.ravel())) for i, r in enumerate(turns)], "mesh_id int, v long, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)))
    want = np.zeros_like(p)
    for r in w.collect():
        want[r["i"]] += 0.5 * r["w"] * (turns[r["i"]] + turns[r["j"]]) @ (p[r["i"]] - p[r["j"]])
    got = geodesics.arap_side(geodesics.edge_vectors(w, v), t).orderBy("v").collect()
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in got], want)


def test_rotations_of_degenerate_covariances():
    r = kernels.rotations(np.stack([np.zeros((3, 3)), np.diag([1.0, 1.0, -1.0]), np.eye(3)]))
    assert np.allclose(r[0], np.eye(3)) and np.allclose(r[2], np.eye(3)) and np.allclose([np.linalg.det(x) for x in r], 1)


def test_farthest_and_drawn_sources(spark):
    p, f = grid(6, 9)
    v, _ = tables(spark, p, f)
    got = [r["source"] for r in geodesics.farthest_sources(v, 8).orderBy("rank").collect()]
    assert got == kernels.farthest_points(p, 8) and len(set(got)) == 8
    one, two = (sorted(tuple(r) for r in geodesics.drawn_sources(x, 5, 3, centroid_first=True).collect()) for x in (v, v.repartition(7)))
    assert one == two and len({r[2] for r in one}) == 5 and one[0][2] == got[0] == points.nearest_to_centroid(v).first()["source"]


def test_monotonicity(spark):
    rows = [(0, 0, i, float(i), float(i * i)) for i in range(60)] + [(0, 1, i, float(-i), float(i)) for i in range(60)] + [(0, 2, i, 1.0, float(i)) for i in range(5)]
    d = spark.createDataFrame(rows, "mesh_id int, source int, v long, a double, b double")
    assert {r["source"]: r["monotonicity"] for r in geodesics.monotonicity(d, ["mesh_id", "source"]).collect()} == {0: 1.0, 1: 0.0, 2: 0.0}


def loops(w, p, heads):
    """One patch's weights and area, token by token."""

    def norm(x, name):
        return (x - x.mean()) / math.sqrt(x.var() + 1e-5) * w[f"{name}.scale"] + w[f"{name}.shift"]

    scale = max(max(np.linalg.norm(t) for t in p), 1e-8)
    x = [w["in.0.weight"] @ (t / scale) + w["in.0.bias"] for t in p]
    d, n = len(x[0]) // heads, 0
    while f"layer{n}.qkv.weight" in w:
        qkv = [w[f"layer{n}.qkv.weight"] @ t + w[f"layer{n}.qkv.bias"] for t in x]
        new = []
        for a in qkv:
            parts = []
            for h in range(heads):
                q = a[h * d : (h + 1) * d]
                score = np.array([math.exp(q @ b[len(x[0]) + h * d : len(x[0]) + (h + 1) * d] / math.sqrt(d)) for b in qkv])
                parts.append(sum(s * b[2 * len(x[0]) + h * d : 2 * len(x[0]) + (h + 1) * d] for s, b in zip(score / score.sum(), qkv)))
            new.append(w[f"layer{n}.out.weight"] @ np.concatenate(parts) + w[f"layer{n}.out.bias"])
        x = [norm(a + b, f"layer{n}.norm1") for a, b in zip(x, new)]
        x = [norm(a + w[f"layer{n}.ff2.weight"] @ np.maximum(w[f"layer{n}.ff1.weight"] @ a + w[f"layer{n}.ff1.bias"], 0) + w[f"layer{n}.ff2.bias"], f"layer{n}.norm2") for a in x]
        n += 1
    area = math.log1p(math.exp((w["area.0.weight"] @ np.mean(x, 0) + w["area.0.bias"])[0])) * scale**2
    return [math.exp((w["head.0.weight"] @ a + w["head.0.bias"])[0]) for a in x], area


def test_inference_against_loops(spark):
    rng, w = np.random.default_rng(10), transformer.seeded_weights(3)
    data = {q: rng.normal(size=(n, 3)) for q, n in ((0, 5), (1, 3), (2, 7), (3, 1))}
    rows = [(0, q, k, k, *map(float, t)) for q, p in data.items() for k, t in enumerate(p)]
    tokens = patches.padded(spark.createDataFrame(rows, "mesh_id int, patch long, rank int, neighbor long, px double, py double, pz double"), 7)
    got = transformer.infer(tokens, w, 4).collect()
    for q, p in data.items():
        mine = sorted((r for r in got if r["center"] == q), key=lambda r: r["rank"])
        weights, area = loops(w, p, 4)
        assert np.allclose([r["w"] for r in mine], weights) and np.allclose(mine[0]["area"], area)


@pytest.mark.parametrize("gradient", [False, True])
def test_inference_ignores_order_and_padding(gradient):
    rng, w = np.random.default_rng(11), transformer.seeded_weights(5, outputs=3 if gradient else 1, in_hidden=(8,), head_hidden=(6,))
    p = rng.normal(size=(1, 6, 3))
    order = rng.permutation(6)
    weights, area, scale, g = transformer.forward(w, p, p, np.ones((1, 6), bool), 4, gradient)
    other, area2, *_ = transformer.forward(w, p[:, order], p[:, order], np.ones((1, 6), bool), 4, gradient)
    wide = np.concatenate([p, np.full((1, 3, 3), 50.0)], 1)
    padded, area3, scale3, _ = transformer.forward(w, wide, wide, np.arange(9)[None] < 6, 4, gradient)
    assert np.allclose(weights[:, order], other) and np.allclose(area, area2) and np.allclose(padded[:, :6], weights) and np.allclose(area, area3) and (padded[:, 6:] == 0).all() and np.allclose(scale, scale3)
    assert (weights > 0).all() and (area > 0).all() and (g is None or np.allclose((g**2).sum(2), weights))


def test_weights_round_trip(spark, tmp_path):
    from vertexflow.sources import mesh_files

    w = transformer.seeded_weights(1)
    mesh_files.write_weights(spark, w, str(tmp_path / "w"))
    back = mesh_files.read_weights(spark, str(tmp_path / "w"))
    assert set(back) == set(w) and all(np.array_equal(back[k], w[k]) for k in w)


def test_skinned_bodies(spark):
    rng = np.random.default_rng(12)
    n, joints, betas = 9, 4, 2
    parent = [-1, 0, 1, 1]
    t, sd, pd_, reg, skin = rng.normal(size=(n, 3)), rng.normal(size=(n, 3, betas)), 0.1 * rng.normal(size=(n, 3, 9 * (joints - 1))), rng.random((joints, n)), rng.random((n, joints))
    reg, skin = reg / reg.sum(1, keepdims=True), skin / skin.sum(1, keepdims=True)
    b, pose, move = rng.normal(size=betas), rng.normal(size=(joints, 3)), rng.normal(size=3)

    def turn(r):
        a = max(np.linalg.norm(r), 1e-8)
        k = np.array([[0, -r[2], r[1]], [r[2], 0, -r[0]], [-r[1], r[0], 0]]) / a
        return np.eye(3) + math.sin(a) * k + (1 - math.cos(a)) * k @ k

    shaped = t + sd @ b
    place, rot = reg @ shaped, [turn(r) for r in pose]
    posed = shaped + pd_ @ np.concatenate([(r - np.eye(3)).ravel() for r in rot[1:]])
    world = []
    for j in range(joints):
        local = np.eye(4)
        local[:3, :3], local[:3, 3] = rot[j], place[j] - (place[parent[j]] if j else 0)
        world.append(world[parent[j]] @ local if j else local)
    rest = []
    for g, x in zip(world, place):
        g = g.copy()
        g[:3, 3] -= g[:3, :3] @ x
        rest.append(g)
    want = np.stack([(sum(skin[i, j] * rest[j] for j in range(joints)) @ np.r_[posed[i], 1])[:3] + move for i in range(n)])

    def table(rows, schema):
        return spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in rows], schema)

    model = {
        "template": table([(i, *x) for i, x in enumerate(t)], "v long, x double, y double, z double"), "shape_dirs": table([(i, k, *sd[i, :, k]) for i in range(n) for k in range(betas)], "v long, beta int, x double, y double, z double"),
        "pose_dirs": table([(i, k, *pd_[i, :, k]) for i in range(n) for k in range(pd_.shape[2])], "v long, p int, x double, y double, z double"), "regressor": table([(j, i, reg[j, i]) for j in range(joints) for i in range(n)], "joint int, v long, w double"),
        "skin": table([(i, j, skin[i, j]) for i in range(n) for j in range(joints)], "v long, joint int, w double"), "tree": table(list(enumerate(parent)), "joint int, parent int"),
    }
    got = bodies.skinned(**model, bodies=table([(5,)], "body_id int"), betas=table([(5, k, b[k]) for k in range(betas)], "body_id int, beta int, value double"), poses=table([(5, j, *pose[j]) for j in range(joints)], "body_id int, joint int, rx double, ry double, rz double"), shifts=table([(5, *move)], "body_id int, x double, y double, z double"))
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in got.orderBy("v").collect()], want)
    made = bodies.generated(model, table([(1, "a"), (2, "a")], "body_id int, family string"), table([("a", k, b[k]) for k in range(betas)], "family string, beta int, value double"), 0.3, 7)
    lengths = [r["n"] for r in made.groupBy("mesh_id").agg(F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).alias("n")).collect()]
    assert np.allclose(lengths, [1, 1])


def test_least_squares_reconstruction(spark):
    rng = np.random.default_rng(13)
    phi, f = rng.normal(size=(12, 4)), rng.normal(size=12)
    vectors = spark.createDataFrame([(0, i, m, float(phi[i, m])) for i in range(12) for m in range(4)], "mesh_id int, v long, m int, phi double")
    field = spark.createDataFrame([(0, i, "x", float(f[i])) for i in range(12)], "mesh_id int, v long, axis string, val double")
    got = {(r["v"], r["m"]): r["val"] for r in spectral.reconstructed(vectors, field).collect()}
    for m in range(4):
        c = np.linalg.lstsq(phi[:, : m + 1], f, rcond=None)[0]
        assert np.allclose([got[i, m] for i in range(12)], phi[:, : m + 1] @ c)


def test_evaluated_pairs_of_one_shape(spark):
    v, f = tables(spark, *grid(6, 14))
    basis = spectral.PROVIDERS["mesh"](f, v, 5)
    corr = v.select(F.col("mesh_id").alias("pair_id"), F.col("v").alias("ref"), F.col("v").alias("va"), F.col("v").alias("vb"))
    truth = corr.select("pair_id", "va", F.col("vb").alias("gt"))
    r = spectral.evaluated_pairs(corr, basis, basis, v, truth).first()
    assert r["orthogonality_error"] < 1e-6 and r["identity_error"] < 1e-6 and r["accuracy"] == 1.0 and r["max_error"] == 0.0


def test_learned_operators(spark):
    from vertexflow.operators import learned

    v, f = tables(spark, *grid(6, 15))
    w = transformer.seeded_weights(2, outputs=3)
    own = learned.operators(v, w, 6, 4, gradient=True)
    rows = own.stiffness.toPandas()
    assert np.allclose(rows.groupby("i").val.sum(), 0, atol=1e-9) and own.masses.count() == 36 and own.masses.where("area <= 0").count() == 0
    fewer = learned.operators(v, w, 6, 4, gradient=True, laplacian="anisotropic_sparse")
    assert abs(fewer.stiffness.groupBy("i").agg(F.sum("val").alias("s")).agg(F.max(F.abs("s"))).first()[0]) < 1e-9
    with pytest.raises(ValueError):
        learned.operators(v, w, 6, 4, laplacian="anisotropic")
    one = learned.averaged(learned.validation(v, f, w, 5, 6, 4)).collect()
    assert {"spectral_distance", "eigenvalue_rel_mse", "eigenvector_similarity_mean"} <= {r["name"] for r in one}


def test_best_and_last_checkpoints(spark, tmp_path):
    from vertexflow.sources import mesh_files

    for step, score in ((1, 0.2), (2, 0.9), (3, 0.9), (4, 0.1)):
        mesh_files.write_step(spark, {"w": np.full((2, 3), float(step))}, str(tmp_path), step, score)
    best, last = mesh_files.read_step(spark, str(tmp_path)), mesh_files.read_step(spark, str(tmp_path), "last")
    assert best[0] == 3 and (best[1]["w"] == 3).all() and best[1]["w"].shape == (2, 3)
    assert last[0] == 4 and (last[1]["w"] == 4).all()
    with pytest.raises(ValueError, match="best or last"):
        mesh_files.read_step(spark, str(tmp_path), "first")
