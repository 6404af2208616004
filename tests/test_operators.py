"""Sources, draws, surfaces, losses and graphs against small examples and plain Python."""

import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vertexflow.functions import scalars
from vertexflow.operators import correspondence, graphs, losses, metrics, neighbors, patches, points, sampling, sparse, surface_rows, topology
from vertexflow.sources import mesh_files


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


SQUARE = ([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0]], [[0, 1, 2], [0, 2, 3]])


def ply(binary):
    head = f"ply\nformat {'binary_little_endian' if binary else 'ascii'} 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n".encode()
    if binary:
        return head + b"".join(struct.pack("<fffB", *v, 7) for v in SQUARE[0]) + struct.pack("<Biiii", 4, 0, 1, 2, 3)
    return head + "".join(f"{a} {b} {c} 7\n" for a, b, c in SQUARE[0]).encode() + b"4 0 1 2 3\n"


def stl(binary):
    corners = [[SQUARE[0][i] for i in t] for t in SQUARE[1]]
    if binary:
        return b"\0" * 80 + struct.pack("<I", 2) + b"".join(struct.pack("<12fH", 0, 0, 1, *sum(t, []), 0) for t in corners)
    return "solid s\n" + "".join("facet normal 0 0 1\nouter loop\n" + "".join(f"vertex {a} {b} {c}\n" for a, b, c in t) + "endloop\nendfacet\n" for t in corners) + "endsolid s\n"


MESHES = {
    "obj": "# note\nv 0 0 0\nvn 0 0 1\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1//1 2//1 3//1 4//1\n", "obj back": "v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf -4/1 -3/2 -2/3 -1/4\n",
    "off": "OFF\n4 1 0\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n4 0 1 2 3\n", "OFF line": "OFF 4 1 0  # counts\n0 0 0\n1 0 0\n1 1 0\n\n0 1 0\n4 0 1 2 3\n", "ply": ply(False), "ply binary": ply(True), "stl": stl(False), "stl binary": stl(True),
}


@pytest.mark.parametrize("name", sorted(MESHES))
def test_parsers(name):
    raw = MESHES[name]
    v, f = mesh_files.parse_mesh(f"m.{name.split()[0]}", raw if isinstance(raw, bytes) else raw.encode())
    assert v.tolist() == SQUARE[0] and f.tolist() == SQUARE[1]


def test_mesh_folders(spark, tmp_path):
    write(tmp_path / "a" / "tri.obj", "v 0 0 0\nv 1 0 0\nv 0 1 0\nvt 0 0\nf 1 2 3\n")
    write(tmp_path / "b" / "tri.obj", "v 5 0 0\nv 6 0 0\nv 5 1 0\nv 5 5 5\n")
    write(tmp_path / "box.OFF", MESHES["off"])
    write(tmp_path / "notes.txt", "v 9 9 9\n")
    root = str(tmp_path)
    v = sorted(tuple(r) for r in mesh_files.mesh_vertices(spark, root).collect())
    assert [x[0] for x in v] == ["a/tri"] * 3 + ["b/tri"] * 4 + ["box"] * 4 and v[3] == ("b/tri", 0, 5.0, 0.0, 0.0) and v[6][1:] == (3, 5.0, 5.0, 5.0)
    assert sorted(tuple(r) for r in mesh_files.mesh_faces(spark, root).collect()) == [("a/tri", 0, 0, 1, 2), ("box", 0, 0, 1, 2), ("box", 1, 0, 2, 3)]
    assert sorted(tuple(r) for r in mesh_files.obj_vertices(spark, root).collect()) == [x for x in v if x[0] != "box"]
    files = mesh_files.mesh_files(spark, root)
    sizes = {r["mesh_id"]: r["length"] for r in files.collect()}
    assert set(sizes) == {"a/tri", "b/tri", "box"}
    assert {r["mesh_id"] for r in mesh_files.mesh_files(spark, root, sizes["box"], sizes["box"]).collect()} >= {"box"}
    assert mesh_files.mesh_files(spark, root, most_files=2).count() == 2 and [r["path"] for r in mesh_files.mesh_files(spark, root, seed=3, most_files=2).collect()] == [r["path"] for r in mesh_files.mesh_files(spark, root, seed=3, most_files=2).collect()]
    n = mesh_files.vertex_normals(mesh_files.mesh_faces(spark, root), mesh_files.mesh_vertices(spark, root)).where("mesh_id = 'box'").collect()
    assert all((r["nx"], r["ny"], r["nz"]) == (0, 0, 1) for r in n) and len(n) == 4
    with pytest.raises(ValueError):
        mesh_files.parse_mesh("empty.obj", b"# nothing\n")


def test_correspondence_folders(spark, tmp_path):
    root = tmp_path / "data" / "set"
    for c, poses in {"cat": ("p1", "p2"), "dog": ("q1",)}.items():
        for p in poses:
            write(root / c / f"{p}.obj", "v 0 0 0\n")
            write(root / c / "corres" / f"{p}.vts", "2\n1\n3\n")
    write(root / "cat" / "lonely.obj", "v 0 0 0\n")
    write(root / "cross_category_corres" / "cat_dog.vts", "3\n1\n")
    write(root / "cross_category_corres" / "cat_wolf.vts", "1\n")
    assert mesh_files.dataset_root(spark, str(tmp_path / "data")) == str(root) and mesh_files.dataset_root(spark, str(root)) == str(root)
    poses = mesh_files.category_poses(spark, str(root))
    assert [tuple(r) for r in poses.collect()] == [("cat", "p1"), ("cat", "p2"), ("dog", "q1")]
    assert sorted(tuple(r) for r in mesh_files.bridges(spark, str(root), poses).collect()) == [("cat", "dog", 0, 2), ("cat", "dog", 1, 0)]
    assert sorted(tuple(r) for r in mesh_files.template_map(spark, str(root / "dog")).collect()) == [("corres/q1", 0, 1), ("corres/q1", 1, 0), ("corres/q1", 2, 2)]


def test_logs(spark, tmp_path):
    mesh_files.write_log(spark.createDataFrame([(1, 0.5), (2, 0.25)], "step int, loss double"), str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 2
    mesh_files.write_args(spark, {"k": 20, "names": ["a"]}, str(tmp_path / "args"))
    assert {r["name"]: r["value"] for r in spark.read.json(str(tmp_path / "args")).collect()} == {"k": "20", "names": '["a"]'}


def test_bridges_both_ways_and_through_hubs(spark):
    rows = [("a", "h", 0, 1), ("a", "h", 1, 1), ("h", "b", 1, 2), ("c", "h", 0, 0)]
    b = spark.createDataFrame(rows, "src string, dst string, ref_src long, ref_dst long")
    assert {tuple(r) for r in sampling.both_ways(b).collect()} == {*rows, ("h", "a", 1, 1), ("b", "h", 2, 1), ("h", "c", 0, 0)}
    hubs = {(r["src"], r["dst"]): r["hub"] for r in sampling.hubs(b).collect()}
    assert hubs[("a", "b")] == "h" and hubs[("a", "h")] is None and len(hubs) == 12
    maps = {tuple(r) for r in sampling.bridge_maps(b).where("src = 'a' and dst in ('b', 'c')").collect()}
    assert maps == {("a", "b", 0, 2), ("a", "b", 1, 2), ("a", "c", 0, None), ("a", "c", 1, None)}


def test_pairs_of_poses(spark):
    poses = spark.createDataFrame([("a", f"p{i}") for i in range(4)] + [("b", f"q{i}") for i in range(3)] + [("v", "r0")], "category string, pose string")
    train, val = poses.where("category <> 'v'"), poses.where("category = 'v'")
    links = spark.createDataFrame([(x, y, None) for x in "abv" for y in "abv" if x != y], "src string, dst string, hub string")
    pairs = sampling.category_pairs(train, val, links)
    assert {tuple(r) for r in pairs.collect()} == {("a", "a", "same"), ("b", "b", "same"), ("a", "b", "cross"), ("a", "v", "val"), ("b", "v", "val")}
    draws = sampling.train_draws(spark.range(300).select(F.col("id").alias("step")), pairs, poses, 0.5, 4).collect()
    assert len(draws) == 300 and all(r["a"] != r["b"] or r["pose_a"] != r["pose_b"] for r in draws) and 100 < sum(r["role"] == "cross" for r in draws) < 200
    checks = [tuple(r) for r in sampling.val_draws(pairs.where("role <> 'same'"), poses, 3).collect()]
    assert len(checks) == len(set(checks)) == 9


def test_draws_do_not_depend_on_partitions(spark):
    v = spark.createDataFrame([(m, i, float(i), 1.0, 2.0) for m in range(2) for i in range(50)], "mesh_id int, v long, x double, y double, z double")
    for draw in (
        lambda d: sampling.subsampled(d, 20, 1), lambda d: sampling.landmarks(d, "v", 6, 2, ["mesh_id"]), lambda d: sampling.noisy(d, 0.1, 3), lambda d: sampling.batches(d, ["mesh_id", "v"], 16, 4),
        lambda d: sampling.vertex_pairs(d.groupBy("mesh_id").agg(F.count("*").alias("n")), 30, 5), lambda d: sampling.shuffled(d, ["mesh_id", "v"], 6).limit(9),
    ):
        assert sorted(map(str, draw(v).collect())) == sorted(map(str, draw(v.repartition(5)).collect()))
    kept = sampling.subsampled(v, 20, 1)
    assert sorted(r["new"] for r in kept.where("mesh_id = 1").collect()) == list(range(20))
    corr = v.select(F.col("mesh_id").alias("pair_id"), F.col("v").alias("ref"), F.col("v").alias("va"), F.col("v").alias("vb"))
    ids = kept.withColumnRenamed("mesh_id", "pair_id")
    assert {(r["va"], r["vb"]) for r in sampling.remapped(corr, ids, ids).collect()} == {(i, i) for i in range(20)}
    ordered = sampling.batches(v, ["mesh_id", "v"], 30).groupBy("batch").agg(F.count("*").alias("n"), F.min(F.struct("mesh_id", "v")).alias("lo")).orderBy("batch").collect()
    assert [r["n"] for r in ordered] == [30, 30, 30, 10] and [tuple(r["lo"]) for r in ordered] == [(0, 0), (0, 30), (1, 10), (1, 40)]
    sizes = spark.createDataFrame([(0, 50), (1, 51)], "pair_id int, n long")
    assert {r["pair_id"]: r["identity"] for r in sampling.is_identity(sampling.identity(v), sizes).collect()} == {0: True, 1: False}


def _numeric(terms, ox, oy, x, y, e=1e-4):
    def z(x, y):
        return sum(c * (x + ox) ** i * (y + oy) ** j for i, j, c in terms)

    def curvature(x, y):
        zx, zy = (z(x + e, y) - z(x - e, y)) / (2 * e), (z(x, y + e) - z(x, y - e)) / (2 * e)
        zxx, zyy = (z(x + e, y) - 2 * z(x, y) + z(x - e, y)) / e**2, (z(x, y + e) - 2 * z(x, y) + z(x, y - e)) / e**2
        zxy = (z(x + e, y + e) - z(x + e, y - e) - z(x - e, y + e) + z(x - e, y - e)) / (4 * e * e)
        one, two = np.array([[1 + zx * zx, zx * zy], [zx * zy, 1 + zy * zy]]), np.array([[zxx, zxy], [zxy, zyy]]) / math.sqrt(1 + zx * zx + zy * zy)
        return np.linalg.solve(one, two), zx, zy

    return curvature(x, y)


def test_surface_quantities(spark):
    surfaces = surface_rows.sampled_surfaces(spark, 6, (2, 4), 0.6, 3, offset=0.2)
    rows = surface_rows.differential(surface_rows.random_sampler(3, 5, 1)(surfaces, 1.0)).collect()
    assert len({r["surface_id"] for r in rows}) == 6 and len({len(r["terms"]) for r in rows}) > 1
    for r in rows:
        s, zx, zy = _numeric([tuple(t) for t in r["terms"]], r["ox"], r["oy"], r["x"], r["y"])
        values = sorted(np.linalg.eigvals(s).real)[::-1]
        assert np.allclose([r["k1"], r["k2"]], values, atol=1e-4) and np.isclose(r["H"], s.trace() / 2, atol=1e-4) and np.isclose(r["K"], np.linalg.det(s), atol=1e-4)
        for k in (1, 2):
            v = np.array([r[f"v{k}x"], r[f"v{k}y"]])
            assert np.allclose(s @ v, values[k - 1] * v, atol=2e-3) and np.isclose(np.linalg.norm(v), 1) and np.isclose(r[f"v{k}_3z"], zx * v[0] + zy * v[1], atol=1e-5)
            lift = np.array([*v, zx * v[0] + zy * v[1]])
            g = np.array([r["Hx"], r["Hy"], zx * r["Hx"] + zy * r["Hy"]])
            assert np.isclose(r["signature"][1 + k], g @ lift / np.linalg.norm(lift), atol=1e-3)


def test_flipped_normals_need_no_join(spark, capsys):
    """Rows of one surface_id with different terms turn by their own mean curvature; one surface's row was taken for all before."""
    up, down = ([(2, 0, c), (0, 2, c), (1, 0, 0.3)] for c in (1.0, -1.0))
    s = spark.createDataFrame([(1, up, 0.1, 0.0), (1, down, 0.1, 0.0), (None, down, None, None)], f"surface_id long, terms {surface_rows.TERMS_TYPE}, ox double, oy double")
    d = surface_rows.differential(surface_rows.regular_sampler(9)(s, 0.5), flip_normals=True)
    assert {(r["terms"][0]["c"], r["nz"] > 0) for r in d.select("terms", "nz").collect()} == {(1.0, True), (-1.0, False)}
    d.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "Join" not in plan and "Exchange" not in plan


def test_surface_samplings(spark):
    s = surface_rows.sampled_surfaces(spark, 4, (3, 3), 0.5, 9, kind="normal")
    assert sorted(map(str, s.collect())) == sorted(map(str, surface_rows.sampled_surfaces(spark, 4, (3, 3), 0.5, 9, kind="normal").repartition(3).collect()))
    both = surface_rows.samplings(s, [surface_rows.regular_sampler(9), surface_rows.random_sampler(4, 6, 2)], 1.0)
    assert both.where("sampler = 0").count() == 36 and 16 <= both.where("sampler = 1").count() <= 24
    scale = 1 / F.sqrt("area")
    areas = surface_rows.areas(s, 400, 1.0)
    small = surface_rows.rescaled(s.join(areas, "surface_id"), scale)
    at = small.crossJoin(spark.createDataFrame([(0.3, -0.2)], "qx double, qy double")).withColumns({"x": F.col("qx") * scale, "y": F.col("qy") * scale})
    pairs = at.select("surface_id", surface_rows.derivative().alias("z"), "area").join(s.withColumns({"x": F.lit(0.3), "y": F.lit(-0.2)}).select("surface_id", surface_rows.derivative().alias("w")), "surface_id").collect()
    assert all(np.isclose(r["z"], r["w"] / math.sqrt(r["area"])) for r in pairs)
    origins = surface_rows.origin_rows(s)
    moved = surface_rows.centred_at_origin(surface_rows.regular_sampler(9)(s, 1.0).withColumn("z", surface_rows.derivative()), origins)
    assert all(abs(r["z"]) < 1e-12 for r in moved.where("x = 0 and y = 0").collect())
    with pytest.raises(ValueError):
        surface_rows.random_sampler(2, 5, 0)


def test_delaunay(spark):
    rng = np.random.default_rng(0)
    xy = rng.random((40, 2))
    points_ = spark.createDataFrame([(1, 2 * i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "surface_id int, p long, x double, y double")
    faces = [(r["v0"] // 2, r["v1"] // 2, r["v2"] // 2) for r in surface_rows.delaunay(points_).collect()]
    for t in faces:
        a, b, c = xy[list(t)]
        m = np.linalg.solve(2 * np.array([b - a, c - a]), [b @ b - a @ a, c @ c - a @ a])
        assert (np.linalg.norm(xy - m, axis=1) >= np.linalg.norm(a - m) - 1e-9).all()
    area = sum(abs(np.linalg.det([xy[t[1]] - xy[t[0]], xy[t[2]] - xy[t[0]]])) / 2 for t in faces)
    from functools import reduce

    hull = sorted(map(tuple, xy))

    def half(ps):
        return reduce(lambda h, p: (lambda g: [*g, p])(h if len(h) < 2 else _drop(h, p)), ps, [])

    def _drop(h, p):
        while len(h) > 1 and (h[-1][0] - h[-2][0]) * (p[1] - h[-2][1]) <= (h[-1][1] - h[-2][1]) * (p[0] - h[-2][0]):
            h = h[:-1]
        return h

    ring = np.array(half(hull)[:-1] + half(hull[::-1])[:-1])
    assert np.isclose(area, abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, np.roll(ring, -1, 0)))) / 2)
    assert surface_rows.grid_faces(spark.range(2).withColumnRenamed("id", "surface_id"), 4).count() == 36


def test_poses(spark):
    rng = np.random.default_rng(1)
    rows = [(0, p, k, *map(float, rng.normal(size=6))) for p in range(5) for k in range(4)]
    d = spark.createDataFrame(rows, "mesh_id int, patch long, neighbor long, px double, py double, pz double, nx double, ny double, nz double")
    turn, shift = patches.axis_rotation("z", patches.swing(1.0, F.lit(0.25))), patches.axis_shift("x", F.lit(2.0))
    got = patches.posed(d, [patches.random_rotation(3), lambda _: (shift, turn)]).orderBy("patch", "neighbor").collect()
    again = patches.posed(d.repartition(3), [patches.random_rotation(3), lambda _: (shift, turn)]).orderBy("patch", "neighbor").collect()
    assert got == again
    for p in range(5):
        old, new = (np.array([[r["px"], r["py"], r["pz"], r["nx"], r["ny"], r["nz"]] for r in rs]) for rs in (pd.DataFrame(rows, columns=d.columns).query(f"patch == {p}").to_dict("records"), [r for r in got if r["patch"] == p]))
        assert np.allclose(np.linalg.norm(old[1:, :3] - old[0, :3], axis=1), np.linalg.norm(new[1:, :3] - new[0, :3], axis=1)) and np.allclose(np.linalg.norm(old[:, 3:], axis=1), np.linalg.norm(new[:, 3:], axis=1))
    m = [patches.axis_rotation(a, F.lit(0.4)) for a in "xyz"]
    flat = np.array(spark.range(1).select(*(c.alias(f"c{i}{j}{k}") for i, r in enumerate(m) for j, row in enumerate(r) for k, c in enumerate(row))).first()).reshape(3, 3, 3)
    assert np.allclose([x @ x.T for x in flat], np.eye(3)) and np.allclose([np.linalg.det(x) for x in flat], 1)


def test_features(spark):
    d = spark.createDataFrame([(0, 0, 1, 1.0, 2.0, 2.0), (0, 0, 2, 0.0, 3.0, 4.0)], "mesh_id int, patch long, neighbor long, px double, py double, pz double")
    patches.register_features("lengths", patches.vectorized(lambda p, n: np.linalg.norm(p, axis=1, keepdims=True)))
    patches.register_features("none", lambda rows: F.lit(None).cast("array<double>"))
    assert [r["features"] for r in patches.with_features(d, "lengths").orderBy("neighbor").collect()] == [[3.0], [5.0]]
    patches.register_features("slopes", patches.vectorized(lambda p, n: (p * n).sum(1, keepdims=True)))
    with_normals = d.withColumns({"nx": F.lit(0.0), "ny": F.lit(2.0), "nz": F.lit(1.0)})
    assert [r["features"] for r in patches.with_features(with_normals, "slopes").orderBy("neighbor").collect()] == [[6.0], [10.0]]
    assert [r["features"] for r in patches.with_features(d, "none").orderBy("neighbor").collect()] == [[1.0, 2.0, 2.0], [0.0, 3.0, 4.0]]
    assert [r["features"] for r in patches.with_features(d).orderBy("neighbor").collect()] == [[1.0, 2.0, 2.0], [0.0, 3.0, 4.0]]
    top = patches.max_pooled(d, ["px", "pz"], ["patch"]).first()
    assert (top["px"], top["pz"]) == (1.0, 4.0)


def test_random_patches(spark):
    d = spark.range(60).select(F.lit(0).alias("mesh_id"), (F.col("id") % 12).alias("patch"), F.col("id").alias("neighbor"))
    drawn = patches.random_patches(d, 5, 1)
    assert drawn.count() == 25 and drawn.select("patch").distinct().count() == 5 and patches.random_patches(d, 50, 1).count() == 60


def test_loss_reductions_and_probes(spark):
    rng = np.random.default_rng(2)
    rows = [(0, p, k, *map(float, rng.normal(size=6))) for p in range(4) for k in range(5)]
    d = spark.createDataFrame(rows, "mesh_id int, patch long, neighbor long, px double, py double, pz double, gx double, gy double, gz double")
    areas = spark.createDataFrame([(0, p, 0.5 + p) for p in range(4)], "mesh_id int, patch long, area double")
    one = losses.dirichlet_consistency(d, areas, "random", 4, 7)
    values = [r["loss"] for r in one.orderBy("patch").collect()]
    assert np.allclose(values, [r["loss"] for r in losses.dirichlet_consistency(d.repartition(3), areas, "random", 4, 7).orderBy("patch").collect()])
    assert np.isclose(losses.reduced(one, "loss", "mean").first()[0], np.mean(values)) and np.isclose(losses.reduced(one, "loss", "sum").first()[0], sum(values)) and losses.reduced(one, "loss", "none") is one
    for bad in (lambda: losses.reduced(one, "loss", "max"), lambda: losses.dirichlet_consistency(d, areas, "grid"), lambda: losses.contrastive(one, "hinge"), lambda: losses.normalized_weights({"a": -1.0})):
        with pytest.raises(ValueError):
            bad()
    assert losses.normalized_weights({"a": 3.0, "b": 1.0, "c": None}) == {"a": 0.75, "b": 0.25, "c": None}
    w = spark.createDataFrame([("w", 0, 1.0, 2.0), ("w", 1, 5.0, 1.0)], "name string, i int, value double, start double")
    assert losses.parameter_proximity(w).first()[0] == 17 / 5
    soft = losses.softmax(spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 800.0)], "k int, x double"), ["k"], "x").orderBy("x").collect()
    assert np.allclose([r["softmax"] for r in soft], [1 / (1 + math.e), math.e / (1 + math.e), 1.0])
    step = {r["name"]: r["value"] for r in losses.step_metrics(spark.createDataFrame([("a", 2.0), ("b", 4.0)], "name string, value double"), {"a": 1.0, "b": None}, areas).collect()}
    assert step == {"a": 2.0, "b": 4.0, "weighted_a": 2.0, "loss": 2.0, "area_mean": 2.0, "area_std": pytest.approx(np.std([0.5, 1.5, 2.5, 3.5], ddof=1))}


def test_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    edges = rng.integers(0, 120, (90, 2))
    up = list(range(120))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    e = spark.createDataFrame([(0, int(a), int(b)) for a, b in edges], "mesh_id int, a long, b long")
    nodes = spark.range(120).select(F.lit(0).alias("mesh_id"), F.col("id").alias("v"))
    got = {r["v"]: r["component"] for r in graphs.components(e, nodes).collect()}
    assert got == {v: root(v) for v in range(120)}
    path = spark.range(200).select(F.lit(0).alias("mesh_id"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graphs.component_sizes(graphs.components(path, spark.range(201).select(F.lit(0).alias("mesh_id"), F.col("id").alias("v")))).collect()[0]["size"] == 201


def test_boundary_loops_of_a_ring(spark):
    n = 8  # a band of triangles between an inner and an outer circle
    faces = [(0, 2 * i, i, (i + 1) % n, n + i) for i in range(n)] + [(0, 2 * i + 1, (i + 1) % n, n + (i + 1) % n, n + i) for i in range(n)]
    f = spark.createDataFrame(faces, "mesh_id int, f long, v0 long, v1 long, v2 long")
    assert {(r["component"], r["size"]) for r in graphs.component_sizes(graphs.boundary_loops(f)).collect()} == {(0, n), (n, n)}
    apart = f.union(spark.createDataFrame([(0, 99, 50, 51, 52)], f.schema))
    assert {r["component"] for r in graphs.face_components(apart).collect()} == {0, 99}


def test_degenerate_faces_have_a_floor(spark):
    v = spark.createDataFrame([(0, i, float(i), 0.0, 0.0) for i in range(3)], "mesh_id int, v long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 0, 1, 2)], "mesh_id int, f long, v0 long, v1 long, v2 long")
    assert topology.face_areas(f, v).first()["area"] == pytest.approx(1e-6)


def test_sparsity_counts_empty_rows(spark):
    coo = spark.createDataFrame([(0, 0, 1, 2.0), (0, 0, 2, 1.0)], "mesh_id int, i long, j long, val double")
    every = spark.range(4).select(F.lit(0).alias("mesh_id"), F.col("id").alias("v"))
    r = sparse.sparsity(coo, every).first()
    assert (r["nnz"], r["rows"], r["avg_row"], r["max_row"], r["min_row"], r["density"]) == (2, 4, 0.5, 2, 0, 12.5)


def test_metrics_of_groups_without_finite_pairs(spark):
    d = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 3.0), ("b", float("nan"), 1.0), ("b", 2.0, float("inf")), ("c", 2.0, 2.0)], "k string, a double, b double")
    got = {r["k"]: tuple(r)[1:] for r in metrics.distance_metrics(d, ["k"]).collect()}
    assert got["a"] == (1.0, 0.0, 0.0) and got["b"] == (0.0, 1.0, 1.0) and got["c"] == (0.0, 0.0, 0.0)


def test_transfer_and_map_errors(spark):
    corr = spark.createDataFrame([(0, 5, 1), (1, 2, 1), (2, 3, 0)], "ref long, va long, vb long")
    field = spark.createDataFrame([(5, 0.5), (2, 0.2), (3, 0.3)], "v long, val double")
    got = {r["v"]: r["val"] for r in correspondence.transfer(corr, field, spark.range(4).withColumnRenamed("id", "v"), -1.0).collect()}
    assert got == {0: 0.3, 1: 0.2, 2: -1.0, 3: -1.0}
    c = np.array([[1.0, 0.2], [0.1, 0.9]])
    r = correspondence.map_errors(spark.createDataFrame([(i, j, float(c[i, j])) for i in range(2) for j in range(2)], "r int, c int, val double")).first()
    assert np.allclose(list(r), [np.linalg.norm(c.T @ c - np.eye(2)), np.linalg.norm(c @ c.T - np.eye(2)), np.linalg.norm(c - np.eye(2)), (1 + 0.81) / (c**2).sum()])


def test_softplus_does_not_overflow(spark):
    got = [r[0] for r in spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "x double").select(scalars.softplus(F.col("x"))).collect()]
    assert np.allclose(got, [0, math.log(2), 800])


def test_unguarded_normalization_and_units(spark):
    v = spark.createDataFrame([(0, 0, 1.0, 1.0, 1.0), (0, 1, 1.0, 1.0, 1.0)], "mesh_id int, v long, x double, y double, z double")
    assert all(math.isnan(r["x"]) for r in points.normalized(v, guarded=False).collect()) and all(r["x"] == 0 for r in points.normalized(v).collect())
    u = v.limit(1).select(*points.unit([F.lit(0.0)] * 3, (0.0, 0.0, 1.0), 1e-10)).first()
    assert tuple(u) == (0.0, 0.0, 1.0) and tuple(v.limit(1).select(*points.unit([F.lit(3.0), F.lit(0.0), F.lit(4.0)])).first()) == (0.6, 0.0, 0.8)


def test_grid_neighbours_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.random((150, 3)), rng.random((40, 3)) * 0.01 + 5, [[20.0, 20.0, 20.0]], np.repeat([[0.5, 0.5, 0.5]], 5, 0)])
    v = spark.createDataFrame([(i % 2, i, *map(float, x)) for i, x in enumerate(p)] + [(7, 900, 0.0, 0.0, 0.0), (7, 901, 1.0, 0.0, 0.0)], "mesh_id int, v long, x double, y double, z double")
    k = lambda rows: sorted((r["mesh_id"], r["center"], r["rank"], r["neighbor"], round(r["dist"], 9)) for r in rows.collect())
    assert k(neighbors.grid_knn(v, 6)) == k(neighbors.knn(v.select("mesh_id", "v", F.array("x", "y", "z").alias("p")), 6))


def test_options():
    from vertexflow.plans import options

    assert options.checked(operator_mode="gradient", laplacian_mode="anisotropic") == {"operator_mode": "gradient", "laplacian_mode": "anisotropic"}
    for bad in ({"operator_mode": "both"}, {"colour": "red"}, {"laplacian_mode": "anisotropic"}, {"operator_mode": "stiffness", "curvature_mode": "gradient"}):
        with pytest.raises(ValueError):
            options.checked(**bad)
    options.register("pair", lambda one, two: (one, two))
    made = options.built({"target": "pair", "one": [1, {"a": 2}], "two": {"target": "pose.align_normal"}})
    assert made == ([1, {"a": 2}], patches.align_normal)
    with pytest.raises(ValueError):
        options.built({"target": "nothing"})


def test_contrastive_reads_its_similarities_once(spark):
    """Similarities that come out a little different each time they are made: no match lies above itself."""
    import random

    noise = F.udf(lambda a: 1e-13 * random.SystemRandom().random(), "double").asNondeterministic()
    sims = spark.range(20).crossJoin(spark.range(20).withColumnRenamed("id", "b")).select(F.col("id").alias("a"), "b")
    sims = sims.withColumn("sim", F.when(F.col("a") == F.col("b"), 0.9).otherwise(0.1) + noise("a"))
    for kind in ("infonce", "dclw"):
        assert losses.contrastive(sims, kind).first()["accuracy"] == 1
    assert losses.top_hits(sims).first()["accuracy"] == 1


def test_gradients_are_shuffled_by_centre_alone(spark):
    """A row for all axes goes to its centre; neither axes nor places are dealt one by one."""
    rows = [(m, c, n, 1.0 + c, 2.0 * n, float(c * n)) for m in range(2) for c in range(4) for n in range(4) if c != n]
    g = spark.createDataFrame([*rows, (0, 1, 2, 0.5, 0.0, 1.0)], "mesh_id int, center long, neighbor long, gx double, gy double, gz double")
    areas = g.select("mesh_id", "center", (1.0 + F.col("center")).alias("area")).distinct()
    made = {"gradient": sparse.gradient(g), "anisotropic": sparse.anisotropic(g, areas)}
    for out in made.values():
        dealt = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
        assert dealt and not any(" d#" in line or " j#" in line for line in dealt)
    for mesh in range(2):
        whole = np.zeros((4, 3, 4))
        for r in made["gradient"].where(f"mesh_id = {mesh}").collect():
            whole[r["i"], r["d"], r["j"]] += r["val"]
        want = sum((1.0 + i) * whole[i].T @ whole[i] for i in range(4))
        got = np.zeros((4, 4))
        for r in made["anisotropic"].where(f"mesh_id = {mesh}").collect():
            got[r["i"], r["j"]] += r["val"]
        assert np.allclose(got, want) and np.allclose(whole.sum(2), 0)


def test_medians_hold_ranges_of_values_alone(spark):
    from vertexflow.operators import spectral

    rng = np.random.default_rng(8)
    groups = {"odd": rng.normal(size=501).tolist(), "even": rng.normal(size=400).tolist(), "equal": [2.5] * 300, "two": [1.0, 4.0], "one": [-3.0, None], "dense": rng.integers(0, 9, 1000).astype(float).tolist()}
    rows = spark.createDataFrame([(k, x) for k, xs in groups.items() for x in xs], "k string, value double").repartition(7)
    got = {r["k"]: r["median"] for r in metrics.medians(rows, ["k"]).collect()}
    assert got == {k: float(np.median([x for x in xs if x is not None])) for k, xs in groups.items()}
    out = spectral.experiment({"m": rows.withColumnRenamed("value", "x")}, ["x"])
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_resized_weights_share_one_shuffle(spark, small):
    """Ranks, cut and padding meet in one shuffle and nothing is sorted before it; tied ranks pad a centre once."""
    from vertexflow import registry

    plan = registry.QUERIES["resized_patch_weights"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" not in plan, plan
    w = spark.createDataFrame([(0, 1, 1, 10, 2.0), (0, 1, 1, 11, 4.0), (0, 2, 1, 12, 1.0), (0, 2, 2, 13, None), (0, 2, 9, 14, 8.0), (1, 2, 1, 15, 5.0), (0, 3, 7, 16, 5.0)], "mesh_id int, center long, rank int, neighbor long, w double")
    got = {(r[0], r[1]): r[2] for r in patches.resized_weights(w, 4).groupBy("mesh_id", "center").agg(F.collect_list(F.struct("rank", "neighbor", "w"))).collect()}
    want = {(0, 1): [(1, 10, 2.0), (1, 11, 4.0), (3, None, 3.0), (4, None, 3.0)], (0, 2): [(1, 12, 1.0), (2, 13, None), (3, None, 1.0), (4, None, 1.0)], (1, 2): [(1, 15, 5.0), *((i, None, 5.0) for i in (2, 3, 4))]}
    assert {k: sorted(map(tuple, v), key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
