"""Formats and the table function, read by name."""

import json

import numpy as np
import pytest

from vertexflow.operators import surface_rows
from vertexflow.sources import spark_sources


@pytest.fixture(scope="module")
def registered(spark):
    spark_sources.register(spark)
    return spark


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("meshes")
    (top / "deep").mkdir()
    (top / "a.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nv 1 1 0\nf 1 2 3\nf 2 4 3\n")
    (top / "deep" / "a.OFF").write_text("OFF\n3 1 0\n0 0 0\n2 0 0\n0 2 5\n3 0 1 2\n")
    (top / "large.obj").write_text("v 0 0 0\n" * 500)
    (top / "notes.txt").write_text("no mesh")
    return str(top)


def test_meshes(registered, folder):
    v = registered.read.format("meshes").load(folder)
    assert v.rdd.getNumPartitions() == 3
    assert {(r["mesh_id"], r["count"]) for r in v.groupBy("mesh_id").count().collect()} == {("a", 4), ("deep/a", 3), ("large", 500)}
    small = v.where("bytes < 1000 and mesh_id > 'b'")
    assert [(r["v"], r["x"], r["z"]) for r in small.orderBy("v").collect()] == [(0, 0.0, 0.0), (1, 2.0, 0.0), (2, 0.0, 5.0)]
    f = registered.read.format("meshes").option("part", "faces").load(folder)
    assert sorted((r["mesh_id"], r["v0"], r["v1"], r["v2"]) for r in f.collect()) == [("a", 0, 1, 2), ("a", 1, 3, 2), ("deep/a", 0, 1, 2)]


def test_filters_choose_files_before_they_are_read(folder):
    from pyspark.sql.datasource import GreaterThan, LessThan, StringContains

    reader = spark_sources.MeshReader(folder, "vertices")
    left = list(reader.pushFilters([LessThan(("bytes",), 1000), StringContains(("mesh_id",), "a"), GreaterThan(("x",), 0.0)]))
    assert [type(f).__name__ for f in left] == ["StringContains", "GreaterThan"]
    assert [p.mesh_id for p in reader.partitions()] == ["a", "deep/a"]


def test_an_empty_folder_and_a_wrong_part(registered, tmp_path):
    assert registered.read.format("meshes").load(str(tmp_path)).collect() == []
    with pytest.raises(Exception, match="vertices or faces"):
        registered.read.format("meshes").option("part", "edges").load(str(tmp_path)).collect()


def test_polynomials_depend_on_their_number_alone(registered, monkeypatch):
    read = lambda n, **o: {r["surface_id"]: r for r in registered.read.format("polynomials").options(count=n, seed=3, scale=0.5, offset=0.1, **o).load().collect()}
    many, few = read(40), read(7)
    assert len(many) == 40 and all(many[i] == few[i] for i in few)
    assert {max(t["i"] + t["j"] for t in r["terms"]) for r in many.values()} == {2, 3}
    assert all(abs(t["c"]) <= 0.5 for r in many.values() for t in r["terms"]) and all(abs(r["ox"]) <= 0.1 for r in many.values())
    assert read(5, kind="normal") != read(5) and registered.read.format("polynomials").load().count() == 0


def test_pose_pairs(registered):
    options = {"steps": 300, "seed": 1, "cross_ratio": 0.4, "poses": json.dumps({"cat": ["p", "q", "r"], "dog": ["s"], "eel": ["t", "u"]}), "bridges": json.dumps([["dog", "cat"], ["cat", "yak"]])}
    rows = registered.read.format("pose_pairs").options(**options).load().collect()
    assert sorted(r["step"] for r in rows) == list(range(300))
    cross = [r for r in rows if r["role"] == "cross"]
    assert 80 < len(cross) < 160 and {(r["a"], r["b"]) for r in cross} == {("cat", "dog")}
    assert all(r["a"] == r["b"] and (r["pose_a"] != r["pose_b"] or r["a"] == "dog") for r in rows if r["role"] == "same")


def test_sample_grid_in_sql_feeds_the_surfaces(registered):
    registered.read.format("polynomials").options(count=3, seed=2).load().createOrReplaceTempView("surfaces")
    grid = registered.sql("SELECT s.*, g.* FROM surfaces s, LATERAL sample_grid(9, 0.5, NULL) g")
    same = surface_rows.regular_sampler(9)(registered.table("surfaces"), 0.5)
    assert sorted((r["surface_id"], r["p"], r["x"], r["y"]) for r in grid.collect()) == sorted((r["surface_id"], r["p"], r["x"], r["y"]) for r in same.collect())
    assert surface_rows.differential(grid).where("H is not null").count() == 27
    drawn = [r for r in registered.sql("SELECT s.surface_id, g.* FROM surfaces s, LATERAL sample_grid(5, 2.0, s.surface_id) g").collect()]
    assert len(drawn) == 15 and np.abs([r["x"] for r in drawn]).max() <= 2 and len({r["x"] for r in drawn}) == 15
