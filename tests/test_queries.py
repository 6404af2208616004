"""Every registered query against its SQL, and kernels against their equations."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vertexflow import registry
from vertexflow.operators import points, sparse, surfaces


def rows(frame: pd.DataFrame) -> list[tuple]:
    """Sorted rows; -0.0 is 0.0 and numbers compare to nine digits."""
    out = []
    for r in frame[sorted(frame.columns)].itertuples(index=False):
        out.append(tuple(None if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)) else float(f"{x:.9g}") + 0.0 if isinstance(x, (int, float, np.integer, np.floating)) and not isinstance(x, (bool, np.bool_)) else str(x) for x in r))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(registry.ORACLE_SQL[name]).df()
    got = registry.QUERIES[name](spark, small).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    for a, b in zip(rows(got), rows(want)):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-8) for x, y in zip(a, b)), (a, b)


def test_entry_imports_without_llm():
    """In a process that can't import the training-data subpackage or its pipeline, everything else is still there."""
    import subprocess
    import sys

    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("vertexflow.llm", "corpus_pipeline", "public_tokenizers")):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
from vertexflow import registry
assert set(e.queries()) == set(registry.QUERIES) and set(e.oracle_sql()) == set(registry.ORACLE_SQL) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[1])


def test_entry_lists_queries_with_their_sql():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_operators_sum_to_zero(spark):
    g = spark.createDataFrame([(0, c, n, float(c + n), float(c - n), 1.0) for c in range(5) for n in range(5) if c != n], "mesh_id int, center long, neighbor long, gx double, gy double, gz double")
    a = g.select("mesh_id", "center", F.lit(2.0).alias("area")).distinct()
    for m in (sparse.anisotropic(g, a), sparse.one_hop(sparse.anisotropic(g, a), g.where("neighbor = center + 1"))):
        assert all(abs(r["s"]) < 1e-9 for r in m.groupBy("i").agg(F.sum("val").alias("s")).collect())
    sums = sparse.gradient(g).groupBy("i", "d").agg(F.sum("val").alias("s")).collect()
    assert len(sums) == 15 and all(abs(r["s"]) < 1e-9 for r in sums)


def test_rotations(spark):
    m = spark.range(1).select(*(c.alias(f"r{i}{j}") for i, row in enumerate(points.rodrigues(F.lit(0.3), F.lit(-0.5), F.lit(1.1))) for j, c in enumerate(row))).first()
    r = np.array(m).reshape(3, 3)
    assert np.allclose(r @ r.T, np.eye(3)) and np.isclose(np.linalg.det(r), 1) and np.allclose(r @ [0.3, -0.5, 1.1], [0.3, -0.5, 1.1])
    n = np.array([0.48, 0.6, 0.64])
    m = spark.range(1).select(*(c.alias(f"r{i}{j}") for i, row in enumerate(points.normal_to_z(tuple(F.lit(float(x)) for x in n))) for j, c in enumerate(row))).first()
    assert np.allclose(np.array(m).reshape(3, 3) @ n, [0, 0, 1])


def test_rescaled_surface():
    terms, s, x, y = [(1, 0, 0.4), (2, 1, -0.3)], 1.7, 0.6, -0.2
    f = lambda t, x, y: sum(c * x**i * y**j for i, j, c in t)
    assert math.isclose(f(surfaces.rescaled(terms, s), x * s, y * s), s * f(terms, x, y))


def test_one_hop_entries_without_dropped_products(spark, small):
    import random

    from vertexflow import law_queries

    draw = random.Random(3)
    rows = [(m, draw.randrange(9), draw.randrange(9), *(draw.choice([None, 0.0, draw.random()]) for _ in range(3))) for m in (0, 1) for _ in range(60)] + [(0, 20, 21, 1.0, 2.0, 3.0), (0, 2, None, 1.0, 1.0, 1.0)]
    g = spark.createDataFrame(rows, "mesh_id int, center long, neighbor long, gx double, gy double, gz double")
    # centres 7, 8 and 20 have no area, 1 has two
    a = spark.createDataFrame([(m, c, 0.5 + c) for m in (0, 1) for c in (0, 1, 1, 2, 3, 4, 5, 6)], "mesh_id int, center long, area double")
    found = [{(r["mesh_id"], r["i"], r["j"]): r["val"] for r in m.collect()} for m in (sparse.one_hop(sparse.anisotropic(g, a), g), sparse.anisotropic_one_hop(g, a))]
    assert len(found[0]) > 60 and found[0].keys() == found[1].keys()
    assert all(math.isclose(v, found[1][k], abs_tol=1e-9) for k, v in found[0].items())
    # by centre, by pair, by row, and the query's sums
    assert law_queries.one_hop_rows(spark, small)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4
