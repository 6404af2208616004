"""Spark data sources: ``spark.read.format("meshes")``, ``"polynomials"`` and ``"pose_pairs"``, and the table function ``sample_grid``.

A partition is one mesh file, or a stretch of surface or step numbers; what a number draws
depends on it and the seed alone. ``meshes`` lists a folder by pyarrow's file systems, so it
reads what they reach; ``mesh_files`` reads any store that Spark does.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.functions import udtf

from .mesh_files import SUFFIXES, parse_mesh

#: Numbers of a partition of drawn rows.
STRETCH = 10_000
_TESTS = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b}


@dataclass
class MeshFile(InputPartition):
    path: str
    mesh_id: str
    size: int


@dataclass
class Stretch(InputPartition):
    first: int
    end: int


def _stretches(count: int) -> list[Stretch]:
    return [Stretch(i, min(i + STRETCH, count)) for i in range(0, count, STRETCH)] or [Stretch(0, 0)]


class MeshReader(DataSourceReader):
    """Filters on ``bytes`` and ``mesh_id`` choose files before any is opened."""

    def __init__(self, folder: str, part: str):
        self.folder, self.part, self.tests = folder, part, []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("bytes",), ("mesh_id",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[MeshFile]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        root = root.rstrip("/")
        found = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.is_file and info.path.lower().rsplit(".", 1)[-1] in SUFFIXES:
                mesh = re.sub(r"\.[^./]*$", "", info.path[len(root) + 1 :])
                if all(_TESTS[kind](info.size if column == "bytes" else mesh, value) for column, kind, value in self.tests):
                    found.append(MeshFile(info.path, mesh, info.size))
        return sorted(found, key=lambda p: p.path) or [MeshFile("", "", 0)]

    def read(self, partition: MeshFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder or self.folder.startswith("file:") else fs.LocalFileSystem()
        with system.open_input_file(partition.path) as f:
            rows = parse_mesh(partition.path, f.read())[self.part == "faces"]
        n = len(rows)
        names = ["v", "x", "y", "z"] if self.part == "vertices" else ["f", "v0", "v1", "v2"]
        columns = [pa.array([partition.mesh_id] * n, pa.string()), pa.array(np.full(n, partition.size)), pa.array(np.arange(n)), *(pa.array(rows[:, i]) for i in range(3))]
        yield pa.RecordBatch.from_arrays(columns, ["mesh_id", "bytes", *names])


class Meshes(DataSource):
    """Options: ``path``, a folder; ``part``, vertices (the default) or faces."""

    @classmethod
    def name(cls) -> str:
        return "meshes"

    def _part(self) -> str:
        part = self.options.get("part", "vertices")
        if part not in ("vertices", "faces"):
            raise ValueError(f"part is vertices or faces, not {part}")
        return part

    def schema(self) -> str:
        return "mesh_id string, bytes long, " + ("v long, x double, y double, z double" if self._part() == "vertices" else "f long, v0 long, v1 long, v2 long")

    def reader(self, schema) -> MeshReader:
        return MeshReader(self.options["path"], self._part())


class PolynomialReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.count, self.seed = int(options.get("count", 0)), int(options.get("seed", 0))
        self.orders = int(options.get("least_order", 2)), int(options.get("most_order", 3))
        self.scale, self.offset, self.kind = float(options.get("scale", 1.0)), float(options.get("offset", 0.0)), options.get("kind", "uniform")
        if self.kind not in ("uniform", "normal"):
            raise ValueError(f"unknown kind of coefficients: {self.kind}")

    def partitions(self) -> list[Stretch]:
        return _stretches(self.count)

    def read(self, partition: Stretch):
        for surface in range(partition.first, partition.end):
            rng = np.random.default_rng([self.seed, surface])
            order = int(rng.integers(self.orders[0], self.orders[1] + 1))
            powers = [(i, n - i) for n in range(1, order + 1) for i in range(n, -1, -1)]
            c = rng.uniform(-self.scale, self.scale, len(powers)) if self.kind == "uniform" else rng.normal(0, self.scale, len(powers))
            ox, oy = rng.uniform(-self.offset, self.offset, 2).tolist() if self.offset else (0.0, 0.0)
            yield surface, [(i, j, float(x)) for (i, j), x in zip(powers, c, strict=True)], ox, oy


class Polynomials(DataSource):
    """Drawn surfaces (surface_id, terms, ox, oy). Options: count, seed, least_order, most_order, scale, kind (uniform, normal), offset."""

    @classmethod
    def name(cls) -> str:
        return "polynomials"

    def schema(self) -> str:
        return "surface_id long, terms array<struct<i:int,j:int,c:double>>, ox double, oy double"

    def reader(self, schema) -> PolynomialReader:
        return PolynomialReader(self.options)


class PairReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.steps, self.seed, self.ratio = int(options.get("steps", 0)), int(options.get("seed", 0)), float(options.get("cross_ratio", 0.5))
        self.poses: dict[str, list[str]] = {c: sorted(p) for c, p in sorted(json.loads(options["poses"]).items())}
        self.cross = sorted({tuple(sorted(b)) for b in json.loads(options.get("bridges", "[]"))} & {(a, b) for a in self.poses for b in self.poses if a < b})

    def partitions(self) -> list[Stretch]:
        return _stretches(self.steps)

    def read(self, partition: Stretch):
        names = list(self.poses)
        for step in range(partition.first, partition.end):
            rng = random.Random(f"{self.seed}:{step}")
            if self.cross and rng.random() < self.ratio:
                a, b = rng.choice(self.cross)
                yield step, a, b, "cross", rng.choice(self.poses[a]), rng.choice(self.poses[b])
            else:
                a = rng.choice(names)
                one, two = rng.sample(self.poses[a], 2) if len(self.poses[a]) > 1 else self.poses[a] * 2
                yield step, a, a, "same", one, two


class PosePairs(DataSource):
    """Training pairs (step, a, b, role, pose_a, pose_b). Options: steps, seed, cross_ratio, poses (JSON: category to pose names), bridges (JSON: pairs of categories)."""

    @classmethod
    def name(cls) -> str:
        return "pose_pairs"

    def schema(self) -> str:
        return "step long, a string, b string, role string, pose_a string, pose_b string"

    def reader(self, schema) -> PairReader:
        return PairReader(self.options)


@udtf(returnType="p long, x double, y double")
class SampleGrid:
    """Rows of a sampling of [-radius, radius]^2: a regular grid of floor(sqrt(points))^2 places, or ``points`` drawn by a seed that isn't null."""

    def eval(self, points: int, radius: float, seed: int | None):
        radius = float(radius)  # SQL numbers come as decimals
        if seed is None:
            side = int(points**0.5)
            step = 2 * radius / (side - 1) if side > 1 else 0.0
            for p in range(side * side):
                yield p, p // side * step - radius, p % side * step - radius
        else:
            places = np.random.default_rng(seed).uniform(-radius, radius, (points, 2))
            for p, (x, y) in enumerate(places.tolist()):
                yield p, x, y


def register(spark: SparkSession) -> None:
    """Make the formats and the table function known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Meshes, Polynomials, PosePairs):
        spark.dataSource.register(source)
    spark.udtf.register("sample_grid", SampleGrid)
