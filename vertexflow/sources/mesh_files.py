"""Mesh and correspondence files as tables, one task per file so vertex order is the file's.

A mesh is named by its path below the scanned folder, without the suffix, so files of one
name in different folders stay apart.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("obj", "off", "ply", "stl")
_PLY_KINDS = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def _below(folder: str) -> Column:
    """A path's part below ``folder``, without its suffix."""
    plain = re.escape(re.sub(r"^\w+:/+", "/", folder).rstrip("/"))
    return F.regexp_extract("path", rf"^.*?{plain}/(.*?)(?:\.[^./]*)?$", 1)


def _files(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.lower("path").rlike(rf"\.({'|'.join(suffixes)})$")).withColumn("mesh_id", _below(folder))


def mesh_files(spark: SparkSession, folder: str, least_bytes: int = 0, most_bytes: int | None = None, seed: int | None = None, most_files: int | None = None) -> DataFrame:
    """(path, mesh_id, length) of mesh files by size, filtered before any is read; suffixes in any case.

    ``most_files`` keeps the first by path, or by a hash of ``seed`` and path where a seed is given.
    """
    files = _files(spark, folder, SUFFIXES).select("path", "mesh_id", "length").where(F.col("length") >= least_bytes)
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    if most_files is None:
        return files
    order = ["path"] if seed is None else [F.xxhash64(F.lit(seed), "path"), "path"]
    return files.orderBy(*order).limit(most_files)


def _fan(polygon: list[int]) -> list[tuple[int, int, int]]:
    return [(polygon[0], polygon[i], polygon[i + 1]) for i in range(1, len(polygon) - 1)]


def _parse_obj(raw: bytes):
    vertices, faces = [], []
    for line in raw.decode("utf-8", "replace").splitlines():
        parts = line.split()
        if parts[:1] == ["v"]:
            vertices.append([float(x) for x in parts[1:4]])
        elif parts[:1] == ["f"]:  # corners a, a/t, a//n, a/t/n; from 1, or back from the last vertex
            at = [int(p.split("/")[0]) for p in parts[1:]]
            faces += _fan([i - 1 if i > 0 else len(vertices) + i for i in at])
    return vertices, faces


def _parse_off(raw: bytes):
    words = " ".join(line.split("#")[0] for line in raw.decode("ascii", "replace").splitlines()).split()
    if words and words[0].upper().endswith("OFF"):
        words = words[1:]
    nv, nf, at = int(words[0]), int(words[1]), 3
    vertices = np.array(words[at : at + 3 * nv], float).reshape(-1, 3)
    at, faces = at + 3 * nv, []
    for _ in range(nf):
        n = int(words[at])
        faces += _fan([int(x) for x in words[at + 1 : at + 1 + n]])
        at += n + 1
    return vertices, faces


def _parse_ply(raw: bytes):
    end = raw.index(b"end_header")
    body = raw.index(b"\n", end) + 1
    order, elements = "", []
    for line in raw[:end].decode("ascii", "replace").splitlines():
        p = line.split()
        if p[:1] == ["format"]:
            order = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}[p[1]]
        elif p[:1] == ["element"]:
            elements.append((p[1], int(p[2]), []))
        elif p[:1] == ["property"]:
            elements[-1][2].append(tuple(p[1:]))
    words, at = iter(raw[body:].split()) if not order else None, body

    def number(kind):
        nonlocal at
        if words is not None:
            return float(next(words))
        of = np.dtype(order + _PLY_KINDS[kind])
        at += of.itemsize
        return np.frombuffer(raw, of, 1, at - of.itemsize)[0]

    vertices, faces = [], []
    for name, count, properties in elements:
        for _ in range(count):
            row = {}
            for p in properties:
                row[p[-1]] = [number(p[2]) for _ in range(int(number(p[1])))] if p[0] == "list" else number(p[0])
            if name == "vertex":
                vertices.append([float(row[a]) for a in "xyz"])
            elif name == "face":
                polygon = row.get("vertex_indices", row.get("vertex_index"))
                faces += _fan([int(i) for i in polygon])
    return vertices, faces


def _parse_stl(raw: bytes):
    n = int.from_bytes(raw[80:84], "little")
    if len(raw) == 84 + 50 * n:
        rows = np.frombuffer(raw, np.dtype([("normal", "<f4", 3), ("corner", "<f4", (3, 3)), ("tail", "<u2")]), n, 84)
        soup = rows["corner"].reshape(-1, 3).astype(float)
    else:
        soup = np.array([line.split()[1:4] for line in raw.decode("ascii", "replace").splitlines() if line.split()[:1] == ["vertex"]], float).reshape(-1, 3)
    # equal corners are one vertex, numbered by first appearance
    _, first, inverse = np.unique(soup, axis=0, return_index=True, return_inverse=True)
    rank = np.empty(len(first), int)
    rank[np.argsort(first)] = np.arange(len(first))
    return soup[np.sort(first)], rank[inverse.ravel()].reshape(-1, 3)


PARSERS: dict[str, Callable] = {"obj": _parse_obj, "off": _parse_off, "ply": _parse_ply, "stl": _parse_stl}


def parse_mesh(path: str, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, triangles) of a file's content; polygons become fans, a file without vertices is an error."""
    vertices, faces = PARSERS[path.rsplit(".", 1)[1].lower()](raw)
    v, f = np.asarray(vertices, float).reshape(-1, 3), np.asarray(faces, np.int64).reshape(-1, 3)
    if not len(v):
        raise ValueError(f"no vertices in {path}")
    return v, f


def _read(spark: SparkSession, folder: str, part: int, columns: list[str], kind: str, index: str) -> DataFrame:
    def run(frames):
        for frame in frames:
            for path, mesh, raw in zip(frame.path, frame.mesh_id, frame.content):
                values = parse_mesh(path, bytes(raw))[part]
                yield pd.DataFrame({"mesh_id": mesh, index: np.arange(len(values)), **{c: values[:, i] for i, c in enumerate(columns)}})

    files = _files(spark, folder, SUFFIXES).select("path", "mesh_id", "content")
    return files.mapInPandas(run, f"mesh_id string, {index} long, {', '.join(f'{c} {kind}' for c in columns)}")


def mesh_vertices(spark: SparkSession, folder: str) -> DataFrame:
    """vertices(mesh_id, v, x, y, z) of all mesh files below a folder."""
    return _read(spark, folder, 0, ["x", "y", "z"], "double", "v")


def mesh_faces(spark: SparkSession, folder: str) -> DataFrame:
    """faces(mesh_id, f, v0, v1, v2) of all mesh files below a folder; none for a file without faces."""
    return _read(spark, folder, 1, ["v0", "v1", "v2"], "long", "f")


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mesh_id, v, nx, ny, nz): unit sums of the area-weighted normals of a vertex's faces."""
    from ..operators.points import unit
    from ..operators.topology import with_corners

    one, two = ([F.col(f"{a}{k}") - F.col(f"{a}0") for a in "xyz"] for k in (1, 2))
    cross = [one[1] * two[2] - one[2] * two[1], one[2] * two[0] - one[0] * two[2], one[0] * two[1] - one[1] * two[0]]
    each = with_corners(faces, vertices).select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("v"), *(c.alias(a) for c, a in zip(cross, "xyz")))
    sums = each.groupBy("mesh_id", "v").agg(*(F.sum(a).alias(a) for a in "xyz"))
    return sums.select("mesh_id", "v", *(c.alias(f"n{a}") for c, a in zip(unit([F.col(a) for a in "xyz"], (0.0, 0.0, 1.0)), "xyz")))


def _lines(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    whole = _files(spark, folder, (suffix,)).select("mesh_id", F.col("content").cast("string").alias("value"))
    return whole.select("mesh_id", F.posexplode(F.split("value", r"\r?\n")).alias("line", "text")).select("mesh_id", "line", F.trim("text").alias("text"))


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn(name, (F.row_number().over(Window.partitionBy("mesh_id").orderBy("line")) - 1).cast("long"))


def obj_vertices(spark: SparkSession, folder: str) -> DataFrame:
    """vertices(mesh_id, v, x, y, z) of OBJ files alone: the lines that start with ``v `` (normals and texture places don't)."""
    rows = _lines(spark, folder, "obj").where(F.col("text").startswith("v "))
    parts = F.split("text", r"\s+")
    rows = rows.select("mesh_id", "line", *(F.get(parts, F.lit(i + 1)).cast("double").alias(a) for i, a in enumerate("xyz")))
    return _numbered(rows, "v").select("mesh_id", "v", "x", "y", "z")


def template_map(spark: SparkSession, folder: str) -> DataFrame:
    """(mesh_id, ref, v) of ``.vts`` files: one number per line, from 1 on disk."""
    rows = _lines(spark, folder, "vts").where("text <> ''").select("mesh_id", "line", (F.col("text").cast("long") - 1).alias("v"))
    return _numbered(rows, "ref").select("mesh_id", "ref", "v")


def dataset_root(spark: SparkSession, folder: str) -> str:
    """``folder``, or the one folder below it whose children hold ``corres`` folders."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.lower("path").endswith(".vts")).select(_below(folder).alias("p"))
    heads = [r[0] for r in paths.select(F.regexp_extract("p", r"^(.*?)/?[^/]+/corres/[^/]+$", 1).alias("head")).where("p rlike '/corres/'").distinct().limit(2).collect()]
    return f"{folder.rstrip('/')}/{heads[0]}".rstrip("/") if len(heads) == 1 else folder


def category_poses(spark: SparkSession, root: str) -> DataFrame:
    """(category, pose): meshes ``<category>/<pose>.obj`` that have a map ``<category>/corres/<pose>.vts``; others are dropped."""
    meshes = _files(spark, root, ("obj",)).select(F.regexp_extract("mesh_id", r"^([^/]+)/([^/]+)$", 1).alias("category"), F.regexp_extract("mesh_id", r"^([^/]+)/([^/]+)$", 2).alias("pose"))
    maps = _files(spark, root, ("vts",)).select(F.regexp_extract("mesh_id", r"^([^/]+)/corres/([^/]+)$", 1).alias("category"), F.regexp_extract("mesh_id", r"^([^/]+)/corres/([^/]+)$", 2).alias("pose"))
    return meshes.where("pose <> ''").join(maps.where("pose <> ''"), ["category", "pose"]).orderBy("category", "pose")


def bridges(spark: SparkSession, root: str, categories: DataFrame) -> DataFrame:
    """(src, dst, ref_src, ref_dst) of ``cross_category_corres/<src>_<dst>.vts`` between known categories; the name splits at its first ``_``."""
    maps = template_map(spark, root).where(F.col("mesh_id").startswith("cross_category_corres/"))
    stem = F.regexp_extract("mesh_id", r"/([^/]+)$", 1)
    rows = maps.select(F.substring_index(stem, "_", 1).alias("src"), F.expr("substring(regexp_extract(mesh_id, '/([^/]+)$', 1), instr(regexp_extract(mesh_id, '/([^/]+)$', 1), '_') + 1)").alias("dst"), F.col("ref").alias("ref_src"), F.col("v").alias("ref_dst"))
    known = categories.select("category").distinct()
    return rows.join(F.broadcast(known), rows.src == known.category, "left_semi").join(F.broadcast(known), rows.dst == known.category, "left_semi")  # folder names: a listing's worth


def write_log(log: DataFrame, path: str) -> None:
    log.write.mode("overwrite").option("header", True).csv(path)


def write_args(spark: SparkSession, args: dict, path: str) -> None:
    """A run's arguments as one JSON row; values are written as JSON texts."""
    import json

    spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(args.items())], "name string, value string").coalesce(1).write.mode("overwrite").json(path)


def write_weights(spark: SparkSession, weights: dict[str, np.ndarray], path: str) -> None:
    """Model weights as (name, shape, values); a checkpoint is a folder of Parquet files."""
    rows = [(k, list(map(int, w.shape)), [float(x) for x in np.ravel(w)]) for k, w in sorted(weights.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").write.mode("overwrite").parquet(path)


def read_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r["name"]: np.array(r["values"], float).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}


def write_step(spark: SparkSession, weights: dict[str, np.ndarray], path: str, step: int, score: float) -> None:
    """A checkpoint of a step with its score, beside those of other steps."""
    write_weights(spark, weights, f"{path}/weights/step={step}")
    spark.createDataFrame([(step, float(score))], "step int, score double").coalesce(1).write.mode("overwrite").parquet(f"{path}/scores/step_={step}")


def read_step(spark: SparkSession, path: str, which: str = "best") -> tuple[int, dict[str, np.ndarray]]:
    """(step, weights) of the checkpoint with the highest score, the later one on ties, or of the last."""
    if which not in ("best", "last"):
        raise ValueError(f"a checkpoint is best or last, not {which}")
    order = [F.desc("score"), F.desc("step")] if which == "best" else [F.desc("step")]
    step = spark.read.parquet(f"{path}/scores").orderBy(*order).first()["step"]
    return step, read_weights(spark, f"{path}/weights/step={step}")
