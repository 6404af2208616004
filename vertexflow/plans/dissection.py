"""Symmetric positive definite systems solved across workers by nested dissection.

A mesh's vertices are ranked along a space-filling curve, and equal stretches of ranks form
the leaves of a binary tree. A vertex with a neighbour across a cut moves up to the tree
node of that cut, so every edge joins a node with one of its ancestors. The Cholesky
factor is then built level by level from the leaves: a task holds the dense front of one
node, its own vertices and those of ancestors that they touch, eliminates its own and hands
what is left to its parent. A solve goes up and down the same tree. Leaves are bounded; on
meshes of surfaces a front grows with the square root of the vertices below it, so no
worker holds a mesh, and the rounds grow with the logarithm of its size, whatever its
condition. A matrix is factored once for any number of right-hand sides.

All meshes go through the rounds together. Matrices are ``coo(mesh_id, i, j, val)`` with
every diagonal entry stored, fields ``(mesh_id, v, x)`` with an array of columns each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Vertices of a leaf at most; bits of a coordinate on the curve; bits of the curve by which vertices are dealt before they are ranked.
LEAF, BITS, DEALT = 256, 20, 12


def _spread(x: Column) -> Column:
    """The bits of a number of ``BITS`` bits, two zeros after each. A fold: written out, each step would double the expression."""
    steps = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
    steps = F.array(*(F.struct(F.lit(shift).alias("shift"), F.lit(mask).cast("long").alias("mask")) for shift, mask in steps))
    return F.aggregate(steps, x, lambda x, s: x.bitwiseOR(F.call_function("shiftleft", x, s["shift"])).bitwiseAND(s["mask"]))


def curve(vertices: DataFrame) -> DataFrame:
    """(mesh_id, v, code): places along a Z-order curve through a mesh's bounding box."""
    boxes = vertices.groupBy("mesh_id").agg(*(f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    span = F.greatest(*(F.col(f"hi{c}") - F.col(f"lo{c}") for c in "xyz"), F.lit(1e-300))
    cell = [F.least(F.floor((F.col(c) - F.col(f"lo{c}")) / span * (1 << BITS)), F.lit((1 << BITS) - 1)).cast("long") for c in "xyz"]
    x, y, z = (_spread(c) for c in cell)
    return vertices.join(boxes, "mesh_id").select("mesh_id", "v", F.shiftleft(x, 2).bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(z).alias("code"))


def ranked(vertices: DataFrame) -> DataFrame:
    """(mesh_id, v, rank, n): a vertex's rank along its mesh's curve, from 0, and the mesh's size. Stretches of the curve are ranked apart."""
    dealt = curve(vertices).withColumn("part", F.shiftright("code", 3 * BITS - DEALT))
    parts = dealt.groupBy("mesh_id", "part").agg(F.count("*").alias("size"))
    whole = Window.partitionBy("mesh_id")
    before = F.coalesce(F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each stretch, not each vertex
    parts = parts.select("mesh_id", "part", before.alias("before"), F.sum("size").over(whole).alias("n"))
    place = F.row_number().over(Window.partitionBy("mesh_id", "part").orderBy("code", "v")) - 1
    return dealt.withColumn("place", place).join(parts, ["mesh_id", "part"]).select("mesh_id", "v", (F.col("place") + F.col("before")).alias("rank"), "n")


def tree(coo: DataFrame, vertices: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(mesh_id, v, level, prefix): the tree node of every vertex; the root is level 0."""
    depth = F.greatest(F.ceil(F.log2(F.col("n") / leaf)), F.lit(0)).cast("int")
    paths = ranked(vertices).withColumn("depth", depth).select("mesh_id", "v", "depth", F.floor(F.col("rank") * F.expr("shiftleft(1L, depth)") / F.col("n")).alias("path"))
    left = paths.select("mesh_id", F.col("v").alias("i"), "depth", F.col("path").alias("p"))
    right = paths.select("mesh_id", F.col("v").alias("j"), F.col("path").alias("q"))
    cut = coo.where("i <> j").select("mesh_id", "i", "j").join(left, ["mesh_id", "i"]).join(right, ["mesh_id", "j"]).where("p < q")
    cut = cut.withColumn("level", F.col("depth") - F.length(F.bin(F.col("p").bitwiseXOR(F.col("q")))))
    cut = cut.groupBy("mesh_id", F.col("i").alias("v")).agg(F.min("level").alias("cut"))
    level = F.coalesce("cut", "depth").cast("int")
    return paths.join(cut, ["mesh_id", "v"], "left").select("mesh_id", "v", level.alias("level"), F.expr("shiftright(path, depth - coalesce(cut, depth))").alias("prefix"))


def _doubles(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, float).tobytes()


class Factor:
    """The Cholesky factor of the matrices of all meshes, written once; ``close`` deletes it."""

    def __init__(self, coo: DataFrame, vertices: DataFrame, leaf: int = LEAF):
        self.scratch = Scratch(coo.sparkSession, "factor")
        self.kind = coo.schema["mesh_id"].dataType.simpleString()
        coo = self.coo = self.scratch.put(coo.select("mesh_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("val").cast("double").alias("val")))
        self.nodes = self.scratch.put(tree(coo, vertices, leaf))
        self.depth = int(self.nodes.agg(F.max("level")).first()[0] or 0)
        at = lambda v, n: self.nodes.select("mesh_id", F.col("v").alias(v), F.col("level").alias(f"l{n}"), F.col("prefix").alias(f"p{n}"))
        both = coo.join(at("i", "i"), ["mesh_id", "i"]).join(at("j", "j"), ["mesh_id", "j"])
        entries = both.select("mesh_id", F.greatest("li", "lj").alias("level"), F.when(F.col("li") >= F.col("lj"), F.col("pi")).otherwise(F.col("pj")).alias("prefix"), "i", "li", "j", "lj", "val")
        entries = self.scratch.put(entries)
        self.levels: list[DataFrame] = [None] * (self.depth + 1)
        rest = None
        for level in range(self.depth, -1, -1):
            rows = entries.where(F.col("level") == level).select("mesh_id", "prefix", "i", "li", "j", "lj", "val", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<int>").alias("id_levels"), F.lit(None).cast("binary").alias("rest"))
            if rest is not None:
                none = [F.lit(None).cast(t).alias(c) for c, t in (("i", "long"), ("li", "int"), ("j", "long"), ("lj", "int"), ("val", "double"))]
                rows = rows.unionByName(rest.where("size(bnd) > 0").select("mesh_id", F.shiftright("prefix", 1).alias("prefix"), *none, F.col("bnd").alias("ids"), F.col("bnd_levels").alias("id_levels"), "rest"))
            rest = self.levels[level] = self.scratch.put(rows.groupBy("mesh_id", "prefix").applyInPandas(_front(level), f"mesh_id {self.kind}, prefix long, own array<long>, bnd array<long>, bnd_levels array<int>, inverse binary, across binary, rest binary"))
        self.scratch.drop(entries)

    def solve(self, rhs: DataFrame, width: int | None = None) -> DataFrame:
        """(mesh_id, v, x) from ``rhs(mesh_id, v, b)``, array columns of one width; vertices without a row count as zeros. The result is written.

        Each level is written as well, so that no plan holds the levels below or above it: the
        driver's plans would grow with the cube of the depth. The root's way up and the leaves'
        way down, which one other step reads, go with that step.
        """
        width = width or rhs.select(F.size("b").alias("n")).agg(F.max("n")).first()[0] or 1
        own = rhs.join(self.nodes, ["mesh_id", "v"]).select("mesh_id", "level", "prefix", "v", "b")
        handed, ups, asked = None, [None] * (self.depth + 1), ["own", "bnd", "inverse", "across"]
        for level in range(self.depth, -1, -1):
            got = own.where(F.col("level") == level).select("mesh_id", "prefix", "v", "b")
            if handed is not None:
                got = got.unionByName(handed)
            got = got.groupBy("mesh_id", "prefix").agg(F.collect_list("v").alias("vs"), F.flatten(F.collect_list("b")).alias("bs"))  # a front's vertices
            here = self.levels[level].select("mesh_id", "prefix", *asked).join(got, ["mesh_id", "prefix"], "left")
            up = here.mapInPandas(_up(width), f"mesh_id {self.kind}, prefix long, y array<double>, ids array<long>, hand array<array<double>>")
            ups[level] = up = self.scratch.put(up) if level else up
            handed = up.select("mesh_id", F.shiftright("prefix", 1).alias("prefix"), F.inline(F.arrays_zip(F.col("ids").alias("v"), F.col("hand").alias("b"))))
        above, out, downs = None, None, []
        for level in range(self.depth + 1):
            here = self.levels[level].select("mesh_id", "prefix", *asked).join(ups[level].select("mesh_id", "prefix", "y"), ["mesh_id", "prefix"])
            if above is None:
                here = here.select("*", F.lit(None).cast("array<long>").alias("known"), F.lit(None).cast("array<double>").alias("values"))
            else:
                here = here.withColumn("up", F.shiftright("prefix", 1)).join(above, ["mesh_id", "up"])
            down = here.mapInPandas(_down(width), f"mesh_id {self.kind}, prefix long, own array<long>, x array<array<double>>, known array<long>, values array<double>")
            if level < self.depth:
                downs.append(down := self.scratch.put(down))
            above = down.select("mesh_id", F.col("prefix").alias("up"), "known", "values")
            part = down.select("mesh_id", F.inline(F.arrays_zip(F.col("own").alias("v"), F.col("x").alias("x"))))
            out = part if out is None else out.unionByName(part)
        out = self.scratch.put(out)
        self.scratch.drop(*ups[1:], *downs)
        return out

    def residuals(self, x: DataFrame, rhs: DataFrame) -> DataFrame:
        """(mesh_id, residual): the largest length of A x - b over the columns, each relative to its b's."""
        ax = self.times(x).withColumnRenamed("x", "ax")
        both = ax.join(rhs.select("mesh_id", "v", "b"), ["mesh_id", "v"], "left").select("mesh_id", F.posexplode(F.arrays_zip("ax", F.coalesce("b", F.transform("ax", lambda _: F.lit(0.0))).alias("b"))).alias("c", "e"))
        off = F.col("e.ax") - F.col("e.b")
        each = both.groupBy("mesh_id", "c").agg(F.sqrt(F.sum(off * off)).alias("off"), F.sqrt(F.sum(F.col("e.b") * F.col("e.b"))).alias("size"))
        return each.groupBy("mesh_id").agg(F.max(F.col("off") / F.greatest("size", F.lit(1e-300))).alias("residual"))

    def times(self, x: DataFrame) -> DataFrame:
        """(mesh_id, v, x): the matrices times a field."""
        return product(self.coo, x)

    def close(self, *keep: DataFrame) -> None:
        """Delete the factor's tables; results of ``solve`` go with the driver's end."""
        self.scratch.drop(self.coo, self.nodes, *self.levels)


def product(coo: DataFrame, x: DataFrame) -> DataFrame:
    """(mesh_id, v, x): matrices times fields of array columns."""
    width = x.select(F.size("x").alias("n")).agg(F.max("n")).first()[0] or 1
    met = coo.join(x.select("mesh_id", F.col("v").alias("j"), "x"), ["mesh_id", "j"])
    sums = [F.sum(F.col("val") * F.get("x", F.lit(c))).alias(f"c{c}") for c in range(width)]
    return met.groupBy("mesh_id", F.col("i").alias("v")).agg(*sums).select("mesh_id", "v", F.array(*(f"c{c}" for c in range(width))).alias("x"))


def _front(level: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        direct, handed = frame[frame.rest.isna()], frame[frame.rest.notna()]
        ids = np.concatenate([direct.i, direct.j, *handed.ids]).astype(np.int64)
        levels = np.concatenate([direct.li, direct.lj, *handed.id_levels]).astype(np.int64)
        ids, first = np.unique(ids, return_index=True)
        levels = levels[first]
        order = np.argsort(levels != level, kind="stable")  # own vertices first
        ids, levels, own = ids[order], levels[order], int((levels == level).sum())
        place = pd.Index(ids)
        a = np.zeros((len(ids), len(ids)))
        i, j = place.get_indexer(direct.i.astype(np.int64)), place.get_indexer(direct.j.astype(np.int64))
        np.add.at(a, (i, j), direct.val.to_numpy(float))
        for some, update in zip(handed.ids, handed.rest, strict=True):
            at = place.get_indexer(some)
            a[np.ix_(at, at)] += np.frombuffer(update).reshape(len(at), len(at))
        try:
            inverse = np.linalg.inv(np.linalg.cholesky((a[:own, :own] + a[:own, :own].T) / 2))
        except np.linalg.LinAlgError as e:
            raise ValueError(f"the matrix of mesh {frame.mesh_id.iloc[0]} is not positive definite") from e
        half = inverse @ a[:own, own:]
        left = a[own:, own:] - half.T @ half
        row = (frame.mesh_id.iloc[0], frame.prefix.iloc[0], ids[:own], ids[own:], levels[own:], _doubles(inverse), _doubles(inverse.T @ half), _doubles(left))
        return pd.DataFrame([row], columns=["mesh_id", "prefix", "own", "bnd", "bnd_levels", "inverse", "across", "rest"])

    return run


def _up(width: int):
    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                n, m = len(r.own), len(r.bnd)
                f = np.zeros((n + m, width))
                if r.vs is not None:
                    np.add.at(f, pd.Index(np.concatenate([r.own, r.bnd])).get_indexer(r.vs), np.asarray(r.bs, float).reshape(-1, width))
                inverse = np.frombuffer(r.inverse).reshape(n, n)
                hand = f[n:] - np.frombuffer(r.across).reshape(n, m).T @ f[:n]
                rows.append((r.mesh_id, r.prefix, (inverse.T @ (inverse @ f[:n])).ravel(), r.bnd, list(hand)))
            yield pd.DataFrame(rows, columns=["mesh_id", "prefix", "y", "ids", "hand"])

    return run


def _down(width: int):
    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                n, m = len(r.own), len(r.bnd)
                above = np.asarray(r.values, float).reshape(-1, width)[pd.Index(r.known).get_indexer(r.bnd)] if m else np.zeros((0, width))
                x = np.asarray(r.y, float).reshape(n, width) - np.frombuffer(r.across).reshape(n, m) @ above
                rows.append((r.mesh_id, r.prefix, r.own, list(x), np.concatenate([r.own, r.bnd]), np.concatenate([x, above]).ravel()))
            yield pd.DataFrame(rows, columns=["mesh_id", "prefix", "own", "x", "known", "values"])

    return run
