"""Nearest neighbours by blocks: every task compares one bounded block with another, and only blocks that can matter to each other."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dissection import ranked
from ..scratch import Scratch

#: Points of a block, pivots of a mesh at most, bytes of all pivots that are sent to tasks, and points up to which every block of a mesh meets every other.
BLOCK, PIVOTS, PIVOT_BYTES, SMALL = 512, 256, 32 << 20, 4 * 512
#: Blocks of queries in a group, and of the points that a group meets, in more than three dimensions (an eighth of a smaller mesh's blocks), and queries compared at once.
SIDE, PART, AT_ONCE = 32, 64, 4096


def _best(left: pd.DataFrame, right: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """The k nearest right rows of every left row. A product picks the candidates; their distances are made of differences, so equal points are at 0."""
    if left.empty or right.empty:
        return pd.DataFrame({"mesh_id": [], "center": [], "block": [], "neighbor": [], "d2": []})
    right = right.sort_values("v")
    a, b = np.stack(left.p.to_list()).astype(float), np.stack(right.p.to_list()).astype(float)
    ids, own = right.v.to_numpy(), left.v.to_numpy()
    middle = b.mean(0)
    x, y = a - middle, b - middle
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    rough = xx[:, None] + yy[None] - 2 * (x @ y.T)
    if same:
        rough[own[:, None] == ids[None]] = np.inf
    few = min(k, len(b)) - 1
    slack = 1e-12 * a.shape[1] * (xx + yy.max())
    row, col = np.nonzero(rough <= (np.partition(rough, few, 1)[:, few] + slack)[:, None])
    fine = np.isfinite(rough[row, col])
    row, col = row[fine], col[fine]
    d2 = np.zeros(len(row))
    for c in range(a.shape[1]):
        d2 += (a[row, c] - b[col, c]) ** 2
    order = np.lexsort((ids[col], d2, row))
    row, col, d2 = row[order], col[order], d2[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, col = row[kept], col[kept]
    block = left.block.to_numpy()[row] if "block" in left else 0
    return pd.DataFrame({"mesh_id": left.mesh_id.iloc[0], "center": own[row], "block": block, "neighbor": ids[col], "d2": d2[kept]})


def _compared(asks: DataFrame, rows: DataFrame, pairs: DataFrame, k: int, same: bool) -> DataFrame:
    """(mesh_id, center, block, neighbor, d2): the best of each pair of blocks in ``pairs(mesh_id, block, other)``."""
    kind = rows.schema["mesh_id"].dataType.simpleString()
    left = asks.join(pairs, ["mesh_id", "block"])
    right = rows.withColumnRenamed("block", "other").join(pairs, ["mesh_id", "other"]).select(F.col("mesh_id").alias("of"), F.col("block").alias("to"), F.col("other").alias("from"), F.col("v").alias("v"), F.col("p").alias("p"))
    met = left.groupBy("mesh_id", "block", "other").cogroup(right.groupBy("of", "to", "from"))
    return met.applyInPandas(lambda x, y: _best(x, y, k, same), f"mesh_id {kind}, center long, block long, neighbor long, d2 double")


def _best_within(left: pd.DataFrame, right: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """The k nearest of all blocks in ``right`` for every query of the blocks in ``left``, none beyond its bound; a block in ``right`` meets those that it names in ``wants``."""
    if left.empty or right.empty:
        return pd.DataFrame({"mesh_id": [], "center": [], "block": [], "neighbor": [], "d2": []})
    own, bound = np.concatenate(left.vs.to_list()), np.concatenate(left.bounds.to_list())
    block = np.repeat(left.block.to_numpy(), left.vs.map(len))
    a = np.concatenate(left.ps.to_list()).reshape(len(own), -1)
    top, slack = np.full((len(own), k), np.inf), np.zeros(len(own))
    found = []
    for ids, b, wants in zip(right.vs, right.ps, right.wants):
        b, wanting = b.reshape(len(ids), -1), np.flatnonzero(np.isin(block, wants))
        middle = b.mean(0)
        y = b - middle
        yy = (y * y).sum(1)
        for at in range(0, len(wanting), AT_ONCE):
            take = wanting[at : at + AT_ONCE]
            x = a[take] - middle
            xx = (x * x).sum(1)
            rough = xx[:, None] + yy[None] - 2 * (x @ y.T)
            if same:
                rough[own[take][:, None] == ids[None]] = np.inf
            slack[take] = np.maximum(slack[take], 1e-12 * a.shape[1] * (xx + yy.max()))
            nearer = np.flatnonzero(rough.min(1) <= np.minimum(bound, top[:, -1])[take] + slack[take])
            take, rough = take[nearer], rough[nearer]
            # the k least so far bound what the next blocks may add
            top[take] = np.sort(np.partition(np.concatenate([top[take], rough], 1), k - 1, 1)[:, :k], 1)
            row, col = np.nonzero((rough <= (np.minimum(bound, top[:, -1])[take] + slack[take])[:, None]) & np.isfinite(rough))
            row = take[row]
            d2 = np.zeros(len(row))
            for c in range(a.shape[1]):
                d2 += (a[row, c] - b[col, c]) ** 2
            found.append((row, ids[col], d2))
    row, neighbor, d2 = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((neighbor, d2, row))
    row, neighbor, d2 = row[order], neighbor[order], d2[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    row = row[kept]
    return pd.DataFrame({"mesh_id": left.mesh_id.iloc[0], "center": own[row], "block": block[row], "neighbor": neighbor[kept], "d2": d2[kept]})


def _grouped(balls: DataFrame, block: str, most: int, name: str) -> DataFrame:
    """(mesh_id, block, name): a mesh's blocks in groups of ``most``, in eight groups if they are few."""
    mesh = Window.partitionBy("mesh_id")
    size = F.least(F.lit(most), F.ceil(F.count("*").over(mesh) / 8))
    return balls.select("mesh_id", block, F.floor((F.row_number().over(mesh.orderBy(block)) - 1) / size).alias(name))


def _packed(rows: DataFrame, *more: str) -> DataFrame:
    """(mesh_id, block, vs, ps and the columns ``more`` as arrays): a row for each block."""
    held = rows.groupBy("mesh_id", "block").agg(F.collect_list(F.struct("v", "p", *more)).alias("held"))
    return held.select("mesh_id", "block", F.col("held.v").alias("vs"), F.flatten("held.p").alias("ps"), *(F.col(f"held.{c}").alias(f"{c}s") for c in more))


def _compared_in_groups(asks: DataFrame, rows: DataFrame, near: DataFrame, sides: DataFrame, parts: DataFrame, k: int, same: bool) -> DataFrame:
    """As ``_compared`` for asks with a ``bound`` on d2: a group of query blocks meets a group of other blocks, so a point is sent once a group and only the best of a group come back."""
    kind = rows.schema["mesh_id"].dataType.simpleString()
    met = near.join(sides, ["mesh_id", "block"]).join(parts, ["mesh_id", "other"])
    left = _packed(asks, "bound").join(met.select("mesh_id", "block", "side", "part").distinct(), ["mesh_id", "block"])
    wanted = met.groupBy("mesh_id", "side", "part", "other").agg(F.collect_list("block").alias("wants"))
    right = _packed(rows).withColumnRenamed("block", "other").join(wanted, ["mesh_id", "other"]).select(F.col("mesh_id").alias("of"), F.col("side").alias("to"), F.col("part").alias("from"), "vs", "ps", "wants")
    both = left.groupBy("mesh_id", "side", "part").cogroup(right.groupBy("of", "to", "from"))
    return both.applyInPandas(lambda x, y: _best_within(x, y, k, same), f"mesh_id {kind}, center long, block long, neighbor long, d2 double")


def _hashed(points: DataFrame, sizes: DataFrame) -> DataFrame:
    return points.join(sizes, "mesh_id").select("mesh_id", "v", "p", F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / BLOCK)).alias("block"))


def _along_curve(points: DataFrame) -> DataFrame:
    """Points of up to three dimensions in blocks of equal counts along a space-filling curve."""
    at = [F.coalesce(F.get("p", F.lit(d)), F.lit(0.0)).alias(c) for d, c in enumerate("xyz")]
    return points.join(ranked(points.select("mesh_id", "v", *at)), ["mesh_id", "v"]).select("mesh_id", "v", "p", F.floor(F.col("rank") / BLOCK).alias("block"))


def _around_pivots(points: DataFrame, pivots: dict) -> DataFrame:
    """Points in blocks of their nearest pivot; the blocks of a crowded pivot, and meshes without pivots, are dealt by a hash."""
    sent = points.sparkSession.sparkContext.broadcast(pivots)
    kind = points.schema["mesh_id"].dataType.simpleString()

    def run(frames):
        for f in frames:
            for mesh, g in f.groupby("mesh_id"):
                q = sent.value.get(mesh)
                yield g.assign(cell=0 if q is None else ((q * q).sum(1)[None] - 2 * (np.stack(g.p.to_list()).astype(float) @ q.T)).argmin(1))

    celled = points.select("mesh_id", "v", "p").mapInPandas(run, f"mesh_id {kind}, v long, p array<double>, cell long")
    counts = celled.groupBy("mesh_id", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = celled.join(counts, ["mesh_id", "cell"])
    return dealt.select("mesh_id", "v", "p", (F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("v"), F.col("parts"))).alias("block"))


def _length(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))


def _balls(rows: DataFrame, width: int, middle: str, radius: str) -> DataFrame:
    """(mesh_id, block, middle, radius): a ball around the mean of each block's points."""
    means = rows.groupBy("mesh_id", "block").agg(*(F.avg(F.get("p", F.lit(d))).alias(f"c{d}") for d in range(width)))
    means = means.select("mesh_id", "block", F.array(*(f"c{d}" for d in range(width))).alias(middle))
    return rows.join(means, ["mesh_id", "block"]).groupBy("mesh_id", "block").agg(F.first(middle).alias(middle), F.max(_length(F.col("p"), F.col(middle))).alias(radius))


def nearest(queries: DataFrame, points: DataFrame, k: int, same: bool, small: int = SMALL) -> DataFrame:
    """(mesh_id, center, rank, neighbor, dist): the k nearest ``points(mesh_id, v, p)`` of each query.

    ``p`` is an array of coordinates. ``same``: a point isn't its own neighbour; it is told by its
    id, so points at the same place stay neighbours. Ties go to the smaller id.

    Both sets are cut into blocks of near points: along a space-filling curve by equal counts in up
    to three dimensions, around pivots drawn from the points in more. A block of queries first
    meets the block whose middle is nearest; its k-th distances bound what it still needs, and
    by the triangle inequality only blocks whose balls come that near are compared as well,
    in more than three dimensions groups of blocks with groups.
    Work follows the points' own density; an outlier or a crowd of equal points makes no large block.
    What is found is written, so callers that read it several times don't make it anew.
    """
    sizes = points.groupBy("mesh_id").agg(F.count("*").alias("n"))
    about = points.agg(F.max(F.size("p")).alias("width")).first()
    width = about["width"] or 1
    most = sizes.agg(F.max("n")).first()[0] or 0
    if most <= small:
        found = _every_pair(queries, points, sizes, k, same)
    else:
        found = _near_pairs(queries, points, k, same, width)
    order = Window.partitionBy("mesh_id", "center").orderBy("d2", "neighbor")
    ranked_ = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked_.select("mesh_id", "center", F.col("rank").cast("int").alias("rank"), "neighbor", F.sqrt("d2").alias("dist"))


def _every_pair(queries: DataFrame, points: DataFrame, sizes: DataFrame, k: int, same: bool) -> DataFrame:
    cuts = queries.groupBy("mesh_id").agg(F.count("*").alias("n"))
    count = lambda d, n: d.select("mesh_id", F.ceil(F.col("n") / BLOCK).alias(n))
    pairs = count(cuts, "m").join(count(sizes, "n"), "mesh_id").select("mesh_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("block"))
    pairs = pairs.select("mesh_id", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other"))
    return _compared(_hashed(queries, cuts), _hashed(points, sizes), pairs, k, same)


def _near_pairs(queries: DataFrame, points: DataFrame, k: int, same: bool, width: int) -> DataFrame:
    scratch = Scratch(points.sparkSession, "neighbors")
    if width <= 3:
        cut = _along_curve
    else:
        large = points.groupBy("mesh_id").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
        share = min(PIVOTS, PIVOT_BYTES // (8 * width * max(1, large.count())))
        turn = F.row_number().over(Window.partitionBy("mesh_id").orderBy(F.xxhash64("v"), "v"))
        drawn = points.join(large, "mesh_id").withColumn("turn", turn).where((F.col("turn") <= share) & (F.col("turn") * (BLOCK // 4) <= F.col("n")))
        pivots: dict = {}
        for r in drawn.select("mesh_id", "p").collect() if share else []:  # PIVOT_BYTES at most
            pivots.setdefault(r["mesh_id"], []).append(r["p"])
        pivots = {m: np.array(p, float) for m, p in pivots.items()}
        cut = lambda d: _around_pivots(d, pivots)
    rows = scratch.put(cut(points.select("mesh_id", F.col("v").cast("long").alias("v"), "p")))
    asks = rows if queries is points else scratch.put(cut(queries.select("mesh_id", F.col("v").cast("long").alias("v"), "p").join(points.select("mesh_id").distinct(), "mesh_id", "left_semi")))
    balls = scratch.put(_balls(asks, width, "middle", "radius"))
    others = scratch.put(_balls(rows, width, "theirs", "reach").withColumnRenamed("block", "other"))
    gap = balls.join(others, "mesh_id").select("mesh_id", "block", "other", _length(F.col("middle"), F.col("theirs")).alias("gap"), "radius", "reach")
    first = scratch.put(gap.groupBy("mesh_id", "block").agg(F.min_by("other", F.struct("gap", "other")).alias("other")))
    found = scratch.put(_compared(asks, rows, first, k, same))
    # what each block of queries still needs: its largest k-th distance, without bound where a query has fewer
    kth = found.groupBy("mesh_id", "block", "center").agg(F.when(F.count("*") >= k, F.max("d2")).otherwise(float("inf")).alias("d2")).groupBy("mesh_id", "block").agg(F.sqrt(F.max("d2")).alias("need"), F.count("*").alias("got"))
    needed = asks.groupBy("mesh_id", "block").agg(F.count("*").alias("n")).join(kth, ["mesh_id", "block"], "left").select("mesh_id", "block", F.when(F.col("got") == F.col("n"), F.col("need")).otherwise(float("inf")).alias("need"))
    near = gap.join(needed, ["mesh_id", "block"]).where((F.col("gap") - F.col("radius") - F.col("reach")) * (1 - 1e-9) <= F.col("need") * (1 + 1e-9))
    near = near.select("mesh_id", "block", "other")
    if width <= 3:
        rest = scratch.put(near.join(first, ["mesh_id", "block", "other"], "left_anti"))
        return scratch.put(found.unionByName(_compared(asks, rows, rest, k, same)))
    # what was found is a bound of each query's own; its block is met again
    own = found.groupBy("mesh_id", "block", F.col("center").alias("v")).agg(F.when(F.count("*") >= k, F.max("d2")).otherwise(float("inf")).alias("bound"))
    bounded = asks.join(own, ["mesh_id", "block", "v"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    return scratch.put(_compared_in_groups(bounded, rows, scratch.put(near), _grouped(balls, "block", SIDE, "side"), _grouped(others, "other", PART, "part"), k, same))


def knn(points: DataFrame, k: int) -> DataFrame:
    """The k nearest neighbours of every point in its own mesh."""
    return nearest(points, points, k, True)


def grid_knn(vertices: DataFrame, k: int) -> DataFrame:
    """``knn`` of 3-D vertices (mesh_id, v, x, y, z)."""
    points = vertices.select("mesh_id", "v", F.array(*(F.col(c).cast("double") for c in "xyz")).alias("p"))
    return knn(points, k)


def chamfer(one: DataFrame, two: DataFrame) -> DataFrame:
    """(mesh_id, chamfer): mean squared distance to the nearest point of the other set, both ways, summed."""

    def way(a, b):
        return nearest(a, b, 1, False).groupBy("mesh_id").agg(F.avg(F.col("dist") * F.col("dist")).alias("m"))

    return way(one, two).join(way(two, one).withColumnRenamed("m", "n"), "mesh_id").select("mesh_id", (F.col("m") + F.col("n")).alias("chamfer"))


def close_pairs(vertices: DataFrame, radius: float) -> DataFrame:
    """(mesh_id, a, b): pairs of 3-D vertices within ``radius``, by an equi-join of grid cells of that width."""
    cell = [F.floor(F.col(c) / radius).alias(f"c{c}") for c in "xyz"]
    base = vertices.select("mesh_id", "v", "x", "y", "z", *cell)
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    spread = base.withColumn("sx", step).withColumn("sy", step).withColumn("sz", step)
    spread = spread.select("mesh_id", F.col("v").alias("a"), *(F.col(c).alias(f"a{c}") for c in "xyz"), *((F.col(f"c{c}") + F.col(f"s{c}")).alias(f"c{c}") for c in "xyz"))
    met = spread.join(base.withColumnRenamed("v", "b"), ["mesh_id", "cx", "cy", "cz"]).where("a < b")
    d2 = sum((F.col(f"a{c}") - F.col(c)) * (F.col(f"a{c}") - F.col(c)) for c in "xyz")
    return met.where(d2 <= radius * radius).select("mesh_id", "a", "b")


def fill_from_nearest(mapped: DataFrame, points: DataFrame) -> DataFrame:
    """Points without a target in ``mapped(mesh_id, v, target)`` take the nearest mapped point's."""
    known = points.join(mapped, ["mesh_id", "v"])
    missing = points.join(mapped, ["mesh_id", "v"], "left_anti")
    near = nearest(missing, known.select("mesh_id", "v", "p"), 1, False)
    filled = near.join(mapped.select("mesh_id", F.col("v").alias("neighbor"), "target"), ["mesh_id", "neighbor"]).select("mesh_id", F.col("center").alias("v"), "target")
    return mapped.select("mesh_id", "v", "target").unionByName(filled)
