"""Seeded draws and pairings of rows: a row's draw is a hash of its own keys and the seed, so it doesn't depend on partitions or order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .surface_rows import _gaussian, _seeded


def shuffled(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """``rows`` in a random but repeatable order."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)


def batches(rows: DataFrame, keys: list[str], size: int, seed: int | None = None) -> DataFrame:
    """``rows`` with a ``batch`` number: about ``size`` rows each, drawn by hash, or in key order where no seed is given.

    Drawn batches need a count alone; ordered ones rank within range partitions and add the rows before each.
    """
    total = rows.count()
    n = max(1, -(-total // size))
    if seed is not None:
        return rows.withColumn("batch", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n)))
    parted = rows.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id())
    sizes = parted.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*keys)) - 1
    return parted.withColumn("_i", own).join(F.broadcast(sizes), "_p").withColumn("batch", F.floor((F.col("_i") + F.col("_before")) / size)).drop("_p", "_i", "_n", "_before")


def landmarks(pool: DataFrame, key: str, count: int, seed: int, keys: list[str] | None = None) -> DataFrame:
    """``count`` rows of the pool (of each group of ``keys``), without repeats, the same for one seed."""
    order = [F.xxhash64(F.lit(seed), key), F.col(key)]
    if not keys:
        return pool.orderBy(*order).limit(count)
    return pool.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_i") <= count).drop("_i")


def vertex_pairs(sizes: DataFrame, count: int, seed: int) -> DataFrame:
    """(mesh_id, p, q): ``count`` draws of two of the n vertices of each mesh of ``sizes(mesh_id, n)``, less those that are equal."""
    draws = sizes.select("mesh_id", "n", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("i"))
    ends = [F.pmod(F.xxhash64(F.lit(seed), F.lit(s), "mesh_id", "i"), F.col("n")).alias(s) for s in ("p", "q")]
    return draws.select("mesh_id", *ends).where("p <> q")


def subsampled(vertices: DataFrame, most: int, seed: int) -> DataFrame:
    """(mesh_id, v, new): ``most`` vertices of each mesh at most, renumbered in their order."""
    drawn = vertices.withColumn("_i", F.row_number().over(Window.partitionBy("mesh_id").orderBy(F.xxhash64(F.lit(seed), "mesh_id", "v"), "v"))).where(F.col("_i") <= most)
    return drawn.select("mesh_id", "v", (F.row_number().over(Window.partitionBy("mesh_id").orderBy("v")) - 1).cast("long").alias("new"))


def remapped(corr: DataFrame, kept_a: DataFrame, kept_b: DataFrame) -> DataFrame:
    """``corr(pair_id, ref, va, vb)`` in the numbers of the kept vertices (pair_id, v, new); rows that lost an end go."""
    a, b = (k.select("pair_id", F.col("v").alias(n), F.col("new").alias(f"new_{n}")) for k, n in ((kept_a, "va"), (kept_b, "vb")))
    return corr.join(a, ["pair_id", "va"]).join(b, ["pair_id", "vb"]).select("pair_id", "ref", F.col("new_va").alias("va"), F.col("new_vb").alias("vb"))


def noisy(vertices: DataFrame, noise: float, seed: int) -> DataFrame:
    """Gaussian noise of ``noise`` times the mesh's mean vertex length on every coordinate."""
    from .points import norm

    mean = vertices.groupBy("mesh_id").agg(F.avg(norm(*map(F.col, "xyz"))).alias("_mean"))
    return vertices.join(mean, "mesh_id").withColumns({a: F.col(a) + noise * F.col("_mean") * _gaussian(seed, F.lit(a), F.col("mesh_id"), F.col("v")) for a in "xyz"}).drop("_mean")


def without(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't among the others'."""
    return rows.join(others.select(*keys), keys, "left_anti")


def union_sorted(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """The distinct keys of both, in order."""
    return one.select(key).union(two.select(key)).distinct().orderBy(key)


def identity(vertices: DataFrame) -> DataFrame:
    """corr(pair_id, ref, va, vb) that leaves every vertex where it is."""
    return vertices.select(F.col("mesh_id").alias("pair_id"), F.col("v").alias("ref"), F.col("v").alias("va"), F.col("v").alias("vb"))


def is_identity(corr: DataFrame, sizes: DataFrame) -> DataFrame:
    """(pair_id, identity): whether a pair's rows are all va = vb = ref and as many as its vertices (pair_id, n)."""
    found = corr.groupBy("pair_id").agg(F.count("*").alias("rows"), F.bool_and((F.col("va") == F.col("vb")) & (F.col("va") == F.col("ref"))).alias("same"))
    return sizes.join(found, "pair_id", "left").select("pair_id", F.coalesce(F.col("same") & (F.col("rows") == F.col("n")), F.lit(False)).alias("identity"))


def both_ways(bridges: DataFrame) -> DataFrame:
    """Bridges (src, dst, ref_src, ref_dst) and the inverses of those that lack an own one; of several sources the last wins."""
    known = bridges.select(F.col("src").alias("ks"), F.col("dst").alias("kd")).distinct()
    back = bridges.groupBy(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("ref_dst").alias("ref_src")).agg(F.max("ref_src").alias("ref_dst"))
    back = back.join(F.broadcast(known), (F.col("src") == F.col("ks")) & (F.col("dst") == F.col("kd")), "left_anti")  # pairs of category names
    return bridges.select("src", "dst", "ref_src", "ref_dst").unionByName(back)


def hubs(bridges: DataFrame) -> DataFrame:
    """(src, dst, hub): how each ordered pair of categories is bridged: hub null directly, else the first hub by name."""
    links = both_ways(bridges).select("src", "dst").distinct()
    onward = links.select(F.col("src").alias("hub"), F.col("dst").alias("end"))
    two = links.join(onward, links.dst == onward.hub).where("src <> end").groupBy("src", F.col("end").alias("dst")).agg(F.min("hub").alias("hub"))
    return links.withColumn("hub", F.lit(None).cast("string")).unionByName(two.join(links, ["src", "dst"], "left_anti"))


def bridge_maps(bridges: DataFrame) -> DataFrame:
    """(src, dst, ref_src, ref_dst) for every bridged ordered pair, through its hub where needed; null where a hop is undefined."""
    every = both_ways(bridges)
    via = hubs(bridges).where("hub is not null")
    first = via.join(every.select("src", F.col("dst").alias("hub"), "ref_src", F.col("ref_dst").alias("mid")), ["src", "hub"])
    second = every.select(F.col("src").alias("hub"), "dst", F.col("ref_src").alias("mid"), "ref_dst")
    return every.unionByName(first.join(second, ["hub", "dst", "mid"], "left").select("src", "dst", "ref_src", "ref_dst"))


def category_pairs(train: DataFrame, val: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, role): same and cross pairs of training categories and validation pairs (val with train, and among val); cross ones need a bridge.

    Tables of category names, a folder listing's worth.
    """
    t, v = train.select(F.col("category").alias("a")).distinct(), val.select(F.col("category").alias("a")).distinct()
    same = t.select("a", F.col("a").alias("b"), F.lit("same").alias("role"))
    other = lambda d: d.select(F.col("a").alias("b"))
    cross = t.join(other(t), F.col("a") < F.col("b")).withColumn("role", F.lit("cross"))
    checked = t.join(other(v), F.col("a") != F.col("b")).unionByName(v.join(other(v), F.col("a") < F.col("b"))).withColumn("role", F.lit("val"))
    bridged = links.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    return same.unionByName(cross.unionByName(checked).join(bridged, ["a", "b"], "left_semi"))


def train_draws(steps: DataFrame, pairs: DataFrame, poses: DataFrame, cross_ratio: float, seed: int) -> DataFrame:
    """(step, a, b, role, pose_a, pose_b) for each row of ``steps(step)``: cross pairs at a rate, poses uniform, distinct within a category that has several."""
    n = pairs.groupBy("role").agg(F.count("*").alias("n")).groupBy().pivot("role", ["same", "cross"]).agg(F.first("n"))
    drawn = steps.crossJoin(F.broadcast(n))  # one row
    cross = (F.coalesce("cross", F.lit(0)) > 0) & (_seeded(seed, F.lit("role"), F.col("step")) < cross_ratio)
    drawn = drawn.withColumn("role", F.when(cross, "cross").otherwise("same"))
    of = F.when(F.col("role") == "cross", F.col("cross")).otherwise(F.col("same"))
    drawn = drawn.select("step", "role", F.floor(_seeded(seed, F.lit("pair"), F.col("step")) * of).alias("i"))
    listed = pairs.withColumn("i", F.row_number().over(Window.partitionBy("role").orderBy("a", "b")) - 1)
    sizes = poses.groupBy("category").agg(F.count("*").alias("n"))
    rows = drawn.join(listed, ["role", "i"]).join(sizes.select(F.col("category").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("category").alias("b"), F.col("n").alias("nb")), "b")
    pa = F.floor(_seeded(seed, F.lit("pa"), F.col("step")) * F.col("na"))
    rows = rows.withColumn("ia", pa)
    # within a category the second pose is one of the others
    apart = F.pmod(F.col("ia") + 1 + F.floor(_seeded(seed, F.lit("pb"), F.col("step")) * (F.col("nb") - 1)), F.col("nb"))
    pb = F.when((F.col("a") == F.col("b")) & (F.col("nb") > 1), apart).otherwise(F.floor(_seeded(seed, F.lit("pb"), F.col("step")) * F.col("nb")))
    rows = rows.withColumn("ib", pb)
    numbered = poses.withColumn("i", F.row_number().over(Window.partitionBy("category").orderBy("pose")) - 1)
    one, two = (numbered.select(F.col("category").alias(c), F.col("i").alias(f"i{c}"), F.col("pose").alias(f"pose_{c}")) for c in "ab")
    return rows.join(one, ["a", "ia"]).join(two, ["b", "ib"]).select("step", "a", "b", "role", "pose_a", "pose_b")


def val_draws(pairs: DataFrame, poses: DataFrame, count: int) -> DataFrame:
    """(a, b, pose_a, pose_b): ``count`` distinct pose pairs of each category pair, the first by a stable hash of the names."""
    one, two = (poses.select(F.col("category").alias(c), F.col("pose").alias(f"pose_{c}")) for c in "ab")
    several = poses.groupBy("category").agg(F.count("*").alias("n")).select(F.col("category").alias("a"), "n")
    every = pairs.select("a", "b").join(one, "a").join(two, "b").join(several, "a").where("a <> b or pose_a <> pose_b or n = 1")
    order = Window.partitionBy("a", "b").orderBy(F.sha2(F.concat_ws("|", "a", "b", "pose_a", "pose_b"), 256))
    return every.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= count).select("a", "b", "pose_a", "pose_b")


def largest(rows: DataFrame, value: str, count: int, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """The ``count`` largest rows by a column, of each group ``by`` or of all; a row's keys on ties."""
    if not by:
        return rows.orderBy(F.desc(value), *keys).limit(count)
    order = Window.partitionBy(*by).orderBy(F.desc(value), *keys)
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= count).drop("_rank")
