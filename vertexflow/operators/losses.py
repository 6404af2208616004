"""Forward formulas of training losses as grouped aggregates over patch rows.

``patches`` has a row for each neighbour: (mesh_id, patch, neighbor, px, py, pz) with the
position relative to the centre and, in gradient mode, the coefficients (gx, gy, gz).
A loss returns one row for each patch; ``reduced`` averages or sums them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .points import norm

KEYS = ["mesh_id", "patch"]


def reduced(rows: DataFrame, value: str, reduction: str) -> DataFrame:
    """One row of the mean or sum, or all rows where the reduction is ``none``."""
    if reduction == "none":
        return rows
    if reduction not in ("mean", "sum"):
        raise ValueError(f"unknown reduction: {reduction}")
    return rows.agg((F.avg if reduction == "mean" else F.sum)(value).alias(value))


def normalized_weights(weights: dict[str, float | None]) -> dict[str, float | None]:
    """Weights that sum to 1; one of None belongs to a loss that is only logged."""
    known = {k: w for k, w in weights.items() if w is not None}
    total = sum(known.values())
    if any(w < 0 for w in known.values()) or known and total <= 0:
        raise ValueError("weights must be non-negative and not all zero")
    return {k: None if w is None else w / total for k, w in weights.items()}


def weighted(components: DataFrame, weights: dict[str, float | None]) -> DataFrame:
    """``components(name, value)`` with each one's weight and weighted value; the loss is their sum."""
    share = F.create_map(*(x for k, w in normalized_weights(weights).items() if w is not None for x in (F.lit(k), F.lit(w))))
    return components.withColumn("weight", F.try_element_at(share, F.col("name"))).withColumn("weighted", F.col("weight") * F.col("value"))


def direction_mse(rows: DataFrame, keys: list[str], eps: float = 1e-8) -> DataFrame:
    """Mean squared difference of the unit vectors of p (px, py, pz) and t (tx, ty, tz)."""
    p, t = ([F.col(f"{s}{a}") for a in "xyz"] for s in "pt")
    lp, lt = F.greatest(norm(*p), F.lit(eps)), F.greatest(norm(*t), F.lit(eps))
    off = [a / lp - b / lt for a, b in zip(p, t)]
    return rows.groupBy(*keys).agg(F.avg(sum((o * o for o in off[1:]), off[0] * off[0]) / 3).alias("direction_mse"))


def tangent_projector(patches: DataFrame, normals: DataFrame) -> DataFrame:
    """(mesh_id, patch, loss): mean squared difference of the sum of g p' from the projector on the plane of ``normals(mesh_id, patch, nx, ny, nz)``."""
    sums = patches.groupBy(*KEYS).agg(*(F.sum(F.col(f"g{a}") * F.col(f"p{b}")).alias(f"{a}{b}") for a in "xyz" for b in "xyz"))
    n = [F.col(f"n{a}") for a in "xyz"]
    length = F.greatest(norm(*n), F.lit(1e-12))
    unit = {a: c / length for a, c in zip("xyz", n)}
    off = [F.col(f"{a}{b}") - (F.lit(float(a == b)) - unit[a] * unit[b]) for a in "xyz" for b in "xyz"]
    return sums.join(normals, KEYS).select(*KEYS, (sum((o * o for o in off[1:]), off[0] * off[0]) / 9).alias("loss"))


def probes(patches: DataFrame, mode: str, count: int = 8, seed: int = 0) -> list[Column]:
    """Values of test functions at each neighbour: its coordinates, or Gaussians drawn by patch, neighbour and probe."""
    if mode == "coordinates":
        return [F.col(f"p{a}") for a in "xyz"]
    if mode != "random":
        raise ValueError(f"unknown probes: {mode}")
    from .surface_rows import _gaussian

    return [_gaussian(seed, F.lit(i), *(F.col(k) for k in KEYS), F.col("neighbor")) for i in range(count)]


def dirichlet_consistency(patches: DataFrame, areas: DataFrame, mode: str = "random", count: int = 8, seed: int = 0, eps: float = 1e-8) -> DataFrame:
    """(mesh_id, patch, loss): relative squared gap between the energy by weights |g|^2 and by the gradient, mean over probes."""
    g = [F.col(f"g{a}") for a in "xyz"]
    s = sum((c * c for c in g[1:]), g[0] * g[0])
    values = probes(patches, mode, count, seed)
    sums = [F.sum(s * v * v).alias(f"s{i}") for i, v in enumerate(values)] + [F.sum(c * v).alias(f"g{a}{i}") for i, v in enumerate(values) for a, c in zip("xyz", g)]
    out = patches.groupBy(*KEYS).agg(*sums).join(areas.select(*KEYS, "area"), KEYS)
    total = F.lit(0.0)
    for i in range(len(values)):
        e_s, e_g = F.col(f"s{i}"), F.col("area") * sum((F.col(f"g{a}{i}") * F.col(f"g{a}{i}") for a in "yz"), F.col(f"gx{i}") * F.col(f"gx{i}"))
        total = total + (e_s - e_g) * (e_s - e_g) / (e_s * e_s + eps)
    return out.select(*KEYS, (total / len(values)).alias("loss"))


def gram_off_diagonal(patches: DataFrame, eps: float = 1e-8) -> DataFrame:
    """(mesh_id, patch, loss): squared products of different coefficients over the squared sum of weights.

    The squared products over all pairs are the squared entries of the 3 x 3 matrix of sums, so no pair is formed.
    """
    square = F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + F.col("gz") * F.col("gz")
    sums = [F.sum(F.col(f"g{a}") * F.col(f"g{b}")).alias(f"{a}{b}") for a in "xyz" for b in "xyz"]
    out = patches.groupBy(*KEYS).agg(*sums, F.sum(square).alias("w"), F.sum(square * square).alias("own"))
    every = sum((F.col(f"{a}{b}") * F.col(f"{a}{b}") for a in "xyz" for b in "xyz"), F.lit(0.0))
    return out.select(*KEYS, ((every - F.col("own")) / (F.col("w") * F.col("w") + eps)).alias("loss"))


def contrastive(similarities: DataFrame, kind: str = "infonce", temperature: float = 0.07, sigma: float = 0.5, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """One row (loss, accuracy, top3, ...) of ``similarities(a, b, sim)`` of landmark vertices, where a and b match if equal;
    vertices without a match count only as others.

    ``infonce`` keeps the match in the denominator, ``dcl`` leaves it out, and ``dclw``
    weights each vertex by 2 - V softmax(match / sigma), so easy matches count less.
    """
    if kind not in ("infonce", "dcl", "dclw"):
        raise ValueError(f"unknown loss: {kind}")
    similarities = _once(similarities)
    s = similarities.withColumn("s", F.col("sim") / temperature)

    def direction(key: str) -> DataFrame:
        match = F.max(F.when(F.col("a") == F.col("b"), F.col("s")))
        others = F.when((F.col("a") != F.col("b")) | F.lit(kind == "infonce"), F.col("s"))
        top = s.groupBy(F.col(key).alias("v")).agg(F.max(others).alias("top"), match.alias("match"))
        parts = s.withColumn("v", F.col(key)).join(top, "v").where(others.isNotNull())
        total = parts.groupBy("v").agg(F.sum(F.exp(F.col("s") - F.col("top"))).alias("e"), F.first("top").alias("top"), F.first("match").alias("match"))
        return total.where("match is not null").select("v", "match", (-F.col("match") + F.col("top") + F.log("e")).alias("loss"))

    one, two = direction("a"), direction("b").select("v", F.col("loss").alias("back"))
    rows = one.join(two, "v")
    if kind == "dclw":
        # softmax over all vertices, shifted by the largest match
        scaled = F.col("match") * (temperature / sigma)
        whole = one.agg(F.max(scaled).alias("most")).crossJoin(one.agg(F.count("*").alias("count")))
        shifted = rows.crossJoin(F.broadcast(whole)).withColumn("e", F.exp(scaled - F.col("most")))  # one row
        total = shifted.agg(F.sum("e").alias("total"))
        rows = shifted.crossJoin(F.broadcast(total)).withColumn("weight", 2 - F.col("count") * F.col("e") / F.col("total"))
        rows = rows.select("v", (F.col("weight") * F.col("loss")).alias("loss"), (F.col("weight") * F.col("back")).alias("back"))
    loss = rows.agg((0.5 * (F.avg("loss") + F.avg("back"))).alias("loss"))
    hits = top_hits(similarities, ks)
    return loss.crossJoin(hits)  # one row each


def _once(similarities: DataFrame) -> DataFrame:
    """The similarities written, unless they are: sums made anew for each reader differ in their last bits with the order of rows, so that a match could lie above itself."""
    return similarities if hasattr(similarities, "_scratch") else Scratch(similarities.sparkSession, "similarities").put(similarities)


def top_hits(similarities: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """One row (accuracy, top3, ...): share of the a whose match is among the k most similar b; ties go to the smaller b.

    The rank of a match is one more than the b above it, so nothing is sorted.
    """
    similarities = _once(similarities)
    own = similarities.where("a = b").select("a", F.col("sim").alias("match"))
    above = (F.col("sim") > F.col("match")) | ((F.col("sim") == F.col("match")) & (F.col("b") < F.col("a")))
    rank = similarities.join(own, "a").groupBy("a").agg((F.count(F.when(above, 1)) + 1).alias("rank"))
    return rank.agg(F.avg((F.col("rank") == 1).cast("double")).alias("accuracy"), *(F.avg((F.col("rank") <= k).cast("double")).alias(f"top{k}") for k in ks))


def parameter_proximity(weights: DataFrame) -> DataFrame:
    """One row: the squared distance of ``weights(name, i, value, start)`` from their start over the start's squared length."""
    off = F.col("value") - F.col("start")
    return weights.agg((F.sum(off * off) / F.sum(F.col("start") * F.col("start"))).alias("proximity"))


def step_metrics(components: DataFrame, weights: dict[str, float | None], areas: DataFrame) -> DataFrame:
    """(name, value) of a training step: every component, weighted ones, the loss, and the mean and sample deviation of areas."""
    each = weighted(components, weights)
    known = each.where("weight is not null")
    total = known.agg(F.sum("weighted").alias("value")).select(F.lit("loss").alias("name"), "value")
    stats = areas.agg(F.avg("area").alias("m"), F.stddev_samp("area").alias("s")).select(F.explode(F.create_map(F.lit("area_mean"), "m", F.lit("area_std"), "s")).alias("name", "value"))
    return each.select("name", "value").unionByName(known.select(F.concat(F.lit("weighted_"), "name").alias("name"), F.col("weighted").alias("value"))).unionByName(total).unionByName(stats)


def softmax(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with the softmax of a column over each group; sums and maxima are partial aggregates, joined back."""
    top = rows.groupBy(*keys).agg(F.max(value).alias("_top"))
    shifted = rows.join(top, keys).withColumn("_e", F.exp(F.col(value) - F.col("_top")))
    return shifted.join(shifted.groupBy(*keys).agg(F.sum("_e").alias("_total")), keys).withColumn("softmax", F.col("_e") / F.col("_total")).drop("_top", "_e", "_total")


