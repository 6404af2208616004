"""Linear blend skinning of body models whose arrays come as tables, never as pickles.

``template(v, x, y, z)``, ``shape_dirs(v, beta, x, y, z)``, ``pose_dirs(v, p, x, y, z)``,
``regressor(joint, v, w)``, ``skin(v, joint, w)`` and ``tree(joint, parent)``; bodies are
``betas(body_id, beta, value)``, ``poses(body_id, joint, rx, ry, rz)`` and ``shifts(body_id, x, y, z)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .points import normalized, rodrigues
from .surface_rows import _gaussian

_R = [f"r{i}{j}" for i in range(3) for j in range(3)]


def shaped(template: DataFrame, shape_dirs: DataFrame, bodies: DataFrame, betas: DataFrame) -> DataFrame:
    """(body_id, v, x, y, z): the template and each body's blend of shape directions."""
    blend = shape_dirs.join(betas, "beta").groupBy("body_id", "v").agg(*(F.sum(F.col(a) * F.col("value")).alias(f"d{a}") for a in "xyz"))
    rows = template.crossJoin(bodies.select("body_id")).join(blend, ["body_id", "v"], "left")
    return rows.select("body_id", "v", *((F.col(a) + F.coalesce(f"d{a}", F.lit(0.0))).alias(a) for a in "xyz"))


def joints(regressor: DataFrame, shape: DataFrame) -> DataFrame:
    """(body_id, joint, x, y, z) of the joints of shaped bodies."""
    return shape.join(regressor, "v").groupBy("body_id", "joint").agg(*(F.sum(F.col("w") * F.col(a)).alias(a) for a in "xyz"))


def joint_rotations(tree: DataFrame, bodies: DataFrame, poses: DataFrame) -> DataFrame:
    """(body_id, joint, r00 .. r22); a joint without a pose rests."""
    every = tree.select("joint").crossJoin(bodies.select("body_id")).join(poses, ["body_id", "joint"], "left")
    turn = rodrigues(*(F.coalesce(F.col(f"r{a}"), F.lit(0.0)) for a in "xyz"))
    return every.select("body_id", "joint", *(turn[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)))


def chained(tree: DataFrame, turns: DataFrame, places: DataFrame) -> DataFrame:
    """(body_id, joint, r00 .. r22, t0, t1, t2): each joint's transform composed along its ancestors, less its rest place.

    One join for each level of the tree; the root has no parent or names one outside the tree.
    """
    rows = turns.join(places, ["body_id", "joint"]).join(tree.select("joint", "parent"), "joint")
    above = places.select("body_id", F.col("joint").alias("parent"), *(F.col(a).alias(f"p{a}") for a in "xyz"))
    rows = rows.join(above, ["body_id", "parent"], "left").withColumn("root", F.col("px").isNull())
    local = rows.select("body_id", "joint", "parent", "root", *_R, *((F.col(a) - F.coalesce(f"p{a}", F.lit(0.0))).alias(f"t{i}") for i, a in enumerate("xyz")), "x", "y", "z")
    done = local.where("root").select("body_id", "joint", *_R, "t0", "t1", "t2")
    level, links = done, tree.select("joint", "parent")
    names = {r["joint"]: r["parent"] for r in links.collect()}  # joints of a body model, some dozens

    def depth(j):
        return 0 if names.get(j) not in names or names[j] == j else 1 + depth(names[j])

    for _ in range(max((depth(j) for j in names), default=0)):
        up = level.select("body_id", F.col("joint").alias("parent"), *(F.col(r).alias(f"u{r}") for r in _R), *(F.col(f"t{i}").alias(f"u{i}") for i in range(3)))
        met = local.where("not root").join(up, ["body_id", "parent"])
        turn = [sum((F.col(f"ur{i}{k}") * F.col(f"r{k}{j}") for k in (1, 2)), F.col(f"ur{i}0") * F.col(f"r0{j}")).alias(f"r{i}{j}") for i in range(3) for j in range(3)]
        move = [(sum((F.col(f"ur{i}{k}") * F.col(f"t{k}") for k in (1, 2)), F.col(f"ur{i}0") * F.col("t0")) + F.col(f"u{i}")).alias(f"t{i}") for i in range(3)]
        level = met.select("body_id", "joint", *turn, *move)
        done = done.unionByName(level)
    rest = done.join(places, ["body_id", "joint"])
    back = [(F.col(f"t{i}") - sum((F.col(f"r{i}{k}") * F.col(a) for k, a in ((1, "y"), (2, "z"))), F.col(f"r{i}0") * F.col("x"))).alias(f"t{i}") for i in range(3)]
    return rest.select("body_id", "joint", *_R, *back)


def skinned(template: DataFrame, shape_dirs: DataFrame, pose_dirs: DataFrame, regressor: DataFrame, skin: DataFrame, tree: DataFrame, bodies: DataFrame, betas: DataFrame, poses: DataFrame, shifts: DataFrame) -> DataFrame:
    """(body_id, v, x, y, z) of every body: shape blend, joints, pose blend, chained transforms, skinning, shift."""
    shape = shaped(template, shape_dirs, bodies, betas)
    places, turns = joints(regressor, shape), joint_rotations(tree, bodies, poses)
    # pose features: entries of R - I of all joints but the first, nine a joint, in joint order
    entries = F.array(*(F.struct(F.lit(3 * i + j).alias("e"), (F.col(f"r{i}{j}") - float(i == j)).alias("value")) for i in range(3) for j in range(3)))
    features = turns.where("joint > 0").select("body_id", "joint", F.explode(entries).alias("s")).select("body_id", ((F.col("joint") - 1) * 9 + F.col("s.e")).alias("p"), "s.value")
    blend = pose_dirs.join(features, "p").groupBy("body_id", "v").agg(*(F.sum(F.col(a) * F.col("value")).alias(f"d{a}") for a in "xyz"))
    posed = shape.join(blend, ["body_id", "v"], "left").select("body_id", "v", *((F.col(a) + F.coalesce(f"d{a}", F.lit(0.0))).alias(a) for a in "xyz"))
    moved = skin.join(chained(tree, turns, places), "joint").groupBy("body_id", "v").agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in [*_R, "t0", "t1", "t2"]))
    at = posed.join(moved, ["body_id", "v"]).join(shifts.select("body_id", *(F.col(a).alias(f"s{a}") for a in "xyz")), "body_id", "left")
    return at.select("body_id", "v", *((F.col(f"r{i}0") * F.col("x") + F.col(f"r{i}1") * F.col("y") + F.col(f"r{i}2") * F.col("z") + F.col(f"t{i}") + F.coalesce(f"s{a}", F.lit(0.0))).alias(a) for i, a in enumerate("xyz")))


def drawn_bodies(bodies: DataFrame, families: DataFrame, tree: DataFrame, pose_scale: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(betas, poses) of ``bodies(body_id, family)``: the family's mean shape (family, beta, value) and Gaussian poses; the root rests."""
    betas = bodies.join(families, "family").select("body_id", "beta", "value")
    each = bodies.select("body_id").crossJoin(tree.select("joint"))
    turn = [F.when(F.col("joint") == 0, 0.0).otherwise(_gaussian(seed, F.lit(a), F.col("body_id"), F.col("joint")) * pose_scale).alias(f"r{a}") for a in "xyz"]
    return betas, each.select("body_id", "joint", *turn)


def generated(model: dict[str, DataFrame], bodies: DataFrame, families: DataFrame, pose_scale: float, seed: int) -> DataFrame:
    """vertices(mesh_id, v, x, y, z) of drawn bodies, in the unit sphere."""
    betas, poses = drawn_bodies(bodies, families, model["tree"], pose_scale, seed)
    still = bodies.select("body_id", *(F.lit(0.0).alias(a) for a in "xyz"))
    out = skinned(**model, bodies=bodies, betas=betas, poses=poses, shifts=still)
    return normalized(out.withColumnRenamed("body_id", "mesh_id"))
