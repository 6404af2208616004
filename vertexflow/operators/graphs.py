"""Connected components of mesh graphs, as DataFrame rounds whose labels are written each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, where it stays until the driver ends."""
    return Scratch(df.sparkSession, "kept").put(df)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(mesh_id, v, component) of every node; component is the smallest node that it reaches over ``edges(mesh_id, a, b)``.

    Each round takes the least label among a node and its neighbours and then the label of that
    label, so paths shorten by halves. Every label is the id of a node of the same component.
    """
    both = edges.select("mesh_id", "a", "b").unionByName(edges.select("mesh_id", F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    scratch = Scratch(edges.sparkSession, "components")
    both, labels, held = scratch.put(both), scratch.put(nodes.select("mesh_id", "v", F.col("v").alias("component")).distinct()), None
    while True:
        seen = labels.select("mesh_id", F.col("v").alias("b"), "component")
        near = both.join(seen, ["mesh_id", "b"]).groupBy("mesh_id", F.col("a").alias("v")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, ["mesh_id", "v"], "left").select("mesh_id", "v", F.least("component", "near").alias("hook"), F.col("component").alias("was"))
        of = hooked.select("mesh_id", F.col("v").alias("hook"), F.col("hook").alias("jump"))
        moved = scratch.put(hooked.join(of, ["mesh_id", "hook"]).select("mesh_id", "v", F.col("jump").alias("component"), "was"))
        changed = not moved.where("component <> was").isEmpty()
        scratch.drop(held)
        labels, held = moved.select("mesh_id", "v", "component"), moved
        if not changed:
            scratch.drop(both)
            return labels


def component_sizes(labels: DataFrame) -> DataFrame:
    """(mesh_id, component, size)."""
    return labels.groupBy("mesh_id", "component").agg(F.count("*").alias("size"))


def face_components(faces: DataFrame) -> DataFrame:
    """(mesh_id, f, component) of faces that hang together over shared edges.

    Faces of one edge are linked to its first face, so an edge of many faces gives no pairs among them.
    """
    sides = F.array(*(F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))
    each = faces.select("mesh_id", "f", F.explode(sides).alias("e")).select("mesh_id", "f", "e.p", "e.q")
    first = each.groupBy("mesh_id", "p", "q").agg(F.min("f").alias("b"))
    links = each.join(first, ["mesh_id", "p", "q"]).where("f <> b").select("mesh_id", F.col("f").alias("a"), "b")
    return components(links, faces.select("mesh_id", F.col("f").alias("v"))).withColumnRenamed("v", "f")


def boundary_loops(faces: DataFrame) -> DataFrame:
    """(mesh_id, v, component): the vertices of each boundary loop, which is named by its smallest one."""
    from .topology import edges

    rim = edges(faces).where("faces = 1").select("mesh_id", "a", "b")
    return components(rim, rim.select("mesh_id", F.explode(F.array("a", "b")).alias("v")))
