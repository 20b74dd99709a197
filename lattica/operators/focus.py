"""What one part of a domain needs of the whole tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.geometry import inv_theta_min, min_mac_r2, vector_mac_r2
from lattica.functions.sfc import BITS, _long, enclosing_box, node_range
from lattica.operators import domain, octree
from lattica.plans.held import held


def focus_tree(leaves: DataFrame, first: int, last: int, theta: float, periodic: bool = True) -> DataFrame:
    """(level, key, count): the leaves of the tree that the keys [first, last) need: all of the tree's leaves there, and
    elsewhere nodes that are divided only as long as the opening criterion fails for a leaf there."""
    leaves = held(leaves.select("level", "key", "count"))
    nodes = held(octree.upsweep(leaves, lambda: [F.sum("count").alias("count"), F.max(F.col("up") == F.col("level")).alias("is_leaf")]))
    marked = domain.mark_macs(nodes, leaves.where((F.col("key") >= first) & (F.col("key") < last)), theta, periodic).withColumn("mac", F.lit(True))
    end = F.when(F.col("level") > 0, F.col("key") + (node_range(F.greatest(F.col("level"), F.lit(1))) - 1)).otherwise(8**BITS - 1)
    inside = (end >= first) & (F.col("key") < last)
    divided = held(nodes.where("NOT is_leaf").join(marked, ["level", "key"], "left").where(F.coalesce("mac", F.lit(False)) | inside).select("level", "key"))
    root = leaves.sparkSession.range(1).select(F.lit(0).alias("level"), _long(0).alias("key"))
    kept = root.unionByName(octree.children(divided).select("level", "key")).join(divided, ["level", "key"], "left_anti")
    return kept.join(nodes.select("level", "key", "count"), ["level", "key"])


def search_boxes(particles: DataFrame, leaves: DataFrame, scale: float) -> DataFrame:
    """(level, key, xlo .. zhi): the box around the spheres of radius scale * h of each leaf's particles and the leaf's centre."""
    rows = octree.leaf_lookup(leaves, particles).groupBy("level", F.col("leaf").alias("key"))
    r = scale * F.col("h")
    found = rows.agg(*(F.min(F.col(c) - r).alias(f"{c}a") for c in "xyz"), *(F.max(F.col(c) + r).alias(f"{c}b") for c in "xyz"))
    placed = domain.node_geometry(leaves.select("level", "key")).join(found, ["level", "key"], "left")
    low, high = (lambda c: F.least(f"{c}a", f"c{c}")), (lambda c: F.greatest(f"{c}b", f"c{c}"))
    return placed.select("level", "key", *(low(c).alias(f"{c}lo") for c in "xyz"), *(high(c).alias(f"{c}hi") for c in "xyz"))


def mac_spheres(nodes: DataFrame, centers: DataFrame | None, theta: float) -> DataFrame:
    """(level, key, cx, cy, cz, r2): each node's acceptance sphere, around its mass centre (r2 0 for nodes without mass),
    or, without centers, around its geometric centre."""
    placed = domain.node_geometry(nodes.select("level", "key"))
    if centers is None:
        return placed.select("level", "key", "cx", "cy", "cz", min_mac_r2(2 * F.col("s"), inv_theta_min(theta)).alias("r2"))
    rows = placed.join(centers.select("level", "key", "m", *(F.col(f"c{c}").alias(f"m{c}") for c in "xyz")), ["level", "key"], "left")
    d = [F.col(f"m{c}") - F.col(f"c{c}") for c in "xyz"]
    r2 = vector_mac_r2(2 * F.col("s"), F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]), 1 / theta)
    has = F.coalesce(F.col("m") != 0, F.lit(False))
    return rows.select("level", "key", *(F.when(has, F.col(f"m{c}")).otherwise(F.col(f"c{c}")).alias(f"c{c}") for c in "xyz"), F.when(has, r2).otherwise(0.0).alias("r2"))


def range_counts(focus: DataFrame, leaves: DataFrame) -> DataFrame:
    """focus (level, key) with count: the keys of the leaves (key, count) that lie in each; leaves must not be larger."""
    found = octree.leaf_lookup(focus, leaves.select("key", "count")).groupBy("level", F.col("leaf").alias("key")).agg(F.sum("count").alias("count"))
    return focus.select("level", "key").join(found, ["level", "key"], "left").select("level", "key", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def protect_ancestors(nodes: DataFrame) -> DataFrame:
    """nodes (level, key, op) with op: a node with op 0 takes the op of its closest ancestor with another, if both begin at
    the same key; else it keeps 0. The root's op isn't 0."""
    up = nodes.where("op = 0").select("level", "key", F.explode(F.sequence(F.lit(0), F.col("level") - 1)).alias("up"))
    up = up.withColumn("at", enclosing_box(F.col("key"), F.col("up")))
    stays = nodes.where("op != 0").select(F.col("level").alias("up"), F.col("key").alias("at"), F.col("op").alias("__op"))
    best = up.join(stays, ["up", "at"]).groupBy("level", "key").agg(F.max(F.struct("up", "at", "__op")).alias("b"))
    best = best.select("level", "key", F.when(F.col("b.at") == F.col("key"), F.col("b.__op")).otherwise(0).alias("__new"))
    return nodes.join(best, ["level", "key"], "left").withColumn("op", F.coalesce("__new", "op")).drop("__new")


def enforce_keys(nodes: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ops under which a tree keeps or gets nodes that begin at given keys; and a status for each key.

    nodes (level, key, op, is_leaf) are all nodes of a tree; keys (key). For each key the smallest node that holds the
    largest node beginning there is found. If it would be merged, or isn't that node, all siblings of it and of its
    ancestors with op 0 get 1; if it isn't that node, it is divided once (op 8 at least). status: 0 there, 1 merges
    undone, 2 one more level is enough, 3 it isn't.
    """
    from lattica.functions.sfc import make_prefix

    wanted = keys.where("key > 0").select(F.col("key").alias("id"), make_prefix(F.col("key")).alias("w")).select("id", F.col("w.level").alias("level"), F.col("w.key").alias("key")).distinct()
    found = octree.containing_node(nodes, wanted).join(wanted.select("id", F.col("level").alias("want")), "id")
    found = found.join(nodes.select(F.col("level").alias("node_level"), F.col("key").alias("node_key"), "op"), ["node_level", "node_key"])
    split = (F.col("node_level") < F.col("want")) & (F.col("node_level") < BITS)
    undo = ((F.col("op") == 0) | split) & (F.col("node_level") > 0)
    found = held(found.withColumns({"split": split, "undo": undo}))
    # the families of a node and of its ancestors are named by their parents
    parents = found.where("undo").select(F.explode(F.sequence(F.lit(1), "node_level")).alias("level"), "node_key")
    parents = parents.select("level", enclosing_box(F.col("node_key"), F.col("level") - 1).alias("__p")).distinct().withColumn("__kept", F.lit(True))
    more = found.where("split").select(F.col("node_level").alias("level"), F.col("node_key").alias("key")).distinct().withColumn("__split", F.lit(True))
    rows = nodes.withColumn("__p", enclosing_box(F.col("key"), F.greatest(F.col("level") - 1, F.lit(0)))).join(parents, ["level", "__p"], "left").join(more, ["level", "key"], "left")
    op = F.when(F.col("__kept") & (F.col("op") == 0), 1).otherwise(F.col("op"))
    rows = rows.withColumn("op", F.when(F.col("__split"), F.greatest(op, F.lit(8))).otherwise(op)).drop("__p", "__kept", "__split")
    deeper = F.col("want") - F.col("node_level") > 1
    status = F.when(F.col("split"), F.when(deeper, 3).otherwise(2)).when(F.col("undo"), 1).otherwise(0)
    return rows, found.select(F.col("id").alias("key"), status.alias("status"))
