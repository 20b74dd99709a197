"""A tree kept from step to step: only the prefixes of keys that changed are counted, and only overfull leaves look at keys again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.sfc import BITS, enclosing_box, node_range
from lattica.operators.octree import BROADCAST_ROWS, STEP, build_octree, leaf_lookup, upsweep
from lattica.plans.held import held


def tree_state(keys: DataFrame, bucket: int) -> DataFrame:
    """(level, key, count, is_leaf) of all nodes of the tree of keys (key): what update_tree() starts from."""
    leaves = build_octree(keys, bucket)
    return held(upsweep(leaves, lambda: [F.sum("count").alias("count"), F.max(F.col("up") == F.col("level")).alias("is_leaf")]))


def key_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, change): how many rows (pid, key) a key has gained; a pid that isn't in both, or has no key, has come or gone.

    A pid names one row at most on either side.
    """
    # a row that keeps its key takes away as much as it adds, so pids needn't meet
    signed = lambda df, by: df.where("key IS NOT NULL").select("key", F.lit(by).cast("long").alias("by"))
    return signed(before, -1).unionByName(signed(after, 1)).groupBy("key").agg(F.sum("by").alias("change")).where("change != 0")


def _grown(full: DataFrame, keys: DataFrame, bucket: int, deepest: int) -> DataFrame | None:
    """(level, key, count, is_leaf) of all nodes below the nodes full (level, key), which hold more than bucket keys each."""
    full, out = held(full.select("level", "key", F.least(F.col("level") + STEP, F.lit(deepest)).alias("to"))), None
    while n := full.count():
        cells = full.select("level", F.col("key").alias("leaf"), "to")
        levels = [r[0] for r in cells.select("level").distinct().collect()]
        tried = keys.select("key", F.explode(F.array(*map(F.lit, sorted(levels)))).alias("level")).withColumn("leaf", enclosing_box(F.col("key"), F.col("level")))
        keys = held(tried.join(F.broadcast(cells) if n <= BROADCAST_ROWS else cells, ["level", "leaf"]).select("key", F.col("level").alias("top"), "to"))
        rows = keys.withColumn("level", F.explode(F.sequence(F.col("top") + 1, F.col("to"))))
        counts = held(rows.groupBy("level", enclosing_box(F.col("key"), F.col("level")).alias("key")).agg(F.count(F.lit(1)).alias("count"), F.first("to").alias("to")))
        divided = full.unionByName(counts.where((F.col("count") > bucket) & (F.col("level") < F.col("to"))).select("level", "key", "to"))
        kids = divided.withColumn("__d", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("level", F.col("level") + 1)
        kids = kids.select("level", (F.col("key") + node_range(F.col("level")) * F.col("__d")).alias("key"), "to")
        nodes = held(kids.join(counts.select("level", "key", "count"), ["level", "key"], "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long")))
        more = (F.col("count") > bucket) & (F.col("level") < deepest)
        made = nodes.select("level", "key", "count", (~more).alias("is_leaf"))
        out = made if out is None else out.unionByName(made)
        full = held(nodes.where(more & (F.col("level") == F.col("to"))).select("level", "key", F.least(F.col("level") + STEP, F.lit(deepest)).alias("to")))
        keys = keys.select("key")
    return out


def update_tree(state: DataFrame, changes: DataFrame, keys: DataFrame, bucket: int, deepest: int = BITS) -> DataFrame:
    """The state of the tree of keys (key), from the state before and the changes (key, change) since.

    Changes are summed by leaf and added to the leaf and its ancestors. A node goes if its parent now has at most `bucket` keys, which is
    a leaf then; a leaf with more is divided, for which the keys in such leaves alone are counted. The result is that of tree_state(keys).
    """
    leaves = state.where("is_leaf").select("level", "key")
    found = leaf_lookup(leaves, changes).groupBy("level", "leaf").agg(F.sum("change").alias("change")).where("change != 0")
    up = found.select("leaf", "change", F.explode(F.sequence(F.lit(0), "level")).alias("level"))
    by = up.groupBy("level", enclosing_box(F.col("leaf"), F.col("level")).alias("key")).agg(F.sum("change").alias("change"))
    now = held(state.join(by, ["level", "key"], "left").select("level", "key", (F.col("count") + F.coalesce("change", F.lit(0))).alias("count"), "is_leaf"))
    inner = now.where((F.col("count") > bucket) & ~F.col("is_leaf")).select((F.col("level") + 1).alias("level"), F.col("key").alias("__p"))
    parent = enclosing_box(F.col("key"), F.greatest(F.col("level") - 1, F.lit(0)))
    kept = now.withColumn("__p", parent).join(inner, ["level", "__p"], "left_semi").drop("__p").unionByName(now.where("level = 0"))
    over = (F.col("count") > bucket) & (F.col("level") < deepest)
    kept = held(kept.select("level", "key", "count", (F.col("is_leaf") & over).alias("full"), (~over).alias("is_leaf")))
    grown = _grown(kept.where("full").select("level", "key"), keys.where("key IS NOT NULL").select("key"), bucket, deepest)
    kept = kept.drop("full")
    return held(kept if grown is None else kept.unionByName(grown))
