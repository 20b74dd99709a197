"""Searches over the leaves of an octree: neighbours by lists of leaves, and the nearest particle by bounds.

Dense places are divided by the tree, so that a task meets blocks of at most about `bucket` particles, however these
cluster. Nodes have the boxes that their particles fill, which are what lists and bounds are made of.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.box import AXES, Box
from lattica.functions.sfc import enclosing_box
from lattica.operators import octree
from lattica.plans.held import held

#: Particles of a leaf, and of a block of a leaf that can't be divided further.
BUCKET = 64
#: Points that go to the particles; rows that are looked at together, and of one of their cells.
FEW_POINTS, SCAN_ROWS, CELL_ROWS = 1 << 12, 1 << 17, 256
#: By how much boxes are widened for what rounding may have taken off them.
_SLACK = 1e-12


class SearchTree(NamedTuple):
    """A tree's leaves (level, key, count), its nodes' boxes (level, key, is_leaf, count, x0 to z1) and its particles with the leaf of each."""

    box: Box
    leaves: DataFrame
    nodes: DataFrame
    placed: DataFrame


def search_tree(df: DataFrame, box: Box, bucket: int = BUCKET) -> SearchTree:
    """The tree of the particles (pid, x, y, z, ...); those with a null or no finite coordinate are left out."""
    keyed = box.with_key(_finite(df).select("pid", *AXES, *(["h"] if "h" in df.columns else [])))
    leaves = held(octree.build_octree(keyed, bucket))
    placed = held(octree.leaf_lookup(leaves, keyed))
    boxes = placed.groupBy("level", F.col("leaf").alias("key")).agg(F.count(F.lit(1)).alias("count"), *(f(c).alias(f"{c}{n}") for c in AXES for f, n in ((F.min, 0), (F.max, 1))))
    sums = lambda: [F.max(F.col("up") == F.col("level")).alias("is_leaf"), F.sum("count").alias("count"), *(f(f"{c}{n}").alias(f"{c}{n}") for c in AXES for f, n in ((F.min, 0), (F.max, 1)))]
    return SearchTree(box, leaves, held(octree.upsweep(boxes, sums)), placed)


def _finite(df: DataFrame) -> DataFrame:
    fits = [F.col(c).isNotNull() & (F.abs(c) < float("inf")) for c in AXES]
    return df.where(fits[0] & fits[1] & fits[2])


def _kin(tree: SearchTree) -> tuple[DataFrame, int]:
    """The nodes but the root by their parents (up, parent), for a broadcast where they are few; and the deepest level."""
    n, deepest = tree.nodes.agg(F.count(F.lit(1)), F.max("level")).first()
    kin = tree.nodes.where("level > 0").withColumns({"up": F.col("level") - 1, "parent": enclosing_box(F.col("key"), F.col("level") - 1)})
    return F.broadcast(kin) if n <= octree.BROADCAST_ROWS else kin, deepest or 0


def _middle(low: str, high: str) -> list[tuple[Column, Column]]:
    """Centres and half sizes along the axes, from columns whose names are those of the axes between a prefix and 0 or 1."""
    out = []
    for c in AXES:
        a, b = F.col(low.format(c)), F.col(high.format(c))
        out.append(((a + b) / 2, (b - a) / 2 + _SLACK * (F.abs(a) + F.abs(b))))
    return out


def interaction_lists(tree: SearchTree, targets: DataFrame) -> DataFrame:
    """targets (t_x0 to t_z1, a box, and more) with every leaf (level, key) whose particles' box meets that box, and this box.

    All targets go down from the root together; at each level those nodes stay that a target meets. So what is held is
    as large as the lists, times the depth at most.
    """
    kin, deepest = _kin(tree)
    asked, own = _middle("t_{}0", "t_{}1"), _middle("{}0", "{}1")
    meets = tree.box.overlap(*(tuple(v[k] for v in side) for side in (asked, own) for k in (0, 1)))
    columns = [*targets.columns, *tree.nodes.columns]
    pairs, found = targets.crossJoin(F.broadcast(tree.nodes.where("level = 0"))).where(meets), None  # one row
    for level in range(deepest + 1):
        pairs = held(pairs)
        done = pairs.where("is_leaf")
        found = done if found is None else found.unionByName(done)
        if level < deepest:
            rest = pairs.where("NOT is_leaf").select(*targets.columns, F.col("level").alias("up"), F.col("key").alias("parent"))
            pairs = rest.join(kin, ["up", "parent"]).select(*columns).where(meets)
    return found.drop("is_leaf")


def _blocks(rows: DataFrame, keys: list[str], values: list[str], name: str, bucket: int) -> DataFrame:
    """(keys, name): the rows of each key in lists of about `bucket`; those of a key that has more are dealt by pid."""
    large = held(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / bucket).alias("__n")).where("__n > 1"))
    side = F.broadcast(large) if large.count() <= octree.BROADCAST_ROWS else large
    block = F.coalesce(F.pmod(F.xxhash64("pid"), F.col("__n")), F.lit(0)).alias("__b")
    dealt = rows.join(side, keys, "left").select(*keys, block, F.struct(*values).alias("__v"))
    return dealt.groupBy(*keys, "__b").agg(F.collect_list("__v").alias(name)).drop("__b")


def leaf_pairs(df: DataFrame, box: Box | None = None, queries: DataFrame | None = None, scale: float = 2.0, bucket: int = BUCKET) -> DataFrame:
    """(i, j, d2) for every j of df other than i with distance below scale * h of i, for all i of df or of queries.

    The i's of a leaf with radii of one order are a group that asks: its box holds the spheres of its particles. Blocks of a group
    meet blocks of each leaf on its list; an i goes on only to leaves whose box its own sphere reaches. Periodic axes take
    nearest images, so radii there are below half a length. An i without radius, and one of 0 or less, finds nothing.
    """
    box = box or Box()
    tree = search_tree(df, box, bucket)
    placed = tree.placed if queries is None else octree.leaf_lookup(tree.leaves, box.with_key(_finite(queries).select("pid", *AXES, "h")))
    rung = F.floor(F.log2("r") / 2).alias("t_rung")  # a wide search doesn't widen that of narrow ones in its leaf
    asking = placed.withColumn("r", scale * F.col("h")).where("r > 0").select("pid", *AXES, "r", F.col("level").alias("t_level"), F.col("leaf").alias("t_key"), rung)
    asking, group = held(asking), ["t_level", "t_key", "t_rung"]
    limits = asking.groupBy(*group).agg(*(f(F.col(c) + s * F.col("r")).alias(f"t_{c}{n}") for c in AXES for f, s, n in ((F.min, -1, 0), (F.max, 1, 1))))
    lists = interaction_lists(tree, limits).select(*group, "level", "key", *(f"{c}{n}" for c in AXES for n in (0, 1)))
    groups = _blocks(asking, group, ["pid", *AXES, "r"], "group", bucket)
    sources = _blocks(tree.placed, ["level", "leaf"], ["pid", *AXES], "sources", bucket).withColumnRenamed("leaf", "key")
    met = lists.join(groups, group).withColumn("t", F.explode("group")).drop("group", *group)
    own = _middle("{}0", "{}1")
    reach = box.gap2(tuple(F.col(f"t.{c}") for c in AXES), tuple(m for m, _ in own), tuple(s for _, s in own))
    near = met.where(reach < F.col("t.r") * F.col("t.r"))
    rows = near.select("level", "key", "t").join(sources, ["level", "key"]).select("t", F.explode("sources").alias("s")).where("t.pid != s.pid")
    d = [box.image(F.col(f"t.{c}") - F.col(f"s.{c}"), k) for k, c in enumerate(AXES)]
    rows = rows.select(F.col("t.pid").alias("i"), F.col("s.pid").alias("j"), (d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("d2"), (F.col("t.r") * F.col("t.r")).alias("r2"))
    return rows.where("d2 < r2").drop("r2")


def near_leaves(tree: SearchTree, points: DataFrame) -> DataFrame:
    """points (point, px, py, pz) with the leaves (level, key, ...) that may hold the particle nearest to each.

    All points go down from the root together. A node's box is at least `low` away; as each face of a box has a
    particle, one lies within `high`. Of the nodes of a level, and leaves above it, those stay whose low isn't above the
    smallest high of these.
    """
    kin, deepest = _kin(tree)
    at = [F.col(f"p{c}") for c in AXES]
    faces = [(F.col(f"{c}0"), F.col(f"{c}1")) for c in AXES]
    square = lambda v: v * v
    low = sum((square(F.greatest(a - p, p - b, F.lit(0.0))) for p, (a, b) in zip(at, faces, strict=True)), F.lit(0.0))
    close = [F.least(square(p - a), square(p - b)) for p, (a, b) in zip(at, faces, strict=True)]
    far = [F.greatest(square(p - a), square(p - b)) for p, (a, b) in zip(at, faces, strict=True)]
    high = F.least(*(sum((close[k] if k == n else far[k] for k in range(3)), F.lit(0.0)) for n in range(3)))
    known, best = ["point", "px", "py", "pz"], F.min("high").over(Window.partitionBy("point"))
    near = points.select(*known).crossJoin(F.broadcast(tree.nodes.where("level = 0")))  # one row
    columns = near.columns
    for level in range(deepest + 1):
        seen = near.withColumns({"low": low, "high": high}).withColumn("best", best)
        near = held(seen.where(F.col("low") <= F.col("best") * (1 + _SLACK)).select(*columns))
        if level < deepest:
            rest = near.where("NOT is_leaf").select(*known, F.col("level").alias("up"), F.col("key").alias("parent"))
            near = near.where("is_leaf").unionByName(rest.join(kin, ["up", "parent"]).select(*columns))
    return near


def nearest_point(df: DataFrame, points: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """points (point, px, py, pz; point tells them apart) with the particle of df nearest to each: point, pid, d2.

    The smallest pid of equals; no rows without particles. Up to FEW_POINTS points go to the particles, which are read once and neither shuffled nor
    kept. Of more, only particles of near_leaves() are measured.
    """
    asked = [tuple(r) for r in points.select("point", "px", "py", "pz").limit(FEW_POINTS + 1).collect()]
    if len(asked) <= FEW_POINTS:
        schema = T.StructType().add("n", T.IntegerType()).add("d2", T.DoubleType()).add("pid", df.schema["pid"].dataType)
        found = _finite(df).select("pid", *(F.col(c).cast("double").alias(c) for c in AXES)).mapInArrow(_nearest_rows(asked), schema)
        nearest = found.groupBy("n").agg(F.min(F.struct("d2", "pid")).alias("m")).select("n", "m.pid", "m.d2")
        names = df.sparkSession.createDataFrame([(n, p) for n, (p, *_) in enumerate(asked)], T.StructType().add("n", T.IntegerType()).add(points.schema["point"]))
        return nearest.join(F.broadcast(names), "n").select("point", "pid", "d2")
    tree = search_tree(df, Box(periodic=(False,) * 3).around(_finite(df)), bucket)
    near = near_leaves(tree, points).select("point", *(f"p{c}" for c in AXES), "level", F.col("key").alias("leaf"))
    met = near.join(tree.placed.select("pid", *AXES, "level", "leaf"), ["level", "leaf"])
    d = [F.col(c) - F.col(f"p{c}") for c in AXES]
    nearest = met.groupBy("point").agg(F.min(F.struct((d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("d2"), "pid")).alias("m"))
    return nearest.select("point", "m.pid", "m.d2")


def _nearest_rows(points: list[tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's nearest row (n, d2, pid) of particles (pid, x, y, z) to the n-th of points (point, px, py, pz)."""
    at = np.array([[np.nan if v is None else v for v in p[1:]] for p in points], np.float64).reshape(-1, 3)
    known = np.flatnonzero(np.isfinite(at).all(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, pids, seen = np.full(len(at), np.inf), [None] * len(at), np.zeros(len(at), bool)

        def look(rows: pa.Table) -> None:
            x = np.stack([rows.column(c).to_numpy() for c in AXES])
            pid = rows.column("pid").combine_chunks()
            # cells of about CELL_ROWS rows, the rows of each one after the other, and the boxes that they fill
            low, n = x.min(1)[:, None], max(1, round((x.shape[1] / CELL_ROWS) ** (1 / 3)))
            wide = np.maximum(x.max(1)[:, None] - low, np.finfo(float).tiny)
            cell = np.minimum((n * ((x - low) / wide)).astype(np.int64), n - 1)
            cell = (cell[0] * n + cell[1]) * n + cell[2]
            order = np.argsort(cell, kind="stable")
            x, starts = x[:, order], np.append(np.flatnonzero(np.diff(cell[order], prepend=-1)), len(order))
            lows, highs = np.minimum.reduceat(x, starts[:-1], 1), np.maximum.reduceat(x, starts[:-1], 1)
            for k in known:
                p = at[k][:, None]
                gap = np.maximum(np.maximum(lows - p, p - highs), 0.0)
                gap = (gap * gap).sum(0) * (1 - _SLACK)
                some = np.flatnonzero(gap <= best[k])
                for c in some[np.argsort(gap[some])]:
                    if gap[c] > best[k]:
                        break
                    d = x[:, starts[c] : starts[c + 1]] - p
                    d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
                    least = d2.min()
                    if least > best[k]:
                        continue
                    mine = pid.take(pa.array(order[starts[c] + np.flatnonzero(d2 == least)]))
                    one = None if mine.null_count else pc.min(mine).as_py()  # as Spark orders them
                    if not seen[k] or least < best[k] or (pids[k] is not None and (one is None or one < pids[k])):
                        best[k], pids[k], seen[k] = least, one, True

        kept, n, kind = [], 0, None
        for batch in batches:
            kept.append(batch)
            kind = batch.schema.field("pid").type
            n += batch.num_rows
            if n >= SCAN_ROWS:
                look(pa.Table.from_batches(kept))
                kept, n = [], 0
        if n:
            look(pa.Table.from_batches(kept))
        found = np.flatnonzero(seen)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(best[found]), pa.array([pids[k] for k in found], kind)], names=["n", "d2", "pid"])

    return run
