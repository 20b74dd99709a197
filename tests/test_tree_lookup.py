"""Look-ups that try few levels, and trees of parts whose fuller nodes alone are asked."""

import pytest
from pyspark.sql import functions as F

from lattica.functions.box import Box
from lattica.operators import essential, octree, sync
from lattica.plans.held import held


def _clump(spark, n=3000):
    at = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 20)) / float(1 << 20) - 0.5
    rows = spark.range(n).select(F.col("id").alias("pid"), *(at(k).alias(c) for k, c in enumerate("xyz")))
    return held(rows.withColumns({c: 4 * F.col(c) * F.col(c) * F.col(c) for c in "xyz"}).withColumn("h", F.lit(0.01)))


def test_keys_try_the_levels_of_their_cell(spark, monkeypatch):
    keyed = held(Box().with_key(_clump(spark)).select("pid", "key").unionByName(spark.createDataFrame([(-1, None)], "pid bigint, key bigint")))
    leaves = held(octree.build_octree(keyed, 4))
    want = sorted(map(tuple, octree.leaf_lookup(leaves, keyed).select("pid", "level", "leaf").collect()))
    monkeypatch.setattr(octree, "SMALL_TREE", 1)
    levels = {r.level: r.n for r in leaves.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(levels) > 3 and min(levels) < octree._cell_level(levels) <= max(levels)
    for most in (octree.BROADCAST_ROWS, 100):
        monkeypatch.setattr(octree, "BROADCAST_ROWS", most)
        found = octree.leaf_lookup(leaves, keyed)
        assert sorted(found.columns) == ["key", "leaf", "level", "pid"]
        assert sorted(map(tuple, found.select("pid", "level", "leaf").collect())) == want and len(want) == 3000


@pytest.mark.parametrize("periodic", [True, False])
def test_fuller_nodes_alone_are_asked(spark, monkeypatch, periodic):
    box, df = Box(periodic=(periodic,) * 3), _clump(spark)
    _, leaves, assignment = sync._distributed(df, 3, 16, box, "morton")
    spheres = held(essential.min_mac_spheres(octree.upsweep(leaves, lambda: [F.sum("count").alias("count")]), box, 0.7))
    regions = essential.part_regions(assignment, box)
    trees = held(essential.focus_trees(spheres, regions, 16, box))
    # all boxes of a region, one by one
    gap = F.exists("cells", lambda v: box.gap2(tuple(F.col(f"c{c}") for c in "xyz"), tuple(v["g"][c] for c in "xyz"), tuple(v["s"][c] for c in "xyz")) < F.col("r2"))
    inside = (F.col("key") >= F.col("first")) & (essential.last_key(F.col("level"), F.col("key")) <= F.col("last"))
    nodes = spheres.crossJoin(regions).withColumn("want", gap & ~inside)
    placed = essential._placed(nodes.select("part", "level", "key", "want"), spheres, regions, box)
    assert placed.count() == nodes.count() and placed.where("want != near").count() == 0 and 0 < placed.where("near").count() < placed.count()
    asked, place = [], essential._placed
    monkeypatch.setattr(essential, "_placed", lambda *a: asked.append(held(place(*a))) or asked[-1])
    own = trees.where("is_leaf").select("part", "level", "key")
    again = essential.update_focus_trees(held(own), spheres, regions, 16, box)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, own.collect()))
    assert asked[0].where("near AND count <= 16").count() == 0 < asked[0].where("near").count()  # small nodes were asked before
