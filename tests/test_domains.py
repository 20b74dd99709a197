"""Domains, the trees of all parts, trees kept over steps, planned exchanges, and whole tables, against brute force and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import domain_queries, queries
from lattica.functions.box import Box, near_image, wrapped
from lattica.operators import essential, exchange, moving, octree, sync
from lattica.plans.held import held
from lattica.sources.particles import clustered, particles

SMALL = "/root/testdata/sf0.001"
OPEN = Box(periodic=(False, False, False))


@pytest.fixture(scope="module")
def spread(spark):
    """A domain's tree nodes, spheres and regions, in an open box of uneven sides."""
    spheres, regions, box = domain_queries._focus(spark, SMALL)
    return spheres, regions, box


def leaves_of(df):
    return {tuple(r) for r in df.select("part", "level", "key").collect()}


def test_trees_settle_from_the_roots(spark, spread):
    spheres, regions, box = spread
    want = leaves_of(essential.focus_trees(spheres, regions, 64, box).where("is_leaf"))
    leaves = regions.select("part", F.lit(0).alias("level"), F.lit(0).cast("long").alias("key"))
    before = None
    for _ in range(15):
        leaves = held(essential.update_focus_trees(leaves, spheres, regions, 64, box))
        if (now := leaves_of(leaves)) == before:
            break
        before = now
    assert now == want
    # a tree that is too deep everywhere is merged to the same one
    whole = spheres.join(spheres.select((F.col("level") - 1).alias("level"), essential.enclosing_box(F.col("key"), F.greatest(F.col("level") - 1, F.lit(0))).alias("key")).where("level >= 0").distinct(), ["level", "key"], "left_anti").select("level", "key")
    leaves = regions.select("part").crossJoin(whole)
    for _ in range(15):
        leaves = held(essential.update_focus_trees(leaves.select("part", "level", "key"), spheres, regions, 64, box))
        if leaves_of(leaves) == want:
            break
    assert leaves_of(leaves) == want


def test_every_tree_is_whole(spread):
    spheres, regions, box = spread
    trees = essential.focus_trees(spheres, regions, 64, box)
    total = spheres.where("level = 0").first()["count"]
    for r in trees.where("is_leaf").groupBy("part").agg(F.sum("count").alias("n"), F.collect_list("level").alias("levels")).collect():
        assert r.n == total and sum(8.0**-v for v in r.levels) == 1
    starts = [r.first for r in regions.orderBy("part").collect()]
    for r in trees.where("is_leaf").groupBy("part").agg(F.collect_set("key").alias("keys")).collect():
        assert set(starts) <= set(r["keys"])
    assert essential.with_quantities(trees, spheres.select("level", "key", F.col("count").alias("whole"))).where("count != whole").isEmpty()


def test_largest_nodes():
    for first, stop in ((0, 8**21), (1, 8**21), (5, 77), (8**20, 8**20 * 3 + 1)):
        nodes = essential.largest_nodes(first, stop)
        at = first
        for level, key in nodes:
            assert key == at and key % 8 ** (21 - level) == 0
            at += 8 ** (21 - level)
        assert at == stop and len(nodes) <= 7 * 21 * 2


def halos_brute(rows, box, parts, leaves, scale=2.0):
    """(part, level, key) of leaves that a part's particles may reach, from leaves {(level, key): (centre, size, part)}."""
    out = set()
    lengths = np.array(box.lengths())
    for (_, own), members in rows.items():
        c, _, part = leaves[own]
        lo = np.minimum((members[:, :3] - scale * members[:, 3:4]).min(0), c)
        hi = np.maximum((members[:, :3] + scale * members[:, 3:4]).max(0), c)
        for node, (g, s, other) in leaves.items():
            d = g - (lo + hi) / 2
            d = np.where(box.periodic, d - lengths * np.rint(d / lengths), d)
            if other != part and (np.abs(d) < (hi - lo) / 2 + s).all():
                out.add((part, *node))
    return out


@pytest.mark.parametrize("curve", ["morton", "hilbert"])
@pytest.mark.parametrize("periodic", [True, False])
def test_sync_follows_its_box(spark, curve, periodic):
    df = clustered(particles(spark, SMALL)).select("pid", *((8 * F.col(c) + 3).alias(c) for c in "xyz"), "h", "vx").where("pid % 3 = 0")
    box = Box((-1.0,) * 3, (7.0,) * 3, (periodic,) * 3)
    out = sync.sync(df, 4, 64, box, scale=8.0, curve=curve)
    own = out.particles.where("NOT is_halo")
    n = df.count()
    assert own.count() == n and own.select("key").distinct().count() >= n - 3
    assert out.box == box if periodic else out.box.low > box.low
    nodes = out.box.node_boxes(sync.domain.find_rank(out.leaves, out.assignment), curve).collect()
    leaves = {(r.level, r.key): (np.array([r.gx, r.gy, r.gz]), np.array([r.sx, r.sy, r.sz]), r.part) for r in nodes}
    rows = {}
    for r in octree.leaf_lookup(out.leaves, own).collect():
        g, s, part = leaves[r.level, r.leaf]
        assert part == r.part and (np.abs(np.array([r.x, r.y, r.z]) - g) <= s * (1 + 1e-9) + 1e-5).all()
        rows.setdefault((r.part, (r.level, r.leaf)), []).append([r.x, r.y, r.z, r.h])
    want = halos_brute({k: np.array(v) for k, v in rows.items()}, out.box, 4, leaves, 8.0)
    got = out.layout.where("is_halo").collect()
    assert {(r.part, r.level, r.key) for r in got} == want and len(got) == len(want) > 0
    held_rows = {(r.part, r.is_halo): r.n for r in out.particles.groupBy("part", "is_halo").agg(F.count(F.lit(1)).alias("n")).collect()}
    ends = {}
    for r in out.layout.orderBy("part", "key").collect():
        assert r.offset == ends.get(r.part, 0)
        ends[r.part] = r.offset + r["count"]
    assert ends == {p: sum(v for (q, _), v in held_rows.items() if q == p) for p, _ in held_rows}


def test_marks_follow_the_mass(spark):
    df = clustered(particles(spark, SMALL)).where("pid % 4 = 0").withColumn("m", F.lit(1.0))
    heavy = df.withColumn("m", F.when(F.col("x") > 0.2, 1000.0).otherwise(1.0))
    even, moved = (sync.sync_grav(d, 4, 64, 0.8, OPEN) for d in (df, heavy))
    assert even.tolerance == moved.tolerance == 1.0
    assert leaves_of(even.marked) != leaves_of(moved.marked)
    assert sync.layout_faults(moved.layout.where("is_halo"), moved.assignment, sync.find_peers(moved.leaves, moved.assignment, 1 / 0.8 + 3**0.5 / 2, moved.box)).isEmpty()
    # trees of the even masses' centres, used after the masses have changed: marks are those of the present centres there
    late = sync.sync_grav(heavy, 4, 64, 0.8, OPEN, centers=even.centers)
    assert late.tolerance >= 1.0
    assert leaves_of(late.marked) <= leaves_of(late.trees)


def test_tolerance_grows_until_trees_suffice(spark, monkeypatch):
    df = clustered(particles(spark, SMALL)).where("pid % 8 = 0").withColumn("m", F.lit(1.0))
    asked = []

    def faults(layout, assignment, peers):
        asked.append(1)
        return layout if len(asked) < 3 else layout.limit(0)

    monkeypatch.setattr(sync, "layout_faults", faults)
    out = sync.sync_grav(df, 4, 64, 0.8, OPEN, step=0.25)
    assert out.tolerance == 1.5 and len(asked) == 3
    asked.append(-1)
    monkeypatch.setattr(sync, "layout_faults", lambda layout, *_: layout)
    with pytest.raises(RuntimeError):
        sync.sync_grav(df, 4, 64, 0.8, OPEN, step=2.0)


def test_shrinking_box(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.3), (0.4, 0.2, 0.9)], "x double, y double, z double")
    unit = Box((0.0,) * 3, (1.0,) * 3, (False, False, True))
    assert unit.around(df, shrink=0.05) == Box((0.05, 0.05, 0.0), (0.95, 0.95, 1.0), (False, False, True))
    tight = unit.around(df, fixed=(False, True, False))
    assert tight.low[:2] == (0.1, 0.0) and tight.high[:2] == (0.4, 1.0)
    assert unit.around(df.limit(0)) == unit
    flat = unit.around(df)
    assert flat.low[1] < 0.2 < flat.high[1]


def test_box_helpers(spark):
    df = spark.createDataFrame([(0.3, 0.3, 0.3, -3, 5)], "x double, y double, z double, i int, j int")
    triple = lambda *v: tuple(F.lit(x) for x in v)
    whole = Box().integer_box(triple(0.0, 0.0, 0.0), triple(0.5, 0.5, 0.5))
    over = Box().integer_box(triple(0.4, 0.0, 0.0), triple(0.25, 0.1, 0.1))
    first, last = F.lit(0).cast("long"), F.lit(8**21 - 1).cast("long")
    r = df.select(Box().contained(whole, first, last).alias("a"), Box().contained(over, first, last).alias("b"), Box().contained(whole, first + 1, last).alias("c"), wrapped(F.col("i"), 8).alias("w"), near_image(F.col("j"), 8).alias("n"), over["xhi"].alias("h")).first()
    assert (r.a, r.b, r.c, r.w, r.n) == (True, False, False, 5, -3) and r.h > 1 << 21


def keys_of(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "pid bigint, key bigint")


def test_tree_is_kept_over_steps(spark):
    r = np.random.default_rng(3)
    values = np.concatenate([r.integers(0, 8**21, 400), 8**20 + r.integers(0, 8**12, 400)])
    before = keys_of(spark, values.tolist())
    state = moving.tree_state(before, 16)
    for change in (lambda v: v[:700], lambda v: np.concatenate([v, 3 * 8**19 + r.integers(0, 8**6, 300)]), lambda v: v[:20], lambda v: np.concatenate([v, [7] * 40])):
        values = change(values)
        after = keys_of(spark, values.tolist())
        changes = held(moving.key_changes(before, after))
        state = moving.update_tree(state, changes, after, 16)
        want = {tuple(x) for x in octree.build_octree(after, 16).select("level", "key", "count").collect()}
        assert {tuple(x) for x in state.where("is_leaf").select("level", "key", "count").collect()} == want
        before = after
    assert moving.key_changes(before, before).isEmpty()


def test_second_field_is_not_shuffled(spark):
    rows = [(k, k % 3, False) for k in range(50)] + [(k, (k + 1) % 3, True) for k in range(0, 50, 2)]
    df = spark.createDataFrame(rows, "pid bigint, part int, is_halo boolean")
    plan = exchange.plan_halos(df, 4)
    names = [exchange.keep_fields(spark.range(50).select(F.col("id").alias("pid"), (F.col("id") * k).alias("v")), plan) for k in (1, 2)]
    for k, name in enumerate(names, 1):
        got = exchange.exchange(spark, plan, name)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert {tuple(x) for x in got.select("pid", "source", "target", "v").collect()} == {(p, p % 3, (p + 1) % 3, p * k) for p in range(0, 50, 2)}
    exchange.drop(spark, plan.table, *names)


def test_smoothing_of_the_particle_table(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber").limit(300).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = particles(spark, str(tmp_path)).orderBy("pid").collect()
    x, h = np.array([[r.x, r.y, r.z] for r in rows]), np.array([r.h for r in rows])
    d = x[:, None] - x[None]
    d2 = ((d - np.rint(d)) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    count = lambda: (d2 < ((2 * h) ** 2)[:, None]).sum(1)
    for _ in range(11):
        n = count()
        h = h * 0.5 * (1 + 1023 * 40 / np.maximum(n, 1)) ** 0.1
        if abs(n - 40).max() <= 4:
            break
    got = {r.pid: r.h for r in queries.smoothing_length_adjust(spark, str(tmp_path)).collect()}
    assert list(got) and sorted(got) == [r.pid for r in rows]
    assert [got[r.pid] for r in rows] == pytest.approx(h.tolist())
    assert abs(count() - 40).max() <= 20


def test_continuum_tree_has_no_holes(spark):
    leaves = octree.continuum_octree(spark, lambda x, y, z: 0 * x + 1e6, bucket=10, rounds=1).collect()
    assert sum(8.0**-r.level for r in leaves) == 1


def test_pairs_of_a_part_with_a_covered_node_go_on_once(spark, monkeypatch):
    leaves = held(octree.uniform_tree(spark, 4).withColumn("count", F.lit(1).cast("long")))
    assignment = held(spark.createDataFrame([(0, 0, 2048), (1, 8**20 * 4, 2048)], "part int, key_lo bigint, count bigint"))
    box = Box(periodic=(False,) * 3)
    searches = held(box.node_boxes(leaves.select("level", "key")).select("level", "key", *(F.col(f"g{c}").alias(f"o{c}") for c in "xyz"), *(F.lit(0.4).alias(f"r{c}") for c in "xyz")))
    sizes, keep = [], sync.held
    monkeypatch.setattr(sync, "held", lambda df: sizes.append((out := keep(df)).count()) or out)
    found = sorted(map(tuple, sync.halo_leaves(leaves, searches, assignment, box).collect()))
    rows = {r.key: (r.gx, r.gy, r.gz) for r in box.node_boxes(leaves.select("level", "key")).collect()}
    reach = 0.4 + 1 / 32
    near = [(0 if k >= 8**20 * 4 else 1, 4, k) for k, (x, _, _) in rows.items() if (x < 0 and x > 1 / 32 - reach) or (x > 0 and x < reach - 1 / 32)]
    assert found == sorted(near)
    assert max(sizes) < 400_000  # boxes and leaves of the other part in reach make 1,157,352 pairs
