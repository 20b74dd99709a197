"""Steps whose work must not grow faster than their input."""

import numpy as np
from pyspark.sql import functions as F

from lattica.functions.box import Box
from lattica.functions.sfc import BITS, node_box
from lattica.operators import essential, exchange, mesh, moving, octree, sync
from lattica.sources.particles import clustered, particles

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def sph_brute(rows, grid):
    """cell -> (w, sums) of rows (x, y, z, h, vx, vy, vz), in [-0.5, 0.5)."""
    out, width, mid = {}, 1 / grid, (np.arange(grid) + 0.5) / grid - 0.5
    for r in rows:
        if None in (r.x, r.y, r.z):
            continue
        h = min(r.h, width) if r.h is not None else width
        d = np.sqrt(((r.x - mid) ** 2)[:, None, None] + ((r.y - mid) ** 2)[None, :, None] + ((r.z - mid) ** 2)[None, None, :])
        for i, j, k in zip(*np.nonzero(d < 2 * h), strict=True):
            q = d[i, j, k] / h
            w = (1 - 1.5 * q**2 + 0.75 * q**3 if q < 1 else 0.25 * (2 - q) ** 3) / np.pi / h**3
            sums = out.setdefault(int(i + grid * j + grid * grid * k), [0.0, {}])
            sums[0] += w
            for c in ("vx", "vy", "vz"):
                if r[c] is not None:
                    sums[1][c] = sums[1].get(c, 0.0) + w * r[c]
    return out


def test_sph_makes_no_rows_of_particles_and_cells(spark):
    rows = [(0.49, -0.5, 0.1, 0.2, 1.0, 2.0, 3.0), (0.0, 0.0, 0.0, None, 1.0, None, 5.0), (None, 0.0, 0.0, 0.1, 1.0, 1.0, 1.0), (-0.3, 0.2, 0.31, 0.05, None, 4.0, -1.0), (3.0, 0.0, 0.0, 0.1, 9.0, 9.0, 9.0), (0.01, 0.02, 0.0, 0.0, 7.0, 7.0, 7.0)]
    rng = np.random.default_rng(1)
    rows += [tuple(map(float, (*rng.uniform(-0.5, 0.5, 3), rng.uniform(0.01, 0.2), *rng.normal(size=3)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "x double, y double, z double, h double, vx double, vy double, vz double")
    for part in (df, df.limit(6)):
        got, want = mesh.raster_sph(part, 8), sph_brute(part.collect(), 8)
        assert "Generate" not in plan_of(got)
        got = {r.cell: r for r in got.collect()}
        assert got.keys() == want.keys()
        for cell, (w, sums) in want.items():
            assert np.isclose(got[cell].w, w)
            for c in ("vx", "vy", "vz"):
                assert (c not in sums) == (got[cell][c] is None)
                assert got[cell][c] is None or np.isclose(got[cell][c], sums[c] / w, atol=1e-9)
    assert mesh.raster_sph(df.where(F.lit(False)), 8).count() == 0


def peers_brute(rows, ellipse):
    """Pairs of parts with near leaves, of rows (part, x0, y0, z0, edge) of lattice boxes in a periodic box."""
    out, n = set(), 1 << BITS
    for a in rows:
        for b in rows:
            if a.part == b.part or (a.part, b.part) in out:
                continue
            d = []
            for c in "xyz":
                p, q = a[f"{c}0"], b[f"{c}0"]
                apart = [v - n * round(v / n) for v in (q + b.edge - p, q - p - a.edge)]
                d.append(0 if q < p + a.edge and p < q + b.edge else min(map(abs, apart)))
            if sum((g / w) ** 2 for g, w in zip(d, ellipse, strict=True)) <= max(a.edge, b.edge) ** 2:
                out.add((a.part, b.part))
    return out


def test_peers_that_touch_are_found_above_the_leaves(spark, monkeypatch):
    df = particles(spark, SMALL)
    _, leaves, assignment = sync._distributed(df, 12, 64, Box(), "morton")
    boxes = sync.domain.find_rank(leaves, assignment).withColumn("b", node_box(F.col("level"), F.col("key"), "morton"))
    rows = boxes.select("part", *(F.col(f"b.{c}0").alias(f"{c}0") for c in "xyz"), F.col("b.edge").alias("edge")).collect()
    got = {tuple(r) for r in sync.find_peers(leaves, assignment, 1.0, Box()).collect()}
    assert got == peers_brute(rows, ((1 + 1e-6),) * 3)
    # two halves: the leaves at their surfaces make 9,216 pairs
    leaves = sync.held(octree.uniform_tree(spark, 4))
    halves = spark.createDataFrame([(0, 0), (1, 8**20 * 4)], "part int, key_lo bigint")
    seen, held = [], sync.held

    def counted(table):
        kept = held(table)
        if "a_n_part" in kept.columns:
            seen.append(kept.count())
        return kept

    monkeypatch.setattr(sync, "held", counted)
    assert {tuple(r) for r in sync.find_peers(leaves, halves, 1.0, Box()).collect()} == {(0, 1), (1, 0)}
    assert 0 < max(seen) < 200


def test_boxes_are_asked_of_nodes_outside_alone(spark):
    box = Box(periodic=(False,) * 3)
    df = clustered(particles(spark, SMALL))
    _, leaves, assignment = sync._distributed(df, 4, 64, box, "morton")
    spheres = essential.min_mac_spheres(octree.upsweep(leaves, lambda: [F.sum("count").alias("count")]), box, 1.0)
    regions = essential.part_regions(assignment, box)
    rows = spheres.select("level", "key").crossJoin(regions.select("part")).select("part", "level", "key")
    placed = essential._placed(rows, spheres, regions, box)
    assert placed.where("near AND NOT inside").count() > 0 and placed.where("inside").count() > 0
    assert placed.where("near AND inside").isEmpty()
    assert placed.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_key_changes_without_a_join(spark):
    schema = "pid long, key long"
    before = spark.createDataFrame([(1, 5), (2, 5), (3, 9), (4, None), (5, 7)], schema)
    after = spark.createDataFrame([(1, 5), (2, 9), (3, 5), (4, 8), (6, 7), (7, 6), (5, None)], schema)
    got = moving.key_changes(before, after)
    assert "Join" not in plan_of(got)
    assert sorted(map(tuple, got.collect())) == [(6, 1), (8, 1)]


def test_halos_go_down_by_few_boxes(spark, monkeypatch):
    # two halves of a periodic box, 4,096 leaves with a search box each; sizes differ, so that some boxes reach further than their neighbours
    box, leaves = Box(), sync.held(octree.uniform_tree(spark, 4).withColumn("count", F.lit(1).cast("long")))
    halves = spark.createDataFrame([(0, 0), (1, 8**20 * 4)], "part int, key_lo bigint")
    placed = sync.held(box.node_boxes(leaves.select("level", "key")))
    wide = F.col("sx") + 0.13 + F.pmod(F.hash("key"), F.lit(5)) * 0.03
    searches = sync.held(placed.select("level", "key", *(F.col(f"g{c}").alias(f"o{c}") for c in "xyz"), *((wide if c == "x" else wide / 2).alias(f"r{c}") for c in "xyz")))
    rows = sorted(map(tuple, searches.join(placed, ["level", "key"]).select("key", "ox", "oy", "oz", "rx", "ry", "rz", "sx").collect()))
    at = np.array([r[1:] for r in rows])
    want = set()
    for part in (0, 1):
        own = np.array([r[0] >= 8**20 * 4 for r in rows]) == bool(part)
        for r, g in zip(np.array(rows, dtype=object)[~own], at[~own], strict=True):
            d = g[:3] - at[own, :3]
            if (np.abs(d - np.rint(d)) < at[own, 3:6] + g[6]).all(1).any():
                want.add((part, 4, r[0]))
    seen, held = [], sync.held

    def counted(table):
        kept = held(table)
        if {"part", "ox"} <= set(kept.columns):
            seen.append(kept.where("level = 4").count())
        return kept

    monkeypatch.setattr(sync, "held", counted)
    got = [tuple(r) for r in sync.halo_leaves(leaves, searches, halves, box).collect()]
    assert len(got) == len(want) > 2000 and set(got) == want
    assert 0 < max(seen) < 10_000


def test_search_boxes_look_up_cells(spark, monkeypatch):
    df, asked, lookup = particles(spark, SMALL), [], octree.leaf_lookup
    keyed, leaves, _ = sync._distributed(df, 4, 64, Box(), "morton")

    def counted(leaves, keys, *more):
        asked.append(keys.count())
        return lookup(leaves, keys, *more)

    monkeypatch.setattr(octree, "leaf_lookup", counted)
    got = {tuple(r) for r in sync.search_boxes(keyed, leaves, Box()).collect()}
    assert 0 < asked[0] <= keyed.count() / 4
    assert got == {tuple(r) for r in sync.search_boxes(keyed, leaves.drop("count"), Box()).collect()} and asked[1] == keyed.count()


def test_parts_are_looked_up_by_leaf(spark, monkeypatch):
    df = clustered(particles(spark, SMALL)).select("pid", "x", "y", "z", "h")
    df = df.unionByName(df.limit(1).select(F.lit(-5).cast("long").alias("pid"), *(F.lit(None).cast("double").alias(c) for c in "xyz"), "h"))
    keyed, leaves, assignment = sync._distributed(df, 4, 64, Box(), "morton")
    keyed = keyed.withColumn("key", F.when(F.col("pid") >= 0, F.col("key")))  # a row without a place
    halos = sync.held(sync.halo_leaves(leaves, sync.search_boxes(keyed, leaves, Box()), assignment, Box()))
    own = {r.pid: r.part for r in sync.domain.find_rank(keyed, assignment).collect()}
    wanted = {}
    for r in halos.collect():
        wanted.setdefault((r.level, r.key), set()).add(r.part)
    want = {(p, own[p], False, own[p]) for p in own}
    for r in octree.leaf_lookup(leaves, keyed).collect():
        want |= {(r.pid, q, True, own[r.pid]) for q in wanted.get((r.level, r.leaf), ())}
    asked, rank = [], sync.domain.find_rank
    monkeypatch.setattr(sync.domain, "find_rank", lambda keys, a: asked.append(set(keys.columns)) or rank(keys, a))
    for most in (octree.BROADCAST_ROWS, 10):
        monkeypatch.setattr(octree, "BROADCAST_ROWS", most)
        out = sync.with_halos(keyed, leaves, assignment, halos)
        got = [tuple(r) for r in out.select("pid", "part", "is_halo", "owner").collect()]
        assert len(got) == len(want) and set(got) == want and (-5, -1, False, -1) in want
    assert not any("pid" in columns for columns in asked)


def test_periodic_boxes_read_no_rows():
    assert Box().around(None) == Box()


def test_plans_of_owned_rows_need_no_join(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 0, False, 0), (1, 2, True, 0), (2, 1, False, 1), (2, 0, True, 1), (2, 3, True, 1)], "pid long, part int, is_halo boolean, owner int")
    kept = []
    monkeypatch.setattr(exchange, "_kept", lambda df, *_: kept.append(df) or "plan")
    exchange.plan_halos(rows)
    exchange.plan_halos(rows.drop("owner"))
    assert "Join" not in plan_of(kept[0])
    assert {tuple(r) for r in kept[0].collect()} == {tuple(r) for r in kept[1].collect()} == {(1, 0, 2), (2, 1, 0), (2, 1, 3)}


def test_gravity_keeps_its_particles_once(spark, monkeypatch):
    df, kept, asked = particles(spark, SMALL).withColumn("m", F.col("h") * 1024), [], []
    held, lookup = sync.held, octree.leaf_lookup
    monkeypatch.setattr(sync, "held", lambda table: kept.append({"key", "m", "x"} <= set(table.columns) and "h" in table.columns) or held(table))
    monkeypatch.setattr(octree, "leaf_lookup", lambda leaves, keys, *more: asked.append(keys.count()) or lookup(leaves, keys, *more))
    out = sync.sync_grav(df, 4, 64, 0.8, Box())
    assert sum(kept) == 1
    assert asked[0] <= df.count() / 4 and asked[1] <= df.count() / 4  # cells, for search boxes and for mass centres
    keyed = out.particles.where("NOT is_halo").select("key", "x", "y", "z", "m")
    assert {tuple(r) for r in out.centers.collect()} == {tuple(r) for r in octree.node_mass_centers(keyed, out.leaves.drop("count")).collect()}


def test_tolerance_grows_where_there_are_particles(spark, monkeypatch):
    df, asked = clustered(particles(spark, SMALL)).where("pid % 8 = 1").withColumn("m", F.lit(1.0)), []
    assert not df.isEmpty()  # line numbers begin at 1, so no pid is a multiple of 8
    monkeypatch.setattr(sync, "layout_faults", lambda layout, *_: asked.append(1) or (layout if len(asked) < 3 else layout.limit(0)))
    out = sync.sync_grav(df, 4, 64, 0.8, Box(periodic=(False,) * 3), step=0.25)
    assert out.tolerance == 1.5 and len(asked) == 3
