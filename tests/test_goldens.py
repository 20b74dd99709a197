"""Known values and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import geometry as G
from lattica.functions import sfc as K
from lattica.operators import domain, mesh, neighbors, octree, spectrum
from lattica.plans.held import held
from lattica.plans.power_spectrum import power_spectrum
from lattica.sources import particles, snapshots


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def lit(v):
    return F.lit(v).cast("long")


def test_fftfreq(spark):
    rows = spark.range(8).select(G.fftfreq(F.col("id"), 8, 1 / 8)).collect()
    assert [r[0] for r in rows] == [0, 1, 2, 3, -4, -3, -2, -1]


def test_cell_centres(spark):
    rows = spark.range(10).select(G.cell_centre(F.col("id"), 10)).collect()
    assert [r[0] for r in rows] == pytest.approx([-0.45 + 0.1 * k for k in range(10)])


def test_morton(spark):
    assert value(spark, K.morton_encode(lit(5 << 18), lit(3 << 18), lit(6 << 18))) == 0b101011110 << 54
    assert tuple(value(spark, K.morton_decode(lit(340)))) == (5, 2, 4)
    assert value(spark, K.morton_encode(*(lit(2**21 - 1),) * 3)) == 2**63 - 1


def test_hilbert_order_and_continuity(spark):
    first = spark.range(8).select(F.expr("id"), K.hilbert_encode(*(F.expr(f"shiftleft(shiftright(id, {s}) & 1, 20)") for s in (2, 1, 0))).alias("h")).collect()
    assert [r.id for r in sorted(first, key=lambda r: r.h)] == [0, 1, 3, 2, 6, 7, 5, 4]
    for bits in (1, 2, 3):
        at = [tuple(r[0]) for r in spark.range(8**bits).select(K.hilbert_decode(F.col("id"), bits)).collect()]
        assert len(set(at)) == 8**bits
        assert all(sum(abs(p - q) for p, q in zip(a, b, strict=True)) == 1 for a, b in zip(at, at[1:], strict=False))
        flat = [tuple(r[0]) for r in spark.range(4**bits).select(K.hilbert2d_decode(F.col("id"), bits)).collect()]
        assert all(sum(abs(p - q) for p, q in zip(a, b, strict=True)) == 1 for a, b in zip(flat, flat[1:], strict=False))


@pytest.mark.parametrize(("a", "b", "n"), [(0, 0o7777, 28), (1, 0o742, 26), (0o41305, 0o46000, 18), (5, 5, 0)])
def test_span(spark, a, b, n):
    bits = {0o7777: 4, 0o742: 4}.get(b, 6)
    rows = K.span_range(spark.createDataFrame([(a, b)], "a bigint, b bigint"), "a", "b", bits).collect()
    assert len(rows) == n
    covered = sorted((r.node, r.node + 8 ** (bits - r.level)) for r in rows)
    assert not covered or covered[0][0] == a and covered[-1][1] == b and all(x[1] == y[0] for x, y in zip(covered, covered[1:], strict=False))


@pytest.mark.parametrize(("key", "place"), [(0, 21), (1, 21), (4, 21), (8, 20), (8**2, 19)])
def test_last_place(spark, key, place):
    assert value(spark, K.last_nonzero_place(lit(key))) == place


def test_key_algebra(spark):
    assert value(spark, K.tree_level(lit(8**20))) == 1 and value(spark, K.tree_level(lit(1))) == 21
    assert [value(spark, K.log8_ceil(lit(n))) for n in (1, 8, 9, 64, 65)] == [0, 1, 2, 2, 3]
    assert [value(spark, K.is_power_of_8(lit(n))) for n in (1, 8, 16, 64)] == [True, True, False, True]
    code = K.to_placeholder(lit(5), F.lit(21))
    assert int(value(spark, code)) == 2**63 + 5 and tuple(value(spark, K.from_placeholder(code))) == (21, 5)
    assert tuple(value(spark, K.smallest_common_box(lit(0o11), lit(0o17)))) == (20, 8)


def test_periodic_distance(spark):
    one, nine = (F.lit(1.0), F.lit(0.0), F.lit(0.0)), (F.lit(9.0), F.lit(0.0), F.lit(0.0))
    assert value(spark, G.dist_sq(one, nine, 10.0, False)) == 64 and value(spark, G.dist_sq(one, nine, 10.0)) == 4
    assert value(spark, G.dist_sq((F.lit(9.0),) * 3, (F.lit(1.0),) * 3, 10.0)) == 12


def test_fft_power_of_iota(spark):
    rows = spark.range(64).select(F.col("id").alias("cell"), F.col("id").cast("double").alias("a"))
    expected = {0: 992.25, 1: 0.5, 3: 0.5, 2: 0.25, 4: 8, 12: 8, 8: 4, 16: 128, 48: 128, 32: 64}
    for method in ("dft", "slab", "pencil"):
        power = {r.cell: r.power for r in spectrum.modal_power(spectrum.fft3(rows, 4, ("a",), method=method), 4, ("a",)).collect()}
        assert power == pytest.approx({k: expected.get(k, 0.0) for k in range(64)}, abs=1e-10)


def test_cell_average(spark):
    df = spark.createDataFrame([(1, -0.5, -0.5, -0.5, 1.0, 2.0, 0.0, 0.1), (2, -0.5, -0.5, -0.5, 3.0, 4.0, 6.0, 0.1)], "pid bigint, x double, y double, z double, vx double, vy double, vz double, h double")
    assert [tuple(r) for r in mesh.raster_cell_avg(df, 4).collect()] == [(0, 2.0, 3.0, 3.0, 2)]
    assert mesh.raster_density(df, 4).first().density == 2 * 64


def test_sparse_bins_merge(spark):
    spec = spark.createDataFrame([(0, 1.0, 1), (1, 2.0, 18), (2, 3.0, 62), (3, 4.0, 98)], "k int, ps double, n bigint")
    rows = {r.k: r.value for r in spectrum.merge_and_normalize(spec, 16, 5, 64).collect()}
    joint = 6 / 81 * 4 * math.pi * (18 * 1 + 62 * 4) / 81
    assert rows == pytest.approx({0: joint, 1: joint, 2: joint, 3: 4 / 98 * 4 * math.pi * 9, 4: 0.0})


def test_octree_invariants(spark):
    keys = particles.random_keys(spark, 20000, gaussian=True)
    for bucket in (16, 64, 1024):
        leaves = octree.build_octree(keys, bucket)
        rows = sorted((r.key, 8 ** (21 - r.level), r["count"]) for r in leaves.collect())
        assert rows[0][0] == 0 and rows[-1][0] + rows[-1][1] == 8**21
        assert all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:], strict=False))
        assert sum(r[2] for r in rows) == 20000 and max(r[2] for r in rows) <= bucket
        ops = octree.node_ops(leaves, bucket)
        assert ops.where("op != 1").isEmpty()


def test_node_ops(spark):
    leaves = octree.children(spark.createDataFrame([(0, 0), (1, 0)], "level int, key bigint")).where("NOT (level = 1 AND key = 0)")
    counts = dict(zip(sorted((r.key for r in leaves.collect())), (1, 1, 1, 0, 0, 0, 0, 0, 2, 3, 4, 5, 6, 7, 8), strict=True))
    table = spark.createDataFrame([(r.level, r.key, counts[r.key]) for r in leaves.collect()], "level int, key bigint, count bigint")
    ops = [r.op for r in octree.node_ops(table, 4).orderBy("key").collect()]
    assert ops == [1, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 8, 8, 8, 8]
    assert octree.apply_node_ops(octree.node_ops(table, 4)).count() == 1 + 3 + 4 * 8


def test_assignment(spark):
    leaves = spark.createDataFrame([(10 * k, 5) for k in range(4)], "key bigint, count bigint")
    assert [tuple(r) for r in domain.sfc_assignment(leaves, 2).orderBy("part").collect()] == [(0, 0, 10), (1, 20, 10)]
    ranges = spark.createDataFrame([(0, 0), (1, 1), (2, 3)], "part int, key_lo bigint")
    found = domain.find_rank(spark.range(4).withColumnRenamed("id", "key"), ranges).orderBy("key").collect()
    assert [r.part for r in found] == [0, 1, 1, 2]


@pytest.mark.parametrize(("h", "n", "periodic"), [(0.062, 400, True), (0.062, 400, False), (1.5, 60, True)])
def test_neighbours_are_all_pairs(spark, h, n, periodic):
    df = particles.uniform_coordinates(spark, n).withColumn("h", F.lit(h) * (1 + F.col("pid") % 3)).cache()
    rows = df.orderBy("pid").collect()
    x = np.array([[r.x, r.y, r.z] for r in rows])
    d = x[:, None] - x[None]
    d -= np.rint(d) if periodic else 0
    near = (d**2).sum(2) < (2 * np.array([r.h for r in rows]))[:, None] ** 2
    np.fill_diagonal(near, False)
    got = {(r.i, r.j) for r in neighbors.radius_pairs(df, periodic).collect()}
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True)}


def test_parseval_and_mass(spark):
    df = particles.uniform_coordinates(spark, 3000).select("*", *(F.randn(k).alias(c) for k, c in enumerate(mesh.VELOCITY)), F.lit(0.03).alias("h"))
    grid = mesh.dense(mesh.raster_cell_avg(df, 8), 8).cache()
    total = spectrum.modal_power(spectrum.fft3(grid, 8), 8).agg(F.sum("power")).first()[0]
    assert total == pytest.approx(grid.agg(F.sum(F.expr("vx*vx + vy*vy + vz*vz"))).first()[0] / 512)
    assert mesh.raster_density(df, 8).agg(F.sum("density")).first()[0] / 512 == pytest.approx(3000)


def test_snapshot_and_command(spark, tmp_path):
    from lattica.cli import main
    from lattica.streaming.steps import spectra_of_steps

    df = particles.particles(spark, "/root/testdata/sf0.001").select("pid", *snapshots.FIELDS)
    path = str(tmp_path / "s")
    for step in (1, 4):
        snapshots.write_step(df, path, step, {"time": ("double", [0.5 * step]), "count": ("int", [7])})
    assert snapshots.read_attribute(spark, path, 4, "count", "double") == [7.0]
    for kind, error in (("char", TypeError), ("int", ValueError)):
        with pytest.raises(error):
            snapshots.read_attribute(spark, path, 4, "count", kind, 2)
    with pytest.raises(KeyError):
        snapshots.read_attribute(spark, path, 4, "none", "int")
    out = str(tmp_path / "spectrum")
    assert main(["--checkpoint", path, "--gridSize", "8", "--interpolation", "cell_avg", "--output", out], spark) == 0
    lines = [r.value.split() for r in spark.read.text(out).collect()]
    want = {r.k: r.value for r in power_spectrum(df, 8, interpolation="cell_avg").collect() if r.k}
    assert {int(k): float(v) for k, v in lines} == pytest.approx(want, rel=1e-5)
    stream = spectra_of_steps(spark, path, str(tmp_path / "out"), str(tmp_path / "cp"), 4)
    stream.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("step").count().count() == 2


def test_partition_range():
    assert [snapshots.partition_range(3, k, 10) for k in range(3)] == [(0, 4), (4, 7), (7, 10)]


def test_kolmogorov_and_plummer(spark):
    ball = particles.plummer_sphere(spark, 500)
    assert ball.agg(F.max(F.abs("x"))).first()[0] < 101
    assert abs(ball.agg(F.avg("x")).first()[0]) < 1e-9
    both = spectrum.overlay({"a": spark.range(5).select(F.col("id").alias("k"), F.lit(1.0).alias("value"))})
    assert both.count() == 3


def test_hilbert2d_walks_once(spark):
    ix, iy = (F.pmod(F.col("id") * m, F.lit(2**21)) for m in (22695477, 69069))
    rows = spark.range(50).select(ix.alias("x"), iy.alias("y"), K.hilbert2d_encode(ix, iy).alias("key")).select("x", "y", "key", K.hilbert2d_decode(F.col("key")).alias("i"))
    assert all((r.x, r.y) == tuple(r.i) for r in rows.collect())
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 2


def test_span_runs(spark):
    ends = [(0, 8**7 - 1), (5, 6), (7, 9), (63, 8**4 + 1), (8**6 - 3, 2 * 8**6 + 70), (9, 9)]
    runs = K.span_runs(spark.createDataFrame(ends, "a bigint, b bigint"), "a", "b", 7).collect()
    for a, b in ends:
        found = []
        for r in (r for r in runs if (r.a, r.b) == (a, b)):
            size = 8 ** (7 - r.level)
            own = [r.left + k * size for k in range(r.n_left)] + [r.right + k * size for k in range(r.n_right)]
            assert len(own) <= 14 and all(r.level == 1 or n // (8 * size) * 8 * size < a or (n // (8 * size) + 1) * 8 * size > b for n in own)
            found += [(n, n + size) for n in own]
        found.sort()
        assert (found == []) if a == b else (found[0][0], found[-1][1]) == (a, b) and all(p[1] == q[0] for p, q in zip(found, found[1:], strict=False))


def test_essential_ops_in_last_corner(spark):
    last = 7 * 8**20
    nodes = spark.createDataFrame([(0, 0, 20, False, False), (1, last, 20, False, False), (2, last + 7 * 8**19, 20, True, False)], "level int, key bigint, count bigint, is_leaf boolean, mac boolean")
    ops = {r.level: r.op for r in domain.essential_ops(nodes, 4, last, 2**63 - 1).collect()}
    assert ops == {0: 1, 1: 1, 2: 8}


def test_merged_leaves(spark):
    leaves = [(2, k * 8**19) for k in range(8)] + [(1, 8**20), (2, 2 * 8**20)]
    out = octree.merged_leaves(spark.createDataFrame([(p, *n) for p, n in enumerate(leaves)], "p int, level int, key bigint"))
    assert sorted(map(tuple, out.collect())) == [(1, 0), (1, 8**20), (2, 2 * 8**20)]


@pytest.mark.parametrize(("periodic", "scale"), [(True, 1.0), (True, 6.0), (False, 1.0), (False, 30.0)])
def test_counts_by_tiles_are_those_of_pairs(spark, monkeypatch, periodic, scale):
    df = particles.particles(spark, "/root/testdata/sf0.001").where("pid % 3 = 0").withColumn("h", F.col("h") * scale)
    df = df.unionByName(df.where("pid % 5 = 0").withColumns({"pid": F.col("pid") + 10**9, "h": F.col("h") / 7})).unionByName(df.where("pid % 7 = 0").withColumns({"pid": F.col("pid") + 2 * 10**9, "h": F.col("h") / 60}))
    monkeypatch.setattr(neighbors, "ASKING_ROWS", 100)
    monkeypatch.setattr(neighbors, "PLACES", 300)
    counts = neighbors.neighbor_counts(df, periodic)
    pairs = neighbors.radius_pairs(df, periodic).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, pairs.collect()))


def test_clustered_containing_goes_below_level_11(spark, tmp_path):
    from lattica.queries import QUERIES

    pids = [1000 + k * 2**21 for k in range(70)]  # all at one place
    spark.createDataFrame([(p // 8, p % 8) for p in pids], "l_orderkey bigint, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = QUERIES["clustered_containing"](spark, str(tmp_path)).collect()
    assert sorted(r.id for r in found) == pids and {r.node_level for r in found} == {21}


@pytest.mark.parametrize(("periodic", "scale", "same"), [(True, 1.0, 1), (False, 1.0, 3), (True, 16.0, 2)])
def test_short_lists_by_tiles_are_those_of_pairs(spark, monkeypatch, periodic, scale, same):
    monkeypatch.setattr(neighbors, "ASKING_ROWS", 50)
    monkeypatch.setattr(neighbors, "PLACES", 60)
    place = {c: (F.floor(F.col("pid") / same) * m % 61 / 61 - 0.5).alias(c) for c, m in (("x", 7), ("y", 11), ("z", 17))}  # ties in distance and, with few keys, in the order
    df = held(spark.range(300).select(F.col("id").alias("pid")).select("pid", *place.values(), ((1 + F.col("pid") % 9) * (0.01 * scale)).alias("h")))
    df = held(df.withColumn("key", F.floor(F.col("x") * 5 + 3).cast("long")))
    pairs = {}
    keys = {r.pid: r.key for r in df.collect()}
    for r in neighbors.radius_pairs(df, periodic).collect():
        pairs.setdefault(r.i, []).append((r.d2, r.j))

    def fail(*_, **__):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(neighbors, "radius_pairs", fail)
    got = {}
    for r in neighbors.nearest_neighbors(df, 4, periodic).collect():
        got.setdefault(r.i, []).append((r["rank"], r.d2, r.j))
    near = {i: sorted(v)[:4] for i, v in pairs.items()}
    assert {i: [j for *_, j in sorted(v)] for i, v in got.items()} == {i: [j for _, j in v] for i, v in near.items()}
    assert all([d for _, d, _ in sorted(got[i])] == [d for d, _ in v] for i, v in near.items())
    capped = {r.i: (r.n, r.listed) for r in neighbors.capped_neighbors(df, 5, periodic).collect()}
    assert capped == {i: (len(v), [j for _, j in sorted((keys[j], j) for _, j in v)[:5]]) for i, v in pairs.items()}
    sums = {r.i: (r.n, r.sum_j, r.farthest) for r in neighbors.sums_by_tiles(df, periodic).collect()}
    assert sums == {i: (len(v), sum(j for _, j in v), max(v)[0]) for i, v in pairs.items()}


def test_octree_counts_the_levels_that_it_needs(spark, monkeypatch):
    keys = held(spark.range(8**6 * 2).select((F.floor(F.col("id") / 2) * 8**15).cast("long").alias("key")))  # two in each node of level 6
    asked, made = [], octree.level_counts
    monkeypatch.setattr(octree, "level_counts", lambda k, above, to: asked.append((above, to)) or made(k, above, to))
    found = octree.build_octree(keys, 2).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("keys")).collect()
    assert [tuple(r) for r in found] == [(6, 8**6, 8**6 * 2)] and asked == [(0, 5), (5, 6)]
    asked.clear()
    same = spark.createDataFrame([(8**20 + 5,)] * 3, "key bigint")
    deep = octree.build_octree(same, 2)
    assert deep.where("count > 0").collect() == [(21, 8**20 + 5, 3)] and deep.count() == 21 * 7 + 1
    assert asked == [(0, 5), (5, 6), (6, 8), (8, 12), (12, 17), (17, 21)]
