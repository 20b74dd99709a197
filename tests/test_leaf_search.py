"""Searches over trees against brute force, on particles that cluster, coincide or have very wide radii."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions.box import Box
from lattica.operators import leaf_search as L
from lattica.operators.neighbors import radius_pairs

SCHEMA = "pid bigint, x double, y double, z double, h double"


def _clump(n=600):
    """A third of the particles in a clump, twenty at one place, ten with a radius far above the others', two with none."""
    rng = np.random.default_rng(5)
    p = rng.uniform(-0.5, 0.5, (n, 3))
    p[: n // 3] = 0.47 + p[: n // 3] * 0.02
    p[n // 3 : n // 3 + 20] = (0.1, -0.2, 0.3)
    h = rng.uniform(0.001, 0.03, n)
    h[:5], h[-5:], h[40], h[41] = 0.1, 0.2, 0.0, np.nan
    return p, h


def _rows(spark, p, h):
    return spark.createDataFrame([(k, *map(float, v), None if np.isnan(r) else float(r)) for k, (v, r) in enumerate(zip(p, h, strict=True))], SCHEMA)


def _brute(p, h, periodic, of=None):
    d = p[:, None] - p[None]
    d -= np.where(periodic, np.rint(d), 0)
    near = (d**2).sum(2) < np.nan_to_num(2 * h)[:, None] ** 2
    np.fill_diagonal(near, False)
    return {(int(i), int(j)) for i, j in zip(*near.nonzero(), strict=True) if of is None or i in of}


@pytest.mark.parametrize("periodic", [(True, True, True), (False, False, False), (True, False, True)])
def test_pairs(spark, periodic):
    p, h = _clump()
    got = [(r.i, r.j) for r in L.leaf_pairs(_rows(spark, p, h), Box(periodic=periodic), bucket=8).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(p, h, np.array(periodic))


def test_pairs_of_some(spark):
    """Also where one leaf has many that ask."""
    p, h = _clump()
    df = _rows(spark, p, h)
    of = set(range(180, 220)) | {599}
    got = L.leaf_pairs(df, queries=df.where(F.col("pid").isin(*of)), bucket=8)
    assert {(r.i, r.j) for r in got.collect()} == _brute(p, h, True, of)


def test_same_as_by_buckets(spark):
    p, h = _clump(300)
    df = _rows(spark, p, h)
    plain = lambda rows: sorted((r.i, r.j, r.d2) for r in rows.collect())
    assert plain(L.leaf_pairs(df)) == plain(radius_pairs(df))


def test_blocks_are_bounded(spark):
    """A place that holds all particles is cut into blocks; none is a task's whole input."""
    df = spark.range(4000).select(F.col("id").alias("pid"), F.lit(1).alias("level"), F.lit(0).alias("leaf"))
    sizes = [len(r.v) for r in L._blocks(df, ["level", "leaf"], ["pid"], "v", 64).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 128


def test_lists_have_only_leaves_that_meet(spark):
    p, h = _clump()
    tree = L.search_tree(_rows(spark, p, h), Box(), 8)
    target = spark.createDataFrame([(7, 0.44, 0.44, 0.44, 0.47, 0.47, 0.47)], "name bigint, t_x0 double, t_y0 double, t_z0 double, t_x1 double, t_y1 double, t_z1 double")
    got = L.interaction_lists(tree, target).collect()
    every = tree.nodes.where("is_leaf").collect()
    want = {(r.level, r.key) for r in every if all(r[f"{c}0"] < 0.47 and r[f"{c}1"] > 0.44 for c in "xyz")}
    assert {(r.level, r.key) for r in got} == want and len(want) < len(every) and {r.name for r in got} == {7}


def test_nothing(spark):
    p, h = _clump(60)
    none = _rows(spark, p, h).limit(0)
    assert L.leaf_pairs(none).count() == 0
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "point bigint, px double, py double, pz double")
    assert L.nearest_point(none, points).count() == 0
    assert L.nearest_point(_rows(spark, p, h), points.limit(0)).count() == 0


def test_left_out(spark):
    """Particles without a place neither find nor are found; further columns with names of the search's own don't matter."""
    rows = [(1, 0.0, 0.0, 0.0, 0.1), (2, 0.01, 0.0, 0.0, 0.1), (3, None, 0.0, 0.0, 0.1), (4, float("nan"), 0.0, 0.0, 0.1), (5, float("inf"), 0.0, 0.0, 0.1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("a") for c in ("level", "leaf", "key", "r", "group", "count")})
    assert {(r.i, r.j) for r in L.leaf_pairs(df).collect()} == {(1, 2), (2, 1)}
    points = spark.createDataFrame([(1, 1.0, 1.0, 1.0)], "point bigint, px double, py double, pz double")
    assert L.nearest_point(df, points).first().pid == 2


@pytest.mark.parametrize("bucket", [1, 8, 1000])
def test_nearest(spark, bucket):
    """Points inside and outside of the box, and where particles coincide."""
    p, h = _clump()
    q = np.vstack([np.random.default_rng(6).uniform(-1, 1, (60, 3)), p[200:203], [[0.1, -0.2, 0.3]]])
    points = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(q)], "point bigint, px double, py double, pz double")
    d2 = ((q[:, None] - p[None]) ** 2).sum(2)
    got = {r.point: (r.pid, r.d2) for r in L.nearest_point(_rows(spark, p, h), points, bucket).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: int(d2[k].argmin()) for k in range(len(q))}
    assert all(abs(v[1] - d2[k].min()) < 1e-12 for k, v in got.items())


def test_nearest_measures_few(spark):
    """From far away, most leaves of a clump are never measured."""
    p, _ = _clump(4000)
    df = _rows(spark, 0.47 + p * 0.02, np.full(4000, 0.1))
    tree = L.search_tree(df, Box(periodic=(False,) * 3).around(df), 8)
    point = spark.createDataFrame([(0, -0.5, -0.5, -0.5)], "point bigint, px double, py double, pz double")
    stayed = L.near_leaves(tree, point).count()
    assert stayed < tree.nodes.where("is_leaf").count() / 10
