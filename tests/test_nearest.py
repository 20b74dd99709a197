"""The nearest particle, for points that go to the particles."""

import numpy as np
import pyarrow as pa
import pytest

from lattica.operators import leaf_search as L


def _rows(spark, p, pids=None):
    rows = [(k if pids is None else pids[k], *map(float, v)) for k, v in enumerate(p)]
    return spark.createDataFrame(rows, "pid bigint, x double, y double, z double")


def _points(spark, q):
    return spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(q)], "point bigint, px double, py double, pz double")


def test_particles_are_not_kept(spark, monkeypatch):
    def kept(_):
        raise AssertionError("particles are kept")

    monkeypatch.setattr(L, "held", kept)
    rng = np.random.default_rng(1)
    p, q = rng.normal(0.3, 0.02, (3000, 3)), rng.uniform(-1, 1, (40, 3))
    got = L.nearest_point(_rows(spark, p), _points(spark, q))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1  # of a task's nearest rows; every particle went to a shuffle before
    want = ((q[:, None] - p) ** 2).sum(2)
    assert {r.point: r.pid for r in got.collect()} == dict(enumerate(want.argmin(1).tolist()))


def test_more_points_go_down_the_tree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df, points = _rows(spark, rng.uniform(-0.5, 0.5, (500, 3))), _points(spark, rng.uniform(-1, 1, (30, 3)))
    few = sorted(map(tuple, L.nearest_point(df, points).collect()))
    monkeypatch.setattr(L, "FEW_POINTS", 29)
    assert sorted(map(tuple, L.nearest_point(df, points).collect())) == few


@pytest.mark.parametrize("rows", [7, 64, 1 << 17])
def test_equals_and_pieces(monkeypatch, rows):
    monkeypatch.setattr(L, "SCAN_ROWS", rows)
    rng = np.random.default_rng(3)
    p = rng.integers(-2, 3, (600, 3)) / 4.0
    pids = rng.permutation(600).tolist()
    q = rng.integers(-4, 5, (50, 3)) / 4.0
    batches = [pa.record_batch([pa.array(pids[k : k + 20]), *(pa.array(np.ascontiguousarray(p[k : k + 20, a])) for a in range(3))], names=["pid", *"xyz"]) for k in range(0, 600, 20)]
    (got,) = L._nearest_rows([(k, *v) for k, v in enumerate(q.tolist())])(iter(batches))
    d2 = ((q[:, None] - p) ** 2).sum(2)
    assert got.column("pid").to_pylist() == [min(pids[k] for k in np.flatnonzero(row == row.min())) for row in d2]
    assert got.column("d2").to_pylist() == d2.min(1).tolist()


def test_rows_without_a_pid_come_first(spark):
    df = _rows(spark, [(0.1, 0, 0), (0.1, 0, 0), (0.5, 0, 0)], [4, None, 2])
    assert [tuple(r) for r in L.nearest_point(df, _points(spark, [(0, 0, 0), (1, 0, 0)])).orderBy("point").collect()] == [(0, None, pytest.approx(0.01)), (1, 2, 0.25)]
