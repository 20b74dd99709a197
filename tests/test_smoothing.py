"""Smoothing lengths of all rounds at once, against all pairs."""

import numpy as np
import pytest

from lattica.operators import neighbors


def _made(spark, x, h, pids=None):
    rows = [(int(i) if pids is None else pids[i], *map(float, p), float(v)) for i, (p, v) in enumerate(zip(x, h, strict=True))]
    return spark.createDataFrame(rows, "pid bigint, x double, y double, z double, h double").repartition(3)


def _adjusted(x, h, target, rounds, periodic):
    d = x[:, None] - x[None]
    d2 = ((d - np.rint(d) if periodic else d) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    for _ in range(rounds):
        n = (d2 < ((2 * h) ** 2)[:, None]).sum(1)
        h = h * 0.5 * (1 + 1023 * target / np.maximum(n, 1)) ** 0.1
        if abs(n - target).max() <= max(1, target // 10):
            break
    return h


@pytest.mark.parametrize(("periodic", "target", "places"), [(True, 40, 1 << 19), (False, 5, 1 << 19), (True, 8, 100)])
def test_lengths_of_mixed_radii(spark, monkeypatch, periodic, target, places):
    monkeypatch.setattr(neighbors, "PLACES", places)  # places of a tile that come in groups are counted round by round
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.uniform(-0.5, 0.5, (300, 3)), rng.normal(0.3, 0.01, (200, 3)), np.repeat(rng.uniform(-0.5, 0.5, (5, 3)), 20, 0)])
    h = rng.choice([1 / 1024, 8 / 1024, 0.03, 0.06], len(x))
    got = {r.pid: r.h for r in neighbors.adjust_smoothing(_made(spark, x, h), target, 6, periodic).collect()}
    assert [got[k] for k in range(len(x))] == pytest.approx(_adjusted(x, h, target, 6, periodic).tolist())


def test_the_last_round_is_the_first_that_suffices(spark):
    x = np.stack(np.meshgrid(*(np.arange(8) / 8 - 0.5,) * 3), -1).reshape(-1, 3)
    h = np.full(len(x), 0.12)
    got = [r.h for r in neighbors.adjust_smoothing(_made(spark, x, h), 26, 11).collect()]
    assert len(got) == 512 and got == pytest.approx(_adjusted(x, h, 26, 11, True).tolist())
    assert len({round(v, 9) for v in got}) == 1


def test_rows_of_one_pid_and_without_a_place_stay_rows(spark):
    x, h = np.random.default_rng(3).uniform(-0.5, 0.5, (60, 3)), np.full(60, 0.05)
    lone = spark.createDataFrame([(99, None, None, None, 0.5), (98, 0.1, 0.1, 0.1, None), (97, 0.1, 0.1, 0.1, 0.0)], "pid bigint, x double, y double, z double, h double")
    got = neighbors.adjust_smoothing(_made(spark, x, h, [k // 2 for k in range(60)]).unionByName(lone), 10, 3).collect()
    assert sorted(r.pid for r in got) == sorted([*(k // 2 for k in range(60)), 97, 98, 99])  # each round used to double rows of one pid
    own = {r.pid: r.h for r in got}
    assert own[98] is None and own[97] == 0 and own[99] == pytest.approx(0.5 * (0.5 * (1 + 10230) ** 0.1) ** 3)


def test_rounds_are_one_pass(spark, monkeypatch):
    rng, kept, keep = np.random.default_rng(5), [], neighbors.held
    monkeypatch.setattr(neighbors, "held", lambda df: kept.append(1) or keep(df))
    df = _made(spark, rng.uniform(-0.5, 0.5, (800, 3)), rng.uniform(0.08, 0.12, 800))
    assert neighbors.adjust_smoothing(df, 5).count() == 800
    assert len(kept) <= 12  # four tables a round before
