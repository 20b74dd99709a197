"""Vector codes and near duplicates among embeddings against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import embedding_dedup, vector_codes
from lattica.llm.common import attached

NAN, INF = float("nan"), float("inf")


def codes_brute(rows, parts=16, entries=64):
    kept = [(i, label, e) for i, label, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    length = len(kept[0][2]) if kept else 0
    kept = [r for r in kept if len(r[2]) == length and length and length % parts == 0]
    x = np.array([[int(np.clip(np.floor(256 * v), -(1 << 27), 1 << 27)) for v in r[2]] for r in kept], object).reshape(len(kept), parts, -1 if kept else 1)
    books = [[list(v) for v in x[:entries, p]] for p in range(parts)]

    def assign(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        for p in range(parts):
            met = {}
            for v in x[:, p]:
                met.setdefault(assign(p, v)[1], []).append(v)
            for k, own in met.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [[assign(p, v[p]) for p in range(parts)] for v in x]
    error = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, label, _), e in zip(kept, error, strict=True):
        total[label] = total.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted([(r[0], "".join(f"{k:02x}" for _, k in f), e, total[r[1]], sha) for r, f, e in zip(kept, found, error, strict=True)], key=str)


def vectors(size, n=150):
    r = np.random.default_rng(4)
    rows = [(k, int(k % 3), r.normal(size=size).round(2).tolist()) for k in range(n)]
    rows += [(n + k, None, rows[k % 5][2]) for k in range(20)]  # equal vectors: ties
    rows += [(1000, 1, None), (1001, 1, []), (1002, 1, [NAN] * size), (1003, 1, [None] + [0.0] * (size - 1)), (1004, 1, [INF] * size), (1005, 1, [1.0] * (size + 1))]
    return rows + [(None, 1, [1e300] * size), (None, 2, [0.0] * size), (3, 1, rows[3][2]), (3, 1, [-0.004] * size)]


def coded(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").withColumns({c: F.lit("odd") for c in ("same", "code", "error", "n")})
    monkeypatch.setattr(vector_codes, "read", lambda *_: df.repartition(3))
    return sorted((tuple(r) for r in vector_codes.op11_vector_codes(spark, "").collect()), key=str)


@pytest.mark.parametrize("rows", [vectors(16), vectors(32, 40), [(1, 1, [0.5] * 17)], []], ids=["16", "few", "uneven", "empty"])
def test_codes(spark, monkeypatch, rows):
    assert coded(spark, rows, monkeypatch) == codes_brute(rows)


def test_annuli(monkeypatch):
    r = np.random.default_rng(5)
    monkeypatch.setattr(vector_codes, "EVALUATED", 100)
    for width, spread in ((1, 5), (4, 20), (8, 1 << 26)):
        entries, parts = r.integers(-spread, spread, (64, width)), r.integers(-spread, spread, (500, width))
        d = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        index, distance = vector_codes.Annuli(entries).nearest(parts)
        assert (index == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


def test_decoded_vectors_have_the_error(spark):
    rows = [(k, 0, v) for k, v in enumerate(np.random.default_rng(6).normal(size=(200, 16)).tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    books = vector_codes.train(df)
    got = vector_codes.encode(df, books).orderBy("vec_id").collect()
    x = np.floor(256 * np.array([r[2] for r in rows])).astype(np.int64)
    assert ((x - vector_codes.decode([r.code for r in got], books)) ** 2).sum(axis=1).tolist() == [r.error for r in got]


def test_attached(spark, monkeypatch):
    from lattica.llm import common

    rows = spark.range(1000).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for keys, least in ((2048, 4096), (10, 50)):
        monkeypatch.setattr(common, "HOT_KEYS", keys)
        monkeypatch.setattr(common, "HOT_ROWS", least)
        got = attached(rows, table, "k", "n").collect()
        assert len(got) == 1000 and sum(r.n for r in got) == 600 * 600 + 400


def links_brute(rows, threshold=0.93):
    unit = []
    for _, label, e in rows:
        ok = label is not None and e is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e)
        v = np.array(e) / np.abs(e).max() if ok else None
        unit.append(v / np.linalg.norm(v) if ok else None)
    near = [[] for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][1] == rows[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                near[a].append(b)
                near[b].append(a)
    out = []
    for a, row in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[s][0] for s in seen if rows[s][0] is not None]
        component = min(ids, default=None)
        out.append((row[0], len(near[a]), component, row[0] == component))
    return sorted(out, key=str)


def near_rows(size=12):
    """Scattered vectors, a dense cluster, a chain of links, and odd ones."""
    r = np.random.default_rng(1)
    rows = [(k, k % 3, (r.normal(size=size) * np.array([5, 3] + [1] * (size - 2))).tolist()) for k in range(200)]
    c = r.normal(size=size)
    rows += [(1000 + k, 1, (c + r.normal(size=size) * r.choice([0.02, 0.2, 0.35])).tolist()) for k in range(200)]
    turn = lambda a: [float(np.cos(a)), float(np.sin(a))] + [0.0] * (size - 2)
    rows += [(3000 - k, 4, turn(0.3 * k)) for k in range(15)]
    odd = [(2000, 1, None), (2001, None, c.tolist()), (2002, 1, []), (2003, 1, [0.0] * size), (2004, 1, [NAN] * size), (2005, 1, [None] + [1.0] * (size - 1)), (2010, 1, [INF] * size)]
    return rows + odd + [(None, 1, c.tolist()), (None, 1, c.tolist()), (1000, 1, c.tolist()), (2006, 1, [1.0]), (2007, 1, [2.0]), (2008, 1, [1.0, 1.0]), (2009, 1, (c * 1e200).tolist()), (None, 7, [1.0] * size)]


@pytest.mark.parametrize("tile", [512, 24])
def test_links(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rows = near_rows()
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").withColumns({c: F.lit("odd") for c in ("key", "grp", "x", "n", "id", "tile", "label_")})
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(df.repartition(5)).collect()), key=str)
    assert got == links_brute(rows)
    assert any(r[1] > 100 for r in got)


def test_no_links(spark):
    df = spark.createDataFrame([(1, None, [1.0]), (2, 1, None)], "vec_id bigint, label int, embedding array<double>")
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_bounds_lose_no_pair():
    r = np.random.default_rng(7)
    for spread in (0.05, 0.3, 3.0):
        a, b = (r.normal(size=24) + r.normal(size=(300, 24)) * spread for _ in range(2))
        b[:20] = a[:20] * 2
        a, b = (m / np.linalg.norm(m, axis=1)[:, None] for m in (a, b))
        axes = np.linalg.qr(r.normal(size=(24, 24)))[0]
        i, j = embedding_dedup.linked_pairs(a, b, a @ axes, b @ axes, 0.93)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(a @ b.T >= 0.93)), strict=True))
