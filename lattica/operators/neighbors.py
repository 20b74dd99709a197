"""Radius searches as equi-joins of buckets; counts, sums and short lists of neighbours by tiles, without pairs."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.geometry import dist_sq
from lattica.operators.ordering import with_rank
from lattica.plans.held import held

#: Rows that ask, and places that are asked, of one task's group.
ASKING_ROWS, PLACES = 1 << 18, 1 << 19
#: Distances that a group holds at a time; cells along the width of a class of radii.
DISTANCES, CELLS = 1 << 16, 8
#: Pairs of a row and a place that take as long as the start of a tile.
TILE_WORK = 1 << 18


def radius_pairs(df: DataFrame, periodic: bool = True, low: float = -0.5, high: float = 0.5, queries: DataFrame | None = None) -> DataFrame:
    """(i, j, d2) for every j other than i with distance below 2 h of i; in a periodic or open box.

    Sources fall into size classes by the power of two above 2 h, each with buckets of that width, so that wide
    searches don't widen narrow ones. A source meets the buckets that its search touches, each once even where the
    periodic grid is so coarse that they coincide.
    """
    length = high - low
    sources = (df if queries is None else queries).select(F.col("pid").alias("i"), *(F.col(c).alias(f"{c}i") for c in "xyz"), (2 * F.col("h")).alias("r"))
    rung = F.ceil(F.log2(F.col("r") / length) - 1e-12).cast("int")
    sources = sources.where("r > 0").withColumn("rung", F.least(rung, F.lit(0)))
    rungs = sorted(r.rung for r in sources.select("rung").distinct().collect())  # powers of two that occur
    if not rungs:
        return df.sparkSession.createDataFrame([], "i bigint, j bigint, d2 double")
    wide = F.pow(F.lit(2.0), F.col("rung").cast("double")) * length
    sources = sources.withColumn("cells", F.pow(F.lit(2.0), -F.col("rung").cast("double")).cast("long"))
    # the buckets that the search's cube touches: two to three along an axis
    for b, c in zip("abc", "xyz", strict=True):
        first, last = (F.floor((F.col(f"{c}i") + s * F.col("r") - low) / wide).cast("long") for s in (-1, 1))
        if periodic:
            touched = F.sequence(first, F.least(last, first + F.col("cells") - 1))
            sources = sources.withColumn(b, F.explode(F.transform(touched, lambda v: F.pmod(v, F.col("cells")))))
        else:
            sources = sources.withColumn(b, F.explode(F.sequence(first, last)))
    targets = df.select(F.col("pid").alias("j"), *(F.col(c).alias(f"{c}j") for c in "xyz")).withColumn("rung", F.explode(F.array(*map(F.lit, rungs))))
    for b, c in zip("abc", "xyz", strict=True):
        raw = F.floor((F.col(f"{c}j") - low) / wide).cast("long")
        targets = targets.withColumn(b, F.pmod(raw, F.pow(F.lit(2.0), -F.col("rung").cast("double")).cast("long")) if periodic else raw)
    met = sources.join(targets, ["rung", "a", "b", "c"]).where("i != j")
    d2 = dist_sq(tuple(F.col(f"{c}i") for c in "xyz"), tuple(F.col(f"{c}j") for c in "xyz"), length, periodic)
    return met.withColumn("d2", d2).where("d2 < r * r").select("i", "j", "d2")


def neighbor_counts(df: DataFrame, periodic: bool = True, queries: DataFrame | None = None) -> DataFrame:
    """(i, n) of the particles that have neighbours."""
    if queries is None:
        return counts_by_tiles(df, periodic)
    return radius_pairs(df, periodic, queries=queries).groupBy("i").agg(F.count(F.lit(1)).alias("n"))


def counts_by_tiles(df: DataFrame, periodic: bool = True, low: float = -0.5, high: float = 0.5) -> DataFrame:
    """(i, n): how many others of df (pid, x, y, z, h) lie within 2 h of each, where any do; in a periodic or open box."""

    def count(asking: pa.Table, asked: pa.Table, *space) -> pa.Table:
        return pa.table({"i": asking.column("pid"), "n": _near_counts(*_places(asking), *_places(asked, "m"), *space)})

    met, most = _by_tiles(df, lambda rows: rows.groupBy(*"xyz").agg(F.count(F.lit(1)).alias("m")), count, "i bigint, n bigint", periodic, low, high)
    if most > 1:
        met = met.groupBy("i").agg(F.sum("n").alias("n"))
    return met.select("i", (F.col("n") - 1).alias("n")).where("n > 0")  # but itself


def sums_by_tiles(df: DataFrame, periodic: bool = True, low: float = -0.5, high: float = 0.5) -> DataFrame:
    """(i, n, sum_j, farthest): the counts, with the sum of these others' pids and the squared distance of the farthest of them."""

    def sums(asking: pa.Table, asked: pa.Table, *space) -> pa.Table:
        n, total, far = _near_sums(*_places(asking), *_places(asked, "m", "s"), *space)
        return pa.table({"i": asking.column("pid"), "n": n, "sum_j": total, "farthest": far})

    met, most = _by_tiles(df, lambda rows: rows.groupBy(*"xyz").agg(F.count(F.lit(1)).alias("m"), F.sum("pid").alias("s")), sums, "i bigint, n bigint, sum_j bigint, farthest double", periodic, low, high)
    if most > 1:
        met = met.groupBy("i").agg(F.sum("n").alias("n"), F.sum("sum_j").alias("sum_j"), F.max("farthest").alias("farthest"))
    return met.select("i", (F.col("n") - 1).alias("n"), (F.col("sum_j") - F.col("i")).alias("sum_j"), "farthest").where("n > 0")


def _first_pids(rows: DataFrame, most: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(x, y, z, keys, ids): places with the first `most` pids at each; of more, none can be among the first most - 1 others of a row."""
    order = Window.partitionBy(*"xyz", *keys).orderBy("pid")
    few = rows.select("pid", *"xyz", *keys).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most)
    return few.groupBy(*"xyz", *keys).agg(F.sort_array(F.collect_list("pid")).alias("ids"))


def _listed(met: DataFrame, dealt: int, most: int, *sums: str) -> DataFrame:
    """Rows of groups put together: the sums, and the first `most` of the lists."""
    if dealt < 2:
        return met
    lists = F.slice(F.sort_array(F.flatten(F.collect_list("listed"))), 1, most)  # of as many lists as groups
    return met.groupBy("i").agg(*(F.sum(c).alias(c) for c in sums), lists.alias("listed"))


def nearest_by_tiles(df: DataFrame, most: int, periodic: bool = True, low: float = -0.5, high: float = 0.5) -> DataFrame:
    """(i, listed): structs (d2, j) of up to `most` nearest others within 2 h of each row of df (pid, x, y, z, h), by distance and j.

    Tasks look at the cells around a place first, and at wider ones only where too few are found, so that the work
    follows the rows and not the pairs in reach.
    """

    def nearest(asking: pa.Table, asked: pa.Table, *space) -> pa.Table:
        pid = asking.column("pid").to_numpy()
        lists = _nearest(pid, *_places(asking), _places(asked)[0], *_ids(asked, most + 1), most, *space)
        return pa.table({"i": pid, "listed": _as_lists(*lists, ("d2", "j"))})

    met, dealt = _by_tiles(df, lambda rows: _first_pids(rows, most + 1), nearest, "i bigint, listed array<struct<d2: double, j: bigint>>", periodic, low, high)
    return _listed(met, dealt, most)


def first_by_tiles(df: DataFrame, most: int, periodic: bool = True, low: float = -0.5, high: float = 0.5) -> DataFrame:
    """(i, n, listed): the counts of others within 2 h of each row of df (pid, key, x, y, z, h), with structs (key, j) of the first `most` of them in that order."""

    def first(asking: pa.Table, asked: pa.Table, *space) -> pa.Table:
        pid = asking.column("pid").to_numpy()
        n, *lists = _near_first(pid, *_places(asking), *_places(asked, "m", "key"), *_ids(asked, most + 1), most, *space)
        return pa.table({"i": pid, "n": n, "listed": _as_lists(*lists, ("key", "j"))})

    def places(rows: DataFrame) -> DataFrame:
        ids = _first_pids(rows, most + 1, ("key",))
        return rows.groupBy(*"xyz", "key").agg(F.count(F.lit(1)).alias("m")).join(ids, [*"xyz", "key"])

    met, dealt = _by_tiles(df, places, first, "i bigint, n bigint, listed array<struct<key: bigint, j: bigint>>", periodic, low, high)
    return _listed(met, dealt, most, "n").withColumn("n", F.col("n") - 1).where("n > 0")


def _by_tiles(df: DataFrame, gather: Callable[[DataFrame], DataFrame], task: Callable[..., pa.Table], schema: str, periodic: bool, low: float, high: float) -> tuple[DataFrame, int]:
    """The rows of task, of which those of one pid are to be put together if the number beside them is above 1.

    Rows that ask lie in tiles, twice as wide as the widest radius of their class (classes by powers of eight). Places where
    particles are (x, y, z and what gather adds) go to the tiles that such radii reach; tasks measure what is near, each
    place's distances once for all rows at a place. Tiles with more rows or places than a task may hold are dealt in groups.
    """
    df = held(df.select("pid", *"xyz", "h", *(["key"] if "key" in df.columns else [])))
    asks = df.select("pid", *"xyz", (2 * F.col("h")).alias("r")).where("r > 0")
    return _meet(asks, held(gather(df)), task, schema, periodic, low, high)


def _meet(asks: DataFrame, places: DataFrame, task: Callable[..., pa.Table], schema: str, periodic: bool, low: float, high: float, least: int | None = None) -> tuple[DataFrame, int]:
    """_by_tiles() of rows that ask (pid, x, y, z, r, ...) and places (x, y, z, ...), which are both held; no class is narrower than 2 ** least."""
    length, rows = high - low, asks.columns
    asks = asks.withColumn("rung", _rung(length, periodic))
    if least is not None:
        asks = asks.withColumn("rung", F.greatest("rung", F.lit(least)))
    rungs = sorted(r.rung for r in asks.select("rung").distinct().collect())
    if not rungs:
        return asks.sparkSession.createDataFrame([], schema), 1
    tile = F.pow(F.lit(2.0), F.col("rung").cast("double")) * (2 * length)
    tiles = F.greatest(F.floor(F.lit(length) / tile), F.lit(1)).cast("long")
    index = lambda c, s: F.floor((F.col(c) + s * tile * (0.5 + 1e-9) - low) / tile).cast("long")
    around = (lambda v: F.pmod(v, tiles)) if periodic else (lambda v: v)
    asks = asks.select("*", *(around(index(c, 0)).alias(t) for c, t in zip("xyz", "abc", strict=True)))
    known = places.columns
    places = places.withColumn("rung", F.explode(F.array(*map(F.lit, rungs))))
    for c, t in zip("xyz", "abc", strict=True):
        places = places.withColumn(t, F.explode(F.array_distinct(F.transform(F.sequence(index(c, -1), index(c, 1)), around))))
    at = ["rung", "a", "b", "c"]
    groups = lambda rows, most, name: rows.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / most).alias(name))
    sizes = held(groups(asks, ASKING_ROWS, "asking").join(groups(places, PLACES, "asked"), at))
    n, most, units = sizes.agg(F.count(F.lit(1)), F.max("asked"), F.sum(F.col("asking") * F.col("asked"))).first()
    side = F.broadcast(sizes) if n <= 1 << 18 else sizes
    dealt, every = (lambda c: F.pmod(F.xxhash64(*"xyz"), F.col(c))), (lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)))
    key = [*at, "u", "v"]
    parts = max(int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4 * (units or 1), 2048))
    left = asks.join(side, at).withColumn("u", dealt("asking")).withColumn("v", every("asked")).select(*key, *rows).repartition(parts, *key)
    right = places.join(side, at).withColumn("v", dealt("asked")).withColumn("u", every("asking")).select(*key, *known).repartition(parts, *key)

    def run(own: tuple, asking: pa.Table, asked: pa.Table) -> pa.Table:
        return task(asking, asked, 2.0 ** own[0].as_py() * length, length if periodic else None)

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema), most or 1


def _rung(length: float, periodic: bool) -> Column:
    """The class of a radius r: the power of two, and of eight, of its widest one."""
    rung = F.ceil(F.log2(F.col("r") / length) / 3 - 1e-12).cast("int") * 3
    return F.least(rung, F.lit(0)) if periodic else rung


def _least_rung(asks: DataFrame, places: DataFrame, periodic: bool, low: float, high: float) -> int | None:
    """The narrowest class whose tiles are worth a task's start; rows of narrower ones are as well off in it."""
    asks, length = asks.withColumn("rung", _rung(high - low, periodic)), high - low
    rungs = sorted(r.rung for r in asks.select("rung").distinct().collect())
    least = rungs[0] if rungs else None
    while least is not None and least < rungs[-1]:
        at = [F.floor((F.col(c) - low) / (2.0**least * 2 * length)).alias(t) for c, t in zip("xyz", "abc", strict=True)]
        count = lambda rows, name, at=at: rows.groupBy(*at).agg(F.count(F.lit(1)).alias(name))
        met = count(asks.where(F.col("rung") <= least), "n").join(count(places, "m"), [*"abc"])
        tiles, work = met.agg(F.count(F.lit(1)), F.sum(F.col("n").cast("double") * F.col("m"))).first()
        if (work or 0) > TILE_WORK * tiles:
            break
        least += 3
    return least


def _places(table: pa.Table, *more: str) -> tuple[np.ndarray, ...]:
    """The coordinates, and further columns; of rows that ask, the radii."""
    more = more or (("r",) if "r" in table.column_names else ())
    return (np.stack([table.column(c).to_numpy() for c in "xyz"]), *(table.column(c).to_numpy() for c in more))


def _ids(table: pa.Table, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists `ids` as rows of a matrix, and how many each has."""
    lists = table.column("ids").combine_chunks()
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ids = np.zeros((len(n), most), np.int64)
    ids[np.arange(most) < n[:, None]] = lists.flatten().to_numpy()
    return ids, n


def _as_lists(n: np.ndarray, first: np.ndarray, second: np.ndarray, names: tuple[str, str]) -> pa.Array:
    """Lists of structs from two matrices, of which row k has n[k] values."""
    fits = np.arange(first.shape[1]) < n[:, None]
    values = pa.StructArray.from_arrays([pa.array(first[fits]), pa.array(second[fits])], names=list(names))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), values)


def _visit(p: np.ndarray, r: np.ndarray, q: np.ndarray, wide: float, length: float | None, start: Callable, order: np.ndarray | None = None) -> None:
    """For each place of p, with its rows in the order of their radii r: start(which q are candidates)(rows, squared distances of these).

    No r is above wide (or all q are candidates, in a box of less than eight times wide); length is that of a periodic box.
    Candidates of a cell of places are the same ones, in the order of `order`.
    """
    if not len(r) or not q.shape[1]:
        return
    cell = wide / CELLS
    kept = np.arange(q.shape[1])
    if length is None or 8 * wide <= length:
        near, kept, starts, size, own, own_flat = _cells(p, q, wide, length)
        wraps = length is not None and bool((near != q).any())
    else:
        wraps, own, own_flat, starts = length is not None, None, np.zeros(len(r), np.int64), None
    ranked = np.lexsort((r, p[2], p[1], p[0], own_flat))
    bounds = np.flatnonzero(np.diff(own_flat[ranked], prepend=-1))
    for first, last in zip(bounds, [*bounds[1:], len(ranked)], strict=True):
        rows = ranked[first:last]
        which = kept
        if starts is not None:
            i, j, k = own[:, rows[0]]
            reach = int(np.ceil(r[rows].max() / cell * (1 + 1e-9)))
            di, dj = (v.ravel() for v in np.meshgrid(np.arange(-reach, reach + 1), np.arange(-reach, reach + 1), indexing="ij"))
            rest = (r[rows].max() / cell * (1 + 1e-9)) ** 2 - np.maximum(np.abs(di) - 1, 0) ** 2 - np.maximum(np.abs(dj) - 1, 0) ** 2
            ok = (rest > 0) & (i + di >= 0) & (i + di < size[0]) & (j + dj >= 0) & (j + dj < size[1])
            dk = np.ceil(np.sqrt(rest[ok])).astype(np.int64)
            base = ((i + di[ok]) * size[1] + j + dj[ok]) * size[2]
            which = kept[_runs(starts[base + np.maximum(k - dk, 0)], starts[base + np.minimum(k + dk, size[2] - 1) + 1])[0]]
        if order is not None:
            which = which[np.argsort(order[which], kind="stable")]
        cand, take = q[:, which], start(which)
        new = np.ones(len(rows), bool)
        new[1:] = (p[:, rows[1:]] != p[:, rows[:-1]]).any(0)
        heads = np.append(np.flatnonzero(new), len(rows))
        step = max(1, DISTANCES // max(1, cand.shape[1]))
        for s in range(0, len(heads) - 1, step):
            some = heads[s : min(s + step, len(heads) - 1) + 1]
            d2 = 0.0
            for axis in range(3):
                d = p[axis, rows[some[:-1]]][:, None] - cand[axis][None, :]
                if wraps:
                    d -= length * np.rint(d / length)
                d *= d
                d2 = d2 + d
            for n, (a, b) in enumerate(zip(some[:-1], some[1:], strict=True)):
                take(rows[a:b], d2[n])


def _cells(p: np.ndarray, q: np.ndarray, wide: float, length: float | None) -> tuple[np.ndarray, ...]:
    """Cells of wide / CELLS around the places p: where q lies seen from there, which of q are in reach by their cells, the start of each
    cell among these, how many cells there are along the axes, and the cells of p."""
    cell, middle = wide / CELLS, (p.min(1) + p.max(1))[:, None] / 2
    near = q if length is None else q - length * np.rint((q - middle) / length)
    corner = p.min(1)[:, None] - wide - 2 * cell
    size = (np.floor((p.max(1)[:, None] - corner) / cell).astype(np.int64) + CELLS + 3).ravel()
    at = np.floor((near - corner) / cell).astype(np.int64)
    kept = np.flatnonzero(((at >= 0) & (at < size[:, None])).all(0))
    at = at[:, kept]
    flat = (at[0] * size[1] + at[1]) * size[2] + at[2]
    ordered = np.argsort(flat, kind="stable")
    own = np.floor((p - corner) / cell).astype(np.int64)
    return near, kept[ordered], np.searchsorted(flat[ordered], np.arange(size.prod() + 1)), size, own, (own[0] * size[1] + own[1]) * size[2] + own[2]


def _runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of a[k] .. b[k] - 1, one run after the other, and their lengths."""
    n = np.maximum(b - a, 0)
    return np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()), n


def _counting(r: np.ndarray, weight: np.ndarray, out: np.ndarray) -> Callable:
    def start(which: np.ndarray) -> Callable:
        w = weight[which]

        def take(rows: np.ndarray, d2: np.ndarray) -> None:
            r2 = r[rows] * r[rows]  # in order
            if len(rows) < 4:
                out[rows] = [(d2 < v) @ w for v in r2]
            else:
                inside = d2 < r2[-1]
                out[rows] = np.cumsum(np.bincount(np.searchsorted(r2, d2[inside], "right"), w[inside], len(rows) + 1))[: len(rows)]

        return take

    return start


def _near_counts(p: np.ndarray, r: np.ndarray, q: np.ndarray, m: np.ndarray, wide: float, length: float | None) -> np.ndarray:
    """How many of the m particles at places q lie within r of each p."""
    out = np.zeros(len(r), np.int64)
    _visit(p, r, q, wide, length, _counting(r, m.astype(np.float64), out))
    return out


def _near_sums(p: np.ndarray, r: np.ndarray, q: np.ndarray, m: np.ndarray, s: np.ndarray, wide: float, length: float | None) -> tuple[np.ndarray, ...]:
    """How many of the m particles at places q lie within r of each p, the sum of their s, and the largest squared distance."""
    n, total, far = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64), np.zeros(len(r))

    def start(which: np.ndarray) -> Callable:
        w, v = m[which].astype(np.int64), s[which].astype(np.int64)

        def take(rows: np.ndarray, d2: np.ndarray) -> None:
            r2 = r[rows] * r[rows]  # in order
            inside = np.flatnonzero(d2 < r2[-1])
            inside = inside[np.argsort(d2[inside])]
            d = d2[inside]
            end = np.searchsorted(d, r2)  # how many are nearer
            some = end > 0
            mine, last = rows[some], end[some] - 1
            n[mine], total[mine], far[mine] = np.cumsum(w[inside])[last], np.cumsum(v[inside])[last], d[last]

        return take

    _visit(p, r, q, wide, length, start)
    return n, total, far


def _near_first(pid: np.ndarray, p: np.ndarray, r: np.ndarray, q: np.ndarray, m: np.ndarray, key: np.ndarray, ids: np.ndarray, many: np.ndarray, most: int, wide: float, length: float | None) -> tuple[np.ndarray, ...]:
    """The counts of _near_counts(), and the first `most` others (number, keys, pids) within r in the order of key and pid."""
    n, met = np.zeros(len(r), np.int64), np.full((len(r), most + 1), -1, np.int64)
    counting, tied = _counting(r, m.astype(np.float64), n), {}

    def start(which: np.ndarray) -> Callable:
        count, keys = counting(which), key[which]
        ties = bool((keys[1:] == keys[:-1]).any())

        def take(rows: np.ndarray, d2: np.ndarray) -> None:
            count(rows, d2)
            r2 = r[rows] * r[rows]
            near = np.flatnonzero(d2 < r2[-1])
            d = d2[near]
            for row, v in zip(rows, r2, strict=True):
                look = 64
                found = np.flatnonzero(d[:look] < v)
                while len(found) <= most and look < len(d):
                    look *= 4
                    found = np.flatnonzero(d[:look] < v)
                hits = near[found[: most + 1]]
                met[row, : len(hits)] = which[hits]  # each has a pid, and one of them may be the row's own
                if ties and len(hits):
                    tied[row] = which[near[(keys[near] <= keys[hits[-1]]) & (d < v)]]  # of places with one key pids decide

        return take

    _visit(p, r, q, wide, length, start, key)
    number, keys, pids = np.zeros(len(r), np.int64), np.zeros((len(r), most), np.int64), np.zeros((len(r), most), np.int64)
    for first in range(0, len(r), 1 << 14):
        rows = np.arange(first, min(first + (1 << 14), len(r)))
        at = met[rows]
        fits = (at >= 0)[:, :, None] & (np.arange(most + 1) < many[at][:, :, None]) & (ids[at] != pid[rows][:, None, None])
        fits, js, ks = (v.reshape(len(rows), -1) for v in (fits, ids[at], np.broadcast_to(key[at][:, :, None], fits.shape)))
        _fill(number, rows, fits, most, (keys, ks), (pids, js))
    for row, at in tied.items():
        all_of = sorted((int(key[k]), int(j)) for k in at for j in ids[k, : many[k]] if j != pid[row])[:most]
        keys[row, : len(all_of)], pids[row, : len(all_of)] = zip(*all_of, strict=True) if all_of else ((), ())
        number[row] = len(all_of)
    return n, number, keys, pids


def _fill(number: np.ndarray, rows: np.ndarray, fits: np.ndarray, most: int, *filled: tuple[np.ndarray, np.ndarray]) -> None:
    """The first `most` values that fit of each row, put at the beginning of the rows of matrices."""
    place = np.cumsum(fits, 1) - 1
    fits = fits & (place < most)
    number[rows] = fits.sum(1)
    at, _ = np.nonzero(fits)
    for out, values in filled:
        out[rows[at], place[fits]] = values[fits]


def _nearest(pid: np.ndarray, p: np.ndarray, r: np.ndarray, q: np.ndarray, ids: np.ndarray, many: np.ndarray, most: int, wide: float, length: float | None) -> tuple[np.ndarray, ...]:
    """The `most` nearest others (number, squared distances, pids) of each p within r, by distance and pid, of the pids at places q."""
    number, d2s, pids = np.zeros(len(r), np.int64), np.zeros((len(r), most)), np.zeros((len(r), most), np.int64)
    if not len(r) or not q.shape[1]:
        return number, d2s, pids
    ranked = np.lexsort((p[2], p[1], p[0]))
    new = np.append(True, (p[:, ranked[1:]] != p[:, ranked[:-1]]).any(0))
    of = np.empty(len(r), np.int64)
    of[ranked] = np.cumsum(new) - 1
    own, widest = p[:, ranked[new]], np.maximum.reduceat(r[ranked], np.flatnonzero(new))
    best_n, best_d, best_j = np.zeros(own.shape[1], np.int64), np.zeros((own.shape[1], most + 1)), np.zeros((own.shape[1], most + 1), np.int64)
    all_met = length is not None and 8 * wide > length
    middle = (own.min(1) + own.max(1))[:, None] / 2
    near = q if length is None or all_met else q - length * np.rint((q - middle) / length)  # where it lies seen from here
    wraps = length is not None and (all_met or bool((near != q).any()))
    low = np.minimum(near.min(1), own.min(1))[:, None]
    span = np.maximum(near.max(1), own.max(1)) - low.ravel()
    reach = max(float(np.prod(span) * (most + 2) / near.shape[1]) ** (1 / 3), float(span.max()) / (1 << 19), wide / (1 << 19))
    todo = np.arange(own.shape[1])
    while len(todo):
        reach = wide if all_met else min(reach, wide)
        if all_met:
            order, a, b = np.arange(q.shape[1]), np.zeros((len(todo), 1), np.int64), np.full((len(todo), 1), q.shape[1])
        else:
            cell = reach * (1 + 1e-9)
            size = np.floor(span / cell).astype(np.int64) + 3  # a cell more on each side
            code = lambda at: (at[0] * size[1] + at[1]) * size[2] + at[2]
            flat = code(np.floor((near - low) / cell).astype(np.int64) + 1)
            order = np.argsort(flat, kind="stable")
            flat = flat[order]
            here = code(np.floor((own[:, todo] - low) / cell).astype(np.int64) + 1)
            columns = (np.arange(-1, 2)[:, None] * size[1] + np.arange(-1, 2)).ravel() * size[2]
            a, b = (np.searchsorted(flat, here[:, None] + columns + s, side) for s, side in ((-1, "left"), (1, "right")))
        total, late, first = np.cumsum((b - a).sum(1)), [], 0
        while first < len(todo):
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + 16 * DISTANCES, "right")))
            mine = todo[first:last]
            index, n = _runs(a[first:last].ravel(), b[first:last].ravel())
            who, cand = np.repeat(np.arange(len(mine)), n.reshape(len(mine), -1).sum(1)), order[index]
            d2 = 0.0
            for axis in range(3):
                d = own[axis, mine][who] - q[axis, cand]
                if wraps:
                    d -= length * np.rint(d / length)
                d2 = d2 + d * d
            seen = d2 < (widest[mine] * widest[mine])[who] if reach >= wide else d2 <= reach * reach
            who, cand, d2 = who[seen], cand[seen], d2[seen]
            done = np.bincount(who, many[cand], len(mine)) > most
            done |= widest[mine] <= reach
            late.append(mine[~done])
            some = done[who]
            who, cand, d2 = who[some], cand[some], d2[some]
            sort = np.lexsort((d2, who))
            who, cand, d2 = who[sort], cand[sort], d2[sort]
            begin = np.searchsorted(who, np.arange(len(mine) + 1))
            if len(who):  # no place beyond the distance of the one that is certain to fill the list
                bound = d2[np.minimum(begin[:-1] + most, np.maximum(begin[1:] - 1, 0))]
                some = d2 <= bound[who]
                who, cand, d2 = who[some], cand[some], d2[some]
            times = many[cand]
            js = ids[np.repeat(cand, times), _runs(np.zeros(len(times), np.int64), times)[0]]
            who, d2 = np.repeat(who, times), np.repeat(d2, times)
            sort = np.lexsort((js, d2, who))
            who, d2, js = who[sort], d2[sort], js[sort]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            some = rank <= most
            who, d2, js, rank = who[some], d2[some], js[some], rank[some]
            best_d[mine[who], rank], best_j[mine[who], rank] = d2, js
            best_n += np.bincount(mine[who], minlength=len(best_n))
            first = last
        todo, reach = np.concatenate(late), reach * 2
    for first in range(0, len(r), 1 << 16):
        rows = np.arange(first, min(first + (1 << 16), len(r)))
        at = of[rows]
        fits = (np.arange(most + 1) < best_n[at][:, None]) & (best_j[at] != pid[rows][:, None]) & (best_d[at] < (r[rows] * r[rows])[:, None])
        _fill(number, rows, fits, most, (d2s, best_d[at]), (pids, best_j[at]))
    return number, d2s, pids


def _lengths(p: np.ndarray, r: np.ndarray, done: np.ndarray, q: np.ndarray, m: np.ndarray, target: int, rounds: int, wide: float, length: float | None) -> tuple[np.ndarray, ...]:
    """How many rounds each row goes on here, after `done` ones, with the others that it counts and its radius after each.

    Squared distances of a place are worked out once, for its widest radius, from cells in the order of their distance. As a radius shrinks,
    the next count is one of the distances that the last one left; those of few neighbours go on together, as sorted
    lists. A row ends here where its radius outgrows what was looked at; it goes on one round at least.
    """
    many, ns, rs = np.zeros(len(r), np.int64), np.zeros((len(r), rounds), np.int64), np.zeros((len(r), rounds))
    if not len(r):
        return many, ns, rs
    few, all_met, cell = 4 * max(target, 1) + 2, length is not None and 8 * wide > length, wide / CELLS
    changed = lambda v, n: v * (0.5 * (1 + 1023.0 * target / n) ** 0.1)
    if all_met:
        near, kept, own_flat = q, np.arange(q.shape[1]), np.zeros(len(r), np.int64)
    else:
        near, kept, starts, size, _, own_flat = _cells(p, q, wide, length)
        d = np.arange(-CELLS - 1, CELLS + 2)
        gap = np.maximum(np.abs(d) - 1, 0) ** 2
        gap = (gap[:, None, None] + gap[:, None] + gap).ravel()
        steps = ((d[:, None, None] * size[1] + d[:, None]) * size[2] + d).ravel()[np.argsort(gap, kind="stable")]
        nearer = np.append(0, np.cumsum(np.bincount(gap))).tolist()  # how many cells lie nearer than the root of so many
    places = [np.ascontiguousarray(near[axis, kept]) for axis in range(3)]
    weight = m[kept].astype(np.float64) if len(m) and m.max() > 1 else None
    within = lambda v: nearer[min(math.ceil((v / cell * (1 + 1e-9)) ** 2), CELLS * CELLS + 1)]
    # rows of one place and radius are one
    ranked = np.lexsort((-r, p[2], p[1], p[0], own_flat))
    place = np.append(True, (p[:, ranked[1:]] != p[:, ranked[:-1]]).any(0))
    alike = np.append(True, place[1:] | (r[ranked[1:]] != r[ranked[:-1]]) | (done[ranked[1:]] != done[ranked[:-1]]))
    rows, place = ranked[alike], place[alike]
    heads = np.append(np.flatnonzero(place), len(rows))
    where = own_flat[rows[heads[:-1]]]
    cells = np.append(np.flatnonzero(np.diff(where, prepend=-1)), len(where))
    lists, slots = np.full((min(1 << 13, len(rows)), few), np.inf), []  # of a slot: row, radius and squared reach

    def settle() -> None:
        row, v, reach = (np.array(c) for c in zip(*slots, strict=True)) if slots else (np.zeros(0, np.int64),) * 3
        on = np.arange(len(row))
        while len(on := on[(v[on] * v[on] <= reach[on]) & (done[row[on]] + many[row[on]] < rounds)]):
            n = np.maximum((lists[on] < (v[on] * v[on])[:, None]).sum(1) - 1, 0)
            v[on] = changed(v[on], np.maximum(n, 1))
            ns[row[on], many[row[on]]], rs[row[on], many[row[on]]] = n, v[on]
            many[row[on]] += 1
        lists[: len(row)] = np.inf
        slots.clear()

    def listed(row: int, v: float, reach: float, d2: np.ndarray, w: np.ndarray | None) -> None:
        if len(d2) > few:
            order = np.argsort(d2)[: few + 1]
            d2, w = d2[order], None if w is None else w[order]
        if w is not None:
            d2 = np.repeat(d2, np.minimum(w, few + 1).astype(np.int64))
        if len(d2) > few:
            d2 = np.sort(d2)[: few + 1]
            reach = d2[few]
        lists[len(slots), : min(len(d2), few)] = d2[:few]
        slots.append((row, v, reach))
        if len(slots) == len(lists):
            settle()

    def look(flat: int, v: float) -> tuple[list[np.ndarray], np.ndarray | None, Callable]:
        """The places near a cell, their weights, and how many of them may lie within a radius."""
        if all_met:
            return places, weight, lambda v: len(places[0])
        base = flat + steps[: within(v)]
        index, n = _runs(starts[base], starts[base + 1])
        ends = np.append(0, np.cumsum(n))
        return [c[index] for c in places], None if weight is None else weight[index], lambda v: ends[within(v)]

    def distances(at: np.ndarray, cand: list[np.ndarray], buffer: np.ndarray, k: int) -> np.ndarray:
        total, d = buffer[0, :k], buffer[1, :k]
        for axis in range(3):
            out = d if axis else total
            np.subtract(at[axis], cand[axis][:k], out=out)
            if all_met:
                out -= length * np.rint(out / length)
            np.multiply(out, out, out=out)
            if axis:
                total += d
        return total

    for a, b in zip(cells[:-1], cells[1:], strict=True):
        (cand, w, reached), sparse = look(where[a], r[rows[heads[a] : heads[b]]].max()), []
        buffer = np.empty((2, len(cand[0])))
        for first, last in zip(heads[a:b], heads[a + 1 : b + 1], strict=True):
            d2 = distances(p[:, rows[first]], cand, buffer, reached(r[rows[first]]))
            for row in rows[first:last].tolist():
                v, k, left = float(r[row]), 0, rounds - int(done[row])
                while True:
                    end = reached(v)
                    inside = d2[:end] < v * v
                    n = (np.count_nonzero(inside) if w is None else int(w[:end] @ inside)) - 1
                    if n < few:
                        break
                    v = changed(v, n)
                    ns[row, k], rs[row, k] = n, v
                    k += 1
                    if k == left:
                        break
                many[row] = k
                if not k and n <= 2 * target:
                    sparse.append((row, v, np.inf if all_met else max(v, min(wide, 1.25 * v * (max(target, 1) / max(n, 1)) ** (1 / 3)))))
                elif k < left:
                    listed(row, v, v * v, d2[:end][inside], None if w is None else w[:end][inside])
        if sparse:
            cand, w, reached = look(where[a], max(v for _, _, v in sparse))
            buffer = np.empty((2, len(cand[0])))
            for row, v, wider in sparse:
                d2 = distances(p[:, row], cand, buffer, end := reached(wider))
                inside = d2 < wider * wider
                listed(row, v, wider * wider, d2[inside], None if w is None else w[:end][inside])
    settle()
    one = np.cumsum(alike) - 1
    of = np.empty(len(r), np.int64)
    of[ranked] = rows[one]
    return many[of], ns[of], rs[of]


def nearest_neighbors(df: DataFrame, most: int, periodic: bool = True, queries: DataFrame | None = None) -> DataFrame:
    """(i, j, d2, rank) of up to `most` nearest of each particle's neighbours, by distance and j."""
    if queries is None:
        rows = nearest_by_tiles(df, most, periodic).select("i", F.posexplode("listed").alias("rank", "l"))
        return rows.select("i", "l.j", "l.d2", (F.col("rank") + 1).alias("rank"))
    order = Window.partitionBy("i").orderBy("d2", "j")
    return radius_pairs(df, periodic, queries=queries).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def capped_neighbors(df: DataFrame, most: int, periodic: bool = True) -> DataFrame:
    """(i, n, listed): how many neighbours each particle (key, ...) has, and the first `most` of them in the order of the curve."""
    return first_by_tiles(df, most, periodic).select("i", "n", F.col("listed.j").alias("listed"))


def adjust_smoothing(df: DataFrame, target: int = 100, rounds: int = 11, periodic: bool = True) -> DataFrame:
    """df with h changed until particles have about `target` neighbours: h * ((1 + 1023 target / n) / 2 ** 10) ** (1/10) halved steps.

    A row's rounds depend on the places around it alone, so a task goes through all of them; rows whose radii outgrow a task's
    places go on in a further pass, and places of too many for a task are counted one round at a time. Whether a round was the last one is known afterwards.
    """
    if rounds < 1:
        return df
    columns = df.columns
    df = held(df.withColumn("__row", F.monotonically_increasing_id()))
    fits = [F.col(c).isNotNull() & (F.abs(c) < float("inf")) for c in "xyz"]
    placed = df.where(fits[0] & fits[1] & fits[2])
    places = held(placed.groupBy(*"xyz").agg(F.count(F.lit(1)).alias("m")))
    asks = placed.select(F.col("__row").alias("pid"), *"xyz", (2 * F.col("h")).alias("r"), F.lit(0).alias("done")).where("r > 0 AND NOT isnan(r)")
    idle, found = df.count() - asks.count(), None
    while True:
        steps = _smoothing_rounds(asks, places, target, rounds, periodic)
        found = steps if found is None else found.unionByName(steps)
        asks = steps.where(F.col("done") + F.size("rs") < rounds)
        if asks.isEmpty():
            break
        asks = held(asks.select("pid", *"xyz", F.element_at("rs", -1).alias("r"), (F.col("done") + F.size("rs")).alias("done")))
    worst = found.select("done", F.posexplode("ns").alias("k", "n")).groupBy((F.col("done") + F.col("k")).alias("k")).agg(F.max(F.abs(F.col("n") - target)).alias("worst"))
    worst, last = {r.k: r.worst for r in worst.collect()}, rounds - 1
    for k in reversed(range(rounds)):
        if max(worst.get(k, 0), target if idle else 0) <= max(1, target // 10):
            last = k
    ended = found.where((F.col("done") <= last) & (F.col("done") + F.size("rs") > last)).select(F.col("pid").alias("__row"), (F.get("rs", last - F.col("done")) / 2).alias("__h"))
    alone = F.col("h")
    for _ in range(last + 1):
        alone = alone * (0.5 * (1 + 1023.0 * target) ** 0.1)
    return df.join(ended, "__row", "left").withColumn("h", F.coalesce("__h", alone)).select(*columns)


def _smoothing_rounds(asks: DataFrame, places: DataFrame, target: int, rounds: int, periodic: bool) -> DataFrame:
    """asks (pid, x, y, z, r, done) with ns, the others counted in this round and further ones, and rs, the radii after each."""

    def follow(asking: pa.Table, asked: pa.Table, *space) -> pa.Table:
        done = asking.column("done").to_numpy()
        many, ns, rs = _lengths(*_places(asking), done, *_places(asked, "m"), target, rounds, *space)
        ends, fits = pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), np.arange(rounds) < many[:, None]
        lists = {k: pa.ListArray.from_arrays(ends, pa.array(v[fits])) for k, v in (("ns", ns), ("rs", rs))}
        return pa.table({**{c: asking.column(c) for c in ("pid", *"xyz", "done")}, **lists})

    def count(asking: pa.Table, asked: pa.Table, *space) -> pa.Table:
        n = _near_counts(*_places(asking), *_places(asked, "m"), *space)
        return pa.table({**{c: asking.column(c) for c in ("pid", *"xyz", "r", "done")}, "n": n})

    least = _least_rung(asks, places, periodic, -0.5, 0.5)
    met, dealt = _meet(asks, places, follow, "pid bigint, x double, y double, z double, done int, ns array<bigint>, rs array<double>", periodic, -0.5, 0.5, least)
    if dealt < 2:
        return held(met)
    met, _ = _meet(asks, places, count, "pid bigint, x double, y double, z double, r double, done int, n bigint", periodic, -0.5, 0.5)
    met = met.groupBy("pid", *"xyz", "r", "done").agg(F.greatest(F.sum("n") - 1, F.lit(0)).alias("n"))
    after = F.col("r") * (0.5 * F.pow(1 + 1023.0 * target / F.greatest(F.col("n"), F.lit(1)), F.lit(0.1)))
    return held(met.select("pid", *"xyz", "done", F.array("n").alias("ns"), F.array(after).alias("rs")))


def fixed_groups(df: DataFrame, size: int, order: str = "key") -> DataFrame:
    """df with group: runs of `size` rows in order. Ranks come from counts of key ranges first, so no task orders all rows."""
    ranked = with_rank(df, order)
    return ranked.withColumn("group", F.floor(F.col("rank") / size)).drop("rank")


def group_splits(df: DataFrame, size: int, tolerance: float, volume: float) -> DataFrame:
    """df (key, x, y, z, h) with group and part: runs of `size` in key order, divided where neighbours are further apart
    than the smaller of tolerance times the edge of the smallest leaf and 2 h."""
    own = Window.partitionBy("group").orderBy("key", "pid")
    rows = fixed_groups(df, size)
    gap = sum(((F.lead(c).over(own) - F.col(c)) * (F.lead(c).over(own) - F.col(c)) for c in "yz"), (F.lead("x").over(own) - F.col("x")) * (F.lead("x").over(own) - F.col("x")))
    limit = F.least(F.lit((tolerance * volume ** (1 / 3)) ** 2), (2 * F.col("h")) * (2 * F.col("h")))
    split = rows.withColumn("__s", F.coalesce((gap > limit).cast("int"), F.lit(0)))
    part = F.coalesce(F.sum("__s").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return split.withColumn("part", part).drop("__s")
