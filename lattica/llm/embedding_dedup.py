"""Near duplicates among embeddings by PCA-ordered tiled comparison.

Equal vectors of one label are a class, compared once. Unit vectors are turned to the axes of their second moments,
largest first, so that leading components carry most of a product. They are sorted by label and their cell in a grid of
the first CELL_AXES axes, whose edge is the distance of vectors that are just alike enough, and cut into tiles of at most TILE
vectors. Linked vectors lie in the same cell or in adjacent ones, so only tiles of such cells meet, and of these only
tiles whose boxes on the leading axes, and whose balls, are near enough. Of two tiles the leading components' products
come first; a pair goes on while product + (norm of either rest) * (norm of the other) can reach the threshold. Where
the balls of two tiles lie so close together that every pair must be linked, none is compared. Pairs within 1e-9 of
the threshold are decided by the cosine of the vectors as they came, in double precision.

A task puts out counts, and one edge for each vector at most (a spanning forest of the pair of tiles); no pairs leave it.
The driver holds the axes (MOST_AXES squared numbers at most). Work is that of the tiles that the bounds leave: for
vectors without any structure within a label that is all its pairs of tiles, on leading components only.

Defined results: a vector that is null, zero, empty or holds a null or a component that isn't finite links with nothing,
and so does one without label; so do vectors of different lengths. Such rows have n_links 0 and their own vec_id as
component_id. Rows of one vec_id, or none, count each: n_links counts rows. component_id is the smallest vec_id that
isn't null, null if there is none; kept says whether it is the row's vec_id. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import Tables, attached, read, written
from lattica.llm.components import components

THRESHOLD = 0.93
TILE = 512
#: Axes of the grid, and of the boxes around tiles.
CELL_AXES, BOX_AXES = 2, 16
#: Longer vectors aren't turned.
MOST_AXES = 1024
#: Pairs whose further components are taken up at a time.
PAIRS = 1 << 16
_DOUBT = 1e-9


def _keyed(df: DataFrame) -> DataFrame:
    """vec_id, grp (label and length), key and x (the vector as doubles) of each row of df; the latter null for a vector that links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            sizes = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(sizes)
            group, key, x = [], [], []
            for label, size, end in zip(batch.column(1).to_pylist(), sizes.tolist(), ends.tolist(), strict=True):
                own = values[end - size : end]
                with np.errstate(over="ignore"):
                    square = own @ own if size else 0.0
                if label is None or not 1e-200 < square < 1e200:  # also where it is no number
                    whole = label is not None and size and np.isfinite(own).all() and own.any()
                    own = own / np.abs(own).max() if whole else None
                group.append(None if label is None or own is None else f"{size}:{label}")
                x.append(None if group[-1] is None else own.tobytes())
                key.append(None if group[-1] is None else hashlib.blake2b(f"{group[-1]} ".encode() + x[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(group, pa.string()), pa.array(key, pa.binary()), pa.array(x, pa.binary())], ["vec_id", "grp", "key", "x"])

    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    return rows.mapInArrow(run, "vec_id bigint, grp string, key binary, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of one length."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def principal_axes(classes: DataFrame) -> np.ndarray:
    """The axes of the second moments of the unit vectors in classes (x), all of one length, as columns, largest first."""
    block = 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                unit = _matrix(batch.column(0))
                total = unit.T @ unit if total is None else total + unit.T @ unit
        if total is not None:
            wide = np.pad(total, ((0, 0), (0, -len(total) % block)))
            i, b = np.divmod(np.arange(len(total) * (wide.shape[1] // block)), wide.shape[1] // block)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(b), *map(pa.array, np.ascontiguousarray(wide.reshape(-1, block).T))], ["i", "b", *(f"m{k}" for k in range(block))])

    sums = classes.select("x").mapInArrow(run, "i bigint, b bigint, " + ", ".join(f"m{k} double" for k in range(block)))
    rows = sums.groupBy("i", "b").agg(*(F.sum(f"m{k}").alias(f"m{k}") for k in range(block))).orderBy("i", "b").collect()
    size = 1 + max(r.i for r in rows)
    moments = np.array([r[2:] for r in rows]).reshape(size, -1)[:, :size]
    return np.ascontiguousarray(np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1])


def _turned(column: pa.Array, axes: dict[int, np.ndarray]) -> np.ndarray:
    unit = _matrix(column)
    return unit @ axes[unit.shape[1]] if unit.shape[1] in axes else unit


def _cells(classes: DataFrame, axes: dict[int, np.ndarray], edge: float) -> DataFrame:
    """classes with cell, their cell's numbers, and lead, the first component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x.as_buffer()) for x in batch.column(3)])
            for size in np.unique(sizes):
                own = batch.filter(pa.array(sizes == size))
                p = _turned(own.column(3), axes)[:, :CELL_AXES]
                cell = np.floor(p / edge).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cell.tolist(), pa.list_(pa.int32())), pa.array(np.ascontiguousarray(p[:, 0]))], [*own.schema.names, "cell", "lead"])

    return classes.select("id", "grp", "n", "x").mapInArrow(run, "id bigint, grp string, n bigint, x binary, cell array<int>, lead double")


def _tiles(cells: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """(tile, grp, cell, ids, counts, xs, low, high, centre, radius) from rows in the order of grp, cell and lead."""

    def tile(rows: list[pa.RecordBatch]) -> list:
        held = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        p = _turned(held.column(3), axes)
        centre = p.mean(axis=0)
        radius = float(np.sqrt(((p - centre) ** 2).sum(axis=1)).max())
        lead = p[:, :BOX_AXES]
        ids, counts = (held.column(k).to_numpy().tobytes() for k in (0, 2))
        return [held.column(1)[0].as_py(), held.column(4)[0].as_py(), ids, counts, b"".join(held.column(3).to_pylist()), lead.min(axis=0).tolist(), lead.max(axis=0).tolist(), centre.tolist(), radius]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), *[pa.list_(pa.float64())] * 3, pa.float64()]
        names = ["grp", "cell", "ids", "counts", "xs", "low", "high", "centre", "radius"]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r], k) for r, k in zip(tile(rows), kinds, strict=True)], names)
        held, size, now = [], 0, None
        for batch in batches:
            places = list(zip(batch.column(1).to_pylist(), map(tuple, batch.column(4).to_pylist()), strict=True))
            start = 0
            for k, place in enumerate(places):
                if held and place != now or size + k - start == TILE or k > start and place != places[k - 1]:
                    if k > start:
                        held.append(batch.slice(start, k - start))
                    yield made(held)
                    held, size, start = [], 0, k
                now = place
            if start < batch.num_rows:
                held.append(batch.slice(start))
                size += batch.num_rows - start
        if held:
            yield made(held)

    rows = cells.mapInArrow(run, "grp string, cell array<int>, ids binary, counts binary, xs binary, low array<double>, high array<double>, centre array<double>, radius double")
    return rows.withColumn("tile", F.monotonically_increasing_id())


def _gap2(a: str, b: str) -> F.Column:
    """The squared distance of two boxes."""
    apart = F.zip_with(F.arrays_zip(F.col(f"{a}low").alias("l"), F.col(f"{a}high").alias("h")), F.arrays_zip(F.col(f"{b}low").alias("l"), F.col(f"{b}high").alias("h")), lambda p, q: F.greatest(p["l"] - q["h"], q["l"] - p["h"], F.lit(0.0)))
    return F.aggregate(apart, F.lit(0.0), lambda acc, v: acc + v * v)


def _tile_pairs(tiles: DataFrame, reach: float) -> DataFrame:
    """(a, b): pairs of tiles, each once and each with itself, that may hold linked vectors."""
    heads = tiles.select("tile", "grp", "cell", "low", "high", "centre", "radius")
    other = heads.select(*(F.col(c).alias(f"o_{c}") for c in heads.columns))
    # a cell and the half of its neighbours that come after it
    steps = [[]]
    for _ in range(CELL_AXES):
        steps = [[*s, d] for s in steps for d in (-1, 0, 1)]
    steps = [s for s in steps if s >= [0] * CELL_AXES]
    # vectors shorter than CELL_AXES have fewer numbers
    near = F.array_distinct(F.array(*(F.zip_with("cell", F.slice(F.array(*map(F.lit, s)), 1, F.size("cell")), lambda c, d: c + d) for s in steps)))
    rows = heads.withColumn("near", F.explode(near)).join(other, (F.col("grp") == F.col("o_grp")) & (F.col("near") == F.col("o_cell")))
    once = (F.col("near") != F.col("cell")) | (F.col("tile") <= F.col("o_tile"))
    between = F.sqrt(F.aggregate(F.zip_with("centre", "o_centre", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, v: acc + v))
    close = (_gap2("", "o_") <= reach * reach + _DOUBT) & (between <= F.col("radius") + F.col("o_radius") + reach + _DOUBT)
    return rows.where(once & close).select(F.col("tile").alias("a"), F.col("o_tile").alias("b"))


def linked_pairs(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit vectors a and b, p and q on the axes, whose cosine reaches the threshold."""
    size = p.shape[1]
    cuts = sorted({max(1, size // 4), max(1, size // 2), size})
    rest = lambda m, k: np.sqrt((m[:, k:] ** 2).sum(axis=1))
    product = p[:, : cuts[0]] @ q[:, : cuts[0]].T
    alive = product + np.outer(rest(p, cuts[0]), rest(q, cuts[0])) >= threshold - _DOUBT
    i, j = np.nonzero(alive)
    if len(i) > alive.size // 16:  # too many to take up pair by pair
        product, done = product + p[:, cuts[0] :] @ q[:, cuts[0] :].T, size
    else:
        done = cuts[0]
    value = product[i, j]
    for cut in [c for c in cuts if c > done]:
        norms = rest(p, cut), rest(q, cut)
        for at in range(0, len(i), PAIRS):
            own = slice(at, at + PAIRS)
            value[own] += np.einsum("nk,nk->n", p[i[own], done:cut], q[j[own], done:cut])
        keep = value + norms[0][i] * norms[1][j] >= threshold - _DOUBT
        i, j, value, done = i[keep], j[keep], value[keep], cut
    keep = value >= threshold
    for k in np.nonzero(np.abs(value - threshold) <= _DOUBT)[0]:
        keep[k] = a[i[k]] @ b[j[k]] >= threshold
    return i[keep], j[keep]


def _forest(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of `size` nodes the smallest one of its component under the edges (i, j)."""
    label = np.arange(size)
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            return label


def _compared(pairs: DataFrame, axes: dict[int, np.ndarray], threshold: float, reach: float) -> DataFrame:
    """(id, other, links): the rows that a class is linked to in a pair of tiles (other null), and edges of its spanning forest (links 0)."""

    def two(batch: pa.RecordBatch, row: int, side: int):
        ids, counts = (np.frombuffer(batch.column(c + side)[row].as_buffer(), np.int64) for c in (2, 4))
        x = np.frombuffer(batch.column(6 + side)[row].as_buffer(), np.float64).reshape(len(ids), -1)
        unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
        p = unit @ axes[unit.shape[1]] if unit.shape[1] in axes else unit
        return ids, counts, unit, p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column(0)[row] == batch.column(1)[row]
                ids, counts, a, p = two(batch, row, 0)
                other, more, b, q = (ids, counts, a, p) if same else two(batch, row, 1)
                n, centres = len(ids), (p.mean(axis=0), q.mean(axis=0))
                spread = np.sqrt(((p - centres[0]) ** 2).sum(axis=1)).max() + np.sqrt(((q - centres[1]) ** 2).sum(axis=1)).max()
                nodes = ids if same else np.concatenate([ids, other])
                if np.sqrt(((centres[0] - centres[1]) ** 2).sum()) + spread <= reach - _DOUBT:
                    links = np.full(n, counts.sum()) - counts if same else np.concatenate([np.full(n, more.sum()), np.full(len(other), counts.sum())])
                    root = np.zeros(len(nodes), np.int64)
                else:
                    i, j = linked_pairs(a, b, p, q, threshold)
                    if same:
                        i, j = i[i < j], j[i < j]
                    links = np.zeros(len(nodes), np.int64)
                    np.add.at(links, i, more[j])
                    np.add.at(links, j + (0 if same else n), counts[i])
                    root = _forest(len(nodes), i, j + (0 if same else n))
                some, child = links > 0, root != np.arange(len(nodes))
                left, right = pa.array(nodes[some]), pa.array(nodes[child])
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([left, right]), pa.concat_arrays([pa.nulls(len(left), pa.int64()), pa.array(nodes[root[child]])]), pa.array(np.concatenate([links[some], np.zeros(len(right), np.int64)]))], ["id", "other", "links"])

    return pairs.mapInArrow(run, "id bigint, other bigint, links bigint")


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of df (vec_id, label, embedding)."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0, and not above 1")
    spark = df.sparkSession
    tables, reach = Tables(spark, "vectors"), math.sqrt(2 - 2 * threshold)
    rows = tables.written(_keyed(df), "rows")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.first("grp").alias("grp"), F.first("x").alias("x"))
    classes = tables.written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    length = (F.octet_length("x") / 8).cast("int")
    common = classes.groupBy(length.alias("length")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "length").first()
    if common is None:
        out = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
        return written(out, "links")
    axes = {common.length: principal_axes(classes.where(length == common.length))} if 1 < common.length <= MOST_AXES else {}
    parts = max(1, math.ceil(classes.count() / (4 * TILE)))
    cells = tables.written(_cells(classes, axes, reach + 1e-6), "cells")
    tiles = tables.written(_tiles(cells.repartitionByRange(parts, "grp", "cell", "lead").sortWithinPartitions("grp", "cell", "lead", "id"), axes), "tiles")
    pairs = tables.written(_tile_pairs(tiles, reach), "pairs")
    side = lambda c: tiles.select(F.col("tile").alias(c), *(F.col(k).alias(f"{k}_{c}") for k in ("ids", "counts", "xs")))
    whole = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ids_a", "ids_b", "counts_a", "counts_b", "xs_a", "xs_b")
    found = tables.written(_compared(whole, axes, threshold, reach), "found")
    links = found.where("other IS NULL").groupBy("id").agg(F.sum("links").alias("links"))
    label = components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct(), tables)
    named = classes.select("id", "key", "n", "least").join(links, "id", "left").join(label.withColumnRenamed("node", "id"), "id", "left")
    named = tables.written(named.select("key", "n", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("label", "id").alias("label")), "named")
    firsts = tables.written(named.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "firsts")
    named = tables.written(attached(named, firsts, "label", "members").select("key", "n", "n_links", "component_id"), "labels")
    out = attached(rows.where("key IS NOT NULL").select("vec_id", "key"), named, "key", "n").select("vec_id", "n_links", "component_id")
    rest = rows.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    out = written(out, "links")
    tables.delete()
    return out


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's number of links, component, and whether it stands for it."""
    return near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


SQL = {
    "op12_embedding_dedup": f"""WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
  label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r AND a.ok AND b.ok WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT a AS r, a AS t FROM l UNION SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.t),
comp AS (SELECT reach.r, min(v.vec_id) AS c FROM reach JOIN v ON v.r = reach.t GROUP BY reach.r)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = v.r) AS n_links, CASE WHEN comp.r IS NULL THEN vec_id ELSE c END AS component_id,
  vec_id IS NOT DISTINCT FROM CASE WHEN comp.r IS NULL THEN vec_id ELSE c END AS kept FROM v LEFT JOIN comp USING (r)"""
}
QUERIES = {"op12_embedding_dedup": op12_embedding_dedup}
