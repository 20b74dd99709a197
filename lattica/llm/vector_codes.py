"""Compressing vectors to codes of their parts, each part's nearest entry found by annular norm pruning.

A vector becomes integers, floor(256 x), and is cut into PARTS equal parts; each part position has a codebook of at most
ENTRIES entries. An entry nearer to a part than the best one known at distance d has a norm within d of the part's, so
entries are sorted by norm, the interval of norms that the best distance allows is found by binary search, and only
that annulus, both ends included, is evaluated, in integers. Codebooks are sums and counts: each task adds up its own
rows, Spark adds up tasks, and the driver holds the codebooks alone (PARTS * ENTRIES entries).

Defined results: rows whose vector is null, or holds a null or a component that isn't finite, are dropped, and so are
vectors whose length isn't that of the first one (by vec_id, null last) or no multiple of PARTS above 0. Integers
beyond +-LARGEST saturate there, so that every error is a BIGINT. With fewer vectors than ENTRIES a codebook has as many
entries. Rows of one vec_id are ordered by their vectors where the first codebooks are chosen; repeated rows count each.
An empty table gives an empty result. Other columns are no input, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import attached, read, written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
LARGEST = 1 << 27
#: Pairs of a part and an entry evaluated at a time.
EVALUATED = 1 << 20


def usable(column: str = "embedding") -> Column:
    """Whether a vector is there and all its components are finite."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.coalesce(F.forall(column, finite), F.lit(False))


def integers(vectors: pa.Array) -> np.ndarray:
    """floor(SCALE * x) of vectors of one length, a row each."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(values * SCALE), -LARGEST, LARGEST).astype(np.int64).reshape(len(vectors), -1)


class Annuli:
    """One codebook, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        squares = (entries * entries).sum(axis=1)
        self.place = np.argsort(squares, kind="stable")
        self.entries, self.norms = entries[self.place], np.sqrt(squares[self.place].astype(np.float64))

    def _distances(self, parts: np.ndarray, at: np.ndarray) -> np.ndarray:
        gap = parts - self.entries[at]
        return (gap * gap).sum(axis=1)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each part: its nearest entry, the lower index of equally near ones, and the squared distance."""
        norms = np.sqrt((parts * parts).sum(axis=1).astype(np.float64))
        after = np.minimum(np.searchsorted(self.norms, norms), len(self.norms) - 1)
        best = np.minimum(self._distances(parts, after), self._distances(parts, np.maximum(after - 1, 0)))
        reach = np.sqrt(best.astype(np.float64)) + 1e-9 * (1 + norms)  # rounding must not exclude what lies on the edge
        low, high = np.searchsorted(self.norms, norms - reach, "left"), np.searchsorted(self.norms, norms + reach, "right")
        index, distance = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        ends = np.cumsum(high - low)
        start = 0
        while start < len(parts):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + EVALUATED, "right")))
            width = (high - low)[start:stop]
            first = np.cumsum(width) - width
            at = np.arange(width.sum()) - np.repeat(first - low[start:stop], width)
            found = self._distances(np.repeat(parts[start:stop], width, axis=0), at)
            distance[start:stop] = np.minimum.reduceat(found, first)
            tied = np.where(found == np.repeat(distance[start:stop], width), self.place[at], len(self.place))
            index[start:stop] = np.minimum.reduceat(tied, first)
            start = stop
        return index, distance


Codebooks = np.ndarray  # of integers: part, entry, position within the part


def _assigned(batch: pa.RecordBatch, annuli: list[Annuli]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part position: the parts, their entries' indexes and squared distances."""
    x = integers(batch.column(batch.schema.get_field_index("embedding")))
    width = x.shape[1] // len(annuli)
    for p, own in enumerate(annuli):
        parts = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
        yield parts, *own.nearest(parts)


def _sums(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(part, entry, n, s0, s1, ...): how many parts are nearest to each entry, and their componentwise sums."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(b) for b in books]
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                for p, (own, index, _) in enumerate(_assigned(batch, annuli)):
                    np.add.at(total[p], index, own)
                    count[p] += np.bincount(index, minlength=entries)
        p, e = np.nonzero(count)
        names = ["part", "entry", "n", *(f"s{j}" for j in range(width))]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (p, e, count[p, e], *total[p, e].T)], names)

    rows = vectors.select("embedding").mapInArrow(run, "part bigint, entry bigint, n bigint, " + ", ".join(f"s{j} bigint" for j in range(width)))
    return rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{j}").alias(f"s{j}") for j in range(width)))


def _of_length(df: DataFrame, length: int) -> DataFrame:
    return df.where(usable() & (F.size("embedding") == length) & F.lit(length > 0))


def train(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """The codebooks of df (vec_id, embedding): from its first vectors, moved to the means of what is nearest in each round."""
    least = df.where(usable()).orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding")).first()
    length = least[0] if least and least[0] % parts == 0 else 0
    rows = _of_length(df, length)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).toArrow()
    x = integers(first.column(0).combine_chunks()) if first.num_rows else np.zeros((0, parts), np.int64)
    books = np.ascontiguousarray(x.reshape(len(x), parts, -1 if len(x) else 1).transpose(1, 0, 2))
    for _ in range(rounds if length else 0):
        for part, entry, n, *sums in _sums(rows, books).collect():
            books[part, entry] = [s // n for s in sums]
    return books


def encode(df: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code and error of each vector of df (vec_id, label, embedding) that can be coded."""
    rows = _of_length(df, books.shape[0] * books.shape[2] if books.shape[1] else 0)
    kind = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField("vec_id", kind["vec_id"]), T.StructField("label", kind["label"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(b) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, error = np.empty((batch.num_rows, len(annuli)), np.uint8), np.zeros(batch.num_rows, np.int64)
            for p, (_, index, distance) in enumerate(_assigned(batch, annuli)):
                codes[:, p] = index
                error += distance
            code = [row.tobytes().hex() for row in codes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "embedding").mapInArrow(run, schema)


def decode(codes: list[str], books: Codebooks) -> np.ndarray:
    """The integer vectors that codes stand for."""
    index = np.array([list(bytes.fromhex(c)) for c in codes], np.int64).reshape(len(codes), len(books))
    return books[np.arange(len(books)), index].reshape(len(codes), -1)


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every coded vector with its error, its label's error and the codebooks' digest."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    books = train(vectors)
    same = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    rows = written(encode(vectors, books), "codes").withColumn("same", same)
    labels = written(rows.groupBy("same").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "labels")
    rows = attached(rows, labels, "same", "n")
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """For vectors of 64 components."""
    d = " + ".join(f"(p.s[{j}] - b.s[{j}]) * (p.s[{j}] - b.s[{j}])" for j in range(1, 5))
    steps = ""
    for k in range(ROUNDS + 1):
        steps += f", a{k} AS MATERIALIZED (SELECT p.r, p.part, min(({d}) * {ENTRIES} + b.entry) AS best FROM p JOIN b{k} b USING (part) GROUP BY ALL)"
        if k < ROUNDS:
            # DuckDB's // cuts towards 0
            means = ", ".join(f"CAST((sum(p.s[{j}]) - ((sum(p.s[{j}]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)" for j in range(1, 5))
            steps += f", m{k} AS (SELECT p.part, a.best % {ENTRIES} AS entry, [{means}] AS s FROM a{k} a JOIN p USING (r, part) GROUP BY ALL), b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.s, b.s) AS s FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"
    last = ROUNDS
    return f"""WITH v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT r, q.range AS part, e[4*q.range + 1 : 4*q.range + 4] AS s FROM v, range({PARTS}) q),
b0 AS MATERIALIZED (SELECT part, r AS entry, s FROM p WHERE r < {ENTRIES}){steps},
c AS (SELECT r, string_agg(printf('%02x', CAST(best % {ENTRIES} AS INT)), '' ORDER BY part) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM a{last} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, entry)) AS sha FROM b{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha FROM h) AS codebooks_sha256 FROM c JOIN v USING (r)"""


QUERIES = {"op11_vector_codes": op11_vector_codes}
SQL = {"op11_vector_codes": _sql()}
