"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Which n-grams a document has counts, not how often. N-grams of ORDERS characters (ASCII letters lower-cased, counted in
UTF-8 bytes) are hashed to 2**BITS features. Over at most FIT_ROWS labelled training rows, chosen by hash, documents with
a feature are counted by label; the log of the ratio of the smoothed rates scales the feature. The features that tell
the labels apart best are kept, and a logistic regression with an L2 penalty is fitted to them on the same rows.
Scores are exact functions of the whole text.

Rows whose crc32(doc_id as text) mod 5 is 0 are held out. Memory: 2**BITS counters per task, MOST_FEATURES weights on
the driver and in each task, FIT_ROWS lists of features on the driver. FIT_ROWS bounds the rows of documents that the fit
reads, also where a labelled doc_id has many: those with the fewest rows come first then.

Defined results: a null or empty text has no feature and gets the score of the intercept; labels that are null are not
used; of a doc_id with several labels or texts each pair counts; without rows of both labels every score is 0.5 if
there is no label at all, else the share of label 1; repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import blocks, read, text_bytes, written

ORDERS = (4, 5, 6)
BITS = 20
MOST_FEATURES = 4096
FIT_ROWS = 20_000
MIN_DOCS = 4
SMOOTH = 0.5
PENALTY = 1e-3
THRESHOLD = 0.5
_STEP = 1 << 17


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def features(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order, the feature of the n-gram that begins at each byte."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    value = low.copy()
    for order in range(2, max(ORDERS) + 1):
        if len(data) < order:
            return
        value = value[: len(data) - order + 1] * np.uint32(0x01000193) + low[order - 1 :]
        if order in ORDERS:
            yield order, ((value ^ np.uint32(order)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def document_features(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each pair (row, feature) once; wanted: a mask of features."""
    pairs = []
    for first in range(0, len(data), _STEP):  # stretches that stay in the cache
        part = data[first : first + _STEP + max(ORDERS) - 1]
        for order, feature in features(part):
            feature = feature[:_STEP]
            at = np.arange(len(feature)) if wanted is None else np.flatnonzero(wanted[feature])
            row = np.searchsorted(offsets, at + first, "right") - 1
            inside = at + first + order <= offsets[row + 1]
            pairs.append((row[inside] << BITS) | feature[at[inside]])
    found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return found >> BITS, found & ((1 << BITS) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task: documents of each label with each feature."""
    total = np.zeros((2, 1 << BITS), np.int64)
    for batch in blocks(batches, "text", 1 << 18):  # all n-grams of a block are sorted at once
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
        label = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
        row, feature = document_features(data, offsets)
        for y in (0, 1):
            total[y] += np.bincount(feature[label[row] == y], minlength=1 << BITS)
    seen = np.flatnonzero(total.sum(0))
    for k in range(0, len(seen), 1 << 16):
        part = seen[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[0][part]), pa.array(total[1][part])], ["feature", "clean", "toxic"])


def _fit(rows: list[np.ndarray], label: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on features that count `scale` where they occur."""
    index = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n, d = len(rows), len(scale)
    weights, bias = np.zeros(d), 0.0
    if not n:
        return weights, bias
    value = scale[index]
    # accelerated gradient steps; the step follows from a bound of the largest curvature
    norms = np.bincount(row, value**2, minlength=n)
    step = 1.0 / (0.25 * (min(norms.max(initial=0.0), 400.0) + 1) + PENALTY)
    ahead, ahead_bias, t = weights.copy(), bias, 1.0
    for _ in range(400):
        z = np.bincount(row, value * ahead[index], minlength=n) + ahead_bias
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - label
        gradient = np.bincount(index, value * error[row], minlength=d) / n + PENALTY * ahead
        new, new_bias = ahead - step * gradient, ahead_bias - step * error.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / t_new * (new - weights), new_bias + (t - 1) / t_new * (new_bias - bias)
        weights, bias, t = new, new_bias, t_new
    return weights * scale, float(bias)


def _within(docs: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """The labels of `known` whose documents are `most` rows at most; where that takes all of them, known itself."""
    ids = F.broadcast(known.select("doc_id").distinct())
    counted = known.join(docs.select("doc_id").join(ids, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc_id")
    if (counted.agg(F.sum("n")).first()[0] or 0) <= most:
        return known
    order = Window.orderBy("n", F.xxhash64(F.col("doc_id")), "doc_id", "label")  # one task: known has FIT_ROWS rows at most
    return counted.withColumn("__upto", F.sum("n").over(order)).where(F.col("__upto") <= most).select("doc_id", "label")


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, their weights, and the intercept, from the labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isin(0, 1)).where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("label"))
    known = written(known.orderBy(F.xxhash64(F.col("doc_id")), "doc_id", "label").limit(fit_rows), "labelled")
    rows = written(docs.select("doc_id", "text").join(F.broadcast(_within(docs, known, fit_rows)), "doc_id").select("text", "label"), "sample")
    counts = rows.mapInArrow(_count, "feature bigint, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        share = toxic / (clean + toxic) if clean + toxic else 0.5
        return np.zeros(0, np.int64), np.zeros(0), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    p, q = (F.col("toxic") + SMOOTH) / (toxic + 2 * SMOOTH), (F.col("clean") + SMOOTH) / (clean + 2 * SMOOTH)
    # how much a feature tells: the signed root of its likelihood ratio, for which rare and common features compare
    gain = (p - q) ** 2 / (p * (1 - p) / toxic + q * (1 - q) / clean)
    best = counts.where(F.col("clean") + F.col("toxic") >= MIN_DOCS).select("feature", F.log(p / q).alias("ratio"), gain.alias("gain")).orderBy(F.desc("gain"), "feature").limit(MOST_FEATURES).collect()
    best = sorted((r["feature"], r["ratio"]) for r in best)
    chosen, scale = np.array([f for f, _ in best], np.int64), np.array([r for _, r in best])
    place = np.full(1 << BITS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1 << 20):
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
            row, feature = document_features(data, offsets, place >= 0)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(place[feature].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("label")).cast(pa.int32()), lists], ["label", "found"])

    got = rows.mapInArrow(listed, "label int, found array<int>").toArrow()
    lists = [np.asarray(x, np.int64) for x in got.column("found").to_pylist()]
    weights, bias = _fit(lists, got.column("label").to_numpy().astype(float), scale)
    return chosen, weights, bias


def _scores(model: tuple[np.ndarray, np.ndarray, float], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The same rows, by blocks, with the scores of their texts."""
    chosen, weights, bias = model
    table = np.zeros(1 << BITS)
    table[chosen] = weights
    wanted = np.zeros(1 << BITS, bool)
    wanted[chosen] = True
    for batch in blocks(batches, "text", 1 << 20):
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
        row, feature = document_features(data, offsets, wanted)
        z = np.bincount(row, table[feature], minlength=batch.num_rows) + bias
        yield batch, 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], column: str = "score") -> DataFrame:
    """doc_id, and the score of the whole text; any doc_id type; one row for each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in _scores(model, batches):
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(values)], ["doc_id", column])

    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, {column} double")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score, from labels that are not held out."""
    docs = read(spark, sf_dir, "documents")
    out = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def filter_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold."""
    model, names = train(docs, read(spark, sf_dir, "labels")), docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in _scores(model, batches):
            yield batch.filter(pa.array(values < THRESHOLD)).select(names)

    return docs.mapInArrow(kept, docs.schema)


SQL: dict[str, str] = {}
QUERIES = {"op5_toxicity": op5_toxicity}
