"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Each source may be repeated `cap` times at most. Targets start in proportion to the weights; what a source cannot
take is shared among the others by weight until no target is above its cap. That fixed point is found in closed form:
sources are ordered by cap / weight, and a source is full if the level that the sources before it leave reaches it.

Within a source every document is taken floor(target / size of source) times, and what is left of the target is
dealt over the documents in the order of a seeded hash of id and text, the last one in part; rows equal in both are
ordered by a hash of all their columns, so reruns agree. Hash order is found in ranges of each
source, 4,096 or, for larger tables, so many that a range of a source that has all rows stays below RANGE_BYTES: sums
of ranges come first, so that no task ever orders a whole source, however hot.

Defined results: a null text has size 0; the null source is a source, ordered last; repeated rows count each; sources
without words get target 0; an empty table gives an empty result. Other columns are carried along untouched, whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import WORD, read

SEED = 17
WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
RANGE_BYTES = 64 << 20


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Of (source, source_size), one row each: with weight, and target, in words, as double."""
    by_name, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    filling = Window.orderBy("__ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("__cap", F.col("source_size").cast("double") * cap)
    rows = rows.withColumn("__ratio", F.col("__cap") / F.col("weight")).withColumn("__want", F.sum("source_size").over(every).cast("double") * share)
    before = lambda c: F.coalesce(F.sum(c).over(filling), F.lit(0.0))
    rows = rows.withColumn("__level", (F.col("__want") - before("__cap")) / (F.sum("weight").over(every) - before("weight")))
    rows = rows.withColumn("__full", F.col("__cap") <= F.col("weight") * F.col("__level"))
    taken = F.sum(F.when(F.col("__full"), F.col("__cap")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(F.col("__full"), 0.0).otherwise(F.col("weight"))).over(every)
    level = (F.col("__want") - taken) / F.when(open_weight > 0, open_weight)
    return rows.select("source", "source_size", "weight", F.when(F.col("__full"), F.col("__cap")).otherwise(F.col("weight") * level).alias("target"))


def _range_digits(docs: DataFrame) -> int:
    """Hexadecimal digits of the hash that name a range, from the size that the optimizer knows of docs."""
    ranges = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / RANGE_BYTES
    return min(8, max(3, math.ceil(math.log(max(1.0, ranges), 16))))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Of each row of docs (doc_id, text, source, ...): row (all its columns, or those to keep), size, source_size, target, whole and extra.

    A row is taken `whole` times in full, and `extra` of its words once more.
    """
    none = F.lit("")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), none), F.lit(":"), F.md5(F.coalesce("text", none))))
    tie = F.xxhash64(*(f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind))  # maps have no order
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    rows = docs.select(F.struct(*(keep or docs.columns)).alias("row"), "source", key.alias("key"), word_count(F.col("text")).alias("size"), order.alias("order"), tie.alias("tie"))
    rows = rows.withColumn("range", F.substring("order", 1, _range_digits(docs)))
    ranges = rows.groupBy("key", "source", "range").agg(F.sum("size").alias("sum"))
    aims = targets(ranges.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, share, cap).select(key.alias("key"), "source_size", "target")
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.drop("source").withColumn("base", F.coalesce(F.sum("sum").over(earlier), F.lit(0))).drop("sum").join(aims, "key")
    inside = Window.partitionBy("key", "range").orderBy("order", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.drop("source").withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ranges, ["key", "range"])
    rows = rows.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    left = F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("source_size") - F.col("base") - F.col("before")
    return rows.select("row", "size", "source_size", "target", "whole", F.greatest(F.lit(0), F.least(F.col("size"), left)).alias("extra"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, same columns, each as often as the mix takes it; a part of a document counts from one half on."""
    copies = F.col("whole") + F.when((F.col("extra") > 0) & (2 * F.col("extra") >= F.col("size")), 1).otherwise(0)
    return mix(docs, **how).select("row", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select("row.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken."""
    rows = mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep=("doc_id",))
    taken = F.col("whole") * F.col("size") + F.col("extra")
    return rows.select("row.doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix_sql(docs: str, columns: str) -> str:
    """DuckDB SQL for mix() of the relation `docs`; `columns` over size, source_size, target, whole and extra."""
    return rf"""
    WITH docs AS (SELECT d.*, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS ord FROM {docs} d),
    sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
    weighed AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS DOUBLE) AS weight,
                       CAST(source_size AS DOUBLE) * {CAP} AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * {SHARE} AS want FROM sizes),
    levels AS (SELECT *, (want - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS lvl FROM weighed
               WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    filled AS (SELECT *, cap <= weight * lvl AS is_full FROM levels),
    aims AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE weight * ((want - sum(CASE WHEN is_full THEN cap ELSE 0.0 END) OVER ()) / nullif(sum(CASE WHEN is_full THEN 0.0 ELSE weight END) OVER (), 0)) END AS target FROM filled),
    placed AS (SELECT d.*, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN CAST(floor(a.target / a.source_size) AS BIGINT) ELSE 0 END AS whole,
                      coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
               FROM docs d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source),
    mixed AS (SELECT *, greatest(0, least(size, CAST(floor(target + 0.5) AS BIGINT) - whole * source_size - before)) AS extra FROM placed)
    SELECT {columns} FROM mixed"""


SQL = {"op8_mixing": mix_sql("documents", "doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(whole * size + extra AS BIGINT) AS taken")}
QUERIES = {"op8_mixing": op8_mixing}
