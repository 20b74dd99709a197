"""Ranks, running values and successors in the order of a key, without ordering all rows in one task.

Rows are dealt by ranges of the key and its ties, whose bounds Spark samples from the rows, so that clustered keys and
repeated ones spread; the parts are held, since bounds may differ from run to run. What a part adds to those after it
is found from one row per part; then each part is ordered for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.held import held

_BEFORE = (Window.unboundedPreceding, -1)


def in_parts(df: DataFrame, order: str = "key", ties: tuple[str, ...] = ()) -> DataFrame:
    """df with __part: rows of a part come before those of the next."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return held(df.repartitionByRange(parts, order, *ties).withColumn("__part", F.spark_partition_id()))


def with_running(df: DataFrame, value: Column, order: str = "key", ties: tuple[str, ...] = ()) -> DataFrame:
    """df with `before`, the sum of value over the rows before each, and `next`, the next row's key."""
    rows = in_parts(df.withColumn("__value", value), order, ties)
    sums = rows.groupBy("__part").agg(F.sum("__value").alias("__sum"), F.min(order).alias("__first"))
    in_order = Window.orderBy("__part")  # one row per part
    base = F.coalesce(F.sum("__sum").over(in_order.rowsBetween(*_BEFORE)), F.lit(0))
    sums = sums.select("__part", base.alias("__base"), F.lead("__first").over(in_order).alias("__then"))
    own = Window.partitionBy("__part").orderBy(order, *ties)
    before = F.col("__base") + F.coalesce(F.sum("__value").over(own.rowsBetween(*_BEFORE)), F.lit(0))
    joined = rows.join(F.broadcast(sums), "__part").withColumns({"before": before, "next": F.coalesce(F.lead(order).over(own), F.col("__then"))})
    return joined.drop("__part", "__value", "__base", "__then")


def with_rank(df: DataFrame, order: str = "key", ties: tuple[str, ...] = ("pid",)) -> DataFrame:
    """df with rank from 0 in the order of a key and ties."""
    return with_running(df, F.lit(1).cast("long"), order, ties).drop("next").withColumnRenamed("before", "rank")


def running_max(df: DataFrame, value: str, order: str = "key", ties: tuple[str, ...] = ()) -> DataFrame:
    """df with `most`, the largest value of each row and those before it."""
    rows = in_parts(df, order, ties)
    tops = rows.groupBy("__part").agg(F.max(value).alias("__top"))
    tops = tops.select("__part", F.max("__top").over(Window.orderBy("__part").rowsBetween(*_BEFORE)).alias("__base"))
    own = Window.partitionBy("__part").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(F.broadcast(tops), "__part").withColumn("most", F.greatest(F.max(value).over(own), "__base")).drop("__part", "__base")


def segmented_scan(df: DataFrame, value: str, head: str, order: str = "key", ties: tuple[str, ...] = ()) -> DataFrame:
    """df with `scan`: the sum of value from the last row at which the boolean column head holds up to each row.

    A part's first rows, before its first head, go on with the sum that earlier parts leave open.
    """
    rows = in_parts(df, order, ties)
    own = Window.partitionBy("__part").orderBy(order, *ties)
    rows = rows.withColumn("__segment", F.sum(F.col(head).cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy("__part", "__segment").agg(F.sum(value).alias("__sum"))
    last = ends.groupBy("__part").agg(F.max(F.struct("__segment", "__sum")).alias("__l")).select("__part", F.col("__l.__segment").alias("__heads"), F.col("__l.__sum").alias("__tail"))
    in_order = Window.orderBy("__part")  # one row per part
    chain = F.sum((F.col("__heads") > 0).cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    # what the parts since the last head leave open: that part's tail, and all of those after it
    open_sum = F.sum("__tail").over(Window.partitionBy("__chain").orderBy("__part").rowsBetween(Window.unboundedPreceding, 0))
    carried = last.withColumn("__chain", chain).withColumn("__open", open_sum)
    carried = carried.select("__part", F.coalesce(F.lag("__open").over(in_order), F.lit(0)).alias("__base"))
    within = F.sum(value).over(Window.partitionBy("__part", "__segment").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.join(F.broadcast(carried), "__part").withColumn("scan", within + F.when(F.col("__segment") == 0, F.col("__base")).otherwise(0))
    return out.drop("__part", "__segment", "__base")


def gather(values: DataFrame, index: DataFrame) -> DataFrame:
    """(idx, value): for each row of index (idx, source) the value of the row `source` of values (idx, value)."""
    return index.join(values.select(F.col("idx").alias("source"), "value"), "source").select("idx", "value")


def scatter(values: DataFrame, index: DataFrame) -> DataFrame:
    """(idx, value): the value of row idx of values goes to the row `target` of index (idx, target)."""
    return values.join(index, "idx").select(F.col("target").alias("idx"), "value")
