"""Connected components of an edge table by alternating star contractions; nothing but sums reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Tables


def components(edges: DataFrame, tables: Tables | None = None, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of edges (a, b), label being the smallest node of its component; any orderable type.

    Large star: each node's larger neighbours are linked to its smallest neighbour or itself. Small star: its smaller
    neighbours and itself are linked to the smallest of them. When neither changes the edges, they are stars. The
    result reads the last round's table among `tables`; those of the other rounds are deleted.
    """
    tables = tables or Tables(edges.sparkSession, "components")
    pairs = tables.written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        last, pairs = pairs, tables.written(small, "edges")
        tables.delete(last)
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
