"""A halo exchange that is planned once: which row goes from which part to which, kept by row id, so that field after field follows without a shuffle."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.held import new_path

BUCKETS = 16


class Plan(NamedTuple):
    """The name of a table (pid, source, target) in `buckets` buckets of pid, each in order."""

    table: str
    buckets: int

    def rows(self, spark) -> DataFrame:
        return spark.table(self.table)


def _kept(df: DataFrame, name: str, buckets: int) -> str:
    """df as a table in buckets of pid, in the shared folder."""
    table = f"{name}_{uuid.uuid4().hex}"
    # as many writers as buckets, so that a bucket is one file
    df.repartition(buckets, "pid").write.bucketBy(buckets, "pid").sortBy("pid").format("parquet").option("path", new_path(df.sparkSession, name)).saveAsTable(table)
    return table


def plan_halos(particles: DataFrame, buckets: int = BUCKETS) -> Plan:
    """The plan of a domain's particles (pid, part, is_halo, and owner, which spares a join): for each halo the part that owns its row and the part that needs it."""
    halos = particles.where("is_halo").withColumnRenamed("part", "target")
    if "owner" in particles.columns:
        rows = halos.withColumnRenamed("owner", "source")
    else:
        rows = halos.join(particles.where("NOT is_halo").select("pid", F.col("part").alias("source")), "pid")
    return Plan(_kept(rows.select("pid", "source", "target"), "halo_plan", buckets), buckets)


def keep_fields(df: DataFrame, plan: Plan) -> str:
    """The name of a table of df (pid, fields) that lies as the plan does: the one shuffle of its rows."""
    return _kept(df, "halo_fields", plan.buckets)


def exchange(spark, plan: Plan, fields: str) -> DataFrame:
    """(pid, source, target, fields): the fields of every halo. Both tables lie in buckets of pid, so nothing is shuffled."""
    return plan.rows(spark).hint("merge").join(spark.table(fields), "pid")


def drop(spark, *tables: str) -> None:
    for table in tables:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
