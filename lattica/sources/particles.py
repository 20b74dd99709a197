"""Particle tables: the view derived from line items, and synthetic sources."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The view's multipliers and offsets; all its numbers are dyadic, so that sums are exact.
_POSITION = {"x": (1103515245, 12345), "y": (22695477, 1), "z": (69069, 5)}
_VELOCITY = {"vx": 40692, "vy": 48271, "vz": 16807}


def particle_view(lineitem: DataFrame) -> DataFrame:
    """pid, x, y, z in [-0.5, 0.5), vx, vy, vz and h, one row per line item's key."""
    pid = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long")
    rows = lineitem.select(pid.alias("pid")).distinct()
    place = {c: (F.pmod(F.col("pid") * m + a, F.lit(2097152)) / F.lit(2097152.0) - 0.5).alias(c) for c, (m, a) in _POSITION.items()}
    speed = {c: ((F.pmod(F.col("pid") * m, F.lit(4096)) - 2048) / F.lit(1024.0)).alias(c) for c, m in _VELOCITY.items()}
    return rows.select("pid", *place.values(), *speed.values(), ((8 + F.pmod(F.col("pid"), F.lit(57))) / F.lit(1024.0)).alias("h"))


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particle_view(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


PARTICLE_SQL = """p AS (SELECT DISTINCT pid, ((pid*1103515245+12345) % 2097152)/2097152.0e0 - 0.5e0 AS x, ((pid*22695477+1) % 2097152)/2097152.0e0 - 0.5e0 AS y,
 ((pid*69069+5) % 2097152)/2097152.0e0 - 0.5e0 AS z, ((pid*40692) % 4096 - 2048)/1024.0e0 AS vx, ((pid*48271) % 4096 - 2048)/1024.0e0 AS vy,
 ((pid*16807) % 4096 - 2048)/1024.0e0 AS vz, (8 + pid % 57)/1024.0e0 AS h FROM (SELECT l_orderkey*8 + l_linenumber AS pid FROM lineitem))"""


def clustered(df: DataFrame) -> DataFrame:
    """The particles drawn towards the middle, x to 2 x |x|, which is exact too: trees over them have many depths."""
    return df.withColumns({c: 2 * F.col(c) * F.abs(c) for c in "xyz"})


CLUSTERED_SQL = PARTICLE_SQL.replace("p AS", "p0 AS", 1) + ", p AS (SELECT pid, 2*x*abs(x) AS x, 2*y*abs(y) AS y, 2*z*abs(z) AS z, vx, vy, vz, h FROM p0)"


def _with_pid(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "pid")


def uniform_coordinates(spark: SparkSession, n: int, low: float = -0.5, high: float = 0.5, seed: int = 42) -> DataFrame:
    return _with_pid(spark, n).select("pid", *((F.rand(seed + k) * (high - low) + low).alias(c) for k, c in enumerate("xyz")))


def gaussian_coordinates(spark: SparkSession, n: int, low: float = -0.5, high: float = 0.5, seed: int = 42) -> DataFrame:
    """Normal around the centre with a fifth of the box as deviation, clamped to the box."""
    clamp = lambda v: F.least(F.greatest(v, F.lit(low)), F.lit(high))
    return _with_pid(spark, n).select("pid", *(clamp(F.randn(seed + k) * ((high - low) / 5) + (low + high) / 2).alias(c) for k, c in enumerate("xyz")))


def plummer_sphere(spark: SparkSession, n: int, seed: int = 42, most: float = 100.0) -> DataFrame:
    """A Plummer sphere of unit scale, radii below `most`, with its centre at the origin."""
    share = (1 + most**-2) ** -1.5
    r = 1 / F.sqrt(F.pow(F.rand(seed) * share, -2 / 3) - 1)
    rows = _with_pid(spark, n).select("pid", r.alias("r"), (F.rand(seed + 1) * 2 - 1).alias("c"), (F.rand(seed + 2) * 2 * math.pi).alias("phi"))
    flat = F.col("r") * F.sqrt(1 - F.col("c") * F.col("c"))
    rows = rows.select("pid", (flat * F.cos("phi")).alias("x"), (flat * F.sin("phi")).alias("y"), (F.col("r") * F.col("c")).alias("z"))
    means = rows.agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    return rows.crossJoin(F.broadcast(means)).select("pid", *((F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyz"))


def random_keys(spark: SparkSession, n: int, gaussian: bool = False, bits: int = 21, seed: int = 42) -> DataFrame:
    """Keys, uniform or normal around the middle; a normal one outside the range is drawn again, up to eight times (then the middle)."""
    top = float(8**bits)
    if not gaussian:
        return spark.range(n).select(F.least(F.rand(seed) * top, F.lit(top - 1024)).cast("long").alias("key"))
    drawn = F.array(*(F.randn(seed + k) * (top / 5) + top / 2 for k in range(8)))
    fits: Column = F.filter(drawn, lambda v: (v >= 0) & (v < top - 1024))
    return spark.range(n).select(F.coalesce(F.get(fits, 0), F.lit(top / 2)).cast("long").alias("key"))
