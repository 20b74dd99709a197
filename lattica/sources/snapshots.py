"""Snapshots: steps of particle tables with attributes, as Parquet or text; spectra as text; when to write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("x", "y", "z", "h", "vx", "vy", "vz")
SCHEMA = T.StructType([T.StructField("pid", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in FIELDS)])
ATTRIBUTES = T.StructType([T.StructField("step", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("value", T.ArrayType(T.DoubleType()))])
#: From which types an attribute may be read as another: wider ones, and either of the two floating ones.
_WIDER = {"char": {"char", "int", "int64", "double"}, "int": {"int", "int64", "double"}, "unsigned": {"unsigned", "int64", "uint64"}, "int64": {"int64"}, "uint64": {"uint64"}, "float": {"float", "double"}, "double": {"double", "float"}}


def write_step(df: DataFrame, path: str, step: int, attributes: dict[str, tuple[str, list[float]]] | None = None) -> None:
    """Writes a step of particles, in place of one of that number, and its attributes (name: (type, values))."""
    df.write.mode("overwrite").parquet(f"{path}/particles/step={step}")
    rows = [(step, name, kind, [float(v) for v in values]) for name, (kind, values) in (attributes or {}).items()]
    if rows:
        df.sparkSession.createDataFrame(rows, ATTRIBUTES).drop("step").coalesce(1).write.mode("overwrite").parquet(f"{path}/attributes/step={step}")


def write_file_attributes(spark: SparkSession, path: str, attributes: dict[str, tuple[str, list[float]]]) -> None:
    """Attributes of the whole file, in place of earlier ones; their step is null."""
    rows = [(name, kind, [float(v) for v in values]) for name, (kind, values) in attributes.items()]
    spark.createDataFrame(rows, T.StructType(ATTRIBUTES.fields[1:])).coalesce(1).write.mode("overwrite").parquet(f"{path}/attributes/step=__HIVE_DEFAULT_PARTITION__")


def steps(spark: SparkSession, path: str) -> DataFrame:
    """(step, iteration, time) of all steps; null where a step lacks the attribute."""
    listed = spark.read.parquet(f"{path}/particles").select("step").distinct()
    named = spark.read.schema(ATTRIBUTES).parquet(f"{path}/attributes").where("name IN ('iteration', 'time')")
    wide = named.groupBy("step").pivot("name", ["iteration", "time"]).agg(F.first(F.col("value")[0]))
    return listed.join(wide, "step", "left").select("step", F.col("iteration").cast("long").alias("iteration"), "time")


def read_step(spark: SparkSession, path: str, step: int = -1, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The particles of a step, the last one for a negative step; only the step's folder and the given columns are read."""
    df = spark.read.parquet(f"{path}/particles")
    if missing := set(columns or ()) - set(df.columns):
        raise KeyError(f"no field {sorted(missing)}")
    if step < 0:
        step = df.agg(F.max("step")).first()[0]
        if step is None:
            return df.limit(0).drop("step")
    return df.where(F.col("step") == step).select(*(columns or [c for c in df.columns if c != "step"]))


def read_attribute(spark: SparkSession, path: str, step: int, name: str, kind: str, size: int | None = None) -> list[float]:
    """An attribute's values as a type that its own may be read as; KeyError, TypeError or ValueError if there is none such."""
    row = spark.read.schema(ATTRIBUTES).parquet(f"{path}/attributes").where((F.col("step") == step) & (F.col("name") == name)).first()
    if row is None:
        raise KeyError(name)
    if kind not in _WIDER[row["type"]]:
        raise TypeError(f"{name} is {row['type']}, not {kind}")
    if size is not None and size != len(row["value"]):
        raise ValueError(f"{name} has {len(row['value'])} values, not {size}")
    return [v if kind in ("float", "double") else int(v) for v in row["value"]]


def partition_range(parts: int, part: int, n: int) -> tuple[int, int]:
    """First and last (exclusive) row of a part, the first n % parts having one more."""
    small, more = divmod(n, parts)
    first = part * small + min(part, more)
    return first, first + small + (part < more)


def part_of_row(row: Column, parts: int, n: int) -> Column:
    """The part of partition_range() that has a row."""
    small, more = divmod(n, parts)
    edge = more * (small + 1)
    return F.when(row < edge, F.floor(row / (small + 1))).otherwise(more + F.floor((row - edge) / max(1, small))).cast("int")


def text_lines(df: DataFrame, columns: tuple[str, ...], separator: str = " ") -> DataFrame:
    """One string column `value` with the columns' values."""
    return df.select(F.concat_ws(separator, *(F.col(c).cast("string") for c in columns)).alias("value"))


def write_text(df: DataFrame, path: str, columns: tuple[str, ...], order: str) -> None:
    """Rows in order, as part files that follow one another by name."""
    text_lines(df.repartitionByRange(order).sortWithinPartitions(order), columns).write.text(path)


def read_text(lines: DataFrame, columns: tuple[str, ...], rows: int | None = None) -> DataFrame:
    """Double columns from lines of numbers between white space; further numbers are ignored."""
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("p"))
    out = parts.select(*(F.get("p", F.lit(k)).cast("double").alias(c) for k, c in enumerate(columns)))
    return out if rows is None else out.limit(rows)


def spectrum_lines(spec: DataFrame, value: str = "value") -> DataFrame:
    """Lines 'k value' from k = 1 on, in scientific notation."""
    return spec.where("k >= 1").orderBy("k").select(F.format_string("%d %e", F.col("k"), F.col(value)).alias("value"))


def write_spectrum(spec: DataFrame, path: str) -> None:
    spectrum_lines(spec).coalesce(1).write.mode("overwrite").text(path)


def is_extra_output(step: Column, time0: Column, time1: Column, wanted: list[str]) -> Column:
    """Whether a step is listed as a whole number, or a listed time lies in [time0, time1)."""
    out = F.lit(False)
    for w in wanted:
        out = out | ((step == int(w)) if w.lstrip("+-").isdigit() else ((time0 <= float(w)) & (time1 > float(w))))
    return out


def is_output_time(time0: Column, time1: Column, period: float) -> Column:
    """Whether a positive multiple of the period lies in [time0, time1)."""
    if period == 0:
        return F.lit(False)
    at = F.floor(time1 / period) * period
    return F.coalesce((time0 <= at) & (time1 > at) & (at > 0), F.lit(False))


def is_output_step(step: Column, every: str) -> Column:
    """Whether a step is a positive multiple; False unless `every` is a positive whole number."""
    return (step % int(every) == 0) & (step > 0) if every.isdigit() and int(every) else F.lit(False)


def read_all(spark: SparkSession, path: str, step: int = -1, most_rows: int = 1 << 20) -> DataFrame:
    """A step that every task sees as a whole: marked for broadcast, which its counted size must allow."""
    df = read_step(spark, path, step)
    if (n := df.count()) > most_rows:
        raise ValueError(f"{n} particles are too many for every task")
    return F.broadcast(df)


def particle_counts(df: DataFrame) -> DataFrame:
    """(partition, n): the particles of each partition; their sum is the global count."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n"))


def dataset_names(spark: SparkSession, path: str) -> list[str]:
    return [c for c in spark.read.parquet(f"{path}/particles").columns if c != "step"]


def attribute_list(spark: SparkSession, path: str, step: int | None = None) -> DataFrame:
    """(step, name, type, size) of the attributes of a step, or of all; those of the file have a null step."""
    rows = spark.read.schema(ATTRIBUTES).parquet(f"{path}/attributes")
    return (rows if step is None else rows.where(F.col("step") == step)).select("step", "name", "type", F.size("value").alias("size"))


def view(df: DataFrame, order: str, first: int | None = None, last: int | None = None, rows: DataFrame | None = None) -> DataFrame:
    """The rows first .. last (inclusive) of df in an order, or those that rows (row) lists."""
    from lattica.operators.ordering import with_rank

    ranked = with_rank(df, order, ())
    if rows is not None:
        return ranked.join(rows.select(F.col("row").cast("long").alias("rank")).distinct(), "rank", "left_semi").drop("rank")
    return ranked.where(F.col("rank").between(first, last)).drop("rank")


def write_table(df: DataFrame, path: str, kind: str, columns: tuple[str, ...], order: str) -> None:
    """Rows in order as 'parquet', 'csv', 'json', 'hdf5' or 'ascii' (columns between spaces); a path that exists is an error."""
    from lattica.sources.h5part import write_h5part

    rows = df.select(*columns).repartitionByRange(order).sortWithinPartitions(order)
    if kind == "ascii":
        write_text(df, path, columns, order)
    elif kind == "hdf5":
        write_h5part(rows, path, mode="error")
    elif kind in ("parquet", "csv", "json"):
        rows.write.format(kind).save(path)
    else:
        raise NotImplementedError(f"no format {kind!r}")


def read_table(spark: SparkSession, path: str, kind: str, columns: tuple[str, ...]) -> DataFrame:
    """Double columns of what write_table() wrote."""
    from lattica.sources.h5part import read_h5part

    if kind == "ascii":
        return read_text(spark.read.text(path), columns)
    if kind == "hdf5":
        return read_h5part(spark, path, columns=",".join(columns)).select(*(F.col(c).cast("double") for c in columns))
    if kind not in ("parquet", "csv", "json"):
        raise NotImplementedError(f"no format {kind!r}")
    return spark.read.format(kind).schema(", ".join(f"{c} double" for c in columns)).load(path)


def mesh_lines(mesh: DataFrame, grid: int, columns: tuple[str, ...] = ("vx", "vy", "vz"), low: float = -0.5, high: float = 0.5) -> DataFrame:
    """(cell, value): lines 'x y z' and the columns for each cell of a mesh, x to z of its centre."""
    from lattica.functions.geometry import cell_centre
    from lattica.operators.mesh import split_cell

    centre = [cell_centre(c, grid, low, high).cast("string") for c in split_cell(F.col("cell"), grid)]
    return mesh.select("cell", F.concat_ws(" ", *centre, *(F.col(c).cast("string") for c in columns)).alias("value"))
