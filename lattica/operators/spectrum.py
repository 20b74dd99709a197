"""Fourier transforms of meshes and shell-averaged power spectra."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.mesh import VELOCITY, split_cell

MIN_BIN_COUNT = 64


def _frequency(i: Column, grid: int) -> Column:
    return F.when(i < (grid + 1) // 2, i).otherwise(i - grid)


def dft3(mesh: DataFrame, grid: int, columns: tuple[str, ...] = VELOCITY, inverse: bool = False) -> DataFrame:
    """The unscaled transform of a dense mesh, cell and <c>_re, <c>_im, axis by axis with sums over grouped rows.

    Each axis multiplies the rows by the grid's size; for grids beyond 32 fft3() is the way.
    """
    sign = 1 if inverse else -1
    i, j, k = split_cell(F.col("cell"), grid)
    at = mesh.select(i.cast("int").alias("a0"), j.cast("int").alias("a1"), k.cast("int").alias("a2"), *(x for c in columns for x in (F.col(c).cast("double").alias(f"{c}_re"), (F.col(f"{c}_im") if f"{c}_im" in mesh.columns else F.lit(0.0)).alias(f"{c}_im"))))
    turns = [(math.cos(2 * math.pi * n / grid), math.sin(2 * math.pi * n / grid)) for n in range(grid)]
    cos, sin = (F.array(*(F.lit(t[p]) for t in turns)) for p in (0, 1))
    for axis in ("a0", "a1", "a2"):
        rest = [a for a in ("a0", "a1", "a2") if a != axis]
        rows = at.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
        rows = rows.withColumn("n", (F.col("f") * F.col(axis)) % grid).withColumns({"c": F.get(cos, F.col("n")), "s": sign * F.get(sin, F.col("n"))})
        re = [F.sum(F.col(f"{v}_re") * F.col("c") - F.col(f"{v}_im") * F.col("s")).alias(f"{v}_re") for v in columns]
        im = [F.sum(F.col(f"{v}_re") * F.col("s") + F.col(f"{v}_im") * F.col("c")).alias(f"{v}_im") for v in columns]
        at = rows.groupBy(*rest, F.col("f").alias(axis)).agg(*re, *im)
    return at.select((F.col("a0") + grid * F.col("a1") + F.lit(grid * grid).cast("long") * F.col("a2")).cast("long").alias("cell"), *(f"{v}_{p}" for v in columns for p in ("re", "im")))


def fft3(mesh: DataFrame, grid: int, columns: tuple[str, ...] = VELOCITY, inverse: bool = False, scale: str = "none", method: str = "slab") -> DataFrame:
    """The transform of a dense mesh by dense planes or pencils: cell and <c>_re, <c>_im.

    slab: whole z-planes are transformed in two axes and then, after one shuffle, pencils along z. pencil: one axis at
    a time, with a shuffle for each, so that a task never holds more than pencils. scale: none, full (1 / G**3 on both
    ways) or symmetric.
    """
    if method == "dft":
        out = dft3(mesh, grid, columns, inverse)
    else:
        out = mesh.select("cell", *(x for c in columns for x in ((F.col(c) if c in mesh.columns else F.col(f"{c}_re")).cast("double").alias(f"{c}_re"), (F.col(f"{c}_im") if f"{c}_im" in mesh.columns else F.lit(0.0)).alias(f"{c}_im"))))
        if method == "slab":
            out = _along(out, grid, columns, ((0, 1),), inverse)
        elif method == "pencil":
            out = _along(_along(out, grid, columns, ((0,),), inverse), grid, columns, ((1,),), inverse)
        else:
            raise ValueError(f"method {method!r}")
        out = _along(out, grid, columns, ((2,),), inverse)
    factor = {"none": 1.0, "full": grid**-3.0, "symmetric": grid**-1.5}[scale]
    return out if factor == 1 else out.select("cell", *((F.col(f"{c}_{p}") * factor).alias(f"{c}_{p}") for c in columns for p in ("re", "im")))


def _along(rows: DataFrame, grid: int, columns: tuple[str, ...], axes: tuple[tuple[int, ...], ...], inverse: bool) -> DataFrame:
    """Transforms along some axes: rows of equal other indices meet in one task, sorted, and are transformed at once."""
    own = axes[0]
    index = split_cell(F.col("cell"), grid)
    rest = [a for a in range(3) if a not in own]
    group = sum((index[a] * grid**p for p, a in enumerate(rest)), F.lit(0).cast("long"))
    place = sum((index[a] * grid**p for p, a in enumerate(own)), F.lit(0).cast("long"))
    keyed = rows.withColumns({"__g": group.cast("long"), "__p": place.cast("long")}).repartition("__g").sortWithinPartitions("__g", "__p")
    each = grid ** len(own)
    names = [f"{c}_{p}" for c in columns for p in ("re", "im")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= max(each, 1 << 15):
                table = pa.Table.from_batches(held)
                whole = size // each * each
                yield from transformed(table.slice(0, whole))
                held, size = table.slice(whole).to_batches(), size - whole
        if size:
            yield from transformed(pa.Table.from_batches(held))

    def transformed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows % each:
            raise ValueError("the mesh isn't dense")
        shape = (-1, *(grid,) * len(own))
        out = [table.column("cell").combine_chunks()]
        for c in columns:
            value = (table.column(f"{c}_re").to_numpy() + 1j * table.column(f"{c}_im").to_numpy()).reshape(shape)
            over = tuple(range(1, len(shape)))
            value = (np.fft.ifftn(value, axes=over, norm="forward") if inverse else np.fft.fftn(value, axes=over)).ravel()
            out += [pa.array(value.real), pa.array(value.imag)]
        yield from pa.Table.from_arrays([a.chunk(0) if isinstance(a, pa.ChunkedArray) and a.num_chunks else a for a in out], ["cell", *names]).to_batches()

    return keyed.select("cell", *names).mapInArrow(run, "cell bigint, " + ", ".join(f"{n} double" for n in names))


def modal_power(modes: DataFrame, grid: int, columns: tuple[str, ...] = VELOCITY) -> DataFrame:
    """(cell, power): the sum over columns of |F|**2 / G**6."""
    norm = float(grid**3)
    parts = [(F.col(f"{c}_{p}") / norm) * (F.col(f"{c}_{p}") / norm) for c in columns for p in ("re", "im")]
    return modes.select("cell", sum(parts[1:], parts[0]).alias("power"))


def mode_number(grid: int) -> Column:
    """The squared wave number of a cell."""
    k = [_frequency(i, grid) for i in split_cell(F.col("cell"), grid)]
    return (k[0] * k[0] + k[1] * k[1] + k[2] * k[2]).cast("long")


def shell_average(power: DataFrame, grid: int, shells: int | None = None) -> DataFrame:
    """(k, ps, n): sum and number of modes of each shell; the last shell has all further modes too."""
    last = (shells or grid // 2) - 1
    shell = F.least(F.round(F.sqrt(mode_number(grid).cast("double"))).cast("int"), F.lit(last))
    return power.groupBy(shell.alias("k")).agg(F.sum("power").alias("ps"), F.count(F.lit(1)).alias("n"))


def merge_and_normalize(spec: DataFrame, grid: int, shells: int | None = None, min_count: int | None = None) -> DataFrame:
    """(k, value) for each shell, neighbours being merged from the left while they have modes, but too few.

    spec is as small as the number of shells; one ordered pass gives each shell the number of its group.
    """
    shells, least = shells or grid // 2, min_count or max(1, int(os.environ.get("PS_MIN_BIN_COUNT", MIN_BIN_COUNT)))
    every = spec.sparkSession.range(shells).select(F.col("id").cast("int").alias("k")).join(spec, "k", "left").select("k", F.coalesce("ps", F.lit(0.0)).alias("ps"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    row = every.agg(F.sort_array(F.collect_list(F.struct("k", "ps", "n"))).alias("s"))
    start = F.struct(F.lit(-1).alias("g"), F.lit(0).cast("long").alias("c"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        joins = (acc["c"] > 0) & (acc["c"] < least)
        g = F.when(joins, acc["g"]).otherwise(acc["g"] + 1)
        return F.struct(g.alias("g"), (F.when(joins, acc["c"]).otherwise(0) + x["n"]).alias("c"), F.concat(acc["out"], F.array(g)).alias("out"))

    groups = row.select(F.posexplode(F.aggregate("s", start, step, lambda acc: acc["out"])).alias("at", "g"), "s").select("g", F.get("s", F.col("at")).alias("x")).select("g", "x.*")
    f = _frequency(F.least(F.col("k"), F.lit(grid - 1)), grid).cast("double")
    own = Window.partitionBy("g")
    total, count, k2 = F.sum("ps").over(own), F.sum("n").over(own), F.sum(f * f * F.col("n")).over(own)
    return groups.select("k", F.when(count > 0, total / count * F.lit(4 * math.pi) * (k2 / count)).otherwise(0.0).alias("value"))


def script_shell_average(power: DataFrame, grid: int) -> DataFrame:
    """(k, ps, n, value): every mode in the nearest shell up to G / 2, unmerged; shells 0 < k < G / 2."""
    shell = F.least(F.round(F.sqrt(mode_number(grid).cast("double"))).cast("int"), F.lit(grid // 2))
    rows = power.groupBy(shell.alias("k")).agg(F.sum("power").alias("ps"), F.count(F.lit(1)).alias("n")).where(f"k > 0 AND k < {grid // 2}")
    return rows.withColumn("value", F.col("ps") * F.lit(4 * math.pi) * F.col("k") * F.col("k") / F.col("n"))


def field_stats(mesh: DataFrame, columns: tuple[str, ...] = VELOCITY) -> DataFrame:
    """(column, total, l2, most): sum, Euclidean norm and largest absolute value."""
    long = mesh.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("e")).select("e.*")
    return long.groupBy("column").agg(F.sum("v").alias("total"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l2"), F.max(F.abs("v")).alias("most"))


def kolmogorov_line(spec: DataFrame, anchor: float = 1.0) -> DataFrame:
    """spec (k, ...) with the reference line anchor * k**(-5/3), for k > 0."""
    return spec.where("k > 0").withColumn("slope", F.lit(anchor) * F.pow(F.col("k").cast("double"), F.lit(-5 / 3)))


def overlay(spectra: dict[str, DataFrame]) -> DataFrame:
    """Spectra (k, value) under one another with a label, each without its last two rows."""
    out = None
    for label, spec in spectra.items():
        last = spec.agg(F.max("k")).first()[0] or 0
        part = spec.where(F.col("k") <= last - 2).select(F.lit(label).alias("label"), "k", "value")
        out = part if out is None else out.unionByName(part)
    return out


def kolmogorov_field(spark, grid: int) -> DataFrame:
    """(cell, vx, vy, vz): the real part of the inverse transform of amplitudes |kx + ky + kz|**(-5/6), alike in all components."""
    rows = spark.range(grid**3).withColumnRenamed("id", "cell")
    k = [_frequency(i, grid) for i in split_cell(F.col("cell"), grid)]
    s = F.abs(k[0] + k[1] + k[2]).cast("double")
    field = fft3(rows.select("cell", F.when(s > 0, F.pow(s, F.lit(-5 / 6))).otherwise(0.0).alias("a")), grid, ("a",), inverse=True, scale="full")
    return field.select("cell", *(F.col("a_re").alias(c) for c in VELOCITY))
