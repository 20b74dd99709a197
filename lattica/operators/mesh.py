"""Rasters of particles on a regular mesh, dense completion, and filling of empty cells.

A mesh has G**3 cells, cell = i + G * j + G * G * k. Cells of particles come from lattice coordinates by an integer
divisor (binning 'lattice') or from positions ('geometric').
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.geometry import cell_centre
from lattica.functions.sfc import BITS, lattice
from lattica.plans.held import held

VELOCITY = ("vx", "vy", "vz")


def mesh_cell(df: DataFrame, grid: int, binning: str = "lattice", low: float = -0.5, high: float = 0.5) -> DataFrame:
    """df with i, j, k and cell."""
    if binning not in ("lattice", "geometric"):
        raise ValueError(f"binning {binning!r}")
    divisor = 1 + (1 << BITS) // grid
    for name, c in zip("ijk", "xyz", strict=True):
        if binning == "lattice":
            index = F.floor(lattice(F.col(c), low, high) / divisor)
        else:
            index = F.least(F.greatest(F.floor((F.col(c) - low) / ((high - low) / grid)), F.lit(0)), F.lit(grid - 1))
        df = df.withColumn(name, index.cast("long"))
    return df.withColumn("cell", F.col("i") + grid * F.col("j") + grid * grid * F.col("k"))


def split_cell(cell: Column, grid: int) -> tuple[Column, Column, Column]:
    return cell % grid, F.floor(cell / grid) % grid, F.floor(cell / (grid * grid))


def dense(mesh: DataFrame, grid: int, columns: tuple[str, ...] = VELOCITY) -> DataFrame:
    """All cells of the mesh, with 0 where it has none, and `filled`."""
    every = mesh.sparkSession.range(grid**3).withColumnRenamed("id", "cell")
    rows = every.join(mesh.select("cell", *columns, F.lit(True).alias("filled")), "cell", "left")
    return rows.select("cell", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in columns), F.coalesce("filled", F.lit(False)).alias("filled"))


def raster_cell_avg(df: DataFrame, grid: int, binning: str = "lattice") -> DataFrame:
    """Mean velocity of each cell that has particles."""
    rows = mesh_cell(df, grid, binning).groupBy("cell").agg(*(F.sum(c).alias(c) for c in VELOCITY), F.count(F.lit(1)).alias("n"))
    return rows.select("cell", *((F.col(c) / F.col("n")).alias(c) for c in VELOCITY), "n")


def raster_density(df: DataFrame, grid: int, mass: float = 1.0, binning: str = "lattice") -> DataFrame:
    """Mass per volume of each cell that has particles; a column m, where there is one, is each particle's mass."""
    own = F.col("m") if "m" in df.columns else F.lit(mass)
    return mesh_cell(df, grid, binning).groupBy("cell").agg((F.sum(own) * float(grid**3)).alias("density"))


def raster_nearest(df: DataFrame, grid: int, ties: tuple[str, ...] = ("pid",), binning: str = "lattice") -> DataFrame:
    """Velocity of each cell's particle nearest to its centre; `ties` order equals."""
    rows = mesh_cell(df, grid, binning)
    d = [F.col(c) - cell_centre(F.col(i), grid) for c, i in zip("xyz", "ijk", strict=True)]
    best = F.min(F.struct((d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("d2"), *ties, *VELOCITY))
    return rows.groupBy("cell").agg(best.alias("b")).select("cell", *(F.col(f"b.{c}").alias(c) for c in VELOCITY), F.col("b.d2").alias("d2"))


def _kernel_sums(grid: int, low: float, high: float):
    """Over Arrow batches of x, y, z, h and velocities: (cell, w, velocities times w), summed over each batch; null without any value."""
    width = (high - low) / grid

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            value = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            h = np.fmin(value["h"], width)
            reach, ends, fits = 2 * h / width, {}, np.ones(len(h), bool)
            for c in "xyz":
                at = (value[c] - low) / width - 0.5
                ends[c] = np.maximum(np.ceil(at - reach), 0), np.minimum(np.floor(at + reach), grid - 1)
                fits &= ends[c][0] <= ends[c][1]
            fits = np.flatnonzero(fits)
            if not len(fits):
                continue
            h, index, square = h[fits], [], []
            for c in "xyz":
                first, last = (e[fits] for e in ends[c])
                near = first[:, None] + np.arange(int((last - first).max()) + 1)
                d = np.where(near <= last[:, None], value[c][fits][:, None] - (low + (near + 0.5) * width), np.inf)
                index.append(near.astype(np.int64))
                square.append(d * d)
            d2 = square[0][:, :, None, None] + square[1][:, None, :, None] + square[2][:, None, None, :]
            row, i, j, k = np.nonzero(d2 < ((2 * h) * (2 * h))[:, None, None, None])
            hr = h[row]
            q = np.sqrt(d2[row, i, j, k]) / hr
            w = (1 / np.pi) / (hr * hr * hr) * np.where(q < 1, 1 - 1.5 * q * q + 0.75 * q * q * q, np.where(q < 2, 0.25 * (2 - q) * (2 - q) * (2 - q), 0.0))
            some = np.flatnonzero(w > 0)
            row, w = row[some], w[some]
            cells, own = np.unique(index[0][row, i[some]] + grid * index[1][row, j[some]] + grid * grid * index[2][row, k[some]], return_inverse=True)
            out = [pa.array(cells), pa.array(np.bincount(own, w, len(cells)))]
            for c in VELOCITY:
                known = batch.column(c).is_valid().to_numpy(zero_copy_only=False)[fits][row]
                sums = np.bincount(own, np.where(known, w * value[c][fits][row], 0.0), len(cells))
                out.append(pa.array(sums, mask=np.bincount(own, known, len(cells)) == 0))
            yield pa.RecordBatch.from_arrays(out, names=["cell", "w", *VELOCITY])

    return run


def raster_sph(df: DataFrame, grid: int, fill: bool = False, low: float = -0.5, high: float = 0.5) -> DataFrame:
    """Kernel-weighted mean velocity of each cell that a particle reaches; smoothing lengths are at most a cell's width.

    A particle reaches at most five cells along each axis, at most 2 h from it; the mesh isn't periodic. Tasks sum over their particles, so
    no row is made for a particle and a cell.
    """
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "h", *VELOCITY)))
    sums = rows.mapInArrow(_kernel_sums(grid, low, high), "cell long, w double, " + ", ".join(f"{c} double" for c in VELOCITY))
    out = sums.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("w", *VELOCITY)))
    out = out.select("cell", *((F.col(c) / F.col("w")).alias(c) for c in VELOCITY), "w")
    return fill_empty(out, grid) if fill else out


def fill_empty(mesh: DataFrame, grid: int, columns: tuple[str, ...] = VELOCITY) -> DataFrame:
    """All cells; empty ones get the mean of those of their 26 neighbours that the given mesh has, else 0.

    Either the empty cells ask their neighbours, or the filled cells tell theirs, whichever are fewer.
    """
    mesh = held(mesh.select("cell", *columns))
    asking = 2 * mesh.count() > grid**3
    full = dense(mesh, grid, columns)
    i, j, k = split_cell(F.col("cell"), grid)
    at = full.where("NOT filled" if asking else "filled").select(F.col("cell").alias("own"), *([] if asking else columns), i.alias("i"), j.alias("j"), k.alias("k"))
    step = F.array(*map(F.lit, (-1, 0, 1)))
    for c in "ijk":
        at = at.withColumn(f"d{c}", F.explode(step)).withColumn(c, F.col(c) + F.col(f"d{c}")).where(f"{c} BETWEEN 0 AND {grid - 1}")
    at = at.where("di != 0 OR dj != 0 OR dk != 0").withColumn("cell", F.col("i") + grid * F.col("j") + grid * grid * F.col("k"))
    met = at.select("own", "cell").join(mesh, "cell").groupBy(F.col("own").alias("cell")) if asking else at.groupBy("cell")
    got = met.agg(*(F.sum(c).alias(f"s_{c}") for c in columns), F.count(F.lit(1)).alias("n"))
    rows = full.join(got, "cell", "left")
    value = lambda c: F.when(F.col("filled"), F.col(c)).otherwise(F.coalesce(F.col(f"s_{c}") / F.col("n"), F.lit(0.0)))
    return rows.select("cell", *(value(c).alias(c) for c in columns), "filled")


def nearest_global(df: DataFrame, grid: int, low: float = -0.5, high: float = 0.5) -> DataFrame:
    """For each node of a grid with both ends, the particle nearest to it anywhere: cell, pid, d2; no rows without particles."""
    from lattica.operators.leaf_search import nearest_point

    width = (high - low) / max(1, grid - 1)
    at = [(F.lit(low) + c * width).alias(f"p{n}") for n, c in zip("xyz", split_cell(F.col("point"), grid), strict=True)]
    nodes = df.sparkSession.range(grid**3).withColumnRenamed("id", "point").select("point", *at)
    return nearest_point(df, nodes).withColumnRenamed("point", "cell")
