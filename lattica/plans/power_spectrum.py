"""The whole analysis as one plan: particles to mesh, transform, power, shells, normalised spectrum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import mesh as M
from lattica.operators import spectrum as S


def raster(df: DataFrame, grid: int, interpolation: str = "nearest", fill: bool = True) -> DataFrame:
    """A dense velocity mesh; an unknown interpolation means nearest."""
    if interpolation == "sph":
        out = M.raster_sph(df, grid)
        return M.fill_empty(out, grid) if fill else M.dense(out, grid)
    out = M.raster_cell_avg(df, grid) if interpolation == "cell_avg" else M.raster_nearest(df, grid)
    return M.fill_empty(out, grid) if fill else M.dense(out, grid)


def power_spectrum(df: DataFrame, grid: int, shells: int | None = None, field: str = "velocity", interpolation: str = "nearest", fill: bool = True, method: str | None = None, min_count: int | None = None, mass: float = 1.0) -> DataFrame:
    """(k, value) of all shells of a particle table."""
    if field == "velocity":
        mesh, columns = raster(df, grid, interpolation, fill), M.VELOCITY
    elif field == "density":
        mesh, columns = M.dense(M.raster_density(df, grid, mass), grid, ("density",)), ("density",)
    else:
        raise ValueError(f"unknown field {field!r}")
    modes = S.fft3(mesh, grid, columns, method=method or ("dft" if grid <= 16 else "slab"))
    return S.merge_and_normalize(S.shell_average(S.modal_power(modes, grid, columns), grid, shells), grid, shells, min_count)


def default_grid(df: DataFrame) -> int:
    """The cube root of the number of particles, rounded down."""
    n = df.agg(F.count(F.lit(1))).first()[0]
    g = round(n ** (1 / 3))
    return g if g**3 <= n else g - 1
