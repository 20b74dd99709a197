"""Geometry as Column expressions: periodic distances, boxes, opening criteria, the smoothing kernel, frequencies."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]


def min_image(d: Column, length: float = 1.0, periodic: bool = True) -> Column:
    """A difference folded to its nearest periodic image."""
    return d - F.lit(length) * F.rint(d / F.lit(length)) if periodic else d


def fold_into(x: Column, low: float = -0.5, high: float = 0.5) -> Column:
    """x moved by one box length if it lies outside."""
    return F.when(x > high, x - (high - low)).when(x < low, x + (high - low)).otherwise(x)


def dist_sq(a: Triple, b: Triple, length: float = 1.0, periodic: bool = True) -> Column:
    d = [min_image(p - q, length, periodic) for p, q in zip(a, b, strict=True)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def normalize(x: Column, low: float, high: float) -> Column:
    return (x - low) / (high - low)


def ranges_overlap(a: Column, b: Column, c: Column, d: Column, period: int = 0) -> Column:
    """Whether [a, b) and [c, d) overlap, also around a period."""
    plain = lambda s, t: (b + s > c + t) & (d + t > a + s)
    return plain(0, 0) | plain(period, 0) | plain(0, period) if period else plain(0, 0)


def range_separation(a: Column, b: Column, c: Column, d: Column, period: int = 0) -> Column:
    """The gap between [a, b) and [c, d), the shorter way around a period."""
    around = (lambda v: v - period * F.rint(v / float(period))) if period else (lambda v: v)
    return F.when(ranges_overlap(a, b, c, d), 0).otherwise(F.least(F.abs(around(d - a)), F.abs(around(c - b)))).cast("long")


def contained(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether [a, b) lies in [c, d)."""
    return (a >= c) & (b <= d)


def min_distance(a: Triple, a_size: Triple, b: Triple, b_size: Triple | None = None, length: float = 1.0, periodic: bool = False) -> list[Column]:
    """Per axis, the distance between a box (centre, half sizes) and a point or another box."""
    other = b_size or (F.lit(0.0),) * 3
    return [F.greatest(F.abs(min_image(p - q, length, periodic)) - s - t, F.lit(0.0)) for p, q, s, t in zip(a, b, a_size, other, strict=True)]


def boxes_overlap(a: Triple, a_size: Triple, b: Triple, b_size: Triple, length: float = 1.0, periodic: bool = True) -> Column:
    d = [F.abs(min_image(p - q, length, periodic)) < s + t for p, q, s, t in zip(a, b, a_size, b_size, strict=True)]
    return d[0] & d[1] & d[2]


def inv_theta_min(theta: float) -> float:
    return 1 / theta + 0.5


def inv_theta_vector(theta: float) -> float:
    return 1 / theta + math.sqrt(3) / 2


def min_mac_r2(edge: Column, inv_theta: float) -> Column:
    """Squared acceptance radius of a cell with an edge length."""
    return (edge * inv_theta) * (edge * inv_theta)


def vector_mac_r2(edge: Column, offset: Column, inv_theta: float) -> Column:
    """The same around a centre of mass that lies `offset` from the cell's centre."""
    return (edge * inv_theta + offset) * (edge * inv_theta + offset)


def mac_fails(source: Triple, r2: Column, target: Triple, target_size: Triple, length: float = 1.0, periodic: bool = True) -> Column:
    """Whether a target box comes nearer to the source than its acceptance radius."""
    d = min_distance(target, target_size, source, None, length, periodic)
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2] < F.abs(r2)


def min_mac_mutual(separation: Triple, longest: Column, ellipse: tuple[float, float, float]) -> Column:
    """Whether two lattice boxes that far apart are far from each other, the same from either side."""
    e = [s / F.lit(w) for s, w in zip(separation, ellipse, strict=True)]
    return e[0] * e[0] + e[1] * e[1] + e[2] * e[2] > longest * longest


def sph_kernel(r: Column, h: Column) -> Column:
    """The cubic spline with support 2 h, normalised in three dimensions."""
    q, norm = r / h, F.lit(1 / math.pi) / (h * h * h)
    return norm * F.when(q < 1, 1 - 1.5 * q * q + 0.75 * q * q * q).when(q < 2, 0.25 * (2 - q) * (2 - q) * (2 - q)).otherwise(0.0)


def cell_centre(i: Column, grid: int, low: float = -0.5, high: float = 0.5) -> Column:
    return F.lit(low) + (i + 0.5) * F.lit((high - low) / grid)


def fftfreq(i: Column, n: int, d: float = 1.0) -> Column:
    """The frequency of bin i of n, of samples d apart."""
    return F.when(i < (n + 1) // 2, i).otherwise(i - n) / F.lit(n * d)


def block_owner(i: Column, size: int, blocks: int) -> Column:
    """Which of `blocks` holds cell i of `size`, the first size % blocks having one more."""
    small, more = divmod(size, blocks)
    edge = more * (small + 1)
    return F.when(i < edge, F.floor(i / (small + 1))).otherwise(more + F.floor((i - edge) / max(1, small))).cast("int")


def block_index(i: Column, size: int, blocks: int) -> Column:
    """A cell's place within its block."""
    small, more = divmod(size, blocks)
    owner = block_owner(i, size, blocks)
    return (i - owner * small - F.least(owner, F.lit(more))).cast("int")


def widened(low: Column, high: Column, delta: Column, most: int, periodic: bool) -> tuple[Column, Column]:
    """A lattice interval widened by delta on both sides, kept within 0 .. most unless it is periodic."""
    a, b = low - delta, high + delta
    return (a, b) if periodic else (F.greatest(a, F.lit(0)), F.least(b, F.lit(most)))


def halo_box(box: dict[str, Column], radius: Column, length: float = 1.0, periodic: bool = True, bits: int = 21) -> dict[str, Column]:
    """A lattice box (xlo, xhi, ... zhi) widened by a radius, in lattice units rounded up."""
    from lattica.functions.sfc import to_n_bits

    delta, out = to_n_bits(radius / length, bits, up=True), {}
    for c in "xyz":
        out[f"{c}lo"], out[f"{c}hi"] = widened(box[f"{c}lo"], box[f"{c}hi"], delta, 1 << bits, periodic)
    return out


def dot(a: Column, b: Column) -> Column:
    """Of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)


def norm2(a: Column) -> Column:
    return dot(a, a)


def ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("long")


def round_up(a: Column, multiple: int) -> Column:
    return ceil_div(a, multiple) * multiple
