"""Coordinate boxes: three pairs of limits, each axis periodic or not, from which keys, node boxes and distances follow."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.geometry import Triple, min_image
from lattica.functions.sfc import BITS, _long, _shl, hilbert_decode, hilbert_encode, lattice, morton_decode, morton_encode

AXES = "xyz"


@dataclass(frozen=True)
class Box:
    low: tuple[float, float, float] = (-0.5, -0.5, -0.5)
    high: tuple[float, float, float] = (0.5, 0.5, 0.5)
    periodic: tuple[bool, bool, bool] = (True, True, True)

    def lengths(self) -> tuple[float, ...]:
        return tuple(h - s for s, h in zip(self.low, self.high, strict=True))

    def around(self, df: DataFrame, fixed: tuple[bool, bool, bool] = (False, False, False), shrink: float | None = None) -> Box:
        """The box of the coordinates in df; periodic and fixed axes keep this box's limits, and with `shrink` the others
        move inwards by that share of their length at most. An axis without extent gets the smallest one around it."""
        keep = [p or f for p, f in zip(self.periodic, fixed, strict=True)]
        if all(keep):
            return self
        found = df.agg(*(f(c).alias(f"{c}{n}") for c in AXES for f, n in ((F.min, "min"), (F.max, "max")))).first()
        low, high = list(self.low), list(self.high)
        for k, c in enumerate(AXES):
            if keep[k] or found[f"{c}min"] is None:
                continue
            a, b = found[f"{c}min"], found[f"{c}max"]
            if shrink is not None:
                a, b = min(a, low[k] + shrink * (high[k] - low[k])), max(b, high[k] - shrink * (high[k] - low[k]))
            if a == b:
                a, b = a - max(1e-9, abs(a) * 1e-9), b + max(1e-9, abs(b) * 1e-9)
            low[k], high[k] = a, b
        return replace(self, low=tuple(low), high=tuple(high))

    def cells(self) -> list[Column]:
        """The lattice coordinates of x, y and z."""
        return [lattice(F.col(c), a, b) for c, a, b in zip(AXES, self.low, self.high, strict=True)]

    def with_key(self, df: DataFrame, curve: str = "morton") -> DataFrame:
        return df.withColumn("key", (hilbert_encode if curve == "hilbert" else morton_encode)(*self.cells()))

    def image(self, d: Column, axis: int) -> Column:
        """A difference along an axis, folded to its nearest image where that axis is periodic."""
        return min_image(d, self.high[axis] - self.low[axis], self.periodic[axis])

    def fold(self, df: DataFrame) -> DataFrame:
        """df with coordinates of periodic axes moved into the box by whole lengths."""
        wrap = lambda k, c: self.low[k] + F.pmod(F.col(c) - self.low[k], F.lit(self.high[k] - self.low[k]))
        return df.withColumns({c: wrap(k, c) for k, c in enumerate(AXES) if self.periodic[k]})

    def node_boxes(self, nodes: DataFrame, curve: str = "morton") -> DataFrame:
        """nodes (level, key, ...) with centre gx, gy, gz and half sizes sx, sy, sz."""
        at = hilbert_decode(F.col("key")) if curve == "hilbert" else morton_decode(F.col("key"))
        rows = nodes.withColumns({"__at": at, "__e": _shl(_long(1), F.lit(BITS) - F.col("level"))})
        corner = lambda c: F.col(f"__at.i{c}").bitwiseAND(-F.col("__e"))
        unit = [n / (1 << BITS) for n in self.lengths()]
        centre = {f"g{c}": F.lit(self.low[k]) + (corner(c) + F.col("__e") * 0.5) * unit[k] for k, c in enumerate(AXES)}
        return rows.withColumns(centre | {f"s{c}": F.col("__e") * (0.5 * unit[k]) for k, c in enumerate(AXES)}).drop("__at", "__e")

    def gap2(self, point: Triple, centre: Triple, size: Triple) -> Column:
        """The squared distance of a point and a box (centre, half sizes)."""
        d = [F.greatest(F.abs(self.image(c - p, k)) - s, F.lit(0.0)) for k, (p, c, s) in enumerate(zip(point, centre, size, strict=True))]
        return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]

    def overlap(self, a: Triple, a_size: Triple, b: Triple, b_size: Triple) -> Column:
        d = [F.abs(self.image(q - p, k)) < s + t for k, (p, q, s, t) in enumerate(zip(a, b, a_size, b_size, strict=True))]
        return d[0] & d[1] & d[2]

    def integer_box(self, centre: Triple, size: Triple) -> dict[str, Column]:
        """The lattice box around a box (centre, half sizes): rounded down below, up above; outside 0 .. 2**21 where it hangs over."""
        out = {}
        for k, c in enumerate(AXES):
            scale = (1 << BITS) / (self.high[k] - self.low[k])
            out[f"{c}lo"] = F.floor((centre[k] - size[k] - self.low[k]) * scale).cast("long")
            out[f"{c}hi"] = F.ceil((centre[k] + size[k] - self.low[k]) * scale).cast("long")
        return out

    def contained(self, box: dict[str, Column], first: Column, last: Column) -> Column:
        """Whether all Morton keys of a lattice box (xlo, xhi, ...) lie in first .. last: those of its lowest and highest corner do.

        A box that hangs over the edges of the lattice doesn't.
        """
        low, high = morton_encode(*(box[f"{c}lo"] for c in AXES)), morton_encode(*(box[f"{c}hi"] - 1 for c in AXES))
        inside = [(box[f"{c}lo"] >= 0) & (box[f"{c}hi"] <= 1 << BITS) for c in AXES]
        return inside[0] & inside[1] & inside[2] & (low >= first) & (high <= last)


def wrapped(i: Column, period: int) -> Column:
    """i moved into 0 .. period - 1."""
    return F.pmod(i, F.lit(period))


def near_image(i: Column, period: int) -> Column:
    """A difference of lattice coordinates, at most period in size, moved into -period/2 + 1 .. period/2."""
    up = F.when(i <= -(period // 2), i + period).otherwise(i)
    return F.when(up > period // 2, up - period).otherwise(up)
