"""Space-filling-curve keys as Column expressions: lattice coordinates, Morton and Hilbert keys, and octal key algebra.

Keys are BIGINT; a node is (level, key) with the key's low 3 * (bits - level) bits zero. The end of the whole range,
8**21, has no BIGINT; ranges are given by their level instead, and placeholder keys are DECIMAL(20, 0).
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 21

# For each octant (x most significant) the Hilbert digit, which axes are mirrored, and the order of axes after it.
OCTANTS = (
    (0, (0, 0, 0), (2, 1, 0)),
    (1, (0, 0, 0), (1, 2, 0)),
    (3, (0, 1, 1), (0, 1, 2)),
    (2, (0, 0, 0), (1, 2, 0)),
    (7, (1, 0, 1), (2, 1, 0)),
    (6, (1, 1, 0), (1, 2, 0)),
    (4, (0, 1, 1), (0, 1, 2)),
    (5, (1, 1, 0), (1, 2, 0)),
)
# The same for quadrants.
QUADRANTS = ((0, (0, 0), (1, 0)), (1, (0, 0), (0, 1)), (3, (1, 1), (1, 0)), (2, (0, 0), (0, 1)))


@cache
def hilbert_tables(dims: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """Tables over state * 2**dims + octant: digit and next state; and over state * 2**dims + digit: octant and next state.

    A state says which original axis stands in each place and whether it is mirrored.
    """
    rules = OCTANTS if dims == 3 else QUADRANTS
    start = (tuple(range(dims)), (0,) * dims)
    states, digit, after = {start: 0}, [], []
    queue = [start]
    for axes, mirrored in queue:
        for octant in range(1 << dims):
            bits = [(octant >> (dims - 1 - axis)) & 1 for axis in range(dims)]
            local = [bits[axes[p]] ^ mirrored[p] for p in range(dims)]
            d, flip, order = rules[sum(b << (dims - 1 - p) for p, b in enumerate(local))]
            turned = tuple(m ^ f for m, f in zip(mirrored, flip, strict=True))
            new = (tuple(axes[p] for p in order), tuple(turned[p] for p in order))
            if new not in states:
                states[new] = len(states)
                queue.append(new)
            digit.append(d)
            after.append(states[new])
    octant_of, state_of = [0] * len(digit), [0] * len(digit)
    for k, d in enumerate(digit):
        at = (k >> dims << dims) + d
        octant_of[at], state_of[at] = k & ((1 << dims) - 1), after[k]
    return digit, after, octant_of, state_of


def _long(v: int) -> Column:
    return F.lit(v).cast("long")


def _shl(c: Column, n) -> Column:
    return F.call_function("shiftleft", c, n) if isinstance(n, Column) else F.shiftleft(c, n)


def _shr(c: Column, n) -> Column:
    return F.call_function("shiftright", c, n) if isinstance(n, Column) else F.shiftright(c, n)


def lattice(x: Column, low: float = -0.5, high: float = 0.5, bits: int = BITS) -> Column:
    """The lattice coordinate of x in [low, high], clamped to 0 .. 2**bits - 1."""
    scale = (1 << bits) / (high - low)
    raw = F.floor(x * F.lit(scale)).cast("double") - F.lit(low * scale)
    return F.least(F.greatest(raw.cast("long"), _long(0)), _long((1 << bits) - 1))


def to_n_bits(x: Column, bits: int = BITS, up: bool = False) -> Column:
    """x in [0, 1] in units of 2**-bits, rounded down or up, at most 2**bits - 1."""
    scaled = x * F.lit(float(1 << bits))
    return F.least((F.ceil(scaled) if up else F.floor(scaled)).cast("long"), _long((1 << bits) - 1))


def expand_bits(c: Column, up: int = 0) -> Column:
    """The low 21 bits of c at every third place, from place `up` on."""
    c = c.cast("long")
    parts = [_shl(c, 2 * k + up).bitwiseAND(1 << (3 * k + up)) for k in range(BITS)]
    return reduce(Column.bitwiseOR, parts)


def compact_bits(c: Column, up: int = 0) -> Column:
    """The bits at every third place of c, from place `up` on, side by side."""
    return reduce(Column.bitwiseOR, [_shr(c, 2 * k + up).bitwiseAND(1 << k) for k in range(BITS)])


def morton_encode(ix: Column, iy: Column, iz: Column) -> Column:
    return expand_bits(ix, 2).bitwiseOR(expand_bits(iy, 1)).bitwiseOR(expand_bits(iz))


def morton_decode(key: Column) -> Column:
    return F.struct(compact_bits(key, 2).alias("ix"), compact_bits(key, 1).alias("iy"), compact_bits(key).alias("iz"))


def _table(values: list[int], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at)


def _walk(dims: int, bits: int, encode: bool, part) -> Column:
    """Folds the levels from the top: part(level) is the octant or digit there; gives the digits or octants in a row."""
    digit, after, octant, state = hilbert_tables(dims)
    values, following = (digit, after) if encode else (octant, state)

    def step(acc: Column, level: Column) -> Column:
        at = acc["state"] * (1 << dims) + part(level).cast("int")
        return F.struct(_table(following, at).alias("state"), _shl(acc["out"], dims).bitwiseOR(_table(values, at).cast("long")).alias("out"))

    start = F.struct(F.lit(0).alias("state"), _long(0).alias("out"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["out"])


@cache
def hilbert_groups(encode: bool, dims: int = 3) -> list[int]:
    """Over state * 2 ** (3 dims) + three octants (or digits): the state after them * 2 ** (3 dims) + their digits (or octants)."""
    digit, after, octant, state = hilbert_tables(dims)
    values, following = (digit, after) if encode else (octant, state)
    out = []
    for k in range(len(values) >> dims << 3 * dims):
        at, group = k >> 3 * dims, 0
        for shift in (2 * dims, dims, 0):
            step = (at << dims) + (k >> shift & (1 << dims) - 1)
            at, group = following[step], group << dims | values[step]
        out.append(at << 3 * dims | group)
    return out


def _by_groups(code: Column, bits: int, encode: bool, dims: int = 3) -> Column:
    """Morton keys to Hilbert keys, or back: one look-up for three levels. A fold isn't compiled, so the code is its start,
    computed once, and each step looks up once: the state is what the step before found."""
    table = F.expr(f"array({', '.join(map(str, hilbert_groups(encode, dims)))})")  # one call
    width, last_group = 3 * dims, (1 << 3 * dims) - 1

    def step(acc: Column, _: Column) -> Column:
        found = F.get(table, acc["found"].bitwiseAND(-1 - last_group).bitwiseOR(_shr(acc["rest"], 63 - width).bitwiseAND(last_group).cast("int")))
        return F.struct(_shl(acc["rest"], width).alias("rest"), found.alias("found"), _shl(acc["out"], width).bitwiseOR(acc["found"].bitwiseAND(last_group).cast("long")).alias("out"))

    start = F.struct(_shl(code, 63 - dims * bits).alias("rest"), F.lit(0).alias("found"), _long(0).alias("out"))
    last = lambda acc: _shl(acc["out"], width).bitwiseOR(acc["found"].bitwiseAND(last_group).cast("long"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(bits // 3)), start, step, last)


def hilbert_encode(ix: Column, iy: Column, iz: Column, bits: int = BITS) -> Column:
    if bits % 3 == 0:
        # coordinates are computed once, whatever they are
        at = F.array(F.struct(ix.cast("long").alias("ix"), iy.cast("long").alias("iy"), iz.cast("long").alias("iz")))
        return F.transform(at, lambda c: _by_groups(morton_encode(c["ix"], c["iy"], c["iz"]), bits, True))[0]
    bit = lambda c, level: _shr(c.cast("long"), level).bitwiseAND(_long(1))
    return _walk(3, bits, True, lambda level: bit(ix, level) * 4 + bit(iy, level) * 2 + bit(iz, level))


def hilbert_decode(key: Column, bits: int = BITS) -> Column:
    """The lattice coordinates of a Hilbert key: its octants in a row are the Morton key."""
    if bits % 3 == 0:
        return F.transform(F.array(_by_groups(key, bits, False)), morton_decode)[0]
    return morton_decode(_walk(3, bits, False, lambda level: _shr(key, level * 3).bitwiseAND(_long(7))))


def _expand2(c: Column, up: int, bits: int) -> Column:
    """The low bits of c at every second place, from place `up` on."""
    return reduce(Column.bitwiseOR, [_shl(c, k + up).bitwiseAND(1 << (2 * k + up)) for k in range(bits)])


def _compact2(c: Column, up: int, bits: int) -> Column:
    """The bits at every second place of c, from place `up` on, side by side."""
    return reduce(Column.bitwiseOR, [_shr(c, k + up).bitwiseAND(1 << k) for k in range(bits)])


def hilbert2d_encode(ix: Column, iy: Column, bits: int = BITS) -> Column:
    if bits % 3 == 0:
        # coordinates are computed once, whatever they are
        at = F.array(F.struct(ix.cast("long").alias("ix"), iy.cast("long").alias("iy")))
        return F.transform(at, lambda c: _by_groups(_expand2(c["ix"], 1, bits).bitwiseOR(_expand2(c["iy"], 0, bits)), bits, True, 2))[0]
    bit = lambda c, level: _shr(c.cast("long"), level).bitwiseAND(_long(1))
    return _walk(2, bits, True, lambda level: bit(ix, level) * 2 + bit(iy, level))


def hilbert2d_decode(key: Column, bits: int = BITS) -> Column:
    """The lattice coordinates of a 2-D Hilbert key: its quadrants in a row, found once, have the bits of x and y by turns."""
    quadrants = _by_groups(key, bits, False, 2) if bits % 3 == 0 else _walk(2, bits, False, lambda level: _shr(key, level * 2).bitwiseAND(_long(3)))
    return F.transform(F.array(quadrants), lambda c: F.struct(_compact2(c, 1, bits).alias("ix"), _compact2(c, 0, bits).alias("iy")))[0]


def with_sfc_key(df: DataFrame, curve: str = "hilbert", low: float = -0.5, high: float = 0.5, removed: str | None = None) -> DataFrame:
    """df with `key`; where the boolean column `removed` holds, the key is null, which later steps leave out."""
    coordinates = [lattice(F.col(c), low, high) for c in "xyz"]
    key = hilbert_encode(*coordinates) if curve == "hilbert" else morton_encode(*coordinates)
    return df.withColumn("key", F.when(~F.col(removed), key) if removed else key)


# Key algebra ---------------------------------------------------------------------------------------------------------


def node_range(level, bits: int = BITS) -> Column:
    """8**(bits - level), for levels from 1."""
    return _shl(_long(1), (F.lit(bits) - level) * 3)


def pad(prefix: Column, length: int, bits: int = BITS) -> Column:
    """A prefix of `length` bits, moved to the top of a key."""
    return _shl(prefix.cast("long"), 3 * bits - length)


def bit_length(c: Column) -> Column:
    return F.when(c == 0, 0).otherwise(F.length(F.bin(c)))


def log8_ceil(n: Column) -> Column:
    return F.when(n <= 1, 0).otherwise(F.floor((bit_length(n - 1) + 2) / 3)).cast("int")


def is_power_of_8(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0) & ((bit_length(n) - 1) % 3 == 0)


def tree_level(size: Column, bits: int = BITS) -> Column:
    """The level of a node that spans `size` keys."""
    return (bits - F.floor((bit_length(size) - 1) / 3)).cast("int")


def common_prefix(a: Column, b: Column, bits: int = BITS) -> Column:
    """How many leading bits two keys have in common."""
    return (3 * bits - bit_length(a.bitwiseXOR(b))).cast("int")


def octal_digit(key: Column, position, bits: int = BITS) -> Column:
    return _shr(key, (F.lit(bits) - position) * 3).bitwiseAND(_long(7)).cast("int")


def enclosing_box(key: Column, level, bits: int = BITS) -> Column:
    """The key of the node of a level that holds a key."""
    shift = (F.lit(bits) - level) * 3
    return _shl(_shr(key, shift), shift)


def smallest_common_box(a: Column, b: Column, bits: int = BITS) -> Column:
    level = F.floor(common_prefix(a, b, bits) / 3).cast("int")
    return F.struct(level.alias("level"), enclosing_box(a, level, bits).alias("key"))


def is_ancestor(level_a: Column, key_a: Column, level_b: Column, key_b: Column, bits: int = BITS) -> Column:
    """Whether node a is a proper ancestor of node b, or a sibling of one."""
    return (level_a < level_b) & (enclosing_box(key_b, F.greatest(level_a - 1, F.lit(0)), bits) == enclosing_box(key_a, F.greatest(level_a - 1, F.lit(0)), bits))


def last_nonzero_place(key: Column, bits: int = BITS) -> Column:
    """The position of the last octal digit that isn't 0; bits for key 0."""
    zeros = F.bit_count(key.bitwiseAND(-key) - 1)
    return F.when(key == 0, bits).otherwise(bits - F.floor(zeros / 3)).cast("int")


def to_placeholder(key: Column, level, bits: int = BITS) -> Column:
    """The node's prefix behind a leading 1 bit, as DECIMAL(20, 0), since level 21 exceeds BIGINT."""
    prefix = _shr(key, (F.lit(bits) - level) * 3).cast("decimal(20,0)")
    return prefix + F.element_at(F.array(*(F.lit(str(8**k)).cast("decimal(20,0)") for k in range(bits + 1))), level + 1)


def from_placeholder(code: Column, bits: int = BITS) -> Column:
    """(level, key) of a placeholder code."""
    powers = F.array(*(F.lit(str(8**k)).cast("decimal(20,0)") for k in range(bits + 1)))
    level = (F.size(F.filter(powers, lambda p: p <= code)) - 1).cast("int")
    return F.struct(level.alias("level"), _shl((code - F.element_at(powers, level + 1)).cast("long"), (F.lit(bits) - level) * 3).alias("key"))


def node_box(level, key: Column, curve: str = "morton", bits: int = BITS) -> Column:
    """The lattice box of a node: lowest corner and edge."""
    at = hilbert_decode(key, bits) if curve == "hilbert" else morton_decode(key)
    edge = _shl(_long(1), F.lit(bits) - level)
    low = lambda c: c.bitwiseAND(-edge)
    return F.struct(low(at["ix"]).alias("x0"), low(at["iy"]).alias("y0"), low(at["iz"]).alias("z0"), edge.alias("edge"))


def neighbour_key(ix: Column, iy: Column, iz: Column, level: int, dx: int, dy: int, dz: int, curve: str = "morton", bits: int = BITS) -> Column:
    """The key of the cell dx, dy, dz cells of a level away, around a periodic lattice."""
    moved = [F.pmod(c + d * (1 << (bits - level)), _long(1 << bits)) for c, d in ((ix, dx), (iy, dy), (iz, dz))]
    return hilbert_encode(*moved, bits) if curve == "hilbert" else morton_encode(*moved)


def span_runs(df: DataFrame, start: str, stop: str, bits: int = BITS) -> DataFrame:
    """Rows of df with the fewest nodes that cover the keys [start, stop), as runs: (..., level, left, n_left, right, n_right).

    Of each level these are the nodes inside whose parents aren't: up to the first parent that begins at start or after it
    and from the last one that ends at stop or before it, seven at most on either side; where no parent lies between, one
    run from start to stop. left and right are keys, null for an empty run; levels without nodes have no row. Nodes are counted in units of their
    level, which fit into a BIGINT where their ends don't.
    """
    rows = df.where(F.col(start) < F.col(stop)).withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(bits))))
    shift = (F.lit(bits) - F.col("level")) * 3
    a, b = F.col(start), F.col(stop)
    rest = a.bitwiseAND(_shl(_long(1), shift) - 1)
    rows = rows.withColumns({"__f": _shr(a, shift) + (rest != 0).cast("long"), "__l": _shr(b, shift)})
    # the same in units of parents; the root, which ends beyond every stop, isn't inside
    up, down = _shl(_shr(F.col("__f") + 7, 3), 3), _shl(_shr(F.col("__l"), 3), 3)
    parted = (F.col("level") > 1) & (up <= down)
    rows = rows.withColumns({"n_left": F.greatest(F.when(parted, up).otherwise(F.col("__l")) - F.col("__f"), _long(0)), "n_right": F.when(parted, F.col("__l") - down).otherwise(_long(0))})
    rows = rows.where("n_left > 0 OR n_right > 0").withColumns({"left": F.when(F.col("n_left") > 0, _shl(F.col("__f"), shift)), "right": F.when(F.col("n_right") > 0, _shl(down, shift))})
    return rows.drop("__f", "__l")


def span_range(df: DataFrame, start: str, stop: str, bits: int = BITS) -> DataFrame:
    """Rows of df with each of the fewest nodes that cover the keys [start, stop): (..., level, node)."""
    size = _shl(_long(1), (F.lit(bits) - F.col("level")) * 3)
    runs = span_runs(df, start, stop, bits)
    rows = runs.withColumn("__k", F.explode(F.sequence(_long(0), F.col("n_left") + F.col("n_right") - 1)))
    node = F.when(F.col("__k") < F.col("n_left"), F.col("left") + size * F.col("__k")).otherwise(F.col("right") + size * (F.col("__k") - F.col("n_left")))
    return rows.select(*df.columns, "level", node.alias("node"))


def octal_power(position, bits: int = BITS) -> Column:
    """What the octal digit at a position (1 is the first) is worth."""
    return node_range(position, bits)


def make_prefix(key: Column, bits: int = BITS) -> Column:
    """(level, key) of the largest node that begins at a key; the root for key 0."""
    return F.struct(F.when(key == 0, 0).otherwise(last_nonzero_place(key, bits)).alias("level"), key.alias("key"))


def mask_key(key: Column) -> Column:
    """A key marked as such: its complement, which is negative."""
    return F.bitwise_not(key)


def unmask_key(key: Column) -> Column:
    return F.when(is_masked(key), F.bitwise_not(key)).otherwise(key)


def is_masked(key: Column) -> Column:
    return key < 0


def digit_weight(digit: Column) -> Column:
    """Minus the digit for the lower four digits, 7 minus the digit for the upper: what an octal digit adds to the place of an inner node."""
    return F.when(digit < 4, -digit).otherwise(7 - digit).cast("int")


def binary_key_weight(key: Column, level: Column, bits: int = BITS) -> Column:
    """The sum of the weights of a key's digits up to the one after a level."""
    places = F.filter(F.sequence(F.lit(1), F.lit(bits)), lambda p: p <= level + 1)
    return F.aggregate(places, F.lit(0), lambda acc, p: acc + digit_weight(octal_digit(key, p, bits)))


def common_node_prefix(centre: tuple[Column, Column, Column], size: tuple[Column, Column, Column], curve: str = "morton", low: float = -0.5, high: float = 0.5) -> Column:
    """(level, key) of the smallest node that the keys of both far corners of a box (centre, half sizes) have in common."""
    corner = lambda sign: [lattice(c + sign * s, low, high) for c, s in zip(centre, size, strict=True)]
    encode = hilbert_encode if curve == "hilbert" else morton_encode
    return smallest_common_box(encode(*corner(-1)), encode(*corner(1)))
