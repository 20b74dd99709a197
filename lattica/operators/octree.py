"""Octrees over keys as tables of nodes (level, key), built in closed form from counts of prefixes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.sfc import BITS, _long, _shl, _shr, enclosing_box, node_range, octal_digit, span_range
from lattica.operators.ordering import with_running
from lattica.plans.held import held


#: Levels that one pass over the keys counts.
STEP = 5
#: Tables of up to so many narrow rows, counted first, may be broadcast: 16 MB at 64 bytes a row.
BROADCAST_ROWS = 1 << 18
#: Trees of fewer leaves are looked up at all their levels.
SMALL_TREE = 1 << 13


def level_counts(keys: DataFrame, above: int, deepest: int) -> DataFrame:
    """(level, key, count) of all nodes with keys at the levels above + 1 .. deepest: one shuffle of partial counts of cells, then sums upwards."""
    cells = keys.groupBy(enclosing_box(F.col("key"), deepest).alias("key")).agg(F.count(F.lit(1)).alias("count"))
    rows = cells.withColumn("level", F.explode(F.sequence(F.lit(above + 1), F.lit(deepest))))
    return rows.groupBy("level", enclosing_box(F.col("key"), F.col("level")).alias("key")).agg(F.sum("count").alias("count"))


def children(nodes: DataFrame) -> DataFrame:
    """(level, key) of the eight children of each node."""
    rows = nodes.select((F.col("level") + 1).alias("level"), F.col("key").alias("parent"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("digit"))
    return rows.select("level", (F.col("parent") + node_range(F.col("level")) * F.col("digit")).alias("key"), "parent")


def build_octree(keys: DataFrame, bucket: int, deepest: int = BITS) -> DataFrame:
    """(level, key, count) of the leaves: a node is divided if it has more than bucket keys, so its children, also empty ones, are nodes.

    Levels are counted a few at a time, from the root on: STEP at first, then as many as the fullest node needs if its keys
    spread evenly, and more each time that they don't. After the first time only keys in nodes that are still too full are looked at again.
    """
    keys = held(keys.where(F.col("key").isNotNull()).select("key"))  # what makes them is worked out once
    above, to, out, rounds = 0, min(STEP, deepest), None, 0
    full = keys.sparkSession.range(1).select(F.lit(0).alias("level"), _long(0).alias("key"))
    while True:
        counts = held(level_counts(keys, above, to))
        if not above:
            total = counts.where("level = 1").agg(F.sum("count")).first()[0] or 0
            if total <= bucket:
                return full.withColumn("count", _long(total))
            before = total
        divided = full.unionByName(counts.where((F.col("count") > bucket) & (F.col("level") < to)).select("level", "key"))
        nodes = children(divided).select("level", "key").join(counts, ["level", "key"], "left")
        nodes = held(nodes.select("level", "key", F.coalesce("count", F.lit(0)).cast("long").alias("count")))
        leaves = nodes.where((F.col("count") <= bucket) | (F.col("level") == deepest))
        out = leaves if out is None else out.unionByName(leaves)
        full = nodes.where((F.col("count") > bucket) & (F.col("level") == to))
        n, left, most = full.agg(F.count(F.lit(1)), F.sum("count"), F.max("count")).first()
        if to == deepest or not n:
            return out
        full = full.select("level", "key")
        # prefixes as small numbers: a broadcast's hash of a single BIGINT puts multiples of a high power of two into a few slots
        prefix = _shr(F.col("key"), 3 * (BITS - to)).alias("cell")
        cell = full.select(prefix)
        keys = keys.select("key", prefix).join(F.broadcast(cell) if n <= BROADCAST_ROWS else cell, "cell", "left_semi").select("key")
        if left < before / 2:  # most are done with: the others by themselves
            keys, before = held(keys), left
        above, rounds = to, rounds + 1
        to = min(above + max(_levels(most, bucket), min(STEP, 1 << (rounds - 1))), deepest)


def _levels(most: int, bucket: int) -> int:
    """After how many levels nodes of most keys have at most about bucket, if these spread evenly."""
    n = 1
    while n < STEP and most > bucket * 8**n:
        n += 1
    return n


def node_counts(leaves: DataFrame, keys: DataFrame, most: int | None = None) -> DataFrame:
    """Leaves (level, key) with how many keys each has, at most `most`."""
    leaves = held(leaves.select("level", "key"))
    found = leaf_lookup(leaves, keys).groupBy("level", "leaf").agg(F.count(F.lit(1)).alias("count")).withColumnRenamed("leaf", "key")
    count = F.coalesce("count", F.lit(0)).cast("long")
    return leaves.join(found, ["level", "key"], "left").select("level", "key", (F.least(count, F.lit(most)) if most else count).alias("count"))


def leaf_lookup(leaves: DataFrame, keys: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows of keys with the leaf that holds each, and what columns `more` of the leaves it has: (..., level, leaf, more). Leaves are
    dyadic, so this is an equi-join per level that exists; up to BROADCAST_ROWS leaves are broadcast, so that keys aren't shuffled. In a
    large tree a key only tries the levels that leaves have in its cell, or, where these are larger than a cell, above it."""
    leaves = held(leaves.select("level", F.col("key").alias("leaf"), *more))
    levels = dict(tuple(r) for r in leaves.groupBy("level").agg(F.count(F.lit(1))).collect())
    side, at = F.broadcast(leaves) if sum(levels.values()) <= BROADCAST_ROWS else leaves, _cell_level(levels)
    level = F.lit(next(iter(levels), 0)) if len(levels) < 2 else F.explode(F.array(*map(F.lit, sorted(levels))))
    if at:
        cell = lambda key: _shr(F.col(key), 3 * (BITS - at)).alias("__cell")
        local = leaves.where(F.col("level") >= at).groupBy(cell("leaf")).agg(F.collect_set("level").alias("__levels"))
        keys = keys.withColumn("__cell", cell("key")).join(F.broadcast(local), "__cell", "left")
        above = F.array(*(F.lit(k) for k in sorted(levels) if k < at)).cast("array<int>")
        level = F.explode(F.coalesce("__levels", above))
    tried = keys.withColumn("level", level).drop("__cell", "__levels").withColumn("leaf", enclosing_box(F.col("key"), F.col("level")))
    return tried.join(side, ["level", "leaf"], "inner" if more else "left_semi")


def _cell_level(levels: dict[int, int]) -> int:
    """The level of cells for leaf_lookup() in a tree with so many leaves by level: the middle one, or above it, so that cells can be broadcast; 0 for small trees."""
    total = sum(levels.values())
    if len(levels) < 3 or total < SMALL_TREE:
        return 0
    at = next(k for k in sorted(levels) if 2 * sum(n for m, n in levels.items() if m <= k) >= total)
    while at and min(8**at, sum(n for m, n in levels.items() if m >= at)) > BROADCAST_ROWS:
        at -= 1
    return at


def few_cells(leaves: DataFrame) -> int | None:
    """The deepest level of leaves (level, count), where its cells that hold keys are at most a quarter as many as the keys; else None."""
    if "count" not in leaves.columns:
        return None
    deepest = leaves.agg(F.max("level")).first()[0] or 0
    most, total = leaves.agg(F.sum(F.least(F.col("count").cast("double"), F.pow(F.lit(8.0), deepest - F.col("level")))), F.sum("count")).first()
    return deepest if 4 * (most or 0) <= (total or 0) else None


def all_nodes(leaves: DataFrame) -> DataFrame:
    """(level, key, is_leaf, parent) of the leaves and all their ancestors."""
    up = leaves.withColumn("up", F.explode(F.sequence(F.lit(0), F.col("level"))))
    rows = up.groupBy(F.col("up").alias("level"), enclosing_box(F.col("key"), F.col("up")).alias("key")).agg(F.max(F.col("up") == F.col("level")).alias("is_leaf"))
    return rows.withColumn("parent", F.when(F.col("level") > 0, enclosing_box(F.col("key"), F.col("level") - 1)))


def merged_leaves(leaves: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, level, key): the fewest nodes that fill what some leaves of a tree (level, key) fill, for those of each `by`."""
    up = leaves.select(*by, "key", F.col("level").alias("of"), F.explode(F.sequence(F.lit(0), F.col("level"))).alias("level"))
    share = F.pow(F.lit(0.125), F.col("of") - F.col("level"))  # of the node; exact
    sums = up.groupBy(*by, "level", enclosing_box(F.col("key"), F.col("level")).alias("key")).agg(F.sum(share).alias("__s"))
    full = held(sums.where("__s = 1").select(*by, "level", "key"))
    parents = full.select(*by, (F.col("level") + 1).alias("level"), F.col("key").alias("__p"))
    rows = full.withColumn("__p", enclosing_box(F.col("key"), F.greatest(F.col("level") - 1, F.lit(0))))
    return rows.join(parents, [*by, "level", "__p"], "left_anti").select(*by, "level", "key")


def locate_node(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The nodes that are exactly the wanted (level, key)."""
    return nodes.join(wanted.select("level", "key"), ["level", "key"], "left_semi")


def containing_node(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (id, level, key) with the deepest node that is it or an ancestor of it: node_level, node_key."""
    up = wanted.select("id", "key", F.explode(F.sequence(F.lit(0), F.col("level"))).alias("level")).withColumn("key", enclosing_box(F.col("key"), F.col("level")))
    found = up.join(nodes.select("level", "key"), ["level", "key"])
    return found.groupBy("id").agg(F.max(F.struct("level", "key")).alias("n")).select("id", F.col("n.level").alias("node_level"), F.col("n.key").alias("node_key"))


def upsweep(leaves: DataFrame, aggregates: Callable[[], list[Column]]) -> DataFrame:
    """(level, key, ...) of all nodes, with aggregates over the leaves below each."""
    up = leaves.withColumn("up", F.explode(F.sequence(F.lit(0), F.col("level"))))
    return up.groupBy(F.col("up").alias("level"), enclosing_box(F.col("key"), F.col("up")).alias("key")).agg(*aggregates())


def _mass_sums(particles: DataFrame, leaves: DataFrame) -> DataFrame:
    mass = F.abs("m")
    rows = particles.select("key", mass.alias("w"), "m", *((mass * F.col(c)).alias(f"s{c}") for c in "xyz"))
    sums, deepest = [F.sum(c).alias(c) for c in ("w", "m", "sx", "sy", "sz")], few_cells(leaves)
    if deepest is not None:  # cells, not particles, look for their leaves
        rows = rows.where("key IS NOT NULL").groupBy(enclosing_box(F.col("key"), F.lit(deepest)).alias("key")).agg(*sums)
    return leaf_lookup(leaves, rows).groupBy("level", F.col("leaf").alias("key")).agg(*sums)


def _centers(sums: DataFrame) -> DataFrame:
    return sums.select("level", "key", "m", *((F.col(f"s{c}") / F.when(F.col("w") == 0, 1.0).otherwise(F.col("w"))).alias(f"c{c}") for c in "xyz"))


def mass_centers(particles: DataFrame, leaves: DataFrame) -> DataFrame:
    """(level, key, m, cx, cy, cz) of the leaves that have particles (key, x, y, z, m): weighted by absolute mass."""
    return _centers(_mass_sums(particles, leaves))


def node_mass_centers(particles: DataFrame, leaves: DataFrame) -> DataFrame:
    """The same of all nodes that have particles, inner ones from the sums of their leaves."""
    return _centers(upsweep(_mass_sums(particles, leaves), lambda: [F.sum(c).alias(c) for c in ("w", "m", "sx", "sy", "sz")]))


def node_ops(leaves: DataFrame, bucket: int, bits: int = BITS) -> DataFrame:
    """leaves (level, key, count) with op: 0 to merge with its siblings, 1 to stay, 8, 64, 512 or 4096 to divide.

    The first of eight siblings takes their place, so it stays where they merge.
    """
    parent = enclosing_box(F.col("key"), F.greatest(F.col("level") - 1, F.lit(0)))
    family = Window.partitionBy("level", parent)
    whole = (F.count(F.lit(1)).over(family) == 8) & (F.col("level") > 0)
    merge = whole & (octal_digit(F.col("key"), F.col("level")) > 0) & (F.sum("count").over(family) <= bucket)
    op = F.when(merge, 0)
    for steps in (4, 3, 2, 1):
        op = op.when((F.col("count") > bucket * 8 ** (steps - 1)) & (F.col("level") + (steps - 1) < bits), 8**steps)
    return leaves.withColumn("op", op.otherwise(1))


def apply_node_ops(leaves: DataFrame) -> DataFrame:
    """The leaves (level, key) after the ops: merged siblings leave their parent, divided ones their descendants."""
    rows = leaves.where("op > 0")
    parent = enclosing_box(F.col("key"), F.greatest(F.col("level") - 1, F.lit(0)))
    merged = leaves.where("op = 0").select((F.col("level") - 1).alias("level"), parent.alias("key")).distinct()
    first = rows.join(merged.select((F.col("level") + 1).alias("level"), "key", F.lit(True).alias("up")), ["level", "key"], "left")
    depth = F.floor((F.length(F.bin(F.col("op"))) - 1) / 3).cast("int")
    level = F.when(F.col("up") & (F.col("op") == 1), F.col("level") - 1).otherwise(F.col("level") + depth).cast("int")
    parts = first.select(level.alias("level"), "key", F.explode(F.sequence(F.lit(0), F.greatest(F.col("op"), F.lit(1)) - 1)).alias("k"))
    return parts.select("level", (F.col("key") + F.when(F.col("k") > 0, node_range(F.col("level")) * F.col("k")).otherwise(0)).alias("key"))


def spanning_tree(keys: DataFrame, bits: int = BITS) -> DataFrame:
    """(level, key): the fewest nodes such that each given key, besides 0 and the end of the range, begins one."""
    spark = keys.sparkSession
    edges = keys.select(F.col("key").cast("long").alias("key")).unionByName(spark.range(1).select(_long(0).alias("key"))).distinct()
    pairs = with_running(edges, F.lit(0)).select(F.col("key").alias("a"), F.col("next").alias("b"))
    body = span_range(pairs.where("b IS NOT NULL"), "a", "b", bits).select("level", F.col("node").alias("key"))
    # the last interval ends with the range, which is no BIGINT: mirrored, it begins at 0
    last = pairs.where("b IS NULL AND a > 0").select(_long(0).alias("a"), (_long(8**bits - 1) - F.col("a") + 1).alias("b"))
    tail = span_range(last, "a", "b", bits).select("level", (_long(8**bits - 1) - (F.col("node") + (node_range(F.col("level"), bits) - 1))).alias("key"))
    root = pairs.where("b IS NULL AND a = 0").select(F.lit(0).alias("level"), _long(0).alias("key"))
    return body.unionByName(tail).unionByName(root)


def inject_keys(leaves: DataFrame, keys: DataFrame, bits: int = BITS) -> DataFrame:
    """The leaves of the spanning tree of the leaves' keys and further ones."""
    return spanning_tree(leaves.select("key").unionByName(keys.select("key")), bits)


def continuum_octree(spark, concentration: Callable[[Column, Column, Column], Column], bucket: int, low: float = -1.0, high: float = 1.0, rounds: int = 11, bits: int = BITS) -> DataFrame:
    """(level, key, count): the tree of a density, a node's count being its volume times the mean over eight points in it."""
    from lattica.functions.sfc import morton_decode

    unit = (high - low) / (1 << bits)

    def counted(nodes: DataFrame) -> DataFrame:
        rows = nodes.withColumns({"__at": morton_decode(F.col("key")), "__e": _shl(_long(1), F.lit(bits) - F.col("level"))})
        rows = rows.withColumns({f"__{c}": F.lit(low) + (F.col(f"__at.i{c}") + F.col("__e") * 0.25) * unit for c in "xyz"} | {"__s": F.col("__e") * (0.5 * unit)})
        near = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: concentration(*(F.col(f"__{c}") + F.col("__s") * (_shr(k, p).bitwiseAND(F.lit(1))) for p, c in enumerate("xyz"))))
        total = F.aggregate(near, F.lit(0.0), lambda acc, v: acc + v)
        volume = F.col("__s") * F.col("__s") * F.col("__s")  # of an eighth
        return held(rows.select("level", "key", F.round(total * volume).cast("long").alias("count")))

    nodes = counted(spark.range(1).select(F.lit(0).alias("level"), _long(0).alias("key")))
    out = None
    for _ in range(rounds + 1):
        leaves = nodes.where(f"count <= {bucket} OR level = {bits}")
        out = leaves if out is None else out.unionByName(leaves)
        open_nodes = nodes.where(f"count > {bucket} AND level < {bits}")
        if open_nodes.isEmpty():
            break
        nodes = counted(children(open_nodes).select("level", "key"))
    else:  # the last nodes are leaves as they are, so that the tree has no holes
        out = out.unionByName(nodes)
    return out


def digits(key: Column, n: int = 7) -> list[Column]:
    return [_shr(key, 3 * (BITS - p)).bitwiseAND(_long(7)).cast("int").alias(f"d{p}") for p in range(1, n + 1)]


def uniform_tree(spark, level: int, bits: int = BITS) -> DataFrame:
    """(level, key): all nodes of a level."""
    return spark.range(8**level).select(F.lit(level).alias("level"), (F.col("id") * (8 ** (bits - level))).alias("key"))
