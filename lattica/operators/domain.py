"""Domain decomposition: boxes, equal-count key ranges, halos, opening criteria and peers, over tables of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.geometry import boxes_overlap, inv_theta_min, mac_fails, min_distance, min_mac_r2
from lattica.functions.sfc import BITS, _long, _shl, hilbert_decode, morton_decode, node_range
from lattica.operators.octree import children, merged_leaves
from lattica.operators.ordering import with_rank, with_running
from lattica.plans.held import held


def global_box(df: DataFrame, fixed: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """One row xmin .. zmax; the limits of fixed (periodic or walled) axes are kept."""
    fixed = fixed or {}
    return df.agg(*(F.lit(float(fixed[c][s])).alias(f"{c}{n}") if c in fixed else (F.min(c) if n == "min" else F.max(c)).alias(f"{c}{n}") for c in "xyz" for s, n in enumerate(("min", "max"))))


def shrink_limits(new: tuple[float, float], old: tuple[float, float], share: float = 0.05) -> tuple[float, float]:
    """Limits that move inwards by at most a share of the old length."""
    most = share * (old[1] - old[0])
    return min(new[0], old[0] + most), max(new[1], old[1] - most)


def sfc_assignment(leaves: DataFrame, parts: int) -> DataFrame:
    """(part, key_lo, count): ranges of leaves (key, count) with about equal counts; a range starts at the leaf before which
    at least its share of all keys lies."""
    total = leaves.agg(F.sum("count")).first()[0] or 0
    rows = with_running(leaves.select("key", "count"), F.col("count"))
    end = F.col("before") + F.col("count")
    aim = lambda part: F.floor(part * F.lit(float(total)) / parts).cast("long")
    # aims in (before, end] end with this leaf, so their ranges start with the next one; rounding moves a part by one at most
    low, high = F.greatest(F.floor(F.col("before") * float(parts) / max(1, total)) - 1, F.lit(1)), F.least(F.ceil(end * float(parts) / max(1, total)) + 1, F.lit(parts - 1))
    cut = rows.where(F.col("count") > 0).where(low <= high).withColumn("part", F.explode(F.sequence(low, high))).where((aim(F.col("part")) > F.col("before")) & (aim(F.col("part")) <= end))
    first = rows.groupBy().agg(F.min("key").alias("key_lo")).select(F.lit(0).alias("part"), "key_lo", F.lit(0).cast("long").alias("at"))
    # aims of 0 start with the first leaf too
    zero = leaves.sparkSession.range(1, parts).where(aim(F.col("id")) == 0).select(F.col("id").cast("int").alias("part")).crossJoin(F.broadcast(first.select("key_lo", "at")))
    edges = first.unionByName(zero).unionByName(cut.select(F.col("part").cast("int").alias("part"), F.col("next").alias("key_lo"), end.alias("at")))
    nxt = F.coalesce(F.lead("at").over(Window.orderBy("part")), F.lit(total))  # as many rows as parts
    return edges.select("part", "key_lo", (nxt - F.col("at")).cast("long").alias("count"))


def find_rank(keys: DataFrame, assignment: DataFrame) -> DataFrame:
    """keys with the part whose range holds each; there are as many ranges as parts, so they fit into an expression."""
    edges = [r[0] for r in assignment.where("key_lo IS NOT NULL").orderBy("part").select("key_lo").collect()]
    if not edges:
        return keys.withColumn("part", F.lit(-1))
    table, steps = F.array(*map(_long, edges)), [1 << k for k in reversed(range(len(edges).bit_length()))]
    # a binary search: each step goes on if the edge there isn't beyond the key
    halve = lambda at, step: F.when(F.coalesce(F.get(table, at + step) <= F.col("key"), F.lit(False)), at + step).otherwise(at)
    return keys.withColumn("part", F.aggregate(F.array(*map(F.lit, steps)), F.lit(-1), halve))


def sync(df: DataFrame, parts: int) -> DataFrame:
    """df (with key) in as many range partitions of the curve, each in key order."""
    return df.where(F.col("key").isNotNull()).repartitionByRange(parts, "key").sortWithinPartitions("key", "pid")


def exchange_matrix(keys: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(source, target, n): keys that move from a part of one assignment to a part of another."""
    rows = find_rank(find_rank(keys, old).withColumnRenamed("part", "source"), new).withColumnRenamed("part", "target")
    return rows.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def limit_shift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(part, key_lo): new range starts that lie between the old starts of the neighbouring parts; the first stays."""
    own = Window.orderBy("part")  # as many rows as parts
    rows = old.select("part", F.col("key_lo").alias("o")).withColumns({"lo": F.lag("o").over(own), "hi": F.lead("o").over(own)}).join(new, "part")
    bound = F.least(F.greatest(F.col("key_lo"), F.coalesce("lo", F.lit(0))), F.coalesce("hi", F.lit(8**BITS - 1)))
    return rows.select("part", F.when(F.col("part") == 0, F.col("key_lo")).otherwise(bound).alias("key_lo"))


def counts_of_parts(leaves: DataFrame, starts: DataFrame) -> DataFrame:
    """(part, key_lo, count): the leaves' keys in each part; a leaf is in the part that its first key is in."""
    found = find_rank(leaves.select("key", "count"), starts).groupBy("part").agg(F.sum("count").alias("count"))
    return starts.select("part", "key_lo").join(found, "part", "left").select("part", "key_lo", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def initial_splits(spark, parts: int, level: int) -> DataFrame:
    """(part, key_lo): equal shares of the range of keys, their starts cut to nodes of a level."""
    size = 8 ** (BITS - level)
    starts = [p * (8**BITS // parts) // size * size for p in range(parts)]
    return spark.createDataFrame(list(enumerate(starts)), "part int, key_lo bigint")


def translate_assignment(assignment: DataFrame, leaves: DataFrame) -> DataFrame:
    """(part, first, last): which leaves (by index, last exclusive) of another tree lie wholly in each part's range."""
    indexed = with_rank(leaves.select("level", "key"), ties=()).select(F.col("rank").alias("idx"), "key", "level")
    end = F.lead("key_lo").over(Window.orderBy("part"))  # as many rows as parts
    ranges = assignment.where("key_lo IS NOT NULL").select("part", "key_lo", end.alias("key_hi"))
    placed = find_rank(indexed, assignment).join(F.broadcast(ranges), "part")
    size = F.when(F.col("level") > 0, node_range(F.greatest(F.col("level"), F.lit(1)))).otherwise(8**BITS - 1)
    inside = F.col("key_hi").isNull() | (F.col("key") + (size - 1) < F.col("key_hi"))
    found = placed.where(inside).groupBy("part").agg(F.min("idx").alias("first"), (F.max("idx") + 1).alias("last"))
    return assignment.select("part").join(found, "part", "left").select("part", F.coalesce("first", F.lit(0)).alias("first"), F.coalesce("last", F.lit(0)).alias("last"))


def shift_ranges(ranges: DataFrame, part: int, incoming: int) -> DataFrame:
    """(part, start): starts of the parts after one, moved by what comes in before them."""
    return ranges.withColumn("start", F.col("start") + F.when(F.col("part") > part, incoming).otherwise(0))


def node_geometry(nodes: DataFrame, low: float = -0.5, high: float = 0.5, curve: str = "morton") -> DataFrame:
    """nodes (level, key) with centre cx, cy, cz and half edge s."""
    at = hilbert_decode(F.col("key")) if curve == "hilbert" else morton_decode(F.col("key"))
    edge, unit = _shl(_long(1), F.lit(BITS) - F.col("level")), (high - low) / (1 << BITS)
    rows = nodes.withColumn("__at", at).withColumn("__e", edge)
    corner = lambda c: F.col(f"__at.{c}").bitwiseAND(-F.col("__e"))
    return rows.select(*nodes.columns, *((F.lit(low) + (corner(f"i{c}") + F.col("__e") * 0.5) * unit).alias(f"c{c}") for c in "xyz"), (F.col("__e") * (0.5 * unit)).alias("s"))


def _centre(prefix: str = "") -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{prefix}c{c}") for c in "xyz")


def _size(prefix: str = "", more: Column | None = None) -> tuple[Column, Column, Column]:
    s = F.col(f"{prefix}s") if more is None else F.col(f"{prefix}s") + more
    return s, s, s


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}{c}") for c in df.columns))


def descend(leaves: DataFrame, start: DataFrame, passes, nodes: DataFrame | None = None, inner: bool = False) -> DataFrame:
    """Pairs of start rows and leaves (with inner: all nodes), found from the root down: a pair goes on while passes() holds for the node.

    leaves: (level, key, ...), or all nodes (level, key, is_leaf), with node_geometry's columns on every node; start: any
    rows. Each round joins the open pairs with their nodes' children, so that the work follows the pairs that pass, not
    all pairs.
    """
    from lattica.operators.octree import all_nodes

    nodes = held(node_geometry((all_nodes(leaves) if nodes is None else nodes).select("level", "key", "is_leaf")))
    start = held(start)
    level = nodes.where("level = 0")
    pairs = held(start.join(F.broadcast(level), passes()))
    kin = held(nodes.join(children(nodes.where("NOT is_leaf")).select("level", "key", "parent"), ["level", "key"]).withColumn("up", F.col("level") - 1))
    out = None
    for _ in range(BITS + 1):
        done = pairs if inner else pairs.where("is_leaf")
        out = done if out is None else out.unionByName(done)
        open_pairs = pairs.where("NOT is_leaf")
        if open_pairs.isEmpty():
            break
        open_pairs = open_pairs.select(*start.columns, F.col("level").alias("up"), F.col("key").alias("parent"))
        pairs = held(open_pairs.join(kin, ["up", "parent"]).select(*start.columns, *nodes.columns).where(passes()))
    return out


def dual_traversal(leaves: DataFrame, theta: float, periodic: bool = True) -> DataFrame:
    """(kind, a_level, a_key, level, key): all pairs of leaves, each pair of nodes that are far apart standing for the pairs below.

    From the pair of the roots on, a pair whose boxes are further apart than the larger one's acceptance radius is
    'far'; a near pair of leaves is 'near'; of other pairs the larger node is replaced by its children (of equal ones
    the first, if it isn't a leaf). Both orders of a pair occur.
    """
    from lattica.operators.octree import all_nodes

    nodes = held(node_geometry(all_nodes(leaves.select("level", "key")).select("level", "key", "is_leaf")))
    kin = held(nodes.join(children(nodes.where("NOT is_leaf")).select("level", "key", "parent"), ["level", "key"]).withColumn("up", F.col("level") - 1))
    pairs = _renamed(nodes.where("level = 0"), "a_").crossJoin(nodes.where("level = 0"))  # one row each
    r2 = min_mac_r2(2 * F.greatest(F.col("s"), F.col("a_s")), inv_theta_min(theta))
    near = _near_boxes(r2, periodic)
    columns, out = pairs.columns, None
    for _ in range(2 * BITS + 1):
        pairs = held(pairs.withColumn("kind", F.when(~near, "far").when(F.col("is_leaf") & F.col("a_is_leaf"), "near")))
        done = pairs.where("kind IS NOT NULL").select("kind", "a_level", "a_key", "level", "key")
        out = done if out is None else out.unionByName(done)
        rest = pairs.where("kind IS NULL").drop("kind")
        if rest.isEmpty():
            break
        first = ~F.col("a_is_leaf") & (F.col("is_leaf") | (F.col("a_level") <= F.col("level")))
        down_a = rest.where(first).withColumnsRenamed({"a_level": "a_up", "a_key": "a_parent"}).drop("a_is_leaf", "a_cx", "a_cy", "a_cz", "a_s").join(_renamed(kin, "a_"), ["a_up", "a_parent"])
        down_b = rest.where(~first).withColumnsRenamed({"level": "up", "key": "parent"}).drop("is_leaf", "cx", "cy", "cz", "s").join(kin, ["up", "parent"])
        pairs = down_a.select(*columns).unionByName(down_b.select(*columns))
    return out


def _near_boxes(r2: Column, periodic: bool) -> Column:
    d = min_distance(_centre("a_"), _size("a_"), _centre(), _size(), 1.0, periodic)
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2] < r2


def halo_cells(leaves: DataFrame, first: int, last: int, radius: float, periodic: bool = True) -> DataFrame:
    """Leaves (level, key) outside the keys [first, last) that come within radius of a leaf inside."""
    # boxes of the nodes that the leaves inside fill are as near as the nearest of these
    inside = merged_leaves(leaves.select("level", "key").where((F.col("key") >= first) & (F.col("key") < last)))
    own = _renamed(node_geometry(inside).select("cx", "cy", "cz", "s"), "o_")
    near = lambda: boxes_overlap(_centre("o_"), _size("o_", F.lit(radius)), _centre(), _size(), 1.0, periodic)
    return descend(leaves.select("level", "key"), own, near).where((F.col("key") < first) | (F.col("key") >= last)).select("level", "key").distinct()


def mark_macs(nodes: DataFrame, targets: DataFrame, theta: float, periodic: bool = True) -> DataFrame:
    """The nodes (level, key) of nodes (level, key, is_leaf), from the root on, whose opening criterion fails for any target
    leaf; a node below one that passes for all targets isn't looked at."""
    # the criterion asks for the nearest target, and the nodes that these fill are as near
    own = _renamed(node_geometry(merged_leaves(targets.select("level", "key"))).select("cx", "cy", "cz", "s"), "t_")
    fails = lambda: mac_fails(_centre(), min_mac_r2(2 * F.col("s"), inv_theta_min(theta)), _centre("t_"), _size("t_"), 1.0, periodic)
    return descend(nodes, own, fails, nodes=nodes, inner=True).select("level", "key").distinct()


def find_peers(leaves: DataFrame, assignment: DataFrame, theta: float, periodic: bool = True) -> DataFrame:
    """(part, peer): parts with leaves of which one fails the criterion for the other, with l the larger of both edges."""
    # a part's leaves of one level as the nodes that they fill, which are as near as the nearest of them; l stays the leaves' edge
    own = find_rank(leaves.select("level", "key"), assignment).withColumn("leaf_level", F.col("level"))
    own = node_geometry(merged_leaves(own, ("part", "leaf_level")))
    ours = _renamed(own.withColumn("leaf", F.col("s") * F.pow(F.lit(0.5), F.col("leaf_level") - F.col("level"))).select("part", "leaf", "cx", "cy", "cz", "s"), "t_")
    r2 = min_mac_r2(2 * F.greatest(F.col("s"), F.col("t_leaf")), inv_theta_min(theta))
    near = lambda: mac_fails(_centre(), r2, _centre("t_"), _size("t_"), 1.0, periodic)
    pairs = descend(leaves.select("level", "key"), ours, near)
    return find_rank(pairs, assignment).where("t_part != part").select(F.col("t_part").alias("part"), F.col("part").alias("peer")).distinct()


def replicate_halos(df: DataFrame, leaves: DataFrame, assignment: DataFrame, radius: float, periodic: bool = True) -> DataFrame:
    """df (with key) with part and is_halo: every particle in its own part, and again in parts of which a leaf's box, widened by radius, touches its leaf."""
    from lattica.operators.octree import leaf_lookup

    placed = find_rank(df, assignment).withColumn("is_halo", F.lit(False))
    # each part as the nodes that its leaves fill: these are few, as it is a range of keys
    own = merged_leaves(find_rank(leaves.select("level", "key"), assignment), ("part",))
    own = _renamed(node_geometry(own).select("part", "cx", "cy", "cz", "s"), "o_")
    near = lambda: boxes_overlap(_centre("o_"), _size("o_", F.lit(radius)), _centre(), _size(), 1.0, periodic)
    wanted = find_rank(descend(leaves.select("level", "key"), own, near), assignment).where("part != o_part").select("level", F.col("key").alias("leaf"), F.col("o_part").alias("part")).distinct()
    halos = leaf_lookup(leaves, df).join(wanted, ["level", "leaf"]).drop("level", "leaf").withColumn("is_halo", F.lit(True))
    return placed.unionByName(halos.select(*placed.columns))


def essential_ops(nodes: DataFrame, bucket: int, first: int, last: int) -> DataFrame:
    """nodes (level, key, count, mac, is_leaf) with op: 0 to go, as its parent has few keys, or passes the criterion away from
    the focus [first, last); 8 for a leaf to divide; else 1."""
    parent = nodes.select((F.col("level") + 1).alias("level"), F.col("key").alias("__p"), F.col("count").alias("__pc"), F.col("mac").alias("__pm"))
    own = nodes.withColumn("__p", F.when(F.col("level") > 0, F.col("key").bitwiseAND(-node_range(F.greatest(F.col("level") - 1, F.lit(1))))).otherwise(F.lit(None)))
    own = own.withColumn("__p", F.when(F.col("level") == 1, _long(0)).otherwise(F.col("__p")))
    rows = own.join(parent, ["level", "__p"], "left")
    # a parent's last key: the end of the last node of a level, 8**21, is no BIGINT
    end = F.when(F.col("level") == 1, F.lit(8**BITS - 1)).otherwise(F.col("__p") + (node_range(F.greatest(F.col("level") - 1, F.lit(1))) - 1))
    fringe = (end >= first) & (F.lit(last) > F.col("__p"))
    gone = (F.col("level") > 0) & ((F.col("__pc") <= bucket) | ((~F.col("__pm")) & ~fringe))
    focus = (F.col("key") >= first) & (F.col("key") < last)
    split = F.col("is_leaf") & (F.col("level") < BITS) & (F.col("count") > bucket) & (F.col("mac") | focus)
    return rows.withColumn("op", F.when(gone, 0).when(split, 8).otherwise(1)).drop("__p", "__pc", "__pm")


def invert_ranges(ranges: DataFrame, first: int, last: int) -> DataFrame:
    """The gaps (lo, hi) that sorted, separate ranges (lo, hi) leave in [first, last)."""
    edges = ranges.unionByName(ranges.sparkSession.createDataFrame([(first, first), (last, last)], "lo bigint, hi bigint"))
    return with_running(edges, F.lit(0), "lo", ("hi",)).select(F.col("hi").alias("lo"), F.col("next").alias("hi")).where("hi > lo")


def enumerate_ranges(ranges: DataFrame) -> DataFrame:
    """idx: every index of ranges (lo, hi), as often as they name it."""
    return ranges.where("hi > lo").select(F.explode(F.sequence("lo", F.col("hi") - 1)).alias("idx"))


def marked_runs(rows: DataFrame, mark: str) -> DataFrame:
    """(lo, hi) of the runs of neighbouring idx whose mark holds."""
    ranked = with_rank(rows.where(mark).select("idx"), "idx", ())
    return ranked.groupBy((F.col("idx") - F.col("rank")).alias("island")).agg(F.min("idx").alias("lo"), (F.max("idx") + 1).alias("hi")).select("lo", "hi")


def layout(leaves: DataFrame) -> DataFrame:
    """leaves with offset: keys before each leaf, in key order."""
    return with_running(leaves, F.col("count")).drop("next").withColumnRenamed("before", "offset")
