"""Domains end to end: box, keys, tree, parts, halos by the particles' own radii, layouts, and what parts open under gravity."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.box import AXES, Box
from lattica.functions.geometry import inv_theta_vector, min_mac_mutual, range_separation
from lattica.functions.sfc import BITS, enclosing_box, node_box
from lattica.operators import domain, essential, octree
from lattica.operators.ordering import with_running
from lattica.plans.held import held


class Domain(NamedTuple):
    """What sync() makes: all tables but the particles are as small as the tree, or as small as the parts' trees."""

    box: Box
    leaves: DataFrame
    assignment: DataFrame
    particles: DataFrame
    layout: DataFrame
    nodes: DataFrame | None = None
    centers: DataFrame | None = None
    trees: DataFrame | None = None
    marked: DataFrame | None = None
    tolerance: float = 1.0


def search_boxes(particles: DataFrame, leaves: DataFrame, box: Box, scale: float = 2.0, curve: str = "morton") -> DataFrame:
    """(level, key, ox, oy, oz, rx, ry, rz): centre and half sizes of the box around the spheres of radius scale * h of each
    leaf's particles (key, x, y, z, h) and the leaf's centre; leaves without particles have none. Where few cells of the deepest level
    hold all particles, these are summed up by cells, and cells, not particles, look for their leaves."""
    r = scale * F.col("h")
    ends = [(f"{c}lo", F.min, F.col(c) - r) for c in AXES] + [(f"{c}hi", F.max, F.col(c) + r) for c in AXES]
    rows, deepest = particles.select("key", *(e.alias(n) for n, _, e in ends)), octree.few_cells(leaves)
    spans = [f(n).alias(n) for n, f, _ in ends]
    if deepest is not None:
        rows = rows.where("key IS NOT NULL").groupBy(enclosing_box(F.col("key"), F.lit(deepest)).alias("key")).agg(*spans)
    found = octree.leaf_lookup(leaves, rows).groupBy("level", F.col("leaf").alias("key")).agg(*spans)
    placed = box.node_boxes(leaves.select("level", "key"), curve).join(found, ["level", "key"])
    low, high = (lambda c: F.least(f"{c}lo", f"g{c}")), (lambda c: F.greatest(f"{c}hi", f"g{c}"))
    return placed.select("level", "key", *(((low(c) + high(c)) / 2).alias(f"o{c}") for c in AXES), *(((high(c) - low(c)) / 2).alias(f"r{c}") for c in AXES))


def _owned_nodes(leaves: DataFrame, assignment: DataFrame) -> DataFrame:
    """All nodes (level, key, is_leaf) of a tree with the parts of their first and last keys, n_part and n_last."""
    nodes = octree.all_nodes(leaves.select("level", "key")).select("level", "key", "is_leaf")
    rows = domain.find_rank(nodes, assignment).withColumnsRenamed({"part": "n_part", "key": "__k"})
    rows = domain.find_rank(rows.withColumn("key", essential.last_key(F.col("level"), F.col("__k"))), assignment)
    return rows.select("level", F.col("__k").alias("key"), "is_leaf", "n_part", F.col("part").alias("n_last"))


def find_peers(leaves: DataFrame, assignment: DataFrame, inv_theta: float, box: Box, curve: str = "morton") -> DataFrame:
    """(part, peer): parts with a pair of leaves that are not far from each other by the mutual criterion on lattice boxes.

    Pairs of nodes go down from the pair of the roots. A pair that is far is dropped, as all pairs below it are far too;
    so is one that lies in a single part, or between two parts that are known to be peers. Of other pairs the larger
    node is replaced by its children. Nodes of two parts that touch make these peers at once: the leaves at the place where they touch
    touch too. So surfaces between parts aren't followed down to the leaves; both orders of a pair occur.
    """
    lengths = box.lengths()
    ellipse = tuple(max(lengths) / n * inv_theta * (1 + 1e-6) for n in lengths)
    nodes = _owned_nodes(leaves, assignment).withColumn("__b", node_box(F.col("level"), F.col("key"), curve))
    nodes = held(nodes.select("level", "key", "is_leaf", "n_part", "n_last", *(F.col(f"__b.{c}0").alias(c) for c in AXES), F.col("__b.edge").alias("e")))
    kin = held(nodes.where("level > 0").withColumns({"up": F.col("level") - 1, "parent": enclosing_box(F.col("key"), F.col("level") - 1)}))
    named = lambda df, p: df.select(*(F.col(c).alias(f"{p}{c}") for c in df.columns))
    gap = [range_separation(F.col(f"a_{c}"), F.col(f"a_{c}") + F.col("a_e"), F.col(f"b_{c}"), F.col(f"b_{c}") + F.col("b_e"), (1 << BITS) if p else 0) for c, p in zip(AXES, box.periodic, strict=True)]
    near = ~min_mac_mutual(tuple(g.cast("double") for g in gap), F.greatest("a_e", "b_e").cast("double"), ellipse)
    one = (F.col("a_n_part") == F.col("a_n_last")) & (F.col("b_n_part") == F.col("b_n_last"))
    goes_on = near & ~(one & (F.col("a_n_part") == F.col("b_n_part")))
    touch = one & (gap[0] + gap[1] + gap[2] == 0)
    near_pairs = lambda df: held(df.where(goes_on).withColumn("met", (F.col("a_is_leaf") & F.col("b_is_leaf")) | touch))
    roots = nodes.where("level = 0")
    pairs = named(roots, "a_").crossJoin(named(roots, "b_"))  # one row each
    columns, peers = pairs.columns, None
    pairs = near_pairs(pairs)
    for _ in range(2 * BITS + 1):
        found = pairs.where("met").select(F.col("a_n_part").alias("part"), F.col("b_n_part").alias("peer")).distinct()
        peers = held(found if peers is None else peers.unionByName(found).distinct())  # at most as many as pairs of parts
        known = F.broadcast(peers.select(*(F.col(c).alias(f"{p}_n_{e}") for p, c in (("a", "part"), ("b", "peer")) for e in ("part", "last"))))
        rest = pairs.where("NOT met").join(known, ["a_n_part", "a_n_last", "b_n_part", "b_n_last"], "left_anti")
        if rest.isEmpty():
            break
        first = ~F.col("a_is_leaf") & (F.col("b_is_leaf") | (F.col("a_level") <= F.col("b_level")))
        down = lambda p, q: rest.where(first if p == "a_" else ~first).select(*(c for c in columns if c.startswith(q)), F.col(f"{p}level").alias(f"{p}up"), F.col(f"{p}key").alias(f"{p}parent")).join(named(kin, p), [f"{p}up", f"{p}parent"]).select(*columns)
        pairs = near_pairs(down("a_", "b_").unionByName(down("b_", "a_")))
    return peers.where("part != peer")


def halo_leaves(leaves: DataFrame, searches: DataFrame, assignment: DataFrame, box: Box, curve: str = "morton") -> DataFrame:
    """(part, level, key): leaves that each part needs besides its own, as they overlap a search box (key, o, r) of one of its leaves.

    From the root down pairs of a search box and a node go on while they overlap and the node isn't wholly in the box's own part; so
    boxes in the middle of a part end early. Of a part's pairs with one node only those go on that may add something: one alone, if a box
    covers the node, as all leaves below are needed then; of boxes that a single face cuts off, the one that reaches furthest
    from each side; of the others those that reach further than these on every face that cuts them. So a part's surface is followed
    down by a few boxes a node, however many reach it. Each box has its own size, and the node's level decides when a pair is done.
    """
    placed = held(box.node_boxes(_owned_nodes(leaves, assignment), curve))
    sizes = [f"{k}{c}" for k in "or" for c in AXES]
    own = domain.find_rank(searches, assignment).select("part", *sizes, F.lit(False).alias("whole"))
    triple = lambda k: tuple(F.col(f"{k}{c}") for c in AXES)
    meets = F.col("whole") | box.overlap(triple("o"), triple("r"), triple("g"), triple("s"))
    goes_on = meets & ~((F.col("n_part") == F.col("part")) & (F.col("n_last") == F.col("part")))
    # how far a box reaches from each side of a node, in lengths of the axis; less than the node's width, if its other face cuts it
    axes = list(zip(AXES, box.lengths(), box.periodic, strict=True))
    to = {f"{side}{c}": (-sign * box.image(F.col(f"g{c}") - F.col(f"o{c}"), k) + F.col(f"r{c}") + F.col(f"s{c}")) for k, c in enumerate(AXES) for side, sign in (("up", 1), ("dn", -1))}
    cuts = {f: to[f] < 2 * F.col(f"s{f[-1]}") for f in to}
    # around a periodic axis a large box may come from both sides; such a one is compared with no other
    single = reduce(Column.__and__, (F.col(f"r{c}") + F.col(f"s{c}") <= n / 2 for c, n, p in axes if p), F.lit(True))
    kin = held(placed.where("level > 0").withColumns({"up": F.col("level") - 1, "parent": enclosing_box(F.col("key"), F.col("level") - 1)}))
    node, columns, out = ["part", "level", "key"], [*own.columns, "level", "key", "is_leaf"], None

    def fewer(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        n = reduce(Column.__add__, (c.cast("int") for c in cuts.values()))
        pairs = held(pairs.select(*columns, F.when(single, n).otherwise(7).alias("n"), *(F.when(cuts[f], to[f]).alias(f) for f in to), (F.col("whole") | (single & (n == 0)) | _inside(box) | F.col("is_leaf")).alias("done")))
        box_of = F.struct(*sizes)
        furthest = [F.max(F.when(~F.col("done") & (F.col("n") == 1) & F.col(f).isNotNull(), F.struct(F.col(f).alias("to"), box_of.alias("b")))).alias(f"b_{f}") for f in to]
        best = held(pairs.groupBy(*node).agg(F.max("done").alias("done"), F.max("is_leaf").alias("is_leaf"), F.max(F.when(F.col("done"), box_of)).alias("b"), *furthest))
        flat = [F.col(f"b.{c}").alias(c) for c in sizes]
        covered = best.where("done").select("part", *flat, F.lit(True).alias("whole"), "level", "key", "is_leaf")
        faces = best.where("NOT done").select(*node, "is_leaf", F.explode(F.array_compact(F.array(*(F.col(f"b_{f}.b") for f in to)))).alias("b"))
        faces = faces.select("part", *flat, F.lit(False).alias("whole"), "level", "key", "is_leaf")
        ahead = best.where("NOT done").select(*node, *(F.col(f"b_{f}.to").alias(f"b_{f}") for f in to))
        less = reduce(Column.__or__, (F.coalesce(F.col(f) <= F.col(f"b_{f}"), F.lit(False)) for f in to))
        more = pairs.where("NOT done AND n > 1").join(ahead, node).where(~((F.col("n") < 7) & less))
        return best, covered.where("NOT is_leaf").unionByName(faces).unionByName(more.select(*columns))

    best, pairs = fewer(own.join(F.broadcast(placed.where("level = 0")), goes_on))
    for _ in range(BITS + 1):
        done = best.where("is_leaf").select(*node)
        out = done if out is None else out.unionByName(done)
        if best.where("NOT is_leaf").isEmpty():
            break
        open_pairs = pairs.select(*own.columns, F.col("level").alias("up"), F.col("key").alias("parent"))
        best, pairs = fewer(open_pairs.join(kin, ["up", "parent"]).where(goes_on))
    return out


def _inside(box: Box) -> Column:
    """Whether a node (g, s) lies wholly in a search box (o, r)."""
    within = [F.abs(box.image(F.col(f"g{c}") - F.col(f"o{c}"), k)) + F.col(f"s{c}") < F.col(f"r{c}") for k, c in enumerate(AXES)]
    return within[0] & within[1] & within[2]


def layout(leaves: DataFrame, assignment: DataFrame, halos: DataFrame) -> DataFrame:
    """(part, level, key, count, is_halo, offset): the leaves (level, key, count) that each part holds, its own and its halos
    (part, level, key), with the number of its rows before each in the order of the curve."""
    own = domain.find_rank(leaves.select("level", "key", "count"), assignment).withColumn("is_halo", F.lit(False))
    more = halos.select("part", "level", "key").distinct().join(leaves.select("level", "key", "count"), ["level", "key"]).withColumn("is_halo", F.lit(True))
    rows = held(with_running(own.unionByName(more.select(*own.columns)), F.col("count"), "part", ("key",)).drop("next"))
    base = rows.groupBy("part").agg(F.min("before").alias("__base"))  # as many rows as parts
    return rows.join(F.broadcast(base), "part").select("part", "level", "key", "count", "is_halo", (F.col("before") - F.col("__base")).alias("offset"))


def layout_faults(layout: DataFrame, assignment: DataFrame, peers: DataFrame) -> DataFrame:
    """The rows of a layout whose particles no peer (part, peer) of its part has: halos that can't be had."""
    found = domain.find_rank(layout.where("is_halo AND count > 0").withColumnRenamed("part", "of"), assignment)
    known = peers.select(F.col("part").alias("of"), F.col("peer").alias("part"))
    return found.join(F.broadcast(known), ["of", "part"], "left_anti").drop("part").withColumnRenamed("of", "part")


def with_halos(particles: DataFrame, leaves: DataFrame, assignment: DataFrame, halos: DataFrame) -> DataFrame:
    """particles (key, ...) with part, is_halo and owner, the part whose range holds its key: each in its own part, and again in
    parts that need its leaf. Parts begin with leaves (as sfc_assignment() makes them), so one look-up of the leaf tells all parts.

    More leaves than may be broadcast are merged to the fewest nodes of the same parts first.
    """
    wanted = halos.groupBy("level", "key").agg(F.sort_array(F.collect_set("part")).alias("more"))
    rows = domain.find_rank(leaves.select("level", "key"), assignment).withColumnRenamed("part", "owner").join(wanted, ["level", "key"], "left")
    rows = held(rows.withColumn("more", F.coalesce("more", F.array().cast("array<int>"))))
    if rows.count() > octree.BROADCAST_ROWS:
        rows = held(octree.merged_leaves(rows, ("owner", "more")))
    found = octree.leaf_lookup(rows, particles, ("owner", "more")).drop("level", "leaf")
    found = found.select("*", F.posexplode(F.concat(F.array("owner"), "more")).alias("__at", "part")).withColumn("is_halo", F.col("__at") > 0)
    columns = [*particles.columns, "part", "is_halo", "owner"]
    nowhere = particles.where("key IS NULL").withColumns({"part": F.lit(-1), "is_halo": F.lit(False), "owner": F.lit(-1)})
    return found.select(*columns).unionByName(nowhere.select(*columns))


def _distributed(df: DataFrame, parts: int, bucket: int, box: Box, curve: str, kept: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The particles with their keys, the leaves and the parts. Of particles that are kept already, Morton keys, which are cheap, aren't."""
    keyed = box.with_key(df, curve)
    if not kept or curve != "morton":
        keyed = held(keyed)
    leaves = held(octree.build_octree(keyed, bucket))
    return keyed, leaves, held(domain.sfc_assignment(leaves, parts))


def _synced(df: DataFrame, parts: int, bucket: int, box: Box | None, shrink: float | None, scale: float, curve: str) -> tuple[Box, DataFrame, DataFrame, DataFrame, DataFrame]:
    """The box, the particles with their keys, the leaves, the parts and their halos (part, level, key)."""
    box = box or Box(periodic=(False, False, False))
    df, kept = box.fold(df), not all(box.periodic)
    if kept:  # a box that follows the particles looks at them first
        df = held(df)
    box = box.around(df, shrink=shrink)
    keyed, leaves, assignment = _distributed(df, parts, bucket, box, curve, kept)
    return box, keyed, leaves, assignment, held(halo_leaves(leaves, search_boxes(keyed, leaves, box, scale, curve), assignment, box, curve))


def sync(df: DataFrame, parts: int, bucket: int, box: Box | None = None, shrink: float | None = None, scale: float = 2.0, curve: str = "morton") -> Domain:
    """The domain of particles (x, y, z, h, ...): all their columns travel along.

    box: the limits of periodic axes, and, with `shrink`, the box of the step before; axes that aren't periodic follow the
    particles, so keys use the whole lattice wherever the particles are. Periodic coordinates are folded into the box. particles has key, part and is_halo: each
    row in its own part, and again in parts that have a particle whose sphere of radius scale * h may reach its
    leaf; owner is the part that a row's key is in. layout: what leaves each part holds and where its rows of them begin.
    """
    box, keyed, leaves, assignment, halos = _synced(df, parts, bucket, box, shrink, scale, curve)
    return Domain(box, leaves, assignment, with_halos(keyed, leaves, assignment, halos), layout(leaves, assignment, halos))


def sync_grav(df: DataFrame, parts: int, bucket: int, theta: float, box: Box | None = None, shrink: float | None = None, scale: float = 2.0, curve: str = "morton", centers: DataFrame | None = None, tolerance: float = 1.0, step: float = 0.05, most: float = 4.0) -> Domain:
    """sync() of particles that have a mass m, with the mass centres of all nodes, each part's tree, and the nodes it opens.

    Trees are divided by the criterion around `centers` (level, key, m, cx, cy, cz; as of the step before, or the present ones), with radii `tolerance` times as large; what is
    opened is then found around the present centres. As these have moved, a part may have to open a leaf that is far from
    its peers; the tolerance then grows by `step` until no part has. Halos are the leaves in reach of the particles' spheres and, of the leaves that a part opens, those
    of the whole tree.
    """
    box, keyed, leaves, assignment, reached = _synced(df, parts, bucket, box, shrink, scale, curve)
    nodes = held(octree.upsweep(leaves, lambda: [F.sum("count").alias("count")]))
    now = held(octree.node_mass_centers(keyed.select("key", *AXES, "m"), leaves))
    peers = held(find_peers(leaves, assignment, inv_theta_vector(theta), box, curve))
    regions = essential.part_regions(assignment, box, curve, peers)
    present = held(essential.vector_mac_spheres(nodes, now, box, theta, 1.0, curve))
    while True:
        spheres = present if centers is None and tolerance == 1.0 else essential.vector_mac_spheres(nodes, now if centers is None else centers, box, theta, tolerance, curve)
        trees = held(essential.focus_trees(spheres, regions, bucket, box))
        marked = held(essential.marked_nodes(trees, present, regions, box))
        opened = trees.where("is_leaf").join(marked, ["part", "level", "key"], "left_semi").select("part", "level", "key", "count", F.lit(True).alias("is_halo"))
        outside = opened.withColumnRenamed("part", "of")
        outside = domain.find_rank(outside, assignment).where("part != of").drop("part").withColumnRenamed("of", "part")
        if layout_faults(outside, assignment, peers).isEmpty():
            break
        tolerance += step
        if tolerance > most:
            raise RuntimeError("the centres moved too far: take the present ones")
    # what a part opens among its peers' leaves it needs as particles
    halos = held(reached.unionByName(outside.join(leaves.select("level", "key"), ["level", "key"], "left_semi").select("part", "level", "key")).distinct())
    return Domain(box, leaves, assignment, with_halos(keyed, leaves, assignment, halos), layout(leaves, assignment, halos), nodes, now, trees, marked, tolerance)
