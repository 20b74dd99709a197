"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles; equal sets form a class, and classes are joined. Shingles have one
order: those that a table of frequent ones doesn't name come first, the table's by their counts, equal ones by hash.
The table has what repeats within stretches of the documents and is bounded; it settles the order and nothing else, so
that results are exact whatever it misses. If two sets are alike enough, their prefixes of length n - ceil(t n) + k share k
shingles at least. Each class picks its own k from 1 to MOST_MATCHES: a longer prefix meets more postings, but its
candidates must share more. Its cost is estimated from the counts of its prefix's shingles. A pair becomes a candidate
if the two prefixes share as many shingles as the smaller k of the two.

A posting list longer than LONG is cut by size, since linked sets have like sizes; if it is still longer than LONG, it
isn't multiplied out. The class in it with the fewest rare shingles becomes its centre;
every member is compared with the centre. Two members of which one isn't linked to the centre can only be linked if
their differences from the centre have shingles in common, and enough of them for a prefix of the differences to show
it; so the same join runs on these differences, and pairs that the centre already connects are never made. In that
order the centre's own shingles, which all members that are unlike it lack, come last. A list of a centre and a
shingle that more than LONG members could drive pairs in is long again and gets a centre of its own, and so on; there the order also puts off what about SAMPLED of the members have in common. A list's centre is the least of its
members, and the next lists have only members after it, so this ends. No list gives more than LONG pairs a member.

Lists that a task would feel are few, by the bound HOT_LISTS; what belongs to each of them is broadcast to their
members, so that no shuffle brings a list's members together.

Candidates are first held against a sketch that bounds their difference from below, then links that would connect
what isn't connected yet are verified on the whole sets. Components come from star contractions. No step is
approximate.

Defined results: null or empty text: no shingles, linked with nothing, its own component; rows with equal doc_id count
each and may be in different components; null doc_ids are linked like others but never name a component that has
another doc_id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import WORD, Tables, blocks, read, text_bytes, text_digest, written
from lattica.llm.components import components
from lattica.llm.shingles import shingles

SIZE, NUMERATOR, DENOMINATOR = 3, 9, 10
#: The pipeline's stage: words of a shingle and threshold.
STAGE_SIZE, STAGE_NUMERATOR, STAGE_DENOMINATOR = 5, 8, 10
MOST_MATCHES = 6
LONG = 64
FREQUENT, MOST_FREQUENT = 16, 1 << 16
SKETCH_BITS = 1024
SAMPLED = 32
#: A list is hot if it has more than HOT_ROWS rows, and more than one in HOT_LISTS of all rows.
HOT_ROWS, HOT_LISTS = 256, 4096
FILTER_BITS = 1 << 23
#: Cost of verifying a candidate, in postings read.
_VERIFY = 20


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
    value, cut = shingles(data, offsets, size)
    for k in range(batch.num_rows):
        yield np.unique(value[cut[k] : cut[k + 1]])


def frequent_shingles(docs: DataFrame, size: int = SIZE, least: int = FREQUENT, most: int = MOST_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent of the shingles that repeat within a stretch of documents, sorted, and how often stretches say so;
    at most `most`. They only settle the order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[n > 1]), pa.array(n[n > 1])], ["token", "n"])

        for batch in blocks(batches, "text", 1 << 20):
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
            held.append(shingles(data, offsets, size)[0])
            if len(held) == 8:
                yield counted()
        if held:
            yield counted()

    counts = docs.select("text").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(most).toArrow()
    token, n = rows.column("token").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def prefix_length(n: int, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> int:
    return n - -(-numerator * n // denominator) + 1


def document_keys(docs: DataFrame, order, size: int = SIZE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, digest: bool = False) -> DataFrame:
    """doc_id, n, key (digest of the set, null if empty), prefix (the first shingles in order), rare, sketch; text_md5 if asked for."""
    more = ["text_md5"] if digest else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, times = order.value
        for batch in blocks(batches, "text", 1 << 20):
            rows = []
            for own in _sets(batch, size):
                n = len(own)
                if not n:
                    rows.append((0, None, None, 0, None))
                    continue
                if len(token):
                    at = np.minimum(np.searchsorted(token, own), len(token) - 1)
                    count = np.where(token[at] == own, times[at], 0)
                else:
                    count = np.zeros(n, np.int64)
                length = min(n, prefix_length(n, numerator, denominator) + MOST_MATCHES - 1)
                rare = int((count == 0).sum())
                first = np.flatnonzero(count == 0)[:length] if rare >= length else np.argsort(count, kind="stable")[:length]
                odd = np.bincount((own.view(np.uint64) >> np.uint64(54)).astype(np.int64), minlength=SKETCH_BITS) & 1
                rows.append((n, hashlib.blake2b(own.tobytes(), digest_size=16).digest(), own[first].tobytes(), rare, np.packbits(odd.astype(np.uint8)).tobytes()))
            n, key, prefix, rare, sketch = zip(*rows, strict=True)
            given = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", *more)]
            yield pa.RecordBatch.from_arrays([given[0], pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(prefix, pa.binary()), pa.array(rare, pa.int32()), pa.array(sketch, pa.binary()), *given[1:]], ["doc_id", "n", "key", "prefix", "rare", "sketch", *more])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(text_digest(F.col("text")).alias(c) for c in more))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, key binary, prefix binary, rare int, sketch binary" + "".join(f", {c} binary" for c in more))


def _explode_prefix(classes: DataFrame) -> DataFrame:
    """(key, pos, token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column(1).to_pylist()
            sizes = np.array([len(p) // 8 for p in prefix], np.int64)
            index = np.repeat(np.arange(batch.num_rows), sizes)
            pos = np.arange(len(index)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index)), pa.array(pos.astype(np.int32)), pa.array(np.frombuffer(b"".join(prefix), np.int64))], ["key", "pos", "token"])

    return classes.select("key", "prefix").mapInArrow(run, "key binary, pos int, token bigint")


def _popcount(column: str, other: str) -> F.Column:
    """Bits in which two sketches differ: bounded by the size of the difference of the sets."""
    word = lambda c, k: F.conv(F.hex(F.substring(c, 8 * k + 1, 8)), 16, -10).cast("long")
    return sum((F.bit_count(word(column, k).bitwiseXOR(word(other, k))) for k in range(SKETCH_BITS // 64)), F.lit(0))


def _with_sets(pairs: DataFrame, sets: DataFrame, *more: str) -> DataFrame:
    rows = pairs.select("a", "b", *more).join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("ta")), "a")
    return rows.join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("tb")), "b").select("a", "b", "ta", "tb", *more)


def _two_sets(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for left, right in zip(batch.column(2), batch.column(3), strict=True):
        yield np.frombuffer(left.as_buffer(), np.int64), np.frombuffer(right.as_buffer(), np.int64)


def _linked(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in _two_sets(batch):
                n = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(denominator * n >= numerator * (len(x) + len(y) - n))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _with_sets(pairs, sets).mapInArrow(run, "a binary, b binary")


def _difference_counts(star: DataFrame, sets: DataFrame, tables: Tables) -> DataFrame:
    """(a, common): shingles in which about SAMPLED members differ from their centre a, that two of them share, with how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            delta = [np.setxor1d(c, x, assume_unique=True) for c, x in _two_sets(batch)]
            if delta:
                index = np.repeat(np.arange(len(delta)), [len(d) for d in delta])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index)), pa.array(np.concatenate(delta), pa.int64())], ["a", "token"])

    members = tables.written(star.groupBy("a").agg(F.count(F.lit(1)).alias("length")), "stars")
    one_in = F.greatest(F.lit(1), F.ceil(F.col("length") / SAMPLED))
    some = _attached(star, members, "a", "length").where(F.pmod(F.xxhash64("b"), one_in) == 0)
    counts = _with_sets(some, sets).mapInArrow(run, "a binary, token bigint").groupBy("a", "token").agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 1")
    return counts.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("token", "n"))).alias("common"))


def _around_centres(star: DataFrame, sets: DataFrame, order, numerator: int, denominator: int, counts: DataFrame | None = None) -> DataFrame:
    """Of (centre a, member b, rare): nb, linked, rare, excess, few, and the prefix of their difference that a linked pair would show.

    Sets of sizes x and y are linked if they differ in (x + y) (1 - t) / (1 + t) shingles at most (for t = 0.9, in a
    19th of x + y). From that follows how much two differences from a centre must share: for a member that isn't linked
    to the centre, with any other; for a linked one, with members that aren't. It is also at least the mean of what the
    two differences exceed their sets' shares by; so of the one with the smaller excess (more times it, for a whole
    number) the first `few` shingles show the pair. The order of a difference is the same for
    all members of a centre: by counts (a, common) where given, then the members' before the centre's, then by order.
    """
    less, more, counted = denominator - numerator, denominator + numerator, counts is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, times = order.value
        for batch in batches:
            size, linked, excess, few, prefix = [], [], [], [], []
            commons = batch.column(5) if counted else None
            for row, (c, x) in enumerate(_two_sets(batch)):
                delta, nc, n = np.setxor1d(c, x, assume_unique=True), len(c), len(x)
                near = more * len(delta) <= less * (nc + n)
                if near:
                    need = (len(delta) + (nc - n) * less / more) / 2
                else:
                    other = max(1.0, len(delta) - n * (1 + denominator / numerator) * less / more)
                    need = (len(delta) + other * (1 - less / more) - (n + nc) * less / more) / 2
                over = more * len(delta) - less * n
                need = max(1, math.ceil(need - 1e-6), math.ceil((over - less * n * denominator / numerator) / more - 1e-6))
                length = len(delta) - need + 1
                few.append(len(delta) - max(need, -(-over // more)) + 1)
                excess.append(over)
                if length > 0:
                    ranks = [c[np.minimum(np.searchsorted(c, delta), nc - 1)] == delta]
                    if len(token):
                        at = np.minimum(np.searchsorted(token, delta), len(token) - 1)
                        ranks.insert(0, np.where(token[at] == delta, times[at], 0))
                    if commons is not None and (own := commons[row]).is_valid and len(own.values):
                        known, often = (own.values.field(k).to_numpy() for k in (0, 1))
                        at = np.minimum(np.searchsorted(known, delta), len(known) - 1)
                        ranks.append(np.where(known[at] == delta, often[at], 0))
                    delta = delta[np.lexsort(ranks)[:length]]
                size.append(n)
                linked.append(near)
                prefix.append(delta[: max(0, length)].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(linked, pa.bool_()), batch.column(4), pa.array(excess, pa.int64()), pa.array(few, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], ["a", "b", "nb", "linked", "rare", "excess", "few", "prefix"])

    extra = ["rare"]
    if counted:
        star = star.join(counts, "a", "left")
        extra.append("common")
    return _with_sets(star, sets, *extra).mapInArrow(run, "a binary, b binary, nb bigint, linked boolean, rare int, excess bigint, few bigint, prefix array<bigint>")


def _hot_length(table: DataFrame, count: str) -> int | None:
    """From which count on keys of a table are hot: HOT_LISTS of them at most; None if none is."""
    most, total = table.agg(F.max(count), F.sum(count)).first()
    least = max(HOT_ROWS, (total or 0) // HOT_LISTS)
    return least if (most or 0) > least else None


def _attached(rows: DataFrame, table: DataFrame, on: str, count: str) -> DataFrame:
    """rows with the columns of table, which has count, the number of rows, for each key; rows of hot keys aren't shuffled."""
    least = _hot_length(table, count)
    if least is None:
        return rows.join(table, on)
    hot = F.broadcast(table.where(F.col(count) > least))
    rest = rows.join(hot.select(on), on, "left_anti").join(table.where(F.col(count) <= least), on)
    return rows.join(hot, on).unionByName(rest)


def _class_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(key, tokens) of the classes in wanted (doc_id, key), once each.

    Documents that stand for no class are mostly left out by a filter of FILTER_BITS bits, however many are wanted. The
    others' sets are found before the shuffle, so that rows meet by their class and not by a doc_id that many rows may
    have; a task passes on one row of a class.
    """
    spark = docs.sparkSession
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    found = wanted.groupBy(F.shiftright(bit, 5).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(32)).cast("int"))).alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS >> 5, np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(words)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            bit = batch.column(1).to_numpy()
            yield batch.filter(pa.array((words[bit >> 5] >> (bit & 31)) & 1 == 1)).select(["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in blocks(some(batches), "text", 1 << 20):
            first = {}
            for row, own in enumerate(_sets(batch, size)):
                key = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                if key not in seen:
                    seen.add(key)
                    first[key] = row
            yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.binary()), batch.column(0).take(pa.array(list(first.values()), pa.int64()))], ["key", "text"])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1 << 20):
            sets = [own.tobytes() for own in _sets(batch, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), pa.array(sets, pa.binary())], ["key", "tokens"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), "text").select("text", bit.alias("bit"))
    rows = rows.mapInArrow(run, "key binary, text string").join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])
    return rows.mapInArrow(tokens, "key binary, tokens binary")


def _multi_match(postings: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The postings in each class's own prefix, with k, from (key, n, rare, pos, token, df)."""
    lengths = [F.col("n") - F.ceil(F.col("n") * numerator / denominator) + k for k in range(1, MOST_MATCHES + 1)]
    met = [F.sum(F.when(F.col("pos") < length, F.col("df") - 1).otherwise(0)) for length in lengths]
    cost = F.array(*(F.struct((m + m * _VERIFY / k).alias("cost"), F.lit(k).alias("k")) for k, m in enumerate(met, 1)))
    chosen = postings.groupBy("key").agg(F.array_min(cost)["k"].alias("k"))
    return postings.join(chosen, "key").where(F.col("pos") < F.col("n") - F.ceil(F.col("n") * numerator / denominator) + F.col("k"))


def _by_size(postings: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Long lists cut by size: a class of size step s is in lists s and s + 1, and two linked classes meet in the list of the larger step."""
    step = F.floor(F.log("n") / math.log(denominator / numerator) + 1e-9).cast("int")
    rows = postings.withColumn("step", F.when(F.col("df") <= LONG, -1).otherwise(step))
    rows = rows.withColumn("list", F.explode(F.when(F.col("df") <= LONG, F.array(F.lit(-1))).otherwise(F.array("step", F.col("step") + 1))))
    long = rows.where(F.col("df") > LONG).groupBy("token", "list").agg(F.count(F.lit(1)).alias("length")).where(f"length > {LONG}")
    return rows.join(long, ["token", "list"], "left")


def _lists(around: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """The lists of a centre and a shingle that can show links, from _around_centres().

    Members of the lists in which LONG at most drive pairs (those that aren't linked to the centre, or those that have
    the shingle among their first few); and (lid, key, rare, length) of the longer ones.
    """
    rows = around.select(F.col("a").alias("centre"), F.col("b").alias("key"), F.col("nb").alias("n"), "linked", "rare", "excess", "few", F.posexplode("prefix").alias("pos", "token"))
    rows = tables.written(rows.select(F.xxhash64("centre", "token").alias("lid"), "key", "n", "linked", "rare", "excess", (F.col("pos") < F.col("few")).alias("early")), "differences")
    number = lambda c: F.sum(c.cast("long"))
    lists = rows.groupBy("lid").agg(F.count(F.lit(1)).alias("length"), number(~F.col("linked")).alias("open"), number(F.col("early")).alias("first"))
    lists = tables.written(lists.where("length > 1 AND open > 0 AND first > 0"), "lists")
    rows = tables.written(_attached(rows, lists, "lid", "length"), "members")
    short = F.least("open", "first") <= LONG
    drives = F.when(F.col("open") <= F.col("first"), ~F.col("linked")).otherwise(F.col("early"))
    return rows.where(short).withColumn("drives", drives), rows.where(~short).select("lid", "key", "rare", "length")


def _open_pairs(members: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs (a, b, sizes) of members of a list that can be linked and that its centre doesn't connect: LONG for each member at most."""
    least = _hot_length(members.groupBy("lid").agg(F.max("length").alias("length")), "length")
    own = [F.col(c).alias(f"__{c}") for c in ("n", "linked", "excess", "early", "drives")]
    left = members.where("drives").select("lid", F.col("key").alias("a"), *own, "length")
    right = members.select("lid", F.col("key").alias("b"), "n", "linked", "excess", "early", "drives", "length")
    if least is None:
        met = left.drop("length").join(right, "lid")
    else:
        met = left.where(F.col("length") <= least).drop("length").join(right.where(F.col("length") <= least), "lid")
        met = met.unionByName(right.where(F.col("length") > least).join(F.broadcast(left.where(F.col("length") > least).drop("length")), "lid"))
    met = met.where("a != b AND (NOT drives OR a < b) AND NOT (linked AND __linked)")
    met = met.where("CASE WHEN struct(__excess, a) < struct(excess, b) THEN __early ELSE early END")
    met = met.where(f"{denominator} * n >= {numerator} * __n AND {denominator} * __n >= {numerator} * n")
    return met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.first(F.col("n") + F.col("__n")).alias("sizes"))


def _stars(members: DataFrame, tables: Tables) -> DataFrame:
    """(a, b, rare) from (lid, key, rare, length): each list's centre with each of its other members."""
    centres = tables.written(members.groupBy("lid").agg(F.min(F.struct("rare", "key"))["key"].alias("a"), F.max("length").alias("length")), "centres")
    rows = _attached(members.select("lid", F.col("key").alias("b"), "rare"), centres, "lid", "length")
    return tables.written(rows.where("a != b").select("a", "b", "rare").distinct(), "star")


def link_classes(docs: DataFrame, keys: DataFrame, order, size: int = SIZE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """(node, label) over the keys of classes that have a link; order: a broadcast of frequent_shingles()."""
    if not 0 < numerator < denominator:
        raise ValueError("the threshold must lie between 0 and 1")
    classes = keys.where("n > 0").groupBy("key").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("doc_id"), F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))
    tables = Tables(docs.sparkSession, "links")
    classes = tables.written(classes, "classes")
    every = _explode_prefix(classes)
    df = every.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    postings = tables.written(every.join(df, "token"), "postings").join(classes.select("key", "n", "rare"), "key")
    postings = tables.written(_by_size(_multi_match(postings, numerator, denominator), numerator, denominator), "prefixes")

    # short lists: all pairs of the list, counted
    short = postings.where("length IS NULL").select("token", "list", "step", F.col("key").alias("a"), "n", "k")
    other = short.select("token", "list", F.col("step").alias("stepb"), F.col("a").alias("b"), F.col("n").alias("nb"), F.col("k").alias("kb"))
    met = short.join(other, ["token", "list"]).where(f"a < b AND greatest(step, stepb) = list AND {denominator} * n >= {numerator} * nb AND {denominator} * nb >= {numerator} * n")
    close = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first(F.least("k", "kb")).alias("k"), F.first(F.col("n") + F.col("nb")).alias("sizes")).where("shared >= k")
    sketches = classes.select("key", "sketch")

    def near_enough(pairs: DataFrame) -> DataFrame:
        held = pairs.join(sketches.select(F.col("key").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("key").alias("b"), F.col("sketch").alias("sb")), "b")
        return held.where(_popcount("sa", "sb") * (denominator + numerator) <= F.col("sizes") * (denominator - numerator)).select("a", "b")

    near = tables.written(near_enough(close), "near")

    # long lists: each member with the list's centre, then lists of differences from it, until none is long
    star = _stars(postings.where("length IS NOT NULL").select(F.xxhash64("token", "list").alias("lid"), "key", "rare", "length"), tables)
    both = near.unionByName(star.select("a", "b"))
    ids = both.select(F.col("a").alias("key")).unionByName(both.select(F.col("b").alias("key"))).distinct()
    sets = tables.written(_class_sets(docs, classes.select("doc_id", "key").join(ids, "key"), size), "sets")
    pairs, linked, counts = near, [], None
    while not star.isEmpty():
        around = tables.written(_around_centres(star, sets, order, numerator, denominator, counts), "around")
        linked.append(around.where("linked").select("a", "b"))
        members, longer = _lists(around, tables)
        pairs = pairs.unionByName(near_enough(_open_pairs(members, numerator, denominator)))
        star = _stars(longer, tables)
        counts = _difference_counts(star, sets, tables)
    if linked:
        pairs = tables.written(pairs.distinct(), "pairs")
    around = functools.reduce(DataFrame.unionByName, linked, pairs.where("false"))

    # one link for each class that no centre holds first; then whatever still connects different components
    held = around.select("b").distinct()
    nearest = pairs.join(held, "b", "left_anti").groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    sure = tables.written(around.unionByName(_linked(nearest, sets, numerator, denominator)), "sure")
    label = components(sure, tables)
    named = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    apart = pairs.join(nearest, ["a", "b"], "left_anti").join(named("a"), "a", "left").join(named("b"), "b", "left")
    apart = apart.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    late = tables.written(_linked(apart, sets, numerator, denominator), "late")
    if not late.isEmpty():
        label = components(sure.unionByName(late), tables)
    out = written(label, "labels")
    tables.delete()
    return out


def _labelled(docs: DataFrame, size: int, numerator: int, denominator: int, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles and key (text_md5 if asked for) of each row of docs; and (node, label) of the classes that have links."""
    order = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, size))
    keys = written(document_keys(docs, order, size, numerator, denominator, digest), "keys")
    return keys.withColumnRenamed("n", "n_shingles"), link_classes(docs, keys, order, size, numerator, denominator)


def _with_label(classes: DataFrame, label: DataFrame) -> DataFrame:
    """Rows of different classes (key, ...) with the label of their components."""
    return classes.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))


def near_duplicate_groups(docs: DataFrame, size: int = SIZE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles, key, component_id for each row of docs (doc_id, text)."""
    rows, label = _labelled(docs, size, numerator, denominator)
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))
    classes = written(_with_label(classes, label), "named")
    firsts = written(classes.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "firsts")
    named = written(_attached(classes, firsts, "label", "members").select("key", "n", "component_id"), "named")
    found = _attached(rows.where("key IS NOT NULL"), named, "key", "n").select("doc_id", "n_shingles", "key", "component_id")
    return found.unionByName(rows.where("key IS NULL").select("doc_id", "n_shingles", "key", F.col("doc_id").alias("component_id")))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and component."""
    return near_duplicate_groups(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs, all columns, of which each group of near duplicates keeps the one with the smallest doc_id.

    Rows are told apart by doc_id and text: of rows with one doc_id, or none, each group keeps its own. A doc_id comes
    before none, then the smaller digest of the text. Of rows equal in both one stays. Rows without a word are in no
    group and all stay.
    """
    rows, label = _labelled(docs.select("doc_id", "text"), STAGE_SIZE, STAGE_NUMERATOR, STAGE_DENOMINATOR, digest=True)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5")).alias("r")
    first = _with_label(rows.where("key IS NOT NULL").groupBy("key").agg(least), label).groupBy("label").agg(F.min("r").alias("r"))
    kept = first.select(F.col("r.doc_id").alias("__kept_id"), F.col("r.text_md5").alias("__kept_md5"))
    has_word = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    own = docs.where(has_word).withColumn("__text_md5", text_digest(F.col("text")))
    own = own.join(kept, own["doc_id"].cast("long").eqNullSafe(kept["__kept_id"]) & (own["__text_md5"] == kept["__kept_md5"]), "left_semi")
    own = own.dropDuplicates(["doc_id", "__text_md5"]).drop("__text_md5")
    return own.unionByName(docs.where(~has_word))


SQL: dict[str, str] = {}
QUERIES = {"op7_jaccard": op7_jaccard}
