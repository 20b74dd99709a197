"""Removal of repeated substrings, found by enhanced suffix arrays over all texts.

Every window of LENGTH bytes has one anchor: its piece of PIECE bytes with the smallest hash, the leftmost of equals. So
equal windows have equal anchors at equal places, and only texts around equal anchors need be compared. Neighbouring
windows with one anchor form a run. Runs go by blocks to tasks that own their anchor's hash: of runs with equal bytes
all but the earliest are repeated as a whole. Where runs with one anchor differ, one run of each kind goes to a suffix
array: the bytes from the anchor on are sorted, neighbours' common prefixes give the interval tree by a stack scan, and
in each interval the bytes before the anchor, sorted the same way, give the sets that also agree to the left and
disagree one byte further: maximal repeats with all their places. All but the earliest place are repeated.

What is put out are the places to remove, of each maximal repeat all but the earliest, as spans of their documents; the
groups themselves, and the earliest places, aren't. Runs with equal bytes are found by 64-bit hashes, before any suffix
array.

Hot anchors: an anchor that would fill a task is found by counting all anchors (at most a few per task are that
frequent, so their list is bounded); its runs are cut into parts of up to SHARED windows, which are dealt by all the
bytes that the part's windows share; if that is hot too, by whole windows, of which equal ones need no more than the
earliest. Each task first drops, in every stretch of its input, runs that repeat there.

Defined results: a null text is empty; a null doc_id is later than all others; rows with one doc_id are one document's
versions: equal starts are not earlier, so equal rows leave each other alone and have equal results; texts shorter
than LENGTH bytes are kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import blocks, partitions, read, text_bytes, written
from lattica.llm.shingles import mix

LENGTH, PIECE, SHARED = 100, 16, 16
_REACH = LENGTH - PIECE + 1
_BLOCK, _FLUSH = 2 << 20, 8
#: An anchor is hot beyond HOT_LEAST runs, if it has more than 1 / HOT_SHARE of what a task gets.
HOT_LEAST, HOT_SHARE = 4096, 4
_PLACE_BITS = np.uint64(24)
_STRETCH = 8 << 20
_NO_ID = (1 << 63) - 1
_RUN = np.dtype([("anchor", "u8"), ("bytes", "u8"), ("doc", "i8"), ("place", "i8"), ("tag", "u4"), ("far", "u1"), ("near", "u1")])
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_BASE = 0x9FB21C651E98DF25


def _doubled(value: np.ndarray, width: int) -> np.ndarray:
    """Hashes of 2 * width bytes from those of width bytes."""
    if len(value) <= width:
        return value[:0]
    return value[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + value[width:]


def runs(data: np.ndarray, offsets: np.ndarray, hot: np.ndarray, hotter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of all texts as records (far and near: how far the first and the last window begin before the anchor), and each one's row."""
    found = []
    for base in range(0, max(0, len(data) - LENGTH + 1), _STRETCH):
        part = data[base : base + _STRETCH + LENGTH - 1]
        h = _BYTE[part]
        for width in (1, 2, 4, 8):
            h = _doubled(h, width)
        piece, h = mix(h), _doubled(h, 16)
        h64 = _doubled(h, 32)
        low = (piece >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(piece), dtype=np.uint64)
        width = 1
        while 2 * width <= _REACH:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(part) - LENGTH + 1], low[_REACH - width : _REACH - width + len(part) - LENGTH + 1])
        anchor = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        whole = np.ones(len(anchor), bool)
        for end in offsets[1:][(offsets[1:] > base) & (offsets[1:] < base + len(part))].tolist():
            whole[max(0, end - base - LENGTH + 1) : end - base] = False
        change = np.ones(len(anchor) + 1, bool)
        change[1:-1] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
        cut = np.flatnonzero(change)
        first, last = cut[:-1], cut[1:] - 1
        keep = whole[first]
        first, last = first[keep], last[keep]
        at = anchor[first]
        name = piece[at]
        if len(hot):
            split = np.isin(name, hot)
            a, f, n = at[split], (at - first)[split], (at - last)[split]
            parts = f // SHARED - n // SHARED + 1
            a, f, n, who = (np.repeat(x, parts) for x in (a, f, n, name[split]))
            k = n // SHARED + np.arange(len(a)) - np.repeat(np.cumsum(parts) - parts, parts)
            f, n = np.minimum(f, k * SHARED + SHARED - 1), np.maximum(n, k * SHARED)
            core = a - k * SHARED
            who = mix(mix(who ^ h64[core]) ^ h64[core + LENGTH - SHARED + 1 - 64] ^ k.astype(np.uint64))
            if len(hotter) and (more := np.isin(who, hotter)).any():
                wide = (f - n + 1)[more]
                a2, w2 = np.repeat(a[more], wide), np.repeat(who[more], wide)
                l2 = np.repeat(n[more], wide) + np.arange(len(a2)) - np.repeat(np.cumsum(wide) - wide, wide)
                w2 = mix(mix(w2 ^ h64[a2 - l2]) ^ h64[a2 - l2 + LENGTH - 64] ^ l2.astype(np.uint64))
                a, f, n, who = (np.concatenate([x[~more], y]) for x, y in ((a, a2), (f, l2), (n, l2), (who, w2)))
            first, last, at, name = (np.concatenate([x[~split], y]) for x, y in ((first, a - f), (last, a - n), (at, a), (name, who)))
        out = np.zeros(len(first), _RUN)
        out["anchor"], out["far"], out["near"], out["place"] = name, at - first, at - last, at + base
        out["bytes"] = mix(mix(mix(h64[first] ^ (out["far"].astype(np.uint64) << np.uint64(8) | out["near"])) + h64[first + LENGTH - 64]) ^ mix(h64[last]) + h64[last + LENGTH - 64])
        found.append(out)
    out = np.concatenate(found) if found else np.zeros(0, _RUN)
    row = np.searchsorted(offsets, out["place"], "right") - 1
    out["place"] -= offsets[row]
    return out, row


def _stretches(batches: Iterator[pa.RecordBatch], hot: np.ndarray, hotter: np.ndarray) -> Iterator[np.ndarray]:
    """All runs of some blocks of rows (key, tag, text) at once."""
    held: list[np.ndarray] = []
    for batch in blocks(batches, "text", _BLOCK):
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
        out, row = runs(data, offsets, hot, hotter)
        out["doc"] = batch.column(batch.schema.get_field_index("key")).to_numpy()[row]
        out["tag"] = batch.column(batch.schema.get_field_index("tag")).to_numpy()[row].astype(np.uint32)
        held.append(out)
        if len(held) == _FLUSH:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def _earliest(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs sorted by anchor, bytes and place, and which of them have no earlier equal."""
    found = found[np.lexsort((found["place"], found["doc"], found["bytes"], found["anchor"]))]
    new = np.ones(len(found), bool)
    new[1:] = (found["anchor"][1:] != found["anchor"][:-1]) | (found["bytes"][1:] != found["bytes"][:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(found) else np.zeros(0, np.int64)
    return found, (found["doc"] == found["doc"][first]) & (found["place"] == found["place"][first])


def _by_document(doc: np.ndarray, tag: np.ndarray, columns: list[np.ndarray], kind: int) -> Iterator[pa.RecordBatch]:
    """A row for each document with its values of all columns, packed."""
    if not len(doc):
        return
    order = np.lexsort((tag, doc))
    doc, tag, table = doc[order], tag[order], np.stack(columns, 1).astype(np.int64)[order]
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]), [True]]))
    packed = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * 8 * len(columns)).astype(np.int32)), pa.py_buffer(table.tobytes())])
    yield pa.RecordBatch.from_arrays([pa.array(doc[cut[:-1]]), pa.array(tag[cut[:-1]].astype(np.int64)), pa.array(np.full(len(cut) - 1, kind, np.int32)), packed], ["key", "tag", "kind", "packed"])


_FOUND = "key bigint, tag bigint, kind int, packed binary"
_REPEATED, _WANTED = 0, 1


def _repeated(found: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield from _by_document(found["doc"], found["tag"], [found["place"] - found["far"], found["place"] - found["near"].astype(np.int64) + LENGTH], _REPEATED)


def _bucketed(table: np.ndarray, by: np.ndarray, buckets: int, extra: list[bytes] | None = None) -> Iterator[tuple[int, bytes]]:
    """The records by bucket of their hash, packed."""
    import zstandard

    bucket = ((by >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    packer = zstandard.ZstdCompressor(level=1)
    for b in np.flatnonzero(np.diff(cut)).tolist():
        own = order[cut[b] : cut[b + 1]]
        rows = table[own]
        data = len(rows).to_bytes(8, "little") + b"".join(np.ascontiguousarray(rows[name]).tobytes() for name in table.dtype.names)
        yield b, packer.compress(data + (b"".join(extra[k] for k in own.tolist()) if extra else b""))


def _unpacked(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple[np.ndarray, bytes]]:
    import zstandard

    reader = zstandard.ZstdDecompressor()
    for batch in batches:
        for packed in batch.column(batch.schema.get_field_index("packed")):
            data = reader.decompress(packed.as_buffer())
            n, at = int.from_bytes(data[:8], "little"), 8
            table = np.zeros(n, kind)
            for name in kind.names:
                size = kind[name].itemsize * n
                table[name] = np.frombuffer(data, kind[name], n, at)
                at += size
            yield table, data[at:]


def _batches(rows: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for b, packed in rows:
        held.append((b, packed))
        size += len(packed)
        if size > 2 << 20:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.int32()), pa.array([x for _, x in held], pa.binary())], ["bucket", "packed"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.int32()), pa.array([x for _, x in held], pa.binary())], ["bucket", "packed"])


def _hot_anchors(rows: DataFrame, hot: np.ndarray, tasks: int) -> np.ndarray:
    """Anchors (with hot: of the parts of hot anchors' runs) that more runs have than a task should get."""
    empty = np.zeros(0, np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for found in _stretches(batches, hot, empty):
            found, first = _earliest(found)
            name, n = np.unique(found["anchor"][first], return_counts=True)
            total += int(n.sum())
            name, n = name[n > 4], n[n > 4]
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(n), pa.array(np.ones(len(n), bool))], ["anchor", "n", "one"])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total], pa.int64()), pa.array([False])], ["anchor", "n", "one"])

    counts = rows.mapInArrow(count, "anchor bigint, n bigint, one boolean").groupBy("one", "anchor").agg(F.sum("n").alias("n"))
    counts = written(counts.where(f"NOT one OR n > {HOT_LEAST}"), "anchors")
    total = counts.where("NOT one").agg(F.sum("n")).first()[0] or 0
    most = max(HOT_LEAST, total // (HOT_SHARE * tasks))
    return np.sort(np.array([r["anchor"] for r in counts.where(F.col("one") & (F.col("n") > most)).collect()], np.int64).view(np.uint64))


class _Tree:
    """Maximal repeats among occurrences of one anchor: right[k] are the bytes from it on, left[k] those before it, reversed."""

    def __init__(self, left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, order: np.ndarray):
        self.left, self.n_left, self.order = left, n_left, order  # order: rank by (doc, place); equals have equal rank
        self.right_lcp = self._lcp(right, n_right)
        self.left_lcp = self._lcp(left, n_left)
        self.mark_left, self.mark_right, self.mark_row = [], [], []

    @staticmethod
    def _lcp(table: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Common prefixes of neighbouring rows."""
        differ = table[1:] != table[:-1]
        lcp = np.where(differ.any(1), differ.argmax(1), table.shape[1])
        return np.minimum(lcp, np.minimum(size[1:], size[:-1]))

    @staticmethod
    def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """(depth, first, last, depth of the parent) of each interval of rows with a longer common prefix than those around it."""
        stack = [(0, 0)]
        for k, depth in enumerate([*lcp, -1]):
            first = k
            while stack and stack[-1][0] > depth:
                top, first = stack.pop()
                yield top, first, k, max(depth, stack[-1][0] if stack else -1)
            if not stack or stack[-1][0] < depth:
                stack.append((depth, first))

    def mark(self, rows: np.ndarray, left: int, right: int) -> None:
        """Of rows that agree on `left` bytes before and `right` from the anchor, all but the earliest repeat them."""
        rank = self.order[rows]
        later = rows[rank > rank.min()]
        self.mark_row.append(later)
        self.mark_left.append(np.full(len(later), left))
        self.mark_right.append(np.full(len(later), right))

    def scan(self, first: int, last: int) -> None:
        """All maximal repeats of at least LENGTH bytes in the sorted rows [first, last]."""
        right, left = self.right_lcp[first:last].tolist(), self.left_lcp[first:last].tolist()
        for depth, lo, hi, parent in self.intervals(right):
            need = LENGTH - depth
            if hi == lo or depth < PIECE:
                continue
            if hi == lo + 1:
                if left[lo] >= need:
                    self.mark(np.array([first + lo, first + hi]), left[lo], depth)
                continue
            least, most = min(left[lo:hi]), max(left[lo:hi])
            if least >= min(LENGTH - max(parent, PIECE) - 1, LENGTH - PIECE):
                self.mark(np.arange(first + lo, first + hi + 1), least, depth)
                continue
            rows = np.arange(first + lo, first + hi + 1)
            bytes_left = self.left[rows]
            by = np.argsort(bytes_left.view(f"S{bytes_left.shape[1]}").ravel(), kind="stable")
            rows = rows[by]
            around = self._lcp(self.left[rows], self.n_left[rows]).tolist()
            for deep, a, b, _ in self.intervals(around):
                if b > a and deep >= need:
                    self.mark(rows[a : b + 1], deep, depth)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeats among the runs whose bytes come with them."""
    tables, texts = [], []
    for table, extra in _unpacked(batches, _RUN):
        size = table["far"].astype(np.int64) - table["near"] + LENGTH
        at = np.cumsum(size) - size
        tables.append(table)
        # bytes before the anchor reversed, then those from it on, each in rows of full length
        data = np.frombuffer(extra + bytes(2 * LENGTH), np.uint8)
        anchor = at + table["far"]
        k = np.arange(LENGTH)
        n_left, n_right = table["far"].astype(np.int64), LENGTH - table["near"].astype(np.int64)
        left = np.where(k[: _REACH - 1] < n_left[:, None], data[np.maximum(anchor[:, None] - 1 - k[: _REACH - 1], 0)], 0).astype(np.uint8)
        right = np.where(k < n_right[:, None], data[anchor[:, None] + k], 0).astype(np.uint8)
        texts.append((left, right))
    if not tables:
        return
    table, left, right = np.concatenate(tables), np.concatenate([a for a, _ in texts]), np.concatenate([b for _, b in texts])
    named = np.concatenate([table["anchor"].astype(">u8").view(np.uint8).reshape(-1, 8), right], 1)
    by = np.argsort(named.view(f"S{named.shape[1]}").ravel(), kind="stable")
    table, left, right = table[by], left[by], right[by]
    placed = np.lexsort((table["place"], table["doc"]))
    new = np.ones(len(table), bool)
    new[1:] = (table["doc"][placed][1:] != table["doc"][placed][:-1]) | (table["place"][placed][1:] != table["place"][placed][:-1])
    rank = np.zeros(len(table), np.int64)
    rank[placed] = np.cumsum(new)
    tree = _Tree(left, right, table["far"].astype(np.int64), LENGTH - table["near"].astype(np.int64), rank)
    cut = np.flatnonzero(np.concatenate([[True], table["anchor"][1:] != table["anchor"][:-1], [True]]))
    for first, last in zip(cut[:-1].tolist(), (cut[1:] - 1).tolist(), strict=True):
        if last > first:
            tree.scan(first, last)
    if tree.mark_row:
        row, back, on = (np.concatenate(x) for x in (tree.mark_row, tree.mark_left, tree.mark_right))
        place = table["place"][row]
        yield from _by_document(table["doc"][row], table["tag"][row], [place - back, place + on], _REPEATED)


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) with key and tag; and (key, tag, spans): what of each document is repeated, as packed pairs."""
    spark = docs.sparkSession
    parts = partitions(spark)
    buckets = 8 * parts
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("key"), F.xxhash64("text").bitwiseAND(0xFFFFFFFF).alias("tag"), "doc_id", "text")
    narrow = rows.select("key", "tag", "text")
    hot = _hot_anchors(narrow, np.zeros(0, np.uint64), parts)
    hotter = _hot_anchors(narrow, hot, parts) if len(hot) else hot
    lists = spark.sparkContext.broadcast((hot, hotter))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _stretches(batches, *lists.value):
            found, first = _earliest(found)
            for kind, part in ((_WANTED, found[first]), (_REPEATED, found[~first])):
                by = part["anchor"] if kind == _WANTED else mix(part["doc"].astype(np.uint64))
                packed = ((b, bytes([kind]) + data) for b, data in _bucketed(part, by, buckets))
                yield from _batches(packed)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {_WANTED: [], _REPEATED: []}
        for batch in batches:
            for packed in batch.column(1):
                kind = packed.as_buffer()[0]
                one = pa.RecordBatch.from_arrays([pa.array([packed.as_py()[1:]], pa.binary())], ["packed"])
                held[kind] += [t for t, _ in _unpacked(iter([one]), _RUN)]
        if held[_REPEATED]:
            yield from _repeated(np.concatenate(held.pop(_REPEATED)))
        if not held[_WANTED]:
            return
        found = np.concatenate(held.pop(_WANTED))
        name = np.sort(found["anchor"])
        again = name[1:][name[1:] == name[:-1]]
        if not len(again):
            return
        found = found[again[np.minimum(np.searchsorted(again, found["anchor"]), len(again) - 1)] == found["anchor"]]
        found, first = _earliest(found)
        yield from _repeated(found[~first])
        kept = found[first]
        # anchors around which bytes differ
        change = np.concatenate([[True], kept["anchor"][1:] != kept["anchor"][:-1]])
        group = np.cumsum(change) - 1
        start = np.flatnonzero(change)
        several = np.bincount(group, kept["bytes"] != kept["bytes"][start][group]) > 0
        kept = kept[several[group]]
        yield from _by_document(kept["doc"], kept["tag"], [kept["place"], kept["far"], kept["near"], kept["anchor"].view(np.int64)], _WANTED)

    dealt = narrow.mapInArrow(deal, "bucket int, packed binary").repartition(parts, "bucket")
    found = written(dealt.mapInArrow(compare, _FOUND), "runs")

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts = [], []

        def flush():
            table = np.concatenate(held)
            yield from _batches(_bucketed(table, table["anchor"], buckets, texts))
            held.clear()
            texts.clear()

        for batch in batches:
            for key, tag, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), batch.column(4).to_pylist(), strict=True):
                data = text.as_buffer()
                table = np.zeros(sum(map(len, wanted)) // 32, _RUN)
                place, far, near, anchor = np.frombuffer(b"".join(wanted), np.int64).reshape(-1, 4).T
                table["doc"], table["tag"], table["place"], table["far"], table["near"], table["anchor"] = key, tag, place, far, near, anchor.view(np.uint64)
                held.append(table)
                texts.extend(bytes(data[p - f : p - n + LENGTH]) for p, f, n in zip(place.tolist(), far.tolist(), near.tolist(), strict=True))
            if len(texts) > 50_000:
                yield from flush()
        if held:
            yield from flush()

    wanted = found.where(f"kind = {_WANTED}").groupBy("key", "tag").agg(F.collect_list("packed").alias("wanted"))
    near = rows.join(wanted, ["key", "tag"]).select("key", "tag", "doc_id", "text", "wanted").mapInArrow(around, "bucket int, packed binary")
    more = near.repartition(parts, "bucket").mapInArrow(_search, _FOUND)
    spans = found.where(f"kind = {_REPEATED}").unionByName(more).groupBy("key", "tag").agg(F.collect_list("packed").alias("spans"))
    return rows, spans


def _cut(data, spans: list[bytes]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs of them, and what is left."""
    pairs = np.frombuffer(b"".join(spans), np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    end = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate([[True], pairs[1:, 0] > end[:-1]])
    first, last = pairs[new, 0].tolist(), end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(pairs) - 1]])].tolist()
    kept, at = [], 0
    for a, b in zip(first, last, strict=True):
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return sum(last) - sum(first), len(first), b"".join(kept)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left) for each row of docs (doc_id, text)."""
    rows, spans = repeated_spans(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 4 << 20):
            out = []
            for text, own in zip(batch.column(3), batch.column(4).to_pylist(), strict=True):
                data = bytes(text.as_buffer()) if text.as_buffer() is not None else b""
                removed, n, kept = _cut(data, own) if own else (0, 0, data)
                out.append((len(data), removed, n, hashlib.sha256(kept).hexdigest()) + ((kept,) if with_text else ()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(2), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 1 + len(columns)])

    joined = rows.join(spans, ["key", "tag"], "left").select("key", "tag", "doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each document is left when all repeated strings of 100 bytes are removed."""
    return remove_repeats(read(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
