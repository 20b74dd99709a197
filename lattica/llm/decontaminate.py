"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Texts and items are normalised (A-Z lower-cased, runs of ASCII white space to one space) and compared as UTF-8 bytes. An
item of n bytes is found in a document if some passage is within floor(MAX_EDITS * n) byte edits of it.

Windows begin at every word of every document, at every character of runs of more than LONG_RUN bytes without a space
(Chinese, Japanese, Thai, packed text), and within words where pieces of items (see below) begin after others; they are as long as an item. Windows that hold too few of the items'
8-byte pieces to be so near to any item of a length class are out (a count that no window within the distance fails).
The others go through the CGK embedding: a random walk that at each step puts out the byte under its pointer and moves
on or stays by a random function of step and byte, so that edits become few Hamming differences. REPEATS walks with
TABLES samples of SAMPLE steps each hash windows and items; whatever shares a bucket is verified by an exact
bit-parallel edit distance.

Items are indexed on the driver, ITEMS_AT_ONCE or ITEM_BYTES of them at a time (one longer item alone); larger
benchmarks take as many passes. So an index of at most about 60 MB, and its longest item, is broadcast. Nothing that
grows with the documents is gathered.

Defined results: null and empty texts match nothing; items that are empty after normalisation are ignored; equal items
match each; repeated rows of documents give repeated results; an empty table on either side gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import blocks, read, text_bytes, text_digest
from lattica.llm.shingles import mix

MAX_EDITS = 0.08
PIECE = 8
REPEATS, TABLES, SAMPLE = 5, 16, 6
SEED = 11
CLASS_RATIO = 1.15
ITEMS_AT_ONCE, ITEM_BYTES = 20_000, 8 << 20
#: Longer runs without a space have windows at all their characters. Shorter ones have a word's start or end near.
LONG_RUN = 16
_PIECE_BITS = 22
#: Steps of a walk whose moves are kept; those of further steps are made anew.
_KEPT_STEPS = 2048
_LANES = 1 << 15


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes of all texts, their offsets, and the place each byte had."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    low[space] = 32
    again = np.zeros(len(data), bool)
    again[1:] = space[1:] & space[:-1]
    again[offsets[:-1][offsets[:-1] < len(data)]] = False
    kept = np.flatnonzero(~again)
    return low[kept], np.searchsorted(kept, offsets), kept


def normal(text: str) -> bytes:
    raw = np.frombuffer(text.encode(), np.uint8)
    return normalise(raw, np.array([0, len(raw)]))[0].tobytes().strip()


def best_edits(item: bytes, text: bytes) -> tuple[int, int]:
    """Least number of edits between item and any part of text, and the end of the first such part (bit-parallel)."""
    m = len(item)
    if (at := text.find(item)) >= 0:
        return 0, at + m
    full, high = (1 << m) - 1, 1 << (m - 1)
    masks: dict[int, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    up, down, score, best, end = full, 0, m, m, 0
    for k, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        hp, hn = down | (full & ~(d0 | up)), up & d0
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full
        up, down = hn | (full & ~(d0 | hp)), d0 & hp
        if score < best:
            best, end = score, k + 1
    return best, end


def allowed(n: int, ratio: float = MAX_EDITS) -> int:
    return int(ratio * n + 1e-9)


def _pieces(data: np.ndarray) -> np.ndarray:
    """A hash of the PIECE bytes that begin at each byte."""
    value = data.astype(np.uint32) + np.uint32(1)
    width = 1
    while width < PIECE:
        value = value[: len(value) - width] * np.uint32(pow(0x01000193, width, 1 << 32)) + value[width:] if len(value) > width else value[:0]
        width *= 2
    return (value * np.uint32(0x9E3779B1)) >> np.uint32(32 - _PIECE_BITS)


def _window_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin, and every character of runs of more than LONG_RUN bytes without a space."""
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    stops = np.flatnonzero(first | (data == 32))
    first[1:] |= data[:-1] == 32
    first &= data != 32
    lengths = np.diff(np.append(stops, len(data)))
    long = np.repeat(lengths > LONG_RUN, lengths)
    inside = np.zeros(len(data), bool)
    if len(stops):
        inside[stops[0] :] = long
    return np.flatnonzero(first | inside & (data != 32) & ((data & 0xC0) != 0x80))


def _moves(repeat: int, first: int) -> np.ndarray:
    """Whether a walk moves on from each byte, at _KEPT_STEPS steps from a first one on."""
    step = np.arange(first, first + _KEPT_STEPS, dtype=np.uint64)[:, None]
    return (mix(np.arange(256, dtype=np.uint64) + (step << np.uint64(8)) + np.uint64(SEED * REPEATS + repeat << 40)) >> np.uint64(63)).astype(np.int8)


class Index:
    """Length classes of items, each with its hash tables."""

    def __init__(self, items: list[tuple[int, bytes]], ratio: float = MAX_EDITS):
        self.items, self.ratio, rng = items, ratio, np.random.default_rng(SEED)
        self.moves = [_moves(repeat, 0) for repeat in range(REPEATS)]
        self.classes = []
        holders = np.zeros(1 << _PIECE_BITS, np.uint64)
        order = sorted(range(len(items)), key=lambda k: len(items[k][1]))
        while order:
            least = len(items[order[0]][1])
            own = [k for k in order if len(items[k][1]) <= max(least, int(least * CLASS_RATIO))]
            order = order[len(own) :]
            most = max(len(items[k][1]) for k in own)
            for k in own:
                holders[_pieces(np.frombuffer(items[k][1], np.uint8))] |= np.uint64(1 << len(self.classes) % 64)
            steps = max(SAMPLE, 2 * least)
            samples = np.stack([np.stack([np.sort(rng.choice(steps, SAMPLE, replace=steps < SAMPLE)) for _ in range(TABLES)]) for _ in range(REPEATS)])
            padded = np.zeros((len(own), most + 1), np.uint8)
            for row, k in enumerate(own):
                padded[row, : len(items[k][1])] = np.frombuffer(items[k][1], np.uint8)
            starts = np.arange(len(own)) * (most + 1)
            tables = []
            for repeat in range(REPEATS):
                keys = self._keys(padded.ravel(), starts, starts + most, repeat, samples[repeat], steps)
                for t in range(TABLES):
                    at = np.argsort(keys[t], kind="stable")
                    tables.append((keys[t][at], np.array(own)[at]))
            need = min(len(items[k][1]) - PIECE + 1 - PIECE * allowed(len(items[k][1]), ratio) for k in own)
            self.classes.append({"need": need, "span": most + allowed(most, ratio), "steps": steps, "samples": samples, "tables": tables, "most": most})
        # which length classes (beyond 64, which of them modulo 64) have a piece
        self.holders = holders.astype(np.uint16) if len(self.classes) <= 16 else holders

    def _keys(self, data: np.ndarray, start: np.ndarray, last: np.ndarray, repeat: int, samples: np.ndarray, steps: int) -> np.ndarray:
        """For each table the key of each window; the walk stays on a window's last byte."""
        at, wanted = start.astype(np.int64), set(samples.ravel().tolist())
        seen = {}
        moves = self.moves[repeat]
        for step in range(max(wanted) + 1):
            byte = data[at]
            if step in wanted:
                seen[step] = byte
            if step and step % _KEPT_STEPS == 0:
                moves = _moves(repeat, step)
            at = np.minimum(at + moves[step % _KEPT_STEPS][byte], last)
        out = np.zeros((len(samples), len(start)), np.uint64)
        for place in range(samples.shape[1]):
            out = out << np.uint64(8) | np.stack([seen[step] for step in samples[:, place].tolist()])
        return out

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of window starts and items' numbers that share a bucket."""
        if len(data) < PIECE:
            return
        holders = self.holders[_pieces(data)]
        starts = _window_starts(data, offsets)
        padded = np.concatenate([data, np.zeros(1, np.uint8)])
        for number, c in enumerate(self.classes):
            hit = (holders & holders.dtype.type(1 << number % 64)) != 0
            total = np.concatenate([np.zeros(1, np.int32), np.cumsum(hit, dtype=np.int32)])

            def held(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Pieces that windows from these places hold, and where their texts end."""
                ends = offsets[np.searchsorted(offsets, begin, "right")]
                stop = np.minimum(begin + c["span"], ends)
                return total[np.minimum(np.maximum(stop - PIECE + 1, begin), len(hit))] - total[np.minimum(begin, len(hit))], ends

            # an item may begin within a short word: there its pieces begin
            inside = np.flatnonzero(hit[1:] & ~hit[:-1]) + 1
            inside = inside[(data[inside] != 32) & ((data[inside] & 0xC0) != 0x80)]
            lanes = np.concatenate([starts, inside])
            pieces, lane_ends = held(lanes)
            lanes, lane_ends = lanes[pieces >= c["need"]], lane_ends[pieces >= c["need"]]
            for k in range(0, len(lanes), _LANES):
                part, last = lanes[k : k + _LANES], np.minimum(lane_ends[k : k + _LANES], lanes[k : k + _LANES] + c["most"])
                # windows that the text cuts short stay on the byte after them
                for repeat in range(REPEATS):
                    keys = self._keys(padded, part, last, repeat, c["samples"][repeat], c["steps"])
                    for t in range(TABLES):
                        table, item = c["tables"][repeat * TABLES + t]
                        low, high = np.searchsorted(table, keys[t], "left"), np.searchsorted(table, keys[t], "right")
                        if (many := high > low).any():
                            n = (high - low)[many]
                            place = np.repeat(low[many], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                            yield np.repeat(part[many], n), item[place]


def _matches(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 2 << 20):
            raw, cut = text_bytes(batch.column(batch.schema.get_field_index("text")))
            data, offsets, _ = normalise(raw, cut)
            doc_ids = batch.column(batch.schema.get_field_index("doc_id"))
            found = list(index.candidates(data, offsets))
            if not found:
                continue
            start, item = np.concatenate([s for s, _ in found]), np.concatenate([i for _, i in found])
            row = np.searchsorted(offsets, start, "right") - 1
            best: dict[tuple[int, int], int] = {}
            spans: list[list[int]] = []  # candidates of one item that lie close together are verified at once
            for r, i, s in sorted(set(zip(row.tolist(), item.tolist(), start.tolist(), strict=True))):
                if spans and spans[-1][:2] == [r, i] and s - spans[-1][3] <= len(index.items[i][1]):
                    spans[-1][3] = s
                else:
                    spans.append([r, i, s, s])
            for r, i, s, last in spans:
                text, most = index.items[i][1], allowed(len(index.items[i][1]), index.ratio)
                begin, end = max(int(offsets[r]), s - most), min(int(offsets[r + 1]), last + len(text) + 2 * most)
                if best.get((r, i), 1) and (edits := best_edits(text, data[begin:end].tobytes())[0]) <= most:
                    best[r, i] = min(best.get((r, i), edits), edits)
            if best:
                keys = list(best)
                n = np.array([len(index.items[i][1]) for _, i in keys])
                edits = np.array([best[k] for k in keys], np.int64)
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array([r for r, _ in keys])), pa.array([index.items[i][0] for _, i in keys], pa.int64()), pa.array(edits), pa.array(1 - edits / n)], ["doc_id", "item_id", "edits", "similarity"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, ratio: float = MAX_EDITS) -> DataFrame:
    """(doc_id, item_id, edits, similarity) for each item that a document of docs (doc_id, text) holds."""
    return _holders(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, ratio)


def _item_blocks(items: Iterator[tuple[int, bytes]]) -> Iterator[list[tuple[int, bytes]]]:
    """Items that aren't empty, as many at once as an index may have."""
    block, size = [], 0
    for item in items:
        if item[1]:
            if block and (len(block) == ITEMS_AT_ONCE or size + len(item[1]) > ITEM_BYTES):
                yield block
                block, size = [], 0
            block.append(item)
            size += len(item[1])
    if block:
        yield block


def _holders(rows: DataFrame, benchmark: DataFrame, ratio: float) -> DataFrame:
    """As contaminated(), of rows (doc_id of any kind, text)."""
    spark = rows.sparkSession
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id bigint, edits bigint, similarity double"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = spark.createDataFrame([], kind)
    for known in _item_blocks((r["item_id"], normal(r["text"])) for r in items.orderBy("item_id", "text").toLocalIterator()):
        index = spark.sparkContext.broadcast(Index(known, ratio))

        def run(batches, index=index):
            return _matches(index.value)(batches)

        out = out.unionByName(rows.mapInArrow(run, kind))
    return out


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and how near it is."""
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item; rows are told apart by doc_id and text."""
    row = F.struct(F.col("doc_id").cast("long").alias("id"), text_digest(F.col("text")).alias("md5"))
    found = _holders(docs.select(row.alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"), MAX_EDITS)
    bad = found.select(F.col("doc_id.id").alias("__bad_id"), F.col("doc_id.md5").alias("__bad_md5")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["__bad_id"]) & (text_digest(docs["text"]) == bad["__bad_md5"]), "left_anti")


SQL: dict[str, str] = {}
QUERIES = {"op2_decontaminate": op2_decontaminate}
