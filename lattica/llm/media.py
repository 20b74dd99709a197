"""Media columns: chroma fingerprints of audio, and a search that aligns recordings.

A media column holds WAV bytes (PCM, 16 bits, one or more channels). A recording becomes frames of 12 pitch classes: the
energy of each window's spectrum, folded into octaves and normalised. Over the integral image of these frames, filters
of several shapes compare sums of rectangles; each gives two Gray-coded bits, and all together a packed 32-bit integer
per frame.

Recordings with equal fingerprints form a class, named by the fingerprint's digest, and classes are searched. A query
class and another that share integers vote for offsets between their frames; at every offset that has a vote the bits
that differ over the common frames are counted, and the offset with the fewest decides. The common frames must be
LEAST_OVERLAP, or all of the shorter recording. Integers that many classes have are not left out: the votes of a pair
become one row before its fingerprints are gathered.

Defined results: a null, empty or broken recording, and one shorter than a filter, has an empty fingerprint, belongs
to a class of its own (by id) and matches nothing; of a recording that is cut short the whole frames count; one of
fewer than LEAST_FRAMES integers matches nothing but its equals; recordings of one id needn't be in one class; repeated
rows are members of one class; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import read, written

RATE, NOTE = 4000, 320
WINDOW, HOP = 512, 160
LOWEST, HIGHEST = 110.0, 1760.0
SPAN = 16
MOST_BITS = 0.1
LEAST_OVERLAP, LEAST_FRAMES = 40, 8
_BITS = np.array([bin(k).count("1") for k in range(1 << 16)], np.uint8)


def decode(data: bytes | None) -> tuple[int, np.ndarray]:
    """Rate and samples (mean of the channels) of a WAV; nothing of what can't be read."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            if w.getsampwidth() != 2:
                return 0, np.zeros(0, np.float32)
            data, channels = w.readframes(w.getnframes()), w.getnchannels()
            x = np.frombuffer(data[: len(data) // (2 * channels) * 2 * channels], "<i2").astype(np.float32)
            return w.getframerate(), x.reshape(-1, channels).mean(1)
    except (wave.Error, EOFError, struct.error, RuntimeError):  # RuntimeError: a chunk that says it ends before it begins
        return 0, np.zeros(0, np.float32)


def encode(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(samples, -32767, 32767).astype("<i2").tobytes())
    return out.getvalue()


_folds: dict[int, np.ndarray] = {}


def _fold(rate: int) -> np.ndarray:
    """Which pitch class each frequency of a window's spectrum belongs to."""
    if rate not in _folds:
        if len(_folds) > 64:
            _folds.clear()
        freq = np.fft.rfftfreq(WINDOW, 1 / rate)
        table = np.zeros((len(freq), 12), np.float32)
        heard = np.flatnonzero((freq >= LOWEST) & (freq <= HIGHEST))
        table[heard, np.round(12 * np.log2(freq[heard] / LOWEST)).astype(int) % 12] = 1
        _folds[rate] = table
    return _folds[rate]


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames of 12 pitch classes, each frame of length one."""
    if len(samples) < WINDOW or not rate:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, WINDOW)[::HOP] * np.hanning(WINDOW).astype(np.float32)
    energy = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32) ** 2
    out = np.sqrt(energy @ _fold(rate))
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return np.where(norm > 1e-3, out / np.maximum(norm, 1e-3), 0).astype(np.float32)


def _filters() -> list[tuple[int, int, int, int]]:
    """(shape, first pitch class, classes, frames) of the 16 filters, by rule: shapes in turn, sizes that halve."""
    out = []
    for k in range(16):
        classes = (12, 8, 6, 4)[k // 4]
        out.append((k % 4, (5 * k) % (13 - classes), classes, (SPAN, SPAN // 2)[k // 2 % 2]))
    return out


FILTERS = _filters()


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """A packed integer for each place where all filters fit."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13), np.float64)
    image[1:, 1:] = frames.cumsum(0).cumsum(1)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return image[t1 : t1 + n, c1] - image[t0 : t0 + n, c1] - image[t1 : t1 + n, c0] + image[t0 : t0 + n, c0]

    out = np.zeros(n, np.uint32)
    for shape, c, classes, t in FILTERS:
        if shape == 0:  # lower against upper classes
            a, b = area(0, t, c, c + classes // 2), area(0, t, c + classes // 2, c + classes)
        elif shape == 1:  # earlier against later frames
            a, b = area(0, t // 2, c, c + classes), area(t // 2, t, c, c + classes)
        elif shape == 2:  # opposite quarters
            h, m = t // 2, c + classes // 2
            a, b = area(0, h, c, m) + area(h, t, m, c + classes), area(0, h, m, c + classes) + area(h, t, c, m)
        else:  # the middle of the frames against both sides
            a, b = 2 * area(t // 4, 3 * t // 4, c, c + classes), area(0, t, c, c + classes)
        value = np.log1p(a) - np.log1p(b)
        level = (value > -0.25).astype(np.uint32) + (value > 0) + (value > 0.25)
        out = out << np.uint32(2) | (level ^ (level >> np.uint32(1)))
    return out


def fingerprints(media: DataFrame, column: str = "media", key: str = "vec_id") -> DataFrame:
    """id, frames, print (packed little-endian integers) and digest (null if empty) of each row's recording."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = []
            for data in batch.column(1):
                rate, samples = decode(data.as_py())
                prints.append(fingerprint(chroma(samples, rate)))
            packed = [p.astype("<u4").tobytes() for p in prints]
            digests = [hashlib.blake2b(p, digest_size=16).digest() if p else None for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p) for p in prints], pa.int32()), pa.array(packed, pa.binary()), pa.array(digests, pa.binary())], ["id", "frames", "print", "digest"])

    return media.select(F.col(key).cast("long").alias("id"), F.col(column).alias("media")).mapInArrow(run, "id bigint, frames int, print binary, digest binary")


def _kind(prints: DataFrame) -> str:
    return prints.schema["class"].dataType.simpleString()


def _hashes(prints: DataFrame) -> DataFrame:
    """(class, token, at): each integer and its frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(p, "<u4") for p in batch.column(1).to_pylist()]
            size = np.array([len(p) for p in own], np.int64)
            index = np.repeat(np.arange(len(own)), size)
            at = np.arange(len(index)) - np.repeat(np.cumsum(size) - size, size)
            token = np.concatenate(own) if own else np.zeros(0, np.uint32)
            # of an integer that stays for some frames only the first
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (at[1:] == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index[new])), pa.array(token[new].astype(np.int64)), pa.array(at[new].astype(np.int32))], ["class", "token", "at"])

    return prints.select("class", "print").mapInArrow(run, f"class {_kind(prints)}, token bigint, at int")


def search(prints: DataFrame, queries: DataFrame) -> DataFrame:
    """Matches (class, match, offset, overlap, bit_error) of the classes in queries (class) among prints (class, print); class of any type.

    The offset is that with the fewest differing bits among those that an equal integer votes for.
    """
    every = _hashes(prints)
    asked = every.join(queries, "class", "left_semi").select(F.col("class").alias("q"), "token", F.col("at").alias("qat"))
    votes = asked.join(every, "token").where("q != class").select("q", "class", (F.col("at") - F.col("qat")).alias("offset"))
    pairs = votes.groupBy("q", "class").agg(F.sort_array(F.collect_set("offset")).alias("offsets")).withColumnRenamed("class", "match")
    rows = pairs.join(prints.select(F.col("class").alias("q"), F.col("print").alias("qprint")), "q").join(prints.select(F.col("class").alias("match"), F.col("print").alias("mprint")), "match")

    def compared(x: np.ndarray, y: np.ndarray, offset: int) -> tuple[float, int, int]:
        x, y = x[max(0, -offset) :], y[max(0, offset) :]
        n = min(len(x), len(y))
        differ = x[:n] ^ y[:n]
        return float(_BITS[differ & 0xFFFF].sum(dtype=np.int64) + _BITS[differ >> 16].sum(dtype=np.int64)) / (32 * max(1, n)), -n, offset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row, (offsets, x, y) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                least = min(LEAST_OVERLAP, len(x), len(y))
                if least < LEAST_FRAMES:
                    continue
                best = min((c for o in offsets if -(c := compared(x, y, o))[1] >= least), default=(1.0,))
                if best[0] <= MOST_BITS:
                    found.append((row, best[2], -best[1], best[0]))
            if found:
                row, offset, overlap, error = zip(*found, strict=True)
                own = batch.select([0, 1]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(offset, pa.int32()), pa.array(overlap, pa.int32()), pa.array(error)], ["class", "match", "offset", "overlap", "bit_error"])

    return rows.select("q", "match", "offsets", "qprint", "mprint").mapInArrow(run, f"class {_kind(prints)}, match {_kind(prints)}, offset int, overlap int, bit_error double")


def tunes(vectors: DataFrame) -> DataFrame:
    """vec_id and media, a WAV with one note for each number of the vector: the tables hold no recordings of their own."""
    pitch = 220.0 * 2 ** (np.arange(24) / 12)
    t = np.arange(NOTE) / RATE
    fade = np.minimum(1, np.minimum(np.arange(NOTE), NOTE - 1 - np.arange(NOTE)) / 32)
    notes = (6000 * np.sin(2 * np.pi * pitch[:, None] * t) + 3000 * np.sin(4 * np.pi * pitch[:, None] * t)) * fade

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                media = []
                for vector in part.column(1).to_pylist():
                    x = np.nan_to_num(np.array([v or 0.0 for v in vector or []], np.float64))
                    scale = np.sqrt((x**2).mean()) if len(x) else 0
                    step = np.clip(np.floor(12 + 5 * x / scale), 0, 23).astype(int) if scale else np.zeros(len(x), int)
                    media.append(encode(notes[step].ravel()) if len(x) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["vec_id", "media"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id bigint, media binary")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tunes of all vectors: each one's class, and the matches of the classes of every id divisible by 100.

    kind 'member': vec_id, class_id and class_key. kind 'match': class_id, class_key, match_id, match_key, offset, overlap and bit_error.
    Keys are digests of fingerprints; ids are the smallest of their members, which two classes may share if an id is repeated.
    """
    prints = written(fingerprints(tunes(read(spark, sf_dir, "embeddings"))), "prints")
    heard = prints.where("digest IS NOT NULL")
    classes = heard.groupBy("digest").agg(F.min("id").alias("id"), F.first("print").alias("print"), F.max(F.coalesce(F.col("id") % 100 == 0, F.lit(False))).alias("asked"))
    classes = written(classes.withColumnRenamed("digest", "class"), "media_classes")
    names = classes.select("class", F.col("id").alias("class_id"), F.lower(F.hex("class")).alias("class_key"))
    alone = prints.where("digest IS NULL").select(F.lit("member").alias("kind"), F.col("id").alias("vec_id"), F.col("id").alias("class_id"))
    members = heard.join(names, heard["digest"] == names["class"]).select(F.lit("member").alias("kind"), F.col("id").alias("vec_id"), "class_id", "class_key")
    found = search(classes.select("class", "print"), classes.where("asked").select("class"))
    matched = names.select(F.col("class").alias("match"), F.col("class_id").alias("match_id"), F.col("class_key").alias("match_key"))
    matches = found.join(names, "class").join(matched, "match").select(F.lit("match").alias("kind"), "class_id", "class_key", "match_id", "match_key", "offset", "overlap", "bit_error")
    return members.unionByName(alone, allowMissingColumns=True).unionByName(matches, allowMissingColumns=True)


SQL: dict[str, str] = {}
QUERIES = {"op10_media": op10_media}
