"""Token ids in a content-addressed store.

Texts become ids of a public tokenizer, each document ended by END_ID. A rolling hash over the ids cuts each document's
stream into chunks where the content says so; a chunk's name is its BLAKE2b digest, and each chunk is stored once,
however many documents have it. A document's recipe lists its chunks; its Merkle root is over their digests, and the
manifest has a Merkle root for each part of the recipes, and one over the parts. Reading first holds the recipes'
counts and roots against the manifest, then gets chunks by name, checks every digest and root, and puts the ids
together. What is missing, cut or changed is an error.

Files below the store's folder: packs/*.pack (frames of zstd with chunks as little-endian ids of 2 or 4 bytes),
index (digest, pack, frame, place), recipes (in doc_id order, with the number of ids before each document) and
manifest. Tasks write files under names no other attempt uses; those of finished tasks alone are named by the tables.

Encoding works on pieces between single white-space characters, at which the byte-level pre-tokenizer always cuts, and
remembers pieces; the ids are those of the tokenizers library for the whole text.

Defined results: a null or empty text has only END_ID; null doc_ids come last; documents of equal doc_id are ordered
by a hash of their ids, and repeated rows are repeated documents; an empty table gives an empty store; extra columns
are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import blocks, filesystem, freed, kept, partitions, read, shared_dir

END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: Chunks end where MASK_BITS bits of the hash of the last WINDOW ids are 0; at LEAST and at MOST so many ids.
WINDOW, MASK_BITS, LEAST, MOST = 16, 9, 64, 4096
FRAME_BYTES = 128 << 10
#: Pieces of up to _REMEMBERED characters are remembered, _PIECES of them at most.
_PIECES, _REMEMBERED = 1_200_000, 24
#: White space other than single spaces and line ends, and the mark that pieces() cuts at.
_ODD_SPACE = ("  ", "\n\n", " \n", "\n ", *map(chr, (0, 9, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_PLACE = "file string, frame bigint, packed int, at int, size int"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts, with a memory of pieces that is emptied when it is full."""

    _slow = re.compile(r"(?<=\S)(?= \S|\n\S)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor are its parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        step, self.letters = self.tokenizer.pre_tokenizer, None
        if type(step).__name__ == "ByteLevel" and step.use_regex and not step.add_prefix_space and self.tokenizer.normalizer is None:
            # the byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on
            own = [*range(33, 127), *range(161, 173), *range(174, 256)]
            self.letters = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(own))}
            self.marks = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in "\n.,;:!?|"}
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        self.begin, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def pieces(self, text: str) -> list[str]:
        plain = not any(x in text for x in _ODD_SPACE)
        if not plain:  # white space other than single spaces and line ends
            return self._slow.split(text)
        return text.replace("\n", "\x00\n").replace(" ", "\x00 ").split("\x00")

    def _ids(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, and how many each has.

        A word of letters with a space or line end before it and a mark after it is cut there by the pre-tokenizer; so
        the model gets the word alone, in the byte-level alphabet. Other pieces go through the whole tokenizer.
        """
        if not self.letters:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        else:
            ids, rest, marks, letters, space, model = [], [], self.marks, self.letters, self.letters[32], self.model.tokenize
            for k, piece in enumerate(new):
                head = tail = None
                if piece[:1] == "\n":
                    head, piece = marks["\n"], piece[1:]
                if (last := piece[-1:]) in marks:
                    tail, piece = marks[last], piece[:-1]
                spaced = piece[:1] == " "
                word = piece[1:] if spaced else piece
                if not word.isalpha():
                    rest.append(k)
                    ids.append(None)
                    continue
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(letters)
                own = [t.id for t in model(space + word if spaced else word)]
                ids.append(own if head is tail is None else [*(head or ()), *own, *(tail or ())])
            for k, e in zip(rest, self.tokenizer.encode_batch_fast([new[k] for k in rest], add_special_tokens=False), strict=True):
                ids[k] = e.ids
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), self.dtype, int(sizes.sum())), sizes

    def _learn(self, new: list[str]) -> None:
        """Adds pieces to the memory; ids of pieces not worth remembering stay until the next batch."""
        flat, sizes = self._ids(new)
        n, k, total = self.count, len(new), int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + k > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used : self.used + total] = flat
        self.begin[n : n + k], self.size[n : n + k] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.count = self.used + total, n + k

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with its end id, in one array, and the n + 1 offsets."""
        gc.disable()  # many lists, no cycles
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        cut = [self.pieces(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        every = list(chain.from_iterable(cut))
        index = np.fromiter(map(self.known.get, every, repeat(-1)), np.int64, len(every))
        self.count, used = len(self.known), self.used
        missed = np.flatnonzero(index < 0).tolist()
        if missed:
            new = dict.fromkeys(every[k] for k in missed)
            if len(self.known) > _PIECES and 2 * len(missed) > len(every):  # other texts than those it has seen
                self.clear()
                return self._encode(texts)
            lasting = [p for p in new if p and len(p) <= _REMEMBERED] if len(self.known) <= _PIECES else []
            first = self.count
            self._learn(lasting)
            self.known.update(zip(lasting, range(first, self.count), strict=True))
            used = self.used
            brief = [p for p in new if p not in self.known]
            new.update(zip(lasting, range(first, self.count), strict=True))
            new.update(zip(brief, range(self.count, self.count + len(brief)), strict=True))
            self._learn(brief)
            index[missed] = [new[every[k]] for k in missed]
        self.used = used
        # each document's end is one more piece of one id
        ends = np.cumsum(counts)
        size = np.insert(self.size[index], ends, 1)
        begin = np.insert(self.begin[index], ends, -1)
        stop = np.cumsum(size)
        source = np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - size), size)
        last = stop[ends + np.arange(len(texts))] - 1 if len(texts) else np.zeros(0, np.int64)
        source[last] = 0
        out = self.flat[source]
        out[last] = END_ID
        return out, np.concatenate([[0], last + 1]).astype(np.int64)


def encoder(path: str) -> Encoder:
    """The encoder that this Python worker keeps."""
    return kept(path, lambda: Encoder(path))


def rolling(ids: np.ndarray) -> np.ndarray:
    """A hash of the last WINDOW ids at each place: each id's random word, shifted by its age."""
    value = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    width = 1
    while width < WINDOW:
        older = np.zeros_like(value)
        older[width:] = value[:-width] << np.uint64(width)
        value = value + older
        width *= 2
    return value


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end. Only those at LEAST ids into a document count, so what stands before it doesn't."""
    return np.flatnonzero((rolling(ids) >> np.uint64(64 - MASK_BITS)) == 0) + 1


def cuts(n: int, found: list[int]) -> list[int]:
    """Ends of the chunks of a document of n ids with these marks."""
    ends, last = [], 0
    for mark in (*found, n):
        while mark - last > MOST:
            ends.append(last := last + MOST)
        if mark - last >= LEAST or mark == n and mark > last:
            ends.append(last := mark)
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of digests; a node without sibling rises as it is."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [digest(b"\x01" + level[k] + level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


class FrameWriter:
    """A file of zstd frames; put() says where a chunk went: frame's number, and place in the frame."""

    def __init__(self, folder: str, suffix: str, level: int = 3):
        import zstandard

        self.store, path = filesystem(folder)
        self.store.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.{suffix}"
        self.uri, self.out = f"{folder}/{name}", self.store.open_output_stream(f"{path}/{name}", compression=None)
        self.zstd, self.parts, self.size, self.offset, self.packed = zstandard.ZstdCompressor(level=level), [], 0, 0, {}

    def put(self, data: bytes) -> tuple[int, int]:
        place = (self.offset, self.size)
        self.parts.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self.flush()
        return place

    def flush(self) -> None:
        if self.parts:
            frame = self.zstd.compress(b"".join(self.parts))
            self.out.write(frame)
            self.packed[self.offset] = len(frame)
            self.offset, self.parts, self.size = self.offset + len(frame), [], 0

    def close(self) -> None:
        self.flush()
        self.out.close()


class FrameReader:
    """Chunks of any frame of any file; keeps the last frames and some open files."""

    def __init__(self, frames: int = 64, files: int = 16):
        import zstandard

        self.zstd, self.frames, self.files, self.most = zstandard.ZstdDecompressor(), OrderedDict(), OrderedDict(), (frames, files)
        self.last, self.data = None, b""

    def get(self, uri: str, frame: int, packed: int, at: int, size: int) -> bytes:
        key = (uri, frame)
        if key == self.last:
            return self.data[at : at + size]
        if key not in self.frames:
            if uri not in self.files:
                store, path = filesystem(uri)
                self.files[uri] = store.open_input_file(path)
                if len(self.files) > self.most[1]:
                    self.files.popitem(last=False)[1].close()
            file = self.files[uri]
            file.seek(frame)
            self.frames[key] = self.zstd.decompress(file.read(packed))
            if len(self.frames) > self.most[0]:
                self.frames.popitem(last=False)
        self.frames.move_to_end(key)
        self.last, self.data = key, self.frames[key]
        return self.data[at : at + size]


_STAGED = f"doc_id bigint, n_tokens bigint, root binary, names array<binary>, new array<struct<name: binary, {_PLACE.replace(' ', ': ').replace(',:', ',')}>>"


def _place_type() -> pa.DataType:
    return pa.struct([("name", pa.binary()), ("file", pa.string()), ("frame", pa.int64()), ("packed", pa.int32()), ("at", pa.int32()), ("size", pa.int32())])


def _encode_to(folder: str, path: str):
    """Per document its recipe, and of the chunks that this task met first, where its own file has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, writer, seen = encoder(path), None, set()
        held: list[tuple] = []

        def emit():
            for _, _, _, _, new in held:
                for x in new:
                    x["packed"] = writer.packed[x["frame"]]
            columns = list(zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.list_(pa.binary())), pa.array(columns[4], pa.list_(_place_type()))], ["doc_id", "n_tokens", "root", "names", "new"])

        for batch in blocks(batches, "text", 2 << 20, path):
            writer = writer or FrameWriter(f"{folder}/spool", "spool", 1)
            ids, offsets = words.encode(batch.column(batch.schema.get_field_index("text")).to_pylist())
            doc_ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            every = marks(ids)
            bound = np.searchsorted(every, offsets, "right").tolist()
            for k, doc_id in enumerate(doc_ids):
                own, last, names, new = ids[offsets[k] : offsets[k + 1]], 0, [], []
                for end in cuts(len(own), (every[bound[k] : bound[k + 1]] - offsets[k]).tolist()):
                    data = own[last:end].tobytes()
                    last = end
                    names.append(name := digest(data))
                    if name not in seen:
                        seen.add(name)
                        frame, at = writer.put(data)
                        new.append({"name": name, "file": writer.uri, "frame": frame, "packed": 0, "at": at, "size": len(data)})
                held.append((doc_id, len(own), merkle(names), names, new))
            writer.flush()
            yield emit()
        if writer:
            writer.close()

    return run


def _pack_to(folder: str):
    """Copies the chunks that the rows name, in the order of the rows, to files of packs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, writer = FrameReader(2, 2), None
        for batch in batches:
            if not batch.num_rows:
                continue
            writer = writer or FrameWriter(f"{folder}/packs", "pack")
            rows = []
            for x in batch.to_pylist():
                frame, at = writer.put(reader.get(x["file"], x["frame"], x["packed"], x["at"], x["size"]))
                rows.append((x["name"], frame, at, x["size"]))
            writer.flush()
            name, frame, at, size = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.binary()), pa.array([writer.uri] * len(rows)), pa.array(frame, pa.int64()), pa.array([writer.packed[f] for f in frame], pa.int32()), pa.array(at, pa.int32()), pa.array(size, pa.int32())], ["name", "file", "frame", "packed", "at", "size"])
        if writer:
            writer.close()

    return run


#: The manifest's rows are as many as parts; the row of part _WHOLE is over all parts.
_MANIFEST = "part int, documents bigint, root binary"
_WHOLE = -1


def _part_roots(recipes: DataFrame) -> DataFrame:
    """(part, documents, root) of the parts of recipes (part, start, root, ...)."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves: dict[int, list] = {}
        for batch in batches:
            for part, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                leaves.setdefault(part, []).append(root)
        yield pa.RecordBatch.from_arrays([pa.array(list(leaves), pa.int32()), pa.array([len(x) for x in leaves.values()], pa.int64()), pa.array([merkle(x) for x in leaves.values()], pa.binary())], ["part", "documents", "root"])

    return recipes.select("part", "start", "root").repartition("part").sortWithinPartitions("part", "start").select("part", "root").mapInArrow(roots, _MANIFEST)


def verify_recipes(spark: SparkSession, folder: str) -> None:
    """ValueError unless the recipes are those that the manifest was made of."""
    kept = {r["part"]: (r["documents"], bytes(r["root"])) for r in spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").collect()}
    whole = kept.pop(_WHOLE, None)
    found = {r["part"]: (r["documents"], bytes(r["root"])) for r in _part_roots(spark.read.parquet(f"{folder}/recipes")).collect()}
    if found != kept or whole != (sum(n for n, _ in kept.values()), merkle([kept[p][1] for p in sorted(kept)])):
        raise ValueError(f"the recipes in {folder} aren't what its manifest says")


def write_store(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Encodes docs (doc_id, text) and writes the store."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows.mapInArrow(_encode_to(folder, path or tokenizer_path()), _STAGED).write.parquet(f"{folder}/staged")
    staged = spark.read.schema(_STAGED).parquet(f"{folder}/staged")
    found = staged.select(F.explode("new").alias("c")).select("c.*")
    own = found.groupBy("name").agg(F.min(F.struct("file", "frame", "at", "packed", "size")).alias("p")).select("name", "p.*")
    own = own.repartition(partitions(spark), "file").sortWithinPartitions("file", "frame", "at")
    own.mapInArrow(_pack_to(folder), f"name binary, {_PLACE}").write.parquet(f"{folder}/index")
    order = [F.col("doc_id").asc_nulls_last(), F.col("root")]
    parts = staged.drop("new").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    parts.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}).write.parquet(f"{folder}/ordered")
    ordered = spark.read.parquet(f"{folder}/ordered")
    before, sums = 0, {}
    for part, n in sorted(map(tuple, ordered.groupBy("part").agg(F.sum("n_tokens")).collect())):
        sums[part], before = before, before + n
    earlier = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.element_at(F.create_map(*(F.lit(int(x)) for kv in sums.items() for x in kv)).cast("map<int,bigint>"), F.col("part")) if sums else F.lit(0)
    recipes = ordered.withColumn("start", offset + F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    recipes.select("part", "doc_id", "start", "n_tokens", "root", "names").write.parquet(f"{folder}/recipes")

    manifest = sorted(tuple(r) for r in _part_roots(spark.read.parquet(f"{folder}/recipes")).collect())
    manifest.append((_WHOLE, sum(n for _, n, _ in manifest), merkle([bytes(r) for _, _, r in manifest])))
    spark.createDataFrame(manifest, _MANIFEST).coalesce(1).write.parquet(f"{folder}/manifest")
    store, where = filesystem(folder)
    for spent in ("spool", "staged", "ordered"):
        if store.get_file_info(f"{where}/{spent}").type != pa.fs.FileType.NotFound:
            store.delete_dir(f"{where}/{spent}")


def read_store(spark: SparkSession, folder: str, width: int = 2, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, where wanted), from the files alone; every digest and root is checked."""
    verify_recipes(spark, folder)
    recipes = spark.read.parquet(f"{folder}/recipes")
    index = spark.read.schema(f"name binary, {_PLACE}").parquet(f"{folder}/index")
    uses = recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode("names").alias("k", "name"))
    places = uses.join(index, "name", "left").groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct("k", "name", "file", "frame", "packed", "at", "size"))).alias("chunks"))
    places = places.select("doc_id", "start", "n_tokens", "root", "chunks")
    # documents that begin with one chunk lie together, but needn't be in one task
    where = [F.col("chunks")[0]["file"], F.col("chunks")[0]["frame"], F.col("start")]
    near = places.repartitionByRange(partitions(spark), *where).sortWithinPartitions(*where)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, kind = FrameReader(), np.dtype(f"<u{width}")
        for batch in batches:
            rows, lists = [], batch.column(4)
            doc_ids, starts, counts, roots = (batch.column(k).to_pylist() for k in range(4))
            flat = lists.flatten()
            name, file, frame, packed, at, long = (flat.field(c).to_pylist() for c in ("name", "file", "frame", "packed", "at", "size"))
            if None in file:
                raise ValueError(f"the store lacks chunk {name[file.index(None)].hex()}")
            cut = [0, *np.cumsum(lists.value_lengths().to_numpy()).tolist()]
            for k, start in enumerate(starts):
                own = slice(cut[k], cut[k + 1])
                data = list(map(reader.get, file[own], frame[own], packed[own], at[own], long[own]))
                names = list(map(digest, data))
                ids = np.frombuffer(b"".join(data), kind).astype("<u4")
                if names != name[own] or merkle(names) != roots[k] or len(ids) != counts[k]:
                    raise ValueError(f"document {doc_ids[k]} at {start} isn't what its recipe says")
                rows.append((doc_ids[k], start, len(ids), zlib.crc32(ids)) + ((ids.tolist(),) if keep_ids else ()))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names[: len(rows[0])])
        freed()

    return near.mapInArrow(load, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * keep_ids)


def store_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Writes docs to a store in the shared folder and reads it back."""
    folder = shared_dir(spark, "tokens")
    write_store(docs, folder)
    return read_store(spark, folder)


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written to a store and read back."""
    return store_documents(spark, read(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op9_token_store": op9_token_store}
