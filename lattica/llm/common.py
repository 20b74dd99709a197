"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word of a text: a maximal run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


ARROW_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Long texts: what goes to Python at once is bounded by bytes, not only by rows.

    The setting stays with the session, since it counts when a result is computed, not when it is declared.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def freed() -> None:
    """Gives memory that this Python worker no longer uses back to the machine."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_digest(text: Column) -> Column:
    """16 bytes that tell texts apart; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which a cluster sets to suit its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir; where that is unset, on one machine, below a temporary folder."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='lattica-')}"
        context.setCheckpointDir(base)
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, held as a Parquet table in the shared folder, so that nothing before it runs again."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any store that Spark knows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Keys with more rows than both of these are hot: at most one in HOT_KEYS of all rows, and HOT_ROWS.
HOT_ROWS, HOT_KEYS = 4096, 2048


def attached(rows: DataFrame, table: DataFrame, on: str, count: str) -> DataFrame:
    """rows with the columns of table, which has one row for each key and in `count` how many rows have it.

    Rows of hot keys, of which there are HOT_KEYS at most, are joined where they are; the others are shuffled by key.
    """
    keys, most, total = table.agg(F.count(F.lit(1)), F.max(count), F.sum(count)).first()
    if keys <= HOT_KEYS:
        return rows.join(F.broadcast(table), on)
    least = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if (most or 0) <= least:
        return rows.join(table, on)
    hot = F.broadcast(table.where(F.col(count) > least))
    rest = rows.join(hot.select(on), on, "left_anti").join(table.where(F.col(count) <= least), on)
    return rows.join(hot, on).unionByName(rest)


class Tables:
    """Tables of one piece of work, which go when it is done."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths = spark, shared_dir(spark, name), {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path, out
        return out

    def delete(self, table: DataFrame | None = None) -> None:
        """One table, or all of them."""
        delete(self.spark, self.folder if table is None else self.paths[id(table)][0])


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The store that holds a URI and the path within it; any store that Arrow knows."""
    import pyarrow.fs as fs

    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


#: What this Python worker keeps between tasks.
_kept: dict[str, object] = {}


def kept(name: str, make):
    """What make() makes, kept for further tasks of this Python worker, one thing at a time."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def blocks(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20, keep: str = "") -> Iterator[pa.RecordBatch]:
    """The same rows in order, as batches of about `most` bytes of text in `column`; one longer row makes a batch alone.

    What the worker keeps goes, unless it is named `keep`, and so does what its last task left: other work needs the memory.
    """
    if _kept.keys() - {keep}:
        _kept.clear()
    freed()
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        ends = np.cumsum(string_lengths(batch.column(at)))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + most - size, "right")))
            if stop > start + 1 or not held or size + ends[stop - 1] - base <= most:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1] - base)
                start, base = stop, int(ends[stop - 1])
            if size >= most or start < batch.num_rows:
                yield joined(held)
                held, size = [], 0
    if held:
        yield joined(held)
    held = []
    freed()


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def string_lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each string; null counts as 0."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All strings of a column as one byte array, and the n + 1 offsets of its rows; null is empty."""
    import pyarrow.compute as pc

    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]
