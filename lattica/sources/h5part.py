"""The Spark data source `h5part`: steps of particles in HDF5 files, a group `Step#<n>` for each step and a dataset for each column.

A path is one file or a folder of them; a step's rows are those of its files in the order of their names. Tasks read
ranges of rows, also several of one dataset, and of these only the datasets of the chosen columns. Each task writes
files of its own, which get the names that readers see once the whole job has succeeded.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lattica.sources.hdf5 import Builder, Dataset, Reader, Unsupported

STEP = "Step#"
ATTRIBUTES = T.StructType([T.StructField("step", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("value", T.ArrayType(T.DoubleType())), T.StructField("text", T.StringType())])
#: Spark's types for numbers, and those of the files.
_SPARK = {"i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(), "u1": T.ShortType(), "u2": T.IntegerType(), "u4": T.LongType(), "f4": T.FloatType(), "f8": T.DoubleType()}
_NUMPY = {v: k for k, v in _SPARK.items() if k[0] != "u"}
#: Rows that a task reads, and that it has in hand at once; rows of a written file.
TASK_ROWS, BATCH_ROWS, FILE_ROWS = 1 << 20, 1 << 16, 1 << 19
#: Files whose headers are read at a time.
_OPEN = 32


class _Rows(InputPartition):
    """Rows first to last of a file's step, `offset` rows of the step being in files before it."""

    def __init__(self, path: str, step: int, first: int, last: int, offset: int):
        self.path, self.step, self.first, self.last, self.offset = path, step, first, last, offset


class _Attributes(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Commit(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def _files(path: str) -> list[str]:
    """The file, or the folder's files by name; names that begin with _ or . are none."""
    system, base = _located(path)
    info = system.get_file_info(base)
    if info.type == fs.FileType.File:
        return [base]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.File and f.base_name[0] not in "_.")


class _Open:
    """A file of steps, open."""

    def __init__(self, system: fs.FileSystem, path: str):
        self._file = system.open_input_file(path)
        self.reader = Reader(lambda at, n: self._file.read_at(n, at))
        self.steps = {int(k[len(STEP) :]): v for k, v in self.reader.children(self.reader.root).items() if re.fullmatch(rf"{STEP}\d+", k)}

    def __enter__(self) -> _Open:
        return self

    def __exit__(self, *_):
        self._file.close()

    def datasets(self, step: int) -> dict[str, Dataset]:
        found = {name: self.reader.dataset(at) for name, at in self.reader.children(self.steps[step]).items()}
        found = {name: d for name, d in found.items() if d is not None}
        if len({d.rows for d in found.values()}) > 1:
            raise ValueError(f"datasets of step {step} differ in length: { {name: d.rows for name, d in found.items()} }")
        return found


def _field(name: str, data: Dataset) -> T.StructField:
    kind = _SPARK.get(np.dtype(data.dtype).str[1:])
    if kind is None:
        raise Unsupported(f"{name} is {data.dtype}; Spark has no such integer")
    return T.StructField(name, kind)


class H5Part(DataSource):
    """Options for reading:

    step: a number, `last` (default) for the highest, or `all`, which adds a column step;
    columns: names between commas, others aren't read (default: all of the first file that has the step);
    firstRow, lastRow: only these rows of the step, both inclusive (default: all);
    rowColumn: name of a further column with the row's number in its step (default: none);
    taskRows: rows of a task (default 1,048,576);
    what: `particles` (default), or `attributes` for (step, name, type, value, text), the step of the file's own being null.

    For writing: step (default 0), attributes and fileAttributes (JSON of names to numbers, lists of numbers or strings; they are in
    each file and read as one), fileRows (default 524,288: rows of a file, which a task holds in memory), chunkRows
    (default 0: contiguous), level (deflate, needs chunkRows). `overwrite` replaces all files of the folder; `append` adds
    rows, or steps. A null in a floating column becomes NaN; in a column of integers it is an error, as the format has none.
    A table without rows is written as one file, so that its columns stay known.
    """

    @classmethod
    def name(cls) -> str:
        return "h5part"

    def _wanted(self) -> str:
        return self.options.get("step", "last")

    def schema(self) -> T.StructType:
        if self.options.get("what", "particles") == "attributes":
            return ATTRIBUTES
        system, _ = _located(self.options["path"])
        paths = _files(self.options["path"])

        def last_step(path: str) -> int:
            with _Open(system, path) as file:
                return max((s for s in file.steps if self._wanted() in ("last", "all", str(s))), default=-1)

        with ThreadPoolExecutor(_OPEN) as pool:
            lasts = list(pool.map(last_step, paths))
        if (last := max(lasts, default=-1)) < 0:
            raise KeyError(f"no step {self._wanted()} in {self.options['path']}")
        with _Open(system, paths[lasts.index(last)]) as file:
            found = [_field(n, d) for n, d in file.datasets(last).items()]
        if names := self.options.get("columns"):
            known = {f.name: f for f in found}
            names = [n.strip() for n in names.split(",")]
            if missing := [n for n in names if n not in known]:
                raise KeyError(f"no dataset {missing}")
            found = [known[n] for n in names]
        if row := self.options.get("rowColumn"):
            found.append(T.StructField(row, T.LongType()))
        if self._wanted() == "all":
            found.append(T.StructField("step", T.IntegerType()))
        if len({f.name.lower() for f in found}) < len(found):
            raise ValueError(f"{[f.name for f in found]} aren't different names")
        return T.StructType(found)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _StepReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _StepWriter(dict(self.options), schema, overwrite)


class _StepReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self._options, self._schema = {k.lower(): v for k, v in options.items()}, schema

    def partitions(self) -> list[InputPartition]:
        paths = _files(self._options["path"])
        if self._options.get("what", "particles") == "attributes":
            return [_Attributes(paths)]
        system, _ = _located(self._options["path"])

        def rows(path: str) -> dict[int, int]:
            with _Open(system, path) as file:
                wanted = file.steps if self._wanted in ("last", "all") else {s for s in file.steps if str(s) == self._wanted}
                return {s: next((d.rows for d in file.datasets(s).values()), 0) for s in wanted}

        with ThreadPoolExecutor(_OPEN) as pool:
            counts = list(zip(paths, pool.map(rows, paths), strict=True))
        if self._wanted == "last":
            last = max((s for _, c in counts for s in c), default=None)
            counts = [(p, {s: n for s, n in c.items() if s == last}) for p, c in counts]
        first, last = int(self._options.get("firstrow", 0)), int(self._options.get("lastrow", 2**62))
        size, offsets, out = int(self._options.get("taskrows", TASK_ROWS)), {}, []
        for path, steps in counts:
            for step, n in sorted(steps.items()):
                before = offsets.get(step, 0)
                offsets[step] = before + n
                a, b = max(0, first - before), min(n, last + 1 - before)
                out += [_Rows(path, step, k, min(k + size, b), before) for k in range(a, b, size)]
        return out or [_Attributes([])]

    @property
    def _wanted(self) -> str:
        return self._options.get("step", "last")

    def read(self, partition: InputPartition) -> Iterator:
        system, _ = _located(self._options["path"])
        if isinstance(partition, _Attributes):
            yield from self._attributes(system, partition.paths)
            return
        with _Open(system, partition.path) as file:
            data = file.datasets(partition.step)
            row, step = self._options.get("rowcolumn"), "step" if self._wanted == "all" else None
            own = [f for f in self._schema.fields if f.name not in (row, step)]
            if missing := [f.name for f in own if f.name not in data]:
                raise KeyError(f"{partition.path} has no dataset {missing}")
            for a in range(partition.first, partition.last, BATCH_ROWS):
                b = min(a + BATCH_ROWS, partition.last)
                columns = [pa.array(file.reader.rows(data[f.name], a, b).astype(_NUMPY[f.dataType])) for f in own]
                if row:
                    columns.append(pa.array(np.arange(a, b, dtype=np.int64) + partition.offset))
                if step:
                    columns.append(pa.array(np.full(b - a, partition.step, np.int32)))
                yield pa.RecordBatch.from_arrays(columns, names=self._schema.names)

    def _attributes(self, system: fs.FileSystem, paths: list[str]) -> Iterator[tuple]:
        seen = set()
        for path in paths:
            with _Open(system, path) as file:
                for step, at in [(None, file.reader.root), *sorted(file.steps.items())]:
                    for name, v in file.reader.attributes(at).items():
                        if (step, name) not in seen:
                            seen.add((step, name))
                            yield (step, name, "text", None, v) if isinstance(v, str) else (step, name, v.dtype.str[1:], [float(x) for x in v], None)


def _values(given: str | None) -> dict[str, np.ndarray | str]:
    """Attributes from JSON: whole numbers are 64-bit integers, others doubles."""
    return {k: v if isinstance(v, str) else np.atleast_1d(np.array(v)) for k, v in json.loads(given or "{}").items()}


class _StepWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool):
        self._options, self._overwrite = {k.lower(): v for k, v in options.items()}, overwrite
        if wrong := [f.name for f in schema.fields if f.dataType not in _NUMPY]:
            raise Unsupported(f"{wrong} aren't numbers")
        self._types, self._job = {f.name: np.dtype(_NUMPY[f.dataType]) for f in schema.fields}, uuid.uuid4().hex[:12]
        system, base = _located(self._options["path"])
        self._before = [] if system.get_file_info(base).type == fs.FileType.NotFound else _files(self._options["path"])
        # names follow one another in the order of jobs, partitions and files, which is the order of rows
        self._number = 0 if overwrite else 1 + max((int(m[1]) for p in self._before if (m := re.match(r"part-(\d+)-", posixpath.basename(p)))), default=-1)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, base = _located(self._options["path"])
        system.create_dir(base, recursive=True)
        limit, names, waiting, n = int(self._options.get("filerows", FILE_ROWS)), [], [], 0
        part = TaskContext.get().partitionId()

        def put():
            nonlocal waiting, n
            names.append(f"part-{self._number:05d}-{part:06d}-{len(names):06d}-{self._job}-{uuid.uuid4().hex[:8]}.h5part")
            with system.open_output_stream(f"{base}/_{names[-1]}") as out:
                out.write(self._file(waiting))
            waiting, n = [], 0

        for batch in iterator:
            while len(batch):
                some = batch.slice(0, limit - n)
                waiting.append(some)
                n, batch = n + len(some), batch.slice(len(some))
                if n == limit:
                    put()
        if n:
            put()
        return _Commit(names)

    def _file(self, batches: list[pa.RecordBatch]) -> bytes:
        built, children = Builder(), {}
        chunk, level = int(self._options.get("chunkrows", 0)), int(self._options.get("level", 0))
        for k, (name, dtype) in enumerate(self._types.items()):
            parts = [b.column(k) for b in batches]
            if dtype.kind == "i" and any(p.null_count for p in parts):
                raise ValueError(f"{name} has nulls, which integers of this format can't hold")
            values = np.concatenate([p.to_numpy(zero_copy_only=False).astype(dtype) for p in parts]) if parts else np.zeros(0, dtype)
            children[name] = built.dataset(values, chunk, level)
        step = built.group(children, _values(self._options.get("attributes")))
        return built.file(built.group({f"{STEP}{int(self._options.get('step', 0))}": step}, _values(self._options.get("fileattributes"))))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = _located(self._options["path"])
        names = [n for m in messages if m is not None for n in m.names]
        if not names:
            system.create_dir(base, recursive=True)
            names = [f"part-{self._number:05d}-000000-000000-{self._job}.h5part"]
            with system.open_output_stream(f"{base}/_{names[0]}") as out:
                out.write(self._file([]))
        with ThreadPoolExecutor(_OPEN) as pool:
            list(pool.map(lambda n: system.move(f"{base}/_{n}", f"{base}/{n}"), names))
        if self._overwrite:
            for path in self._before:
                system.delete_file(path)
        self._clear(system, base)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_located(self._options["path"]))

    def _clear(self, system: fs.FileSystem, base: str) -> None:
        """Takes away what attempts of this job's tasks have left."""
        if system.get_file_info(base).type == fs.FileType.Directory:
            for f in system.get_file_info(fs.FileSelector(base)):
                if f.base_name.startswith("_part-") and self._job in f.base_name:
                    system.delete_file(f.path)


def write_h5part(df: DataFrame, path: str, step: int = 0, mode: str = "append", **options) -> None:
    """Writes df as a step; options as H5Part names them, attributes as dicts; mode `error` doesn't write where something is."""
    df.sparkSession.dataSource.register(H5Part)
    if mode == "error":
        system, base = _located(path)
        if system.get_file_info(base).type != fs.FileType.NotFound:
            raise FileExistsError(path)
        mode = "append"
    given = {k: json.dumps(v) if isinstance(v, dict) else str(v) for k, v in options.items()}
    df.write.format("h5part").mode(mode).options(step=str(step), **given).save(path)


def read_h5part(spark: SparkSession, path: str, step: int | str = "last", **options) -> DataFrame:
    """A step, the last, or `all`; options as H5Part names them."""
    spark.dataSource.register(H5Part)
    return spark.read.format("h5part").options(step=str(step), **{k: str(v) for k, v in options.items()}).load(path)


def h5part_attributes(spark: SparkSession, path: str) -> DataFrame:
    """(step, name, type, value, text) of all steps, and of the files with a null step."""
    return read_h5part(spark, path, what="attributes")


def h5part_particles(spark: SparkSession, path: str, step: int = -1, columns: tuple[str, ...] = ("x", "y", "z", "h", "vx", "vy", "vz")) -> DataFrame:
    """pid and columns of a step, of the last one for a negative step; without a dataset pid, pid is the row's number in the step."""
    number = "last" if step < 0 else step
    known = read_h5part(spark, path, number).columns
    own = [c for c in ("pid", *columns) if c in known]
    return read_h5part(spark, path, number, columns=",".join(own), **({} if "pid" in known else {"rowColumn": "pid"}))
