"""HDF5 files: their bytes, and steps of particles in them."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import cli
from lattica.sources import snapshots
from lattica.sources.h5part import h5part_attributes, h5part_particles, read_h5part, write_h5part
from lattica.sources.hdf5 import Builder, Damaged, Reader, Unsupported
from lattica.sources.particles import particles
from tests.compare import SMALL


def reader(data):
    return Reader(lambda at, n: bytes(data[at : at + n]))


def built(attributes=None, **values):
    b = Builder()
    step = b.group({n: b.dataset(*v) if isinstance(v, tuple) else b.dataset(v) for n, v in values.items()}, attributes or {})
    return b.file(b.group({"Step#0": step}, {}))


def step_of(r):
    return r.children(r.children(r.root)["Step#0"])


@pytest.mark.parametrize("kind", ["i1", "u1", "i2", "u2", "i4", "u4", "i8", "u8", "f4", "f8"])
def test_types(kind):
    values = np.array([0, 1, 2, 100], kind)
    r = reader(built(v=values))
    data = r.dataset(step_of(r)["v"])
    assert data.dtype[1:] == kind
    assert np.array_equal(r.rows(data, 1, 3), values[1:3])


def test_fixed_bytes():
    """What the format fixes: the superblock, and the messages of a contiguous dataset of doubles."""
    data = bytes(built(v=np.array([1.5])))
    assert data[:24].hex() == "894844460d0a1a0a" + "00000000" + "00080800" + "20001000" + "00000000"
    assert struct.unpack("<4Q", data[24:56]) == (0, 2**64 - 1, len(data), 2**64 - 1)
    assert bytes.fromhex("11203f000800000000004000340b0034ff030000") in data
    assert struct.pack("<BBQQ", 3, 1, 96, 8) in data and data[96:104] == struct.pack("<d", 1.5)


@pytest.mark.parametrize("level", [0, 6])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 64 * 8, 64 * 8 + 1, 64 * 64 * 8 + 5])
def test_chunks(n, level):
    """Also trees of two and three levels."""
    values = np.arange(n, dtype="f8") / 3
    r = reader(built(v=(values, 8, level)))
    data = r.dataset(step_of(r)["v"])
    for a, b in {(0, n), (n // 2, n), (n // 3, n // 2), (max(0, n - 1), n)}:
        assert np.array_equal(r.rows(data, a, b), values[a:b])


def test_a_chunk_reads_only_its_bytes():
    data, asked = built(v=(np.arange(1 << 15, dtype="i8"), 64)), []
    r = Reader(lambda at, n: (asked.append(n), bytes(data[at : at + n]))[1])
    found = r.dataset(step_of(r)["v"])
    asked.clear()
    assert list(r.rows(found, 130, 133)) == [130, 131, 132]
    assert sum(asked) < 8192


def test_many_names():
    values = {f"column_{k}": np.array([k]) for k in range(300)}
    r = reader(built(**values))
    found = step_of(r)
    assert {n: int(r.rows(r.dataset(at), 0, 1)[0]) for n, at in found.items()} == {n: int(v[0]) for n, v in values.items()}


def test_attributes():
    given = {"time": np.array([0.25]), "box": np.arange(6.0), "n": np.array([2**40]), "text": "häuser", "none": ""}
    r = reader(built(given, v=np.array([1.0])))
    got = r.attributes(r.children(r.root)["Step#0"])
    assert got["text"] == "häuser" and got["none"] == ""
    assert all(np.array_equal(got[n], given[n]) for n in ("time", "box", "n"))


def test_user_block():
    data = bytearray(built(v=np.arange(5.0)))
    struct.pack_into("<Q", data, 24, 1024)
    r = reader(bytes(1024) + bytes(data))
    assert list(r.rows(r.dataset(step_of(r)["v"]), 0, 5)) == [0, 1, 2, 3, 4]


def _object(messages, continued=None):
    body = b"".join(struct.pack("<HHB3x", k, len(d) + -len(d) % 8, 0) + d + bytes(-len(d) % 8) for k, d in messages)
    return struct.pack("<BxHII4x", 1, len(messages) + (continued or 0), 1, len(body)) + body


def test_headers_of_other_writers():
    """Big-endian numbers, a dataspace of version 2, filters of version 2 with checksums, a header that is continued, a skipped filter."""
    values = np.arange(6, dtype=">i4")
    plain = values.tobytes()
    packed = zlib.compress(plain[:12]) + b"sums"
    space, kind = struct.pack("<BBBBQ", 2, 1, 0, 1, 6), struct.pack("<4BIHH", 0x10, 9, 0, 0, 4, 0, 32)
    data = bytearray(96)
    data += packed.ljust(64, b"\0") + (plain[12:] + b"sums").ljust(64, b"\0")
    tree = len(data)
    data += struct.pack("<4sBBHQQ", b"TREE", 1, 0, 2, 2**64 - 1, 2**64 - 1)
    data += struct.pack("<IIQQQ", len(packed), 0, 0, 0, 96) + struct.pack("<IIQQQ", 16, 1, 3, 0, 160) + struct.pack("<IIQQ", 0, 0, 6, 0)
    more = len(data)
    rest = [(0x08, struct.pack("<BBBQII", 3, 2, 2, tree, 3, 4)), (0x0B, struct.pack("<BB", 2, 2) + struct.pack("<HHHI", 1, 0, 1, 6) + struct.pack("<HHH", 3, 0, 0))]
    data += _object(rest)[16:]
    size, at = len(data) - more, len(data)
    data += _object([(0x01, space), (0x03, kind), (0x10, struct.pack("<QQ", more, size))], 2)
    b = Builder()
    data[:96] = bytes(b.file(b.group({}, {})))[:96]
    r = reader(data)
    found = r.dataset(at)
    assert (found.rows, found.dtype, found.place[3]) == (6, ">i4", (1, 3))
    assert list(r.rows(found, 0, 6)) == list(range(6)) and list(r.rows(found, 2, 4)) == [2, 3]


def _read_all(r):
    for at in step_of(r).values():
        r.rows(r.dataset(at), 0, 9)
    r.attributes(r.children(r.root)["Step#0"])


def test_cut_files():
    data, ends = built({"time": np.array([1.0])}, v=np.arange(9.0), w=(np.arange(9.0), 4, 6)), []
    _read_all(Reader(lambda at, n: (ends.append(at + n), bytes(data[at : at + n]))[1]))
    for n in range(0, max(ends), 8):
        with pytest.raises(Damaged):
            _read_all(reader(data[:n]))


def test_unsupported():
    data = bytearray(built(v=np.arange(3.0)))
    data[8] = 2
    with pytest.raises(Unsupported, match="superblock 2"):
        reader(data)


# Steps ---------------------------------------------------------------------------------------------------------------


def test_steps_by_tasks(spark, tmp_path):
    """Several files, several tasks for one dataset, only the columns asked for, rows in their order."""
    path, df = f"{tmp_path}/steps.h5part", spark.range(10000).select("id", (F.col("id") / 7).alias("x"), F.lit(1).alias("one"))
    write_h5part(df.repartitionByRange(3, "id").sortWithinPartitions("id"), path, 2, fileRows=1500, chunkRows=256, level=1)
    write_h5part(df.limit(10).coalesce(1), path, 5)
    got = read_h5part(spark, path, 2, columns="x,id", rowColumn="row", taskRows=700)
    assert got.columns == ["x", "id", "row"] and got.rdd.getNumPartitions() > 14
    assert all(r.id == r.row and r.x == r.id / 7 for r in got.collect()) and got.count() == 10000
    assert read_h5part(spark, path).count() == 10
    assert {(r.step, r["count"]) for r in read_h5part(spark, path, "all").groupBy("step").count().collect()} == {(2, 10000), (5, 10)}
    view = read_h5part(spark, path, 2, firstRow=1490, lastRow=1510)
    assert sorted(r.id for r in view.collect()) == list(range(1490, 1511))
    assert read_h5part(spark, path, 2, firstRow=20000).count() == 0


def test_append_and_overwrite(spark, tmp_path):
    path, df = f"{tmp_path}/s", spark.range(3).coalesce(1)
    write_h5part(df, path, 1, attributes={"time": 0.5, "name": "é"}, fileAttributes={"n": [1, 2]})
    write_h5part(df, path, 1)
    assert [r.id for r in read_h5part(spark, path, 1, rowColumn="row").orderBy("row").collect()] == [0, 1, 2, 0, 1, 2]
    assert {tuple(r)[:3] + (tuple(r.value or ()), r.text) for r in h5part_attributes(spark, path).collect()} == {(None, "n", "i8", (1.0, 2.0), None), (1, "time", "f8", (0.5,), None), (1, "name", "text", (), "é")}
    with pytest.raises(FileExistsError):
        write_h5part(df, path, mode="error")
    write_h5part(df, path, 7, mode="overwrite")
    assert read_h5part(spark, path, "all").select("step").distinct().collect()[0][0] == 7
    assert not [f for f in (tmp_path / "s").iterdir() if f.name.startswith("_")]


def test_nulls_and_empty(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, 0.5)], "id bigint, x double").coalesce(1)
    write_h5part(rows, f"{tmp_path}/a")
    assert [str(r.x) for r in read_h5part(spark, f"{tmp_path}/a").orderBy("id").collect()] == ["nan", "0.5"]
    with pytest.raises(Exception, match="id has nulls"):
        write_h5part(spark.createDataFrame([(None, 1.0)], rows.schema), f"{tmp_path}/b")
    assert not list((tmp_path / "b").iterdir())
    write_h5part(rows.limit(0), f"{tmp_path}/c", 3)
    got = read_h5part(spark, f"{tmp_path}/c")
    assert got.columns == ["id", "x"] and got.count() == 0


@pytest.mark.parametrize(("options", "message"), [({"step": 9}, "no step 9"), ({"columns": "id,z"}, "no dataset"), ({"rowColumn": "ID"}, "aren't different names")])
def test_errors(spark, tmp_path, options, message):
    write_h5part(spark.range(2), f"{tmp_path}/a")
    with pytest.raises(Exception, match=message):
        read_h5part(spark, f"{tmp_path}/a", **options).collect()
    with pytest.raises(Exception, match="aren't numbers"):
        write_h5part(spark.sql("SELECT 'a' AS t"), f"{tmp_path}/b")


def test_other_files_are_damaged(spark, tmp_path):
    (tmp_path / "x.h5").write_text("not HDF5")
    with pytest.raises(Exception, match="no HDF5 signature"):
        read_h5part(spark, f"{tmp_path}/x.h5").collect()


def test_table_format(spark, tmp_path):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") / 3).alias("b"))
    snapshots.write_table(df, f"{tmp_path}/t", "hdf5", ("b", "a"), "a")
    assert sorted(map(tuple, snapshots.read_table(spark, f"{tmp_path}/t", "hdf5", ("a", "b")).collect())) == [(k, k / 3) for k in range(50)]
    with pytest.raises(FileExistsError):
        snapshots.write_table(df, f"{tmp_path}/t", "hdf5", ("a",), "a")
    with pytest.raises(NotImplementedError):
        snapshots.read_table(spark, f"{tmp_path}/t", "netcdf", ("a",))


def test_spectrum_of_hdf5_steps(spark, tmp_path):
    """The command line gives the same spectrum from HDF5 steps, also without a dataset pid, as from a Parquet snapshot."""
    df = particles(spark, SMALL)
    snapshots.write_step(df, f"{tmp_path}/plain", 4)
    ordered = df.repartitionByRange(4, "pid").sortWithinPartitions("pid")
    write_h5part(ordered, f"{tmp_path}/a.h5part", 4)
    write_h5part(ordered.drop("pid"), f"{tmp_path}/b.h5part", 4)
    for name in ("plain", "a.h5part", "b.h5part"):
        cli.main(["--checkpoint", f"{tmp_path}/{name}", "--gridSize", "8", "--output", f"{tmp_path}/out-{name}"], spark)
    lines = [sorted(r.value for r in spark.read.text(f"{tmp_path}/out-{name}").collect()) for name in ("plain", "a.h5part", "b.h5part")]
    assert lines[0] == lines[1] == lines[2] and len(lines[0]) > 2
    assert h5part_particles(spark, f"{tmp_path}/b.h5part").columns == ["x", "y", "z", "h", "vx", "vy", "vz", "pid"]
