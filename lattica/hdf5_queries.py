"""Queries of steps kept in HDF5 files: what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.plans.held import new_path
from lattica.sources.h5part import h5part_attributes, read_h5part, write_h5part
from lattica.sources.particles import PARTICLE_SQL, particles

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"WITH {PARTICLE_SQL} SELECT pid, x, vz, CAST(h AS FLOAT) AS h, CAST(3 AS INT) AS step FROM p UNION ALL SELECT pid, x + vx * 0.125e0, vz, CAST(2*h AS FLOAT), 10 FROM p")
def hdf5_steps(spark, sf_dir):
    """Two steps in one folder, the second in deflated chunks, read together."""
    path, df = new_path(spark, "hdf5"), particles(spark, sf_dir)
    write_h5part(df.withColumn("h", F.col("h").cast("float")), path, 3)
    write_h5part(df.withColumns({"x": F.col("x") + F.col("vx") * 0.125, "h": (2 * F.col("h")).cast("float")}), path, 10, chunkRows=1 << 14, level=4)
    return read_h5part(spark, path, "all", columns="pid,x,vz,h", taskRows=1 << 16)


@query(f"WITH {PARTICLE_SQL}, r AS (SELECT pid, y, row_number() OVER (ORDER BY pid) - 1 AS row FROM p), n AS (SELECT count(*) AS n FROM p) SELECT pid, y, row FROM r, n WHERE row BETWEEN n // 4 AND n // 2")
def hdf5_view(spark, sf_dir):
    """The second quarter of a step's rows in the order of pid, of two of its datasets."""
    path, df = new_path(spark, "hdf5"), particles(spark, sf_dir)
    write_h5part(df.repartitionByRange("pid").sortWithinPartitions("pid"), path, 1, fileRows=1 << 18)
    n = df.count()
    return read_h5part(spark, path, 1, columns="pid,y", firstRow=n // 4, lastRow=n // 2, rowColumn="row", taskRows=1 << 14)


@query(f"""WITH {PARTICLE_SQL}, a AS (SELECT count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p)
 SELECT CAST(NULL AS INT) AS step, 'rows' AS name, 'i8' AS type, CAST(n AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS b, CAST(NULL AS VARCHAR) AS text FROM a
 UNION ALL SELECT 4, 'x', 'f8', x0, x1, NULL FROM a UNION ALL SELECT 4, 'y', 'f8', y0, y1, NULL FROM a UNION ALL SELECT 4, 'source', 'text', NULL, NULL, 'view' FROM a""")
def hdf5_attributes(spark, sf_dir):
    """Limits and the number of rows as attributes of a step and of the files."""
    path, df = new_path(spark, "hdf5"), particles(spark, sf_dir)
    n, x0, x1, y0, y1 = df.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    write_h5part(df.select("pid", "x", "y"), path, 4, attributes={"x": [x0, x1], "y": [y0, y1], "source": "view"}, fileAttributes={"rows": n})
    got = h5part_attributes(spark, path)
    return got.select("step", "name", "type", F.get("value", F.lit(0)).alias("a"), F.get("value", F.lit(1)).alias("b"), "text")
