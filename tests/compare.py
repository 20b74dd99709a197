"""A Spark query against DuckDB SQL on the same tables."""

import decimal
import os

SMALL = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return repr(float(f"{v:.10g}")) if isinstance(v, float) else repr(v)


def compare(spark, query, sql, sf_dir=SMALL):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{t}')")
    want = con.sql(sql)
    names = want.columns
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    order = [names.index(c) for c in sorted(names)]
    expected = sorted(tuple(_plain(r[k]) for k in order) for r in want.fetchall())
    got = sorted(tuple(_plain(r[c]) for c in sorted(names)) for r in df.collect())
    assert got == expected
