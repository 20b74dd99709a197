"""Every query of the library against its SQL."""

import pytest

from lattica import domain_queries, hdf5_queries, queries, search_queries
from tests.compare import SMALL, compare

ROWS_ONLY = sorted(set(queries.QUERIES) - set(queries.SQL))
CASES = [(m, q) for m in (queries, domain_queries, hdf5_queries, search_queries) for q in sorted(m.SQL)]


@pytest.mark.parametrize(("module", "name"), CASES, ids=[q for _, q in CASES])
def test_query(spark, module, name):
    compare(spark, module.QUERIES[name], module.SQL[name])


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0


def test_contract(spark):
    import __spark_entry__

    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)
    assert __spark_entry__.entry(spark).count() == 8
