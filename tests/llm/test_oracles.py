"""The operators' queries against their SQL."""

import pytest

from lattica.llm import chat, embedding_dedup, mixing, vector_codes, warc
from tests.compare import compare

CASES = [(m, q) for m in (chat, embedding_dedup, mixing, vector_codes, warc) for q in m.SQL]


@pytest.mark.parametrize(("module", "name"), CASES, ids=[q for _, q in CASES])
def test_query(spark, module, name):
    compare(spark, module.QUERIES[name], module.SQL[name])
