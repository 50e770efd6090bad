"""The queries with SQL give the rows of their SQL."""

import pytest
from oracle import agree

from drivelake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    agree(spark, queries.QUERIES[name], queries.SQL[name], "/root/testdata/sf0.01")
