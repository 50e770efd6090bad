"""Every query with SQL gives the rows of its SQL; the others give rows."""

import pytest
from oracle import SMALL, agree

from drivelake.plans import queries, store_queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name in queries.SQL:
        agree(spark, queries.QUERIES[name], queries.SQL[name])
    else:
        assert queries.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.SQL) <= set(__spark_entry__.queries())
