"""Every training-data query that has SQL against it, on the smallest tables."""

import os

import pytest

from colloquy.llm import queries
from tests.test_queries import SF, duck, table  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and table(got) == table(want)
