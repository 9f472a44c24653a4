"""Queries beside their SQL."""

import pytest

from shelfmark.llm.queries import ORACLES, QUERIES
from tests.compare import duck, duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, FOLDER)) == duck_rows(duck(FOLDER), ORACLES[name])
