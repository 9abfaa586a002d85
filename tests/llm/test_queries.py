"""Queries of the training-data operators against their SQL, on the smallest tables."""

import pytest

from lectern.llm import queries
from tests.test_entry import pytestmark, same_rows_as_sql  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_operator_has_the_rows_of_its_sql(spark, name):
    same_rows_as_sql(spark, name)
