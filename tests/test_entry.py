"""Registered queries against their SQL, on the smallest tables."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


def rows(table):
    names = sorted(table.column_names)
    one = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(one, r)) for r in zip(*(table.column(n).to_pylist() for n in names), strict=True))


def names():
    from lectern.plans import registry

    return sorted(registry.SQL)


@pytest.mark.parametrize("name", names())
def test_same_rows_as_sql(spark, name):
    same_rows_as_sql(spark, name)


def same_rows_as_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    assert rows(e.queries()[name](spark, DATA).toArrow()) == rows(con.sql(e.oracle_sql()[name]).to_arrow_table())
