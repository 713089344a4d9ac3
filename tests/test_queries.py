"""Every query with SQL against DuckDB, every other one for rows and a stable schema."""

import pytest
from conftest import SF
from oracle import compare, connect

from loomspan.plans import catalogue

WITH_SQL = sorted(catalogue.oracle_sql())
WITHOUT = sorted(set(catalogue.queries()) - set(WITH_SQL))


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", WITH_SQL)
def test_equals_sql(spark, con, name):
    assert compare(spark, con, catalogue.queries()[name], catalogue.oracle_sql()[name], SF) == ""


@pytest.mark.parametrize("name", WITHOUT)
def test_gives_rows(spark, name):
    df = catalogue.queries()[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and [r["place"] for r in sorted(rows, key=lambda r: r["place"])] == list(range(1, len(rows) + 1))
    assert set(entry.oracle_sql()) <= set(entry.queries())
