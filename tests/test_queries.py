"""Every registered query against DuckDB on the smallest tables; those without SQL must give rows."""

import pytest

from glyphloom.plans import catalog

from .oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert differences(df, sql, con) == ""
