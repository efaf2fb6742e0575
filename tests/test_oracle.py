"""Every registered query with SQL gives the rows of its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from workload.check import DATA, database, differences

SF = f"{DATA}/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert differences(got, con.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
