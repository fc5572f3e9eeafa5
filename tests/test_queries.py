"""Every registered query against its SQL; queries without SQL must give a stable, filled result."""

import pytest
from compare import connect, difference

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, folder, con, name):
    assert difference(queries()[name](spark, folder), con, oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, folder, name):
    assert queries()[name](spark, folder).count() > 0


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["n_name", "mean", "n", "median"] or set(df.columns) == {"n_name", "mean", "n", "median"}
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
