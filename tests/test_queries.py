"""Every query with SQL gives the rows of its SQL; the others run and have a stable schema."""

import os

import pytest

from quotemill.plans import articles, market, problems, records
from tests.helpers import DATA, rows, views

QUERIES = {k: v for m in (problems, market, articles, records) for k, v in m.QUERIES.items()}
SQL = {k: v for m in (problems, market, articles, records) for k, v in m.SQL.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), views().sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
