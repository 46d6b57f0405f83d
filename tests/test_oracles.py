"""Every registered query with SQL gives the rows of that SQL."""

import pytest

import __spark_entry__ as entry
from check_queries import compare

DATA = "/root/testdata/sf0.001"
RUNS, SQLS = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQLS))
def test_matches_sql(spark, name):
    same, text = compare(spark, DATA, name, RUNS[name], SQLS[name])
    assert same, text


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQLS) <= set(RUNS)
