"""Every registered query with SQL, on the smallest tables, against DuckDB."""

import os

import pytest

import __spark_entry__ as entry
from verification.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


# minutes of boosting each; tests/test_models.py covers the same code on a small table
SLOW = {"train_gateway_math", "train_gateway_english", "train_low_gpa", "compare_models", "scoring_run"}


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_query_equals_sql(spark, con, name):
    outcome = compare(spark, con, SF, QUERIES[name], SQL[name])
    assert outcome.startswith("ok"), outcome


def test_entry(spark):
    assert entry.entry(spark).count() > 0
