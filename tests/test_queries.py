"""Every registered query with SQL gives the SQL's rows on the driver's tables."""

import pytest

from compare import differences, tables
from conftest import DATA, SMALL

from millrace.plans.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con():
    return tables(DATA)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows_equal_sql(spark, con, name):
    assert differences(QUERIES[name](spark, DATA), ORACLE[name], con) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    a, b = (__spark_entry__.entry(spark).schema for _ in range(2))
    assert a == b
