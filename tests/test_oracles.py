"""Every registered query on the small tables, against its SQL on DuckDB."""

import os

import pytest

from workloads import check
from workloads.queries import load

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    rows, problem, _ = check.compare(spark, con, SF, QUERIES[name], SQL.get(name))
    assert problem is None
    assert rows > 0 or name == "derived_id_conflicts"


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
