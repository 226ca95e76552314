"""Every query with SQL, on the smallest tables, against DuckDB."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = queries()[name](spark, SF).toPandas()
    assert compare(got, con.execute(oracle_sql()[name]).df()) == ""


def test_sql_only_for_registered_queries():
    assert set(oracle_sql()) <= set(queries())


def test_model_queries_without_sql(spark):
    report = queries()["experiment_report"](spark, SF).toPandas()
    assert len(report) == 10 and report["value"].dropna().between(0, 1).all()


def test_entry(spark):
    rows = {r.setting: r for r in entry(spark).collect()}
    assert rows["delta"].n0 == 0 and rows["delta"].n1 == 1688
    assert rows["baseline"].n0 + rows["baseline"].n1 == 87
