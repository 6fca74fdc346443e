"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest
from oracle_compare import connect, oracle_rows, spark_rows

from threadloom.plans.catalog import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    expected_columns, expected_rows = oracle_rows(con, ORACLES[name])
    assert columns == expected_columns
    assert len(rows) == len(expected_rows)
    assert rows == expected_rows


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"text_classifier", "tune_classifier", "predict_labels", "explore_clusters"}


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["category", "priority", "tickets"]
    assert df.count() > 0
