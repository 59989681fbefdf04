"""Every named query with SQL gives the same rows as that SQL over the same tables."""

import pytest
from compare import difference, spark_rows

import __spark_entry__ as driver

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_matches_sql(spark, name):
    found = driver.queries()[name](spark, SF_DIR)
    assert difference(found, SF_DIR, driver.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - set(driver.oracle_sql())))
def test_runs_without_sql(spark, name):
    _, found = spark_rows(driver.queries()[name](spark, SF_DIR))
    assert found


def test_sql_names_are_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).columns == ["name", "sales_count"]


def test_stream_and_batch_intake_decide_alike(spark):
    batch = driver.queries()["order_intake"](spark, SF_DIR)
    stream = driver.queries()["stream_order_intake"](spark, SF_DIR)
    columns = ["feed_id", "order_number", "reject_reason"]
    assert spark_rows(batch.select(*columns)) == spark_rows(stream.select(*columns))
