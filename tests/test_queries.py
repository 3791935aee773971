"""Every registered query against its SQL twin on the smallest data set."""

import math
import os

import pytest

from pagerisk.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
catalog.load()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def comparable(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(comparable(row[i]) for i in order) for row in rows), key=repr)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    result = catalog.QUERIES[name](spark, SF_DIR)
    rows = result.collect()
    assert rows
    if name in catalog.ORACLES:
        cursor = duck.execute(catalog.ORACLES[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(result.columns)
        assert sorted_rows(result.columns, rows) == sorted_rows(columns, cursor.fetchall())


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).columns
    assert set(driver.oracle_sql()) <= set(driver.queries())
