"""Every registered query beside its SQL, at the smallest scale."""

import duckdb
import pytest
from conftest import SF

from check_oracle import compare
from martlens.testbed.bindings import TABLES
from martlens.testbed.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    _, verdict = compare(spark, SF, name, con)
    assert verdict.startswith("ok" if name in ORACLE else "rows only"), verdict


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
