"""Every registered query against its SQL equivalent on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from compare_oracles import TABLES, rows
from folioworks.oracles import ORACLES
from folioworks.queries import QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def test_every_query_of_the_library_has_an_equivalent():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark, sf_dir):
    assert entry.entry(spark).count() > 0


# Queries of the training-data operators have tests of their own.
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, db, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
