"""Queries of the operators that SQL can express, against their SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from compare_oracles import TABLES, rows
from folioworks.llm.oracles import ORACLES
from folioworks.llm.queries import QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
