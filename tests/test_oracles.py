"""Registered core queries against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lumenary.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def canonical(rows):
    return sorted(repr([None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not there")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rel = db.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == columns
    assert canonical(map(tuple, df.select(*columns).collect())) == canonical(rel.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
