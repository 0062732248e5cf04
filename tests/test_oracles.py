"""Every registered query of the engine against its SQL in DuckDB; the llm subpackage has its own tests."""

import duckdb
import pandas as pd
import pytest

from loomfield.plans.registry import ORACLES, QUERIES
from loomfield.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value) -> str:
    """A null is one, whatever type holds it, and a column with nulls may hold whole numbers as floats."""
    if getattr(value, "ndim", 0):
        return str(list(value))
    if value is None or pd.isna(value):
        return "null"
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    frame = QUERIES[name](spark, SF)
    assert frame.columns and frame.count() >= 0
