"""Every registered query with a SQL counterpart, both engines on the same tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from conftest import DATA


def _names():
    from courselake.plans.registry import QUERIES
    from oracles.queries import ORACLES

    return sorted(set(QUERIES) & set(ORACLES))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(value):
        if value is None or pd.isna(value):
            return "-"
        if isinstance(value, (bool,)) or type(value).__name__ == "bool":
            return str(bool(value))
        if isinstance(value, (int, float)) or hasattr(value, "dtype"):
            return repr(round(float(value), 6))
        return str(value)

    ordered = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in row) for row in ordered.itertuples(index=False))


@pytest.mark.parametrize("name", _names())
def test_query_equals_sql(spark, duck, name):
    from courselake.plans.registry import QUERIES
    from oracles.queries import ORACLES

    actual = QUERIES[name](spark, DATA).toPandas()
    expected = duck.execute(ORACLES[name]).df()
    assert sorted(actual.columns) == sorted(expected.columns)
    assert rows(actual) == rows(expected)


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120
