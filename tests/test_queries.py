"""Every query of the catalogue against its SQL, over the whole small tables."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from lodestone.plans import catalogue

DIRECTORY = "/root/testdata/sf0.01"


def plain(value: object) -> object:
    """A value in a form that both engines share; doubles by ten digits."""
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}") + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return float(value) if type(value).__name__ == "Decimal" else value


def rows(columns: list[str], found: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    own = duckdb.connect()
    own.sql("SET TimeZone = 'UTC'")
    for file in Path(DIRECTORY).glob("*.parquet"):
        own.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return own


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIRECTORY)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    ours, theirs = rows(got.columns, [tuple(r) for r in got.collect()]), rows(want.columns, want.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_runs_and_repeats(spark, name):
    first, second = (catalogue.QUERIES[name](spark, DIRECTORY) for _ in range(2))
    one, two = ([tuple(r) for r in df.collect()] for df in (first, second))
    assert one and first.columns == second.columns
    assert rows(first.columns, one) == rows(second.columns, two)


def test_the_contract(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
