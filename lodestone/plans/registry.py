"""Names of queries, what builds them and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.tables import read_table


@dataclass(frozen=True)
class Tables:
    """Tables of a directory, read when they are named."""

    spark: SparkSession
    directory: str

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.directory, name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of ``Tables`` under its name, with its SQL."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[build.__name__] = lambda spark, directory: build(Tables(spark, directory))
        if sql:
            ORACLES[build.__name__] = sql
        return build

    return register


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded, so that engines that add in another order agree."""
    return df.select(*(F.round(f"`{c}`", places).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes))
