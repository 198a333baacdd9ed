"""Tables of a directory of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of a directory with one Parquet file or folder a table."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
