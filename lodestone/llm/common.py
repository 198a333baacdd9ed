"""Small helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.scratch import drop_stored, scratch_path, shared_dir, stored

__all__ = ["drop_stored", "fresh", "row_key", "small_batches", "scratch_path", "shared_dir", "stored"]


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def row_key(id_col: str, text_col: str) -> Column:
    """Key of a row's content, never null; repeated rows share it, and so share one result."""
    return F.concat_ws(":", F.xxhash64(F.col(id_col), F.col(text_col)), F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col)))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2_000) -> Iterator[None]:
    """What is planned and run here hands texts to Python so many rows at a time at most; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if int(before) <= 0 or int(before) > rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
