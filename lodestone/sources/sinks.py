"""Sinks: files, databases, and a store of profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_files(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Files of a kind that Spark writes: ``parquet``, ``csv`` (with a header), ``json`` or ``orc``."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by or [])
    (writer.option("header", "true") if kind == "csv" else writer).format(kind).save(path)


def write_database(df: DataFrame, url: str, table: str, **options: str) -> None:
    """A table of a database, through its driver on the class path."""
    df.write.mode("overwrite").format("jdbc").options(url=url, dbtable=table, **options).save()


def markdown(df: DataFrame, limit: int = 100) -> str:
    """The first rows of a report as a Markdown table."""
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows])


def as_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON text."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def add_to_store(profiled: DataFrame, path: str, schema_hash: int, taken_at: str) -> None:
    """Append a profile to the store, partitioned by the hash of the table's schema."""
    profiled.withColumn("schema_hash", F.lit(schema_hash)).withColumn("taken_at", F.lit(taken_at)).write.mode("append").partitionBy("schema_hash").parquet(path)


def latest(store: DataFrame, keep: int = 1) -> DataFrame:
    """The rows of the last ``keep`` profiles of each schema; pruning writes these elsewhere."""
    order = Window.partitionBy("schema_hash").orderBy(F.desc("taken_at"))
    return store.withColumn("__rank", F.dense_rank().over(order)).filter(F.col("__rank") <= keep).drop("__rank")
