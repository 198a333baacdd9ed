"""Data sources: what a string names, and the DataFrame it reads."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources import logs

#: File endings and the kinds of source they name.
ENDINGS = {".csv": "csv", ".tsv": "csv", ".parquet": "parquet", ".json": "json", ".ndjson": "ndjson", ".jsonl": "ndjson", ".avro": "avro", ".orc": "orc", ".xlsx": "excel", ".xls": "excel", ".log": "log", ".sqlite": "sqlite", ".db": "sqlite"}


#: Column that holds the text of rows that don't parse.
CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class SourceSpec:
    """A kind of source, where it is, a table or sheet in it, and options of its reader."""

    kind: str
    path: str
    table: str | None = None
    options: dict[str, str] = field(default_factory=dict)


def parse_source(text: str) -> SourceSpec:
    """What a path, URL or connection string names; an unknown ending is a CSV file."""
    place, _, table = text.partition("#")
    table = table or None
    low = place.lower()
    if low.startswith(("postgres://", "postgresql://", "jdbc:postgresql:")) or ("host=" in low and "username=" in low):
        return SourceSpec("postgres", place, table)
    if low.startswith(("mysql://", "jdbc:mysql:")) or ("server=" in low and "uid=" in low):
        return SourceSpec("mysql", place, table)
    if low.startswith(("sqlite://", "jdbc:sqlite:")):
        return SourceSpec("sqlite", re.sub(r"^(?:sqlite://|jdbc:sqlite:)", "", place), table)
    if low.startswith(("delta:", "iceberg:")):
        kind, _, rest = place.partition(":")
        return SourceSpec(kind.lower(), rest, table)
    if "_delta_log" in low:
        return SourceSpec("delta", place, table)
    bare = low.split("?")[0].rstrip("/")
    ending = re.search(r"\.[a-z]+$", bare)
    kind = ENDINGS.get(ending[0] if ending else "")
    if low.startswith(("s3://", "s3a://", "gs://", "abfss://", "az://")):
        return SourceSpec(kind or "parquet", re.sub(r"^s3://", "s3a://", place), table)
    return SourceSpec(kind or ("parquet" if text.endswith("/") else "csv"), place, table)


def _csv(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """Rows of a CSV file; the text of a row that doesn't parse is kept in ``_corrupt_record``, which other rows have null."""
    sep = "\t" if spec.path.lower().endswith(".tsv") else ","
    options = {"header": "true", "inferSchema": "true", "sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT} | spec.options
    plain = spark.read.options(**options).csv(spec.path)
    if options["mode"] != "PERMISSIVE" or CORRUPT in plain.columns:
        return plain
    return spark.read.options(**options).schema(plain.schema.add(CORRUPT, "string")).csv(spec.path)


def _jdbc(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """A table of a database, through its driver on the class path."""
    url = spec.path
    if spec.kind == "sqlite":
        url = f"jdbc:sqlite:{spec.path}"
    elif not url.startswith("jdbc:"):
        url = "jdbc:" + re.sub(r"^postgres://", "postgresql://", url)
    return spark.read.format("jdbc").options(url=url, dbtable=spec.table or "", **spec.options).load()


def _excel(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """A sheet; workbooks are small and are read on the driver, if their reader is installed."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(spec.path, sheet_name=spec.table or 0))


def _format(name: str) -> Callable[[SparkSession, SourceSpec], DataFrame]:
    return lambda spark, spec: spark.read.format(name).options(**spec.options).load(spec.path)


READERS: dict[str, Callable[[SparkSession, SourceSpec], DataFrame]] = {
    "csv": _csv,
    "parquet": _format("parquet"),
    "orc": _format("orc"),
    "json": lambda spark, spec: spark.read.options(multiLine="true", **spec.options).json(spec.path),
    "ndjson": lambda spark, spec: spark.read.options(**spec.options).json(spec.path),
    "avro": _format("avro"),
    "delta": _format("delta"),
    "iceberg": _format("iceberg"),
    "excel": _excel,
    "log": lambda spark, spec: logs.read_log(spark, spec.path),
    "sqlite": _jdbc,
    "postgres": _jdbc,
    "mysql": _jdbc,
}


def read_source(spark: SparkSession, source: str | SourceSpec) -> DataFrame:
    """The DataFrame of a source; nothing is read before an action."""
    spec = parse_source(source) if isinstance(source, str) else source
    if spec.kind not in READERS:
        raise ValueError(f"no reader for {spec.kind}")
    return READERS[spec.kind](spark, spec)


def read_all(spark: SparkSession, sources: list[str]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Each distinct source, and what went wrong with those that can't be read."""
    found: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}
    for source in dict.fromkeys(sources):
        try:
            found[source] = read_source(spark, source)
        except Exception as error:  # one source's failure is reported and the others go on
            failed[source] = str(error)
    return found, failed


def describe(df: DataFrame) -> DataFrame:
    """A row a column: name, type, and whether it may be null."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields], "column_name string, column_type string, nullable boolean")
