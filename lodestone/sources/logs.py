"""Web server logs as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The lines of the formats.
ACCESS = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "(\S+) (\S+) ?([^"]*)" (\S+) (\S+)(?: "([^"]*)" "([^"]*)")?'
ERROR = r"^\[([^\]]+)\] \[([^\]]+)\](?: \[pid [^\]]+\])?(?: \[client ([^\]]+)\])? ?(.*)$"


def detect(lines: list[str]) -> str:
    """Name of a log's format from its first lines: ``iis``, ``error``, ``access`` or ``unknown``."""
    for line in lines[:20]:
        if line.startswith("#Fields:"):
            return "iis"
        if re.match(r"^\[[^\]]+\] \[[^\]]+\]", line):
            return "error"
        if re.match(r"^[0-9A-Fa-f.:]+ ", line) and re.search(r'"\s+[0-9]{3}\s', line):
            return "access"
    return "unknown"


def _part(line: Column, form: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(line, form, i), F.lit(""))


def parse_access(lines: DataFrame, line: str = "value") -> DataFrame:
    """Access lines of the common and the combined format; a line of another form is left out."""
    own = F.col(line)
    part = lambda i: _part(own, ACCESS, i)
    bare = lambda c: F.nullif(c, F.lit("-"))
    stamp = F.try_to_timestamp(part(4), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    return lines.filter(own.rlike(ACCESS)).select(part(1).alias("client_ip"), bare(part(2)).alias("identity"), bare(part(3)).alias("user"), part(4).alias("timestamp_raw"), stamp.alias("timestamp"), part(5).alias("method"), part(6).alias("path"), part(7).alias("protocol"), part(8).try_cast("int").alias("status"), bare(part(9)).try_cast("bigint").alias("bytes"), bare(part(10)).alias("referrer"), bare(part(11)).alias("user_agent"))


def parse_error(lines: DataFrame, line: str = "value") -> DataFrame:
    """Error lines; one that doesn't start with two brackets is left out."""
    own = F.col(line)
    stamp = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(_part(own, ERROR, 1), r"^[A-Za-z]{3} ", ""), r"\.[0-9]+", ""), F.lit("MMM dd HH:mm:ss yyyy"))
    return lines.filter(own.rlike(ERROR)).select(_part(own, ERROR, 1).alias("timestamp_raw"), _part(own, ERROR, 2).alias("level"), _part(own, ERROR, 3).alias("client_ip"), _part(own, ERROR, 4).alias("message"), stamp.alias("timestamp"))


def parse_iis(lines: DataFrame, fields: str, line: str = "value") -> DataFrame:
    """Lines under a ``#Fields:`` directive, all columns text."""
    names = [re.sub(r"[-(.]", "_", n).replace(")", "") for n in fields.removeprefix("#Fields:").split()]
    parts = F.split(F.col(line), " ")
    return lines.filter(~F.col(line).startswith("#") & (F.col(line) != "")).select(*(F.nullif(F.get(parts, i), F.lit("-")).alias(n) for i, n in enumerate(names)))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log of the format that its first lines show."""
    lines = spark.read.text(path)
    first = [r["value"] for r in lines.limit(20).collect()]
    kind = detect(first)
    if kind == "iis":
        return parse_iis(lines, next(x for x in first if x.startswith("#Fields:")))
    return {"access": parse_access, "error": parse_error}.get(kind, lambda df: df)(lines)
