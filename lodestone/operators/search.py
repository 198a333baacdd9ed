"""Search over tables: structured, adaptive, and ranked over text."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import tokens


def contains(column: str, text: str) -> Column:
    """Whether a column's text holds another, case aside; its own % and _ are plain."""
    return F.contains(F.lower(F.col(column).cast("string")), F.lit(text.lower()))


def wildcard(column: str, pattern: str) -> Column:
    """Whether a column's whole text fits a pattern with * and ?, case aside."""
    regex = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.lower())
    return F.lower(F.col(column).cast("string")).rlike(f"^(?s:{regex})$")


def condition(column: str, kind: T.DataType, text: str) -> Column | None:
    """How a text is looked for in a column of a type; None where it can't be there."""
    if isinstance(kind, T.NumericType):
        if m := re.fullmatch(r"\s*(-?[0-9.]+)\s*-\s*(-?[0-9.]+)\s*", text):
            return F.col(column).between(float(m[1]), float(m[2]))
        return F.col(column) == float(text) if re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", text) else None
    if isinstance(kind, T.BooleanType):
        return F.col(column) == F.lit(text.lower() in ("true", "yes", "1", "y"))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.to_date(column) == F.lit(text).cast("date") if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text) else None
    if isinstance(kind, T.StringType):
        return wildcard(column, text) if re.search(r"[*?]", text) else contains(column, text)
    return None


def adaptive_search(df: DataFrame, text: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows in which any column holds a text, looked for as suits each column's type."""
    found = [c for f in df.schema.fields if (columns is None or f.name in columns) and (c := condition(f.name, f.dataType, text)) is not None]
    return df.filter(reduce(lambda a, b: a | b, found)) if found else df.limit(0)


#: Comparisons of ``where <column> <comparison> <value>``.
COMPARE = {"=": "__eq__", "!=": "__ne__", "<>": "__ne__", "<=": "__le__", ">=": "__ge__", "<": "__lt__", ">": "__gt__"}


def ask(df: DataFrame, question: str) -> DataFrame:
    """Rows that a plain request names: ``where``, ``containing``, ``over``, ``under`` and ``named`` phrases, all together.

    Names of columns are matched case aside. A request that names nothing gives all rows.
    """
    names = {c.lower(): c for c in df.columns}
    found: list[Column] = []
    for name, sign, value in re.findall(r"\b(?:where|and)\s+(\w+)\s*(<=|>=|!=|<>|=|<|>)\s*('[^']*'|\S+)", question, re.IGNORECASE):
        if name.lower() in names:
            plain = value.strip("'")
            number = re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", plain)
            found.append(getattr(F.col(names[name.lower()]), COMPARE[sign])(float(plain) if number else plain))
    for name, word, value in re.findall(r"\b(\w+)\s+(over|above|under|below)\s+(-?[0-9.]+)", question, re.IGNORECASE):
        if name.lower() in names:
            column = F.col(names[name.lower()])
            found.append(column > float(value) if word.lower() in ("over", "above") else column < float(value))
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    for several in re.findall(r"\b(?:containing|named|called)\s+((?:'[^']*'|\w+)(?:\s+or\s+(?:'[^']*'|\w+))*)", question, re.IGNORECASE):
        wanted = [w.strip("'") for w in re.split(r"\s+or\s+", several, flags=re.IGNORECASE)]
        found.append(reduce(lambda a, b: a | b, (contains(c, w) for c in texts for w in wanted)))
    return df.filter(reduce(lambda a, b: a & b, found)) if found else df


#: What a statement handed over as text may not do.
FORBIDDEN = ("insert", "update", "delete", "drop", "create", "alter", "truncate", "merge", "grant", "load", "add", "set", "cache", "refresh", "call")


def guarded_sql(spark: SparkSession, statement: str, limit: int = 20) -> DataFrame:
    """Run one reading statement, and at most ``limit`` of its rows; anything else is refused."""
    bare = re.sub(r"'[^']*'", "''", statement).strip()
    if ";" in bare or "--" in bare or "/*" in bare or not re.match(r"(?i)(select|with)\b", bare):
        raise ValueError("only a single SELECT is run")
    if word := re.search(rf"(?i)\b({'|'.join(FORBIDDEN)})\b\s+(?!\()", bare):
        raise ValueError(f"{word[1]} is not allowed")
    return spark.sql(statement).limit(limit)


@dataclass
class SiteQuery:
    """A site search taken apart."""

    terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    prefixes: list[str] = field(default_factory=list)
    filters: dict[str, str] = field(default_factory=dict)


#: Words that a search passes over.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def parse_site_query(text: str) -> SiteQuery:
    """Take apart phrases, ``-words``, ``word*``, ``category:``, ``after:``, ``before:`` and plain words."""
    query = SiteQuery(phrases=[p.lower() for p in re.findall(r'"([^"]+)"', text)])
    for word in re.sub(r'"[^"]*"', " ", text).split():
        if m := re.fullmatch(r"(category|after|before):(\S+)", word, re.IGNORECASE):
            query.filters[m[1].lower()] = m[2]
        elif word[0] == "-" and len(word) > 1:
            query.excluded.append(word[1:].lower())
        elif word[-1] == "*" and len(word) > 1:
            query.prefixes.append(word[:-1].lower())
        elif word.lower() not in STOP_WORDS:
            query.terms.append(word.lower())
    return query


def _starts(prefix: str) -> Callable[[Column], Column]:
    return lambda t: t.startswith(prefix)


def site_search(df: DataFrame, text: str, column: str, category: str | None = None, date: str | None = None) -> DataFrame:
    """Rows whose text has all terms, phrases and prefixes of a site search and none that it excludes.

    ``category:`` compares the ``category`` column, case aside; ``after:`` and ``before:`` the day of ``date``, its bound
    included for ``after:``. A filter whose column isn't named is an error rather than passed over.
    """
    query, low, own = parse_site_query(text), F.lower(column), tokens(F.col(column), 0)
    found = [F.array_contains(own, t) for t in query.terms] + [F.contains(low, F.lit(p)) for p in query.phrases]
    found += [~F.array_contains(own, t) for t in query.excluded] + [F.size(F.filter(own, _starts(p))) > 0 for p in query.prefixes]
    for name, value in query.filters.items():
        place = category if name == "category" else date
        if place is None:
            raise ValueError(f"no column for {name}:")
        day = F.to_date(F.col(place))
        found.append(F.lower(place) == value.lower() if name == "category" else day >= F.to_date(F.lit(value)) if name == "after" else day < F.to_date(F.lit(value)))
    return df.filter(reduce(lambda a, b: a & b, found)) if found else df
