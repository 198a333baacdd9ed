"""Constraints on a table: rules as data, checked against its profile, and rules drawn from a profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = "rule string, column_name string, low double, high double, text string"


def check(profiled: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule with what was found and whether it holds. ``profiled`` is a typed profile of the table."""
    facts = profiled.select("column_name", "row_count", "null_percent", "unique_percent", "min", "max", "mean", "std", F.col("inferred_type").alias("kind"))
    table = F.broadcast(profiled.agg(F.max("row_count").alias("rows"), F.count("*").alias("columns")))  # one row
    joined = rules.join(facts, "column_name", "left").crossJoin(table)
    found = F.when(F.col("rule") == "RowCountBetween", F.col("rows").cast("double")).when(F.col("rule") == "ColumnCount", F.col("columns").cast("double")).when(F.col("rule").isin("NotNull", "MaxNullPercent"), F.col("null_percent")).when(F.col("rule") == "MinBetween", F.col("min")).when(F.col("rule") == "MaxBetween", F.col("max")).when(F.col("rule") == "MeanBetween", F.col("mean")).when(F.col("rule") == "StdBetween", F.col("std")).when(F.col("rule") == "Unique", F.col("unique_percent"))
    inside = F.col("found").between(F.coalesce("low", F.lit(float("-inf"))), F.coalesce("high", F.lit(float("inf"))))
    holds = F.when(F.col("rule") == "ColumnExists", F.col("kind").isNotNull()).when(F.col("rule") == "ColumnType", F.col("kind") == F.col("text")).when(F.col("rule") == "NotNull", F.col("found") == 0).when(F.col("rule") == "MaxNullPercent", F.col("found") <= F.col("high")).when(F.col("rule") == "Unique", F.col("found") >= 99.9).otherwise(inside)
    return joined.withColumn("found", found).select("rule", "column_name", "found", F.coalesce(holds, F.lit(False)).alias("holds"))


def values_in_set(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """One row: how many non-null values a set doesn't have."""
    outside = ~F.col(column).cast("string").isin(*allowed)
    return df.agg(F.count_if(outside).alias("violations")).select(F.lit("ValuesInSet").alias("rule"), F.lit(column).alias("column_name"), "violations", (F.col("violations") == 0).alias("holds"))


def matches_pattern(df: DataFrame, column: str, regex: str) -> DataFrame:
    """One row: how many non-null values a pattern doesn't match."""
    return df.agg(F.count_if(~F.col(column).rlike(regex)).alias("violations")).select(F.lit("MatchesPattern").alias("rule"), F.lit(column).alias("column_name"), "violations", (F.col("violations") == 0).alias("holds"))


def suggest(profiled: DataFrame) -> DataFrame:
    """Rules that the profiled table keeps, with room for growth."""
    none, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    rule = lambda name, low=none, high=none, text=no_text: F.struct(F.lit(name).alias("rule"), low.alias("low"), high.alias("high"), text.alias("text"))
    wide = F.abs(F.col("max") - F.col("min")) * 0.1
    each = F.array(
        rule("ColumnExists"), rule("ColumnType", text=F.col("inferred_type")), F.when(F.col("null_count") == 0, rule("NotNull")), F.when(F.col("null_count") > 0, rule("MaxNullPercent", high=F.least(F.col("null_percent") * 1.5, F.lit(100.0)))),
        F.when(F.col("min").isNotNull(), rule("MinBetween", F.col("min") - wide, F.col("max"))), F.when(F.col("max").isNotNull(), rule("MaxBetween", F.col("min"), F.col("max") + wide)), F.when(F.col("unique_percent") >= 99.9, rule("Unique")),
    )
    own = profiled.select("column_name", F.explode(F.filter(each, lambda r: r.isNotNull())).alias("r")).select("r.rule", "column_name", "r.low", "r.high", "r.text")
    rows = F.max("row_count").cast("double")
    table = profiled.agg(rows.alias("n"), F.count("*").cast("double").alias("k")).select(F.explode(F.array(rule("RowCountBetween", F.col("n") * 0.5, F.col("n") * 2), rule("ColumnCount", F.col("k"), F.col("k")))).alias("r"))
    return own.unionByName(table.select("r.rule", no_text.alias("column_name"), "r.low", "r.high", "r.text"))
