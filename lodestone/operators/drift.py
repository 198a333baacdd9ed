"""Drift between two versions of a table, profile centroids and their distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import clamp
from lodestone.operators.stats import long_form, numeric_profile, skew_kurtosis


def shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of non-null values of each value of each column."""
    counts = long_form(df, columns).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    totals = F.broadcast(counts.groupBy("column_name").agg(F.sum("n").alias("total")))  # a row a column
    return counts.join(totals, "column_name").select("column_name", "value", (F.col("n") / F.col("total")).alias("share"))


def both_shares(base: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shares ``p`` before and ``q`` now; null where a value isn't there."""
    return shares(base, columns).withColumnRenamed("share", "p").join(shares(current, columns).withColumnRenamed("share", "q"), ["column_name", "value"], "full_outer")


def categorical_drift(base: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population stability index and Jensen-Shannon divergence of categories, over all values."""
    tiny = lambda c, e: F.greatest(F.coalesce(c, F.lit(e)), F.lit(e))
    p, q = tiny("p", 1e-4), tiny("q", 1e-4)
    a, b = tiny("p", 1e-10), tiny("q", 1e-10)
    m = (a + b) / 2
    psi = F.abs(F.sum((q - p) * F.log(q / p)))
    js = F.sum(a * F.log(a / m) + b * F.log(b / m)) / 2 / F.log(F.lit(2.0))
    return both_shares(base, current, columns).groupBy("column_name").agg(psi.alias("psi"), js.alias("js_divergence"))


def category_shifts(base: DataFrame, current: DataFrame, columns: Sequence[str], least_points: float = 5.0) -> DataFrame:
    """Values whose share moved by so many points, with what is new and what is gone."""
    delta = 100 * (F.coalesce("q", F.lit(0.0)) - F.coalesce("p", F.lit(0.0)))
    return both_shares(base, current, columns).select("column_name", "value", delta.alias("points"), F.col("p").isNull().alias("is_new"), F.col("q").isNull().alias("is_removed")).filter(F.abs("points") >= least_points)


def numeric_drift(base: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Changes of moments and quartiles, with a stability index and a distance from them."""
    old, new = (numeric_profile(df, columns).select("column_name", *(F.col(c).alias(f"{c}_{n}") for c in ("mean", "std", "q25", "median", "q75"))) for df, n in ((base, "a"), (current, "b")))
    joined = old.join(new, "column_name")
    c = F.col
    pooled = F.sqrt((c("std_a") * c("std_a") + c("std_b") * c("std_b")) / 2)
    ratio = F.try_divide(F.greatest("std_a", "std_b"), F.least("std_a", "std_b"))
    psi = clamp(0.1 * F.coalesce(F.try_divide(F.abs(c("mean_b") - c("mean_a")), pooled), F.lit(0.0)) + 0.1 * F.coalesce(F.log(ratio), F.lit(0.0)))
    iqr_a, iqr_b = c("q75_a") - c("q25_a"), c("q75_b") - c("q25_b")
    furthest = F.greatest(*(F.abs(c(f"{q}_b") - c(f"{q}_a")) for q in ("q25", "median", "q75")))
    ks = F.least((F.try_divide(furthest, (iqr_a + iqr_b) / 2) + F.try_divide(F.abs(iqr_b - iqr_a), iqr_a)) / 2, F.lit(1.0))
    change = lambda n: F.when(c(f"{n}_a") == 0, F.when(c(f"{n}_b") != 0, 100.0).otherwise(0.0)).otherwise(100 * (c(f"{n}_b") - c(f"{n}_a")) / F.abs(c(f"{n}_a")))
    return joined.select("column_name", change("mean").alias("mean_change"), change("std").alias("std_change"), psi.alias("psi"), ks.alias("ks"))


def schema_of(df: DataFrame) -> DataFrame:
    """A row a column: its name and type."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "name string, type string")


def schema_diff(base: DataFrame, current: DataFrame) -> DataFrame:
    """Columns added, removed, or of another type; case doesn't count."""
    key = F.lower("name").alias("column_name")
    old, new = schema_of(base).select(key, F.col("type").alias("old_type")), schema_of(current).select(key, F.col("type").alias("new_type"))
    change = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").when(F.col("old_type") != F.col("new_type"), "type changed")
    return old.join(new, "column_name", "full_outer").select("column_name", change.alias("change"), "old_type", "new_type").filter("change is not null")


def row_change(base: DataFrame, current: DataFrame) -> DataFrame:
    """Change of the number of rows, in percent, and whether it is over 10."""
    counts = base.agg(F.count("*").alias("rows_before")).crossJoin(current.agg(F.count("*").alias("rows_now")))
    return counts.withColumn("change", F.try_divide(100.0 * (F.col("rows_now") - F.col("rows_before")), F.col("rows_before"))).withColumn("significant", F.abs("change") > 10)


def drift_score(psi: DataFrame, schema_changes: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: the mean of what there is of schema, row and column drift, a tenth more for each removed column, at most 1; drift is more than 0.2.

    A changed schema counts 0.5 if a column is gone and 0.15 if not, a significant change of
    the rows 0.3 of its share, and each column its stability index.
    """
    one = psi.agg(F.collect_list("psi").alias("psi")).crossJoin(schema_changes.agg(F.count_if(F.col("change") == "removed").alias("removed"), F.count("*").alias("changes"))).crossJoin(rows)  # a value a column
    schema = F.when(F.col("removed") > 0, 0.5).when(F.col("changes") > 0, 0.15)
    moved = F.when(F.col("significant"), 0.3 * F.least(F.abs("change") / 100, F.lit(1.0)))
    scores = F.array_compact(F.concat(F.array(schema, moved), "psi"))
    mean = F.coalesce(F.try_divide(F.aggregate(scores, F.lit(0.0), lambda s, x: s + x), F.size(scores)), F.lit(0.0))
    return one.select(F.least(mean + F.when(F.size(scores) > 0, 0.1 * F.col("removed")).otherwise(0.0), F.lit(1.0)).alias("drift_score")).withColumn("has_drift", F.col("drift_score") > 0.2)


def centroid(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row a numeric column of what places it: null share, centre between its ends, bounded skewness."""
    both = numeric_profile(df, columns).join(skew_kurtosis(df, columns), "column_name")
    centre = F.coalesce(F.try_divide(F.col("mean") - F.col("min"), F.col("max") - F.col("min")), F.lit(0.5))
    return both.select("column_name", (F.col("null_count") / F.col("row_count")).alias("null_share"), F.least(F.col("distinct_count") / F.col("row_count"), F.lit(1.0)).alias("unique_share"), centre.alias("centre"), clamp(F.col("skewness") / 3 + 0.5).alias("lean"))


def centroid_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: mean distance of common columns, and a fifth for the share of columns that only one has."""
    parts = ("null_share", "unique_share", "centre", "lean")
    left, right = (d.select("column_name", *(F.col(p).alias(f"{p}_{n}") for p in parts)) for d, n in ((a, "a"), (b, "b")))
    joined = left.join(right, "column_name", "full_outer")
    gap = sum((F.abs(F.col(f"{p}_a") - F.col(f"{p}_b")) for p in parts), F.lit(0.0)) / len(parts)
    lone = F.avg((F.col("centre_a").isNull() | F.col("centre_b").isNull()).cast("double"))
    return joined.agg(F.coalesce(F.avg(gap), F.lit(1.0)).alias("gap"), lone.alias("lone")).select(F.least(F.col("gap") + 0.2 * F.col("lone"), F.lit(1.0)).alias("distance"))


def schema_hash(df: DataFrame) -> Column:
    """A literal that depends on the names and types of the columns only."""
    text = "|".join(sorted(f"{f.name.lower()}:{f.dataType.simpleString()}" for f in df.schema.fields))
    return F.xxhash64(F.lit(text))
