"""The profile: a row a column, with inferred types, interest, alerts, quality and index advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators import stats


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row a column: type, counts, and the statistics that its type has.

    Two passes: one aggregation for all counts and moments, and one over values
    reduced map-side for distinct counts and the most frequent values.
    """
    columns = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    numbers = [c for c in stats.numeric_columns(df) if c in columns]
    names = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    as_number = lambda c: c.cast("double")
    basic = stats.per_column(df, columns, {"row_count": lambda c: F.count(F.lit(1)), "null_count": lambda c: F.count_if(c.isNull()), "avg_length": lambda c: F.avg(F.length(c.cast("string"))), "max_length": lambda c: F.max(F.length(c.cast("string")))})
    basic = basic.withColumn("data_type", F.create_map(*(F.lit(x) for c in columns for x in (c, names[c])))[F.col("column_name")])
    if numbers:
        wide = {"mean": lambda c: F.avg(as_number(c)), "std": lambda c: F.stddev_samp(as_number(c)), "min": lambda c: F.min(as_number(c)), "max": lambda c: F.max(as_number(c))}
        basic = basic.join(stats.per_column(df, numbers, wide), "column_name", "left").join(stats.outliers_and_zeros(df, numbers), "column_name", "left").join(stats.skew_kurtosis(df, numbers), "column_name", "left")
    distinct = stats.distinct_counts(df, columns) if exact else stats.per_column(df, columns, {"distinct_count": lambda c: F.approx_count_distinct(c)})
    top = stats.top_values(df, columns, 1).select("column_name", F.col("percent").alias("top_percent"))
    out = basic.join(distinct, "column_name", "left").join(top, "column_name", "left").fillna({"distinct_count": 0})
    return out.withColumn("unique_percent", F.least(F.try_divide(100.0 * F.col("distinct_count"), F.col("row_count")), F.lit(100.0))).withColumn("null_percent", F.try_divide(100.0 * F.col("null_count"), F.col("row_count")))


NUMERIC = r"^(?:tinyint|smallint|int|bigint|float|double|decimal)"
INTEGER = r"^(?:tinyint|smallint|int|bigint)$"


def inferred_type(name: Column, data_type: Column, distinct: Column, rows: Column) -> Column:
    """Semantic type of a column from its name, its type and how many distinct values it has."""
    low, unique = F.lower(name), F.try_divide(100.0 * distinct, rows)
    id_like = low.endswith("id") | low.contains("uuid") | low.contains("guid") | (data_type.rlike(INTEGER) & (unique > 95))
    text = F.when((unique < 5) | (distinct <= 50), "Categorical").otherwise("Text")
    number = F.when((distinct <= 10) & (rows > 100), "Categorical").otherwise("Numeric")
    return F.when(id_like, "Id").when(data_type == "boolean", "Boolean").when(data_type.rlike("^(?:date|timestamp)"), "DateTime").when(data_type.rlike(NUMERIC), number).when(data_type == "string", text).otherwise("Unknown")


def typed(profiled: DataFrame) -> DataFrame:
    """The profile with ``inferred_type``."""
    return profiled.withColumn("inferred_type", inferred_type(*map(F.col, ("column_name", "data_type", "distinct_count", "row_count"))))


def interest(profiled: DataFrame) -> DataFrame:
    """The profile with a score of how much a column is worth looking at."""
    low, unique = F.lower("column_name"), F.col("unique_percent")
    id_like = low.endswith("id") | low.endswith("key")
    points = [
        -F.col("null_percent") / 20, F.when(F.col("distinct_count") <= 1, -10.0), F.when((unique > 1) & (unique < 90), 2.0), F.when(id_like, -5.0),
        F.when(F.col("data_type").rlike(INTEGER) & (unique > 95), -3.0), F.when(F.col("std") > 0, 2.0), F.when(F.col("data_type").rlike("^(?:date|timestamp)"), 3.0),
        F.when(low.rlike("price|amount|cost|total|revenue|salary|balance"), 2.0),
    ]
    return profiled.withColumn("interest", sum((F.coalesce(p, F.lit(0.0)) for p in points), F.lit(0.0)))


def alerts(profiled: DataFrame) -> DataFrame:
    """A row for each alert on a column: ``column_name``, ``alert``, ``severity``."""
    t = F.col("inferred_type")
    outlier_percent = F.try_divide(100.0 * F.col("outlier_count"), F.col("row_count"))
    zero_percent = F.try_divide(100.0 * F.col("zero_count"), F.col("row_count"))
    imbalance = F.try_divide(F.col("top_percent"), F.try_divide(F.lit(100.0), F.col("distinct_count")))
    alert = lambda when, name, severity: F.when(when, F.struct(F.lit(name).alias("alert"), severity.alias("severity")))
    info, warn = F.lit("Info"), F.lit("Warning")
    rules = F.array(
        alert(F.col("null_percent") > 10, "HighNulls", F.when(F.col("null_percent") > 50, warn).otherwise(info)), alert(F.col("distinct_count") == 1, "Constant", warn),
        alert((F.col("unique_percent") > 95) & ~t.isin("Numeric", "Id", "DateTime") & (F.coalesce("avg_length", F.lit(0.0)) < 50), "HighCardinality", info), alert(F.abs("skewness") > 2, "HighSkewness", info),
        alert(outlier_percent > 1, "Outliers", F.when(outlier_percent > 5, warn).otherwise(info)), alert((t == "Categorical") & (imbalance > 5), "Imbalanced", info),
        alert((t == "Categorical") & (F.col("unique_percent") > 90) & (F.col("distinct_count") > 100), "PotentialLeakage", warn), alert(zero_percent > 30, "ZeroInflated", info),
    )
    return profiled.select("column_name", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("a")).select("column_name", "a.*")


def quality_score(profiled: DataFrame) -> DataFrame:
    """One row: 100 less what nulls, constants, outliers and near-unique categories cost, at least 0."""
    t, nulls = F.col("inferred_type"), F.col("null_percent")
    loss = F.when(nulls > 50, 5).when(nulls > 10, 2).otherwise(0) + F.when((t == "Categorical") & (F.col("distinct_count") > 0.9 * F.col("row_count")), 1).otherwise(0)
    loss = loss + F.when((t == "Numeric") & (F.col("std") == 0), 1).otherwise(0) + F.when(F.coalesce(F.col("outlier_count") > 0.1 * F.col("row_count"), F.lit(False)), 2).otherwise(0)
    return profiled.agg(F.greatest(F.lit(100) - F.sum(loss), F.lit(0)).cast("int").alias("quality_score"), F.count("*").alias("columns"))


#: What the parts of the anomaly score weigh, and the least scores of its labels from the worst.
ANOMALY_WEIGHTS = {"alerts": 0.25, "nulls": 0.15, "outliers": 0.20, "distribution": 0.15, "cardinality": 0.10, "schema": 0.15}
ANOMALY_LABELS = ((0.7, "Critical"), (0.5, "Poor"), (0.35, "Concerning"), (0.2, "Fair"), (0.1, "Good"))


def anomaly_score(profiled: DataFrame, alert_rows: DataFrame) -> DataFrame:
    """One row: how unusual a typed profile is, 0 to 1, in six parts, with its label.

    Alerts count by severity against the number of columns; nulls by their mean, their
    most, and the columns with over 20 percent; outliers by the mean and most of the
    columns that have any; distributions by skewness over 2 and 5 and kurtosis over 7;
    cardinality by constant, nearly unique and large categorical columns; and the schema by
    very many columns, few rows a column, or hardly any numbers.
    """
    t, one = F.col("inferred_type"), F.lit(1.0)
    share = lambda when, of: F.coalesce(F.try_divide(F.count_if(when), F.count_if(of)), F.lit(0.0))
    every, number = F.lit(True), t == "Numeric"
    off = F.when(number & (F.col("outlier_count") > 0), F.col("outlier_count") / F.col("row_count"))
    skew, tail = F.abs("skewness"), F.abs("kurtosis")
    parts = profiled.agg(
        F.count("*").alias("columns"), F.max("row_count").alias("rows"),
        (0.3 * F.avg("null_percent") / 100 + 0.4 * F.max("null_percent") / 100 + 0.3 * share(F.col("null_percent") > 20, every)).alias("nulls"),
        (0.4 * F.least(F.coalesce(F.avg(off), F.lit(0.0)) * 10, one) + 0.4 * F.least(F.coalesce(F.max(off), F.lit(0.0)) * 5, one) + 0.2 * share(F.coalesce(off > 0.05, F.lit(False)), number)).alias("outliers"),
        (0.3 * share(number & (skew > 2), number & skew.isNotNull()) + 0.4 * share(number & (skew > 5), number & skew.isNotNull()) + 0.3 * share(number & (tail > 7), number & skew.isNotNull())).alias("distribution"),
        (0.5 * share(F.col("distinct_count") <= 1, every) + 0.3 * share((F.col("unique_percent") > 95) & (t != "Id"), every) + 0.2 * share((t == "Categorical") & (F.col("unique_percent") > 50), t == "Categorical")).alias("cardinality"),
        share(number, every).alias("numbers"),
    )
    counts = alert_rows.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("Error", "Warning", "Info")))
    both = parts.crossJoin(F.broadcast(counts))  # one row each
    per = lambda name, k: F.least(F.col(name) / F.greatest(F.col("columns") * k, one), one)
    known = F.when((F.col("rows") > 0) & (F.col("columns") / F.col("rows") > 0.1), 0.3).otherwise(0.0)
    schema = F.when(F.col("columns") > 100, 0.2).otherwise(0.0) + known + F.when((F.col("numbers") < 0.1) & (F.col("columns") > 5), 0.1).otherwise(0.0)
    both = both.withColumn("alerts", 0.6 * per("Error", 0.3) + 0.3 * per("Warning", 0.5) + 0.1 * per("Info", 1.0)).withColumn("schema", schema)
    score = F.round(sum((w * F.least(F.coalesce(c, F.lit(0.0)), one) for c, w in ANOMALY_WEIGHTS.items()), F.lit(0.0)), 4)
    label = F.when(F.lit(False), "")
    for least, name in ANOMALY_LABELS:
        label = label.when(F.col("score") >= least, name)
    return both.select(*(F.coalesce(c, F.lit(0.0)).alias(c) for c in ANOMALY_WEIGHTS), score.alias("score")).withColumn("label", label.otherwise("Excellent"))


def index_advice(profiled: DataFrame) -> DataFrame:
    """Columns worth an index, and why: the first reason that holds."""
    name, unique = F.col("column_name"), F.col("distinct_count")
    reason = F.when(F.col("inferred_type") == "Id", "identifier").when((F.col("inferred_type") == "Categorical") & unique.between(2, 100) & (F.col("unique_percent") < 50), "low-cardinality category").when(F.col("inferred_type") == "DateTime", "date range").when(name.rlike("(?:_id|Id|_key)$"), "key name").when((unique == 2), "flag")
    return profiled.select("column_name", reason.alias("reason")).filter("reason is not null")


def sql_type(profiled: DataFrame) -> DataFrame:
    """Column definitions for a relational target."""
    kind = F.when(F.col("data_type").rlike(INTEGER) | (F.col("data_type") == "boolean"), "INTEGER").when(F.col("data_type").rlike(NUMERIC), "REAL").otherwise("TEXT")
    return profiled.select("column_name", F.concat(kind, F.when(F.col("null_count") == 0, " NOT NULL").otherwise("")).alias("definition"))


def risk_vectors(profiled: DataFrame) -> DataFrame:
    """``column_name`` and twelve features of each typed column, for a classifier of its risk.

    Null and unique percent, deviation, skewness, share of outliers, imbalance (1 but for
    categories), average and largest length (of texts), and flags: number, category, date, text.
    """
    kind, zero = F.col("inferred_type"), F.lit(0.0)
    given = F.col("row_count") - F.col("null_count")
    imbalance = F.when(kind == "Categorical", F.try_divide(F.col("top_percent") * F.col("distinct_count"), F.lit(100.0)))
    length = lambda c: F.when(kind == "Text", F.col(c).cast("double"))
    features = [F.col("null_percent"), F.col("unique_percent"), F.col("std"), F.col("skewness"), F.try_divide(F.col("outlier_count"), given), F.coalesce(imbalance, F.lit(1.0)), length("avg_length"), length("max_length")]
    flags = [(kind == k).cast("double") for k in ("Numeric", "Categorical", "DateTime", "Text")]
    return profiled.select("column_name", F.array(*(F.coalesce(f.cast("double"), zero) for f in [*features, *flags])).alias("features"))
