"""Column and group statistics: many of them in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.operators.ordering import percentiles
from lodestone.functions.scalars import pearson, strength


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def rows_by_column(wide: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row with ``<column>__<name>`` fields as a row for each column."""
    each = [F.struct(F.lit(c).alias("column_name"), *(F.col(f"`{c}__{n}`").alias(n) for n in names)) for c in columns]
    return wide.select(F.explode(F.array(*each)).alias("s")).select("s.*")


def per_column(df: DataFrame, columns: Sequence[str], stats: dict[str, object]) -> DataFrame:
    """Statistics of several columns in one aggregation; ``stats`` maps a name to a function of the column."""
    wide = df.agg(*(f(F.col(f"`{c}`")).alias(f"{c}__{n}") for c in columns for n, f in stats.items()))
    return rows_by_column(wide, columns, list(stats))


def long_form(df: DataFrame, columns: Sequence[str], to: str = "string") -> DataFrame:
    """Non-null values as rows of ``column_name`` and ``value``."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast(to).alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact number of distinct values of each column: values are reduced before they are shuffled."""
    return long_form(df, columns).distinct().groupBy("column_name").agg(F.count("*").alias("distinct_count"))


#: Names of the quartiles.
QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Count, nulls, distinct values, range, mean, sample deviation and quartiles of numeric columns.

    With ``exact=False`` distinct counts and quartiles are sketched in the same
    single pass; exact quartiles order the values near them alone.
    """
    columns = list(columns or numeric_columns(df))
    stats: dict[str, object] = {
        "row_count": lambda c: F.count(F.lit(1)), "null_count": lambda c: F.count_if(c.isNull()), "min": lambda c: F.min(c.cast("double")), "max": lambda c: F.max(c.cast("double")),
        "mean": lambda c: F.avg(c.cast("double")), "std": lambda c: F.stddev_samp(c.cast("double")),
    }
    if not exact:
        sketched = lambda p: lambda c: F.percentile_approx(c.cast("double"), F.lit(p), F.lit(10_000))
        return per_column(df, columns, stats | {"q25": sketched(0.25), "median": sketched(0.5), "q75": sketched(0.75), "distinct_count": lambda c: F.approx_count_distinct(c)})
    points = percentiles(df, columns, list(QUARTILES.values()))
    quartiles = points.groupBy("column_name").agg(*(F.max(F.when(F.col("share") == p, F.col("value"))).alias(n) for n, p in QUARTILES.items()))
    out = per_column(df, columns, stats).join(F.broadcast(quartiles), "column_name", "left").join(F.broadcast(distinct_counts(df, columns)), "column_name", "left")  # a row a column each
    return out.withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))


def quantiles(df: DataFrame, columns: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """One row of exact percentiles, ``<column>__<name>`` each."""
    points = percentiles(df, columns, list(shares.values()))
    return points.agg(*(F.max(F.when((F.col("column_name") == c) & (F.col("share") == p), F.col("value"))).alias(f"{c}__{n}") for c in columns for n, p in shares.items()))


def skew_kurtosis(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Third and fourth standardised moments: sample deviation, divisor n, a normal's kurtosis is 3."""
    columns = list(columns or numeric_columns(df))
    first = df.agg(*(f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))))
    with_stats = df.select(*columns).crossJoin(F.broadcast(first))  # one row
    z = lambda c: F.try_divide(F.col(c).cast("double") - F.col(f"{c}__mean"), F.col(f"{c}__std"))
    wide = with_stats.agg(*(F.avg(F.pow(z(c), F.lit(k))).alias(f"{c}__{n}") for c in columns for n, k in (("skewness", 3), ("kurtosis", 4))))
    return rows_by_column(wide, columns, ["skewness", "kurtosis"])


def outliers_and_zeros(df: DataFrame, columns: Sequence[str] | None = None, fence: float = 1.5) -> DataFrame:
    """Values outside the quartiles by more than ``fence`` interquartile ranges, and zeros."""
    columns = list(columns or numeric_columns(df))
    wide = df.select(*columns).crossJoin(F.broadcast(quantiles(df, columns, {"q25": 0.25, "q75": 0.75})))  # one row

    def outside(c: str) -> Column:
        iqr = F.col(f"{c}__q75") - F.col(f"{c}__q25")
        return (F.col(c) < F.col(f"{c}__q25") - fence * iqr) | (F.col(c) > F.col(f"{c}__q75") + fence * iqr)

    counted = wide.agg(*(e.alias(f"{c}__{n}") for c in columns for n, e in (("outlier_count", F.count_if(outside(c))), ("zero_count", F.count_if(F.col(c) == 0)))))
    return rows_by_column(counted, columns, ["outlier_count", "zero_count"])


def mad(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median absolute deviation from the median, over all rows."""
    wide = df.select(*columns).crossJoin(F.broadcast(quantiles(df, columns, {"med": 0.5})))  # one row
    away = wide.select(*(F.abs(F.col(c) - F.col(f"{c}__med")).alias(c) for c in columns))
    return rows_by_column(quantiles(away, columns, {"mad": 0.5}), columns, ["mad"])


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins with their edges and counts; the last one is closed. Nothing for a constant column."""
    value = F.col(column).cast("double")
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    edges = F.broadcast(ends.filter("lo < hi").select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).select("bin", (F.col("lo") + F.col("bin") * width).alias("lower_edge"), F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("upper_edge")))
    listed = df.select(value.alias("v")).filter("v is not null").crossJoin(F.broadcast(ends)).withColumn("guess", F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(bins - 1)).cast("int"))
    # a value next to an edge may belong to the bin beside the one that division gives
    lower = lambda i: F.col("lo") + i * width
    fixed = F.when(F.col("v") < lower(F.col("guess")), F.col("guess") - 1).when((F.col("guess") < bins - 1) & (F.col("v") >= lower(F.col("guess") + 1)), F.col("guess") + 1).otherwise(F.col("guess"))
    counts = listed.groupBy(fixed.alias("bin")).agg(F.count("*").alias("n"))
    return edges.join(counts, "bin", "left").select("bin", "lower_edge", "upper_edge", F.coalesce("n", F.lit(0)).alias("n"))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` most frequent values of each column, ties to the smaller value, with their share of non-nulls."""
    counts = long_form(df, columns).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    totals = F.broadcast(counts.groupBy("column_name").agg(F.sum("n").alias("total"), F.count("*").alias("distinct_count")))  # a row a column
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    ranked = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(totals, "column_name").select("column_name", "value", "n", "rank", (100.0 * F.col("n") / F.col("total")).alias("percent"), "distinct_count")


def entropy_imbalance(df: DataFrame, columns: Sequence[str], k: int | None = 10) -> DataFrame:
    """Shannon entropy of the top ``k`` shares (all for None), imbalance, mode, and the rows of other values."""
    rows = df.count()
    if k is None:  # nothing needs to be ranked
        counts = long_form(df, columns).groupBy("column_name", "value").agg(F.count("*").alias("n"))
        totals = F.broadcast(counts.groupBy("column_name").agg(F.sum("n").alias("total"), F.count("*").alias("distinct_count")))  # a row a column
        top = counts.join(totals, "column_name").withColumn("percent", 100.0 * F.col("n") / F.col("total"))
    else:
        top = top_values(df, columns, k)
    share = F.col("percent") / 100
    mode = F.min(F.struct((-F.col("n")).alias("less"), "value"))["value"]
    out = top.groupBy("column_name").agg(F.sum(-share * F.log2(share)).alias("entropy"), mode.alias("mode"), (F.max("percent") / (100.0 / F.max("distinct_count"))).alias("imbalance_ratio"), (F.lit(rows) - F.sum("n")).alias("other_count"))
    return out.withColumn("other_percent", F.try_divide(100.0 * F.col("other_count"), F.lit(rows)))


def text_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lengths of non-null texts in code points, and how many are blank."""
    return per_column(df, columns, {"avg_length": lambda c: F.avg(F.length(c)), "max_length": lambda c: F.max(F.length(c)), "min_length": lambda c: F.min(F.length(c)), "empty_count": lambda c: F.count_if(F.trim(c) == "")})


def correlations(df: DataFrame, columns: Sequence[str] | None = None, least: float = 0.3, most_pairs: int | None = None) -> DataFrame:
    """Pearson correlation of every pair of columns, in one aggregation; those of ``least`` or more."""
    pairs = list(combinations(columns or numeric_columns(df), 2))[:most_pairs]
    wide = df.agg(*(pearson(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    each = F.array(*(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))
    return wide.select(F.explode(each).alias("s")).select("s.*").filter(F.abs("r") >= least).withColumn("strength", strength(F.col("r")))


def aggregate_by(df: DataFrame, category: str, measure: str, limit: int | None = 50) -> DataFrame:
    """Mean and sum of a measure for each category, both non-null, the largest mean first."""
    out = df.filter(F.col(category).isNotNull() & F.col(measure).isNotNull()).groupBy(F.col(category).cast("string").alias("category")).agg(F.avg(measure).alias("avg_value"), F.sum(measure).alias("sum_value"), F.count("*").alias("n"))
    return out.orderBy(F.desc("avg_value"), "category").limit(limit) if limit else out


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of pairs of values, both non-null."""
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))


def cramers_v(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Association of pairs of categories, at most 1; chi-squared over the cells that occur."""

    def one(a: str, b: str) -> DataFrame:
        cells = contingency(df, a, b)
        by = lambda c: F.sum("n").over(Window.partitionBy(c))
        total = F.broadcast(cells.agg(F.sum("n").alias("t")))  # one row
        expected = cells.withColumn("na", by("a")).withColumn("nb", by("b")).crossJoin(total).withColumn("e", F.col("na") * F.col("nb") / F.col("t"))
        chi = expected.agg(F.sum(F.pow(F.col("n") - F.col("e"), F.lit(2)) / F.col("e")).alias("chi"), F.max("t").alias("t"), F.countDistinct("a").alias("r"), F.countDistinct("b").alias("c"))
        v = F.sqrt(F.try_divide(F.col("chi"), F.col("t") * (F.least("r", "c") - 1)))
        return chi.select(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.least(v, F.lit(1.0)).alias("cramers_v"))

    return reduce(DataFrame.unionByName, (one(a, b) for a, b in pairs))


def conditional_distribution(df: DataFrame, parent: str, child: str, least: float = 0.01) -> DataFrame:
    """Share of each child value under each parent value, of ``least`` or more."""
    cells = contingency(df, parent, child)
    share = F.col("n") / F.sum("n").over(Window.partitionBy("a"))
    return cells.select(F.col("a").alias("parent_value"), F.col("b").alias("child_value"), share.alias("probability")).filter(F.col("probability") >= least)


def compare_groups(df: DataFrame, group: str, measures: Sequence[str], limit: int = 10) -> DataFrame:
    """Count, and mean, least and largest of measures, for the largest groups."""
    aggs = [f(m).alias(f"{n}_{m}") for m in measures for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    return df.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("group_value")).agg(F.count("*").alias("n"), *aggs).orderBy(F.desc("n"), "group_value").limit(limit)


def having_at_least(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Groups of at least ``n`` rows."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") >= n)


def share_of_rows(df: DataFrame, by: str) -> DataFrame:
    """Percent of all rows in each group."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))  # one row
    return counts.crossJoin(total).select(by, "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("percent"))
