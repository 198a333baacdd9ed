"""Detection of patterns in text, numbers and time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.functions.text import shape, shape_regex
from lodestone.operators.ordering import before, in_blocks, middle, numbered
from lodestone.operators.stats import rows_by_column

#: Forms of text that columns are tested for.
FORMS = {
    "Email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "Url": r"^https?://[^\s]+$",
    "Uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "Phone": r"^[\+]?[(]?[0-9]{1,3}[)]?[-\s\.]?[0-9]{3}[-\s\.]?[0-9]{4,6}$",
    "IpAddress": r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$",
    "CreditCard": r"^[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{1,7}$",
    "Percentage": r"^-?[0-9]+\.?[0-9]*\s*%$",
    "Currency": r"^[$£€¥][0-9,]+\.?[0-9]*$",
}


def form_rates(df: DataFrame, columns: list[str], least: float = 10.0) -> DataFrame:
    """Percent of non-null values of each form in each column, in one aggregation."""
    rate = lambda c, rx: F.round(F.try_divide(100.0 * F.count_if(F.col(c).rlike(rx)), F.count(c)), 1)
    wide = df.agg(*(rate(c, rx).alias(f"{c}__{name}") for c in columns for name, rx in FORMS.items()))
    by_column = rows_by_column(wide, columns, list(FORMS))
    each = F.array(*(F.struct(F.lit(n).alias("form"), F.col(n).alias("percent")) for n in FORMS))
    return by_column.select("column_name", F.explode(each).alias("f")).select("column_name", "f.*").filter(F.col("percent") >= least)


def novel_shape(df: DataFrame, column: str, least: float = 0.7) -> DataFrame:
    """The leading shape of a column's distinct values, if it covers ``least`` of the five leading ones."""
    values = df.select(F.col(column).alias("v")).filter(F.length("v").between(2, 100)).distinct()
    counts = values.groupBy(shape(F.col("v")).alias("shape")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "shape").limit(5)
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))  # one row
    return counts.crossJoin(total).orderBy(F.desc("n"), "shape").limit(1).filter(F.col("n") >= least * F.col("total")).select(F.lit(column).alias("column_name"), "shape", "n", (F.col("n") / F.col("total")).alias("share"), shape_regex(F.col("shape")).alias("regex"))


def distribution_class(skew: Column, kurtosis: Column, iqr_share: Column, bimodal: Column) -> Column:
    """Name of a distribution from its moments; the first rule that holds."""
    return (
        F.when((F.abs(skew) < 0.5) & (F.abs(kurtosis - 3) < 1), "Normal").when((kurtosis < 2) & (iqr_share > 0.4) & (iqr_share < 0.6), "Uniform").when((skew > 2) & (kurtosis > 10), "PowerLaw")
        .when((skew > 0.5) & (kurtosis > 6), "Exponential").when(skew > 1, "RightSkewed").when(skew < -1, "LeftSkewed").when(bimodal, "Bimodal").otherwise("Unknown")
    )


def peaks(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Bins of a column that hold strictly more rows than both neighbours."""
    value = F.col(column).cast("double")
    ends = F.broadcast(df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")))  # one row
    bucket = F.least(F.floor(F.try_divide((F.col("v") - F.col("lo")) * bins, F.col("hi") - F.col("lo"))), F.lit(bins - 1)).cast("int")
    counts = df.select(value.alias("v")).filter("v is not null").crossJoin(ends).groupBy(bucket.alias("bin")).agg(F.count("*").alias("n")).filter("bin is not null")
    beside = lambda k: counts.select((F.col("bin") + k).alias("bin"), F.col("n").alias(f"n{k}"))
    joined = counts.join(beside(1), "bin", "left").join(beside(-1), "bin", "left")
    return joined.filter((F.col("n") > F.coalesce("n1", F.lit(0))) & (F.col("n") > F.coalesce(F.col("n-1"), F.lit(0)))).select("bin", "n")


def trend_by_date(df: DataFrame, date: str, value: str) -> DataFrame:
    """Least squares of a value on the days since the first date."""
    first = F.broadcast(df.agg(F.min(F.to_date(date)).alias("first")))  # one row
    days = F.datediff(F.to_date(date), F.col("first")).cast("double")
    fit = df.filter(F.col(date).isNotNull() & F.col(value).isNotNull()).crossJoin(first).agg(F.regr_slope(F.col(value).cast("double"), days).alias("slope"), F.regr_r2(F.col(value).cast("double"), days).alias("r_squared"))
    return fit.withColumn("direction", F.when(F.col("slope") > 0.001, "Increasing").when(F.col("slope") < -0.001, "Decreasing").otherwise("Stable")).withColumn("reported", (F.col("r_squared") > 0.3) | (F.abs("slope") > 0.001))


def _head(df: DataFrame, order: list[str], rows: int | None) -> DataFrame:
    return df.orderBy(*order).limit(rows) if rows else df


def trend_by_order(df: DataFrame, order: str, value: str, rows: int | None = None) -> DataFrame:
    """Least squares of a value on its place in an order; of the first ``rows`` rows alone if that is given."""
    head = _head(df.filter(F.col(value).isNotNull()).select(order, value), [order], rows)
    placed = numbered(head, [order]).select(F.col(value).cast("double").alias("y"), F.col("rn").cast("double").alias("x"))
    return placed.agg(F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r_squared"), F.count("*").alias("n"))


def granularity(df: DataFrame, ts: str, rows: int | None = None) -> DataFrame:
    """Median positive gap in seconds between times (the first ``rows`` if that is given), and its name."""
    head = _head(df.filter(F.col(ts).isNotNull()).select(F.unix_timestamp(F.col(ts).cast("timestamp")).alias("t")), ["t"], rows)
    gaps = before(numbered(head, ["t"]), "t", "last").select((F.col("t") - F.col("last")).alias("gap")).filter("gap > 0")
    out = middle(gaps, "gap", [0.5]).agg(F.max("value").alias("median_gap"))
    g = F.col("median_gap")
    # fixed values: seconds at which the next coarser name starts
    name = F.when(g < 120, "Minute").when(g < 7_200, "Hourly").when(g < 172_800, "Daily").when(g < 864_000, "Weekly").when(g < 5_184_000, "Monthly").when(g < 15_552_000, "Quarterly").otherwise("Yearly")
    return out.withColumn("granularity", name)


def time_gaps(df: DataFrame, ts: str) -> DataFrame:
    """Days from the first to the last that have no row."""
    day = F.to_date(ts)
    out = df.agg((F.datediff(F.max(day), F.min(day)) + 1).cast("long").alias("expected"), F.countDistinct(day).alias("actual"), F.count(ts).alias("n"))
    out = out.withColumn("gaps", F.greatest(F.col("expected") - F.col("actual"), F.lit(0)))
    return out.select("expected", "actual", "gaps", F.round(F.try_divide(100.0 * F.col("gaps"), F.col("n")), 1).alias("gap_percent")).withColumn("contiguous", F.col("gap_percent") < 5)


def weekday_seasonality(df: DataFrame, ts: str) -> DataFrame:
    """Variation of row counts over the days of the week (Sunday is 0)."""
    counts = df.filter(F.col(ts).isNotNull()).groupBy((F.dayofweek(ts) - 1).alias("dow")).agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("days"), (F.stddev_samp("n") / F.avg("n")).alias("variation")).withColumn("seasonal", (F.col("days") >= 5) & (F.col("variation") > 0.3))


def autocorrelation(df: DataFrame, order: list[str], value: str, rows: int | None = None, lags: int = 60) -> DataFrame:
    """Autocorrelation of values in an order at lags from 1; of the first ``rows`` alone if that is given.

    Rows go into blocks with copies of the ``lags`` rows before them; products of
    neighbours are added up within each, a few sums a block.
    """
    placed = numbered(_head(df.filter(F.col(value).isNotNull()).select(*order, value), order, rows), order).select(F.col(value).cast("double").alias("v"), "rn")
    mean, n = placed.agg(F.avg("v"), F.count("*")).first()

    def products(block: pd.DataFrame) -> pd.DataFrame:
        own = block.sort_values("rn")
        c, copies = own["v"].to_numpy() - mean, int(own["__copy"].sum())
        sums = [float(c[copies:] @ c[copies:])] + [float(c[max(copies, k) :] @ c[max(copies, k) - k : len(c) - k]) if len(c) > k else 0.0 for k in range(1, lags + 1)]
        return pd.DataFrame({"lag": range(lags + 1), "s": sums})

    sums = in_blocks(placed, lags).groupBy("__block").applyInPandas(products, "lag int, s double").groupBy("lag").agg(F.sum("s").alias("s"))
    total = F.broadcast(sums.filter("lag = 0").select(F.col("s").alias("total")))  # one row
    return sums.filter(F.col("lag").between(1, max(n - 1, 0))).crossJoin(total).select("lag", F.try_divide(F.col("s"), F.col("total")).alias("acf"))


def acf_peaks(acf: DataFrame, least: float = 0.2) -> DataFrame:
    """Lags whose autocorrelation exceeds ``least`` and both neighbours', with what the period means."""
    along = Window.orderBy("lag")  # as many rows as there are lags
    near = acf.withColumn("before", F.lag("acf").over(along)).withColumn("after", F.lead("acf").over(along))
    lag = F.col("lag")
    meaning = F.when(lag == 7, "weekly").when(lag == 12, "monthly over a year").when(lag == 14, "fortnightly").when(lag == 24, "hourly over a day").when(lag.isin(30, 31), "monthly").when(lag == 52, "weekly over a year").when(lag.isin(365, 366), "yearly").when(lag <= 3, "very short").when(lag <= 10, "short").otherwise("long")
    return near.filter((F.col("acf") > least) & (F.col("acf") > F.col("before")) & (F.col("acf") > F.col("after"))).select("lag", "acf", meaning.alias("period"))


def key_overlap(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Share of a column's distinct values that another column has, compared as text."""
    values = lambda df, c: df.select(F.col(c).cast("string").alias("v")).filter("v is not null").distinct()
    own, other = values(child, child_col), values(parent, parent_col).withColumn("there", F.lit(1))
    return own.join(other, "v", "left").agg(F.count("*").alias("distinct_values"), F.count("there").alias("found"), (F.count("there") / F.count("*")).alias("overlap")).select(F.lit(child_col).alias("child"), F.lit(parent_col).alias("parent"), "*").withColumn("is_key", F.col("overlap") > 0.9)


def monotonic_share(df: DataFrame, order: str, value: str, rows: int | None = None) -> DataFrame:
    """Shares of rising and falling steps among values in an order (the first ``rows`` if that is given), and the verdict above 0.95."""
    head = _head(df.filter(F.col(value).isNotNull()).select(order, value), [order], rows)
    step = before(numbered(head, [order]), value, "last").select((F.col(value) - F.col("last")).alias("step"))
    shares = step.agg(F.avg((F.col("step") > 0).cast("double")).alias("rising"), F.avg((F.col("step") < 0).cast("double")).alias("falling"))
    return shares.withColumn("verdict", F.when(F.col("rising") > 0.95, "Increasing").when(F.col("falling") > 0.95, "Decreasing").otherwise("None"))


def date_range(df: DataFrame, columns: list[str]) -> DataFrame:
    """First and last date of each column and the days between them, in one aggregation."""
    wide = df.agg(*(f(F.to_date(c)).alias(f"{c}__{n}") for c in columns for n, f in (("first_date", F.min), ("last_date", F.max))))
    return rows_by_column(wide, columns, ["first_date", "last_date"]).withColumn("span_days", F.datediff("last_date", "first_date"))


def time_series_pattern(df: DataFrame) -> DataFrame:
    """One row for a table with a date column, the first of which orders it: how finely, with what gaps and seasons, and how sure that is."""
    dated = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    if not dated:
        return df.sparkSession.createDataFrame([], "column_name string, granularity string, gaps long, contiguous boolean, seasonal boolean, confidence double")
    parts = [granularity(df, dated[0]).select("granularity"), time_gaps(df, dated[0]).select("gaps", "contiguous"), weekday_seasonality(df, dated[0]).select("seasonal")]
    one = parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each
    return one.select(F.lit(dated[0]).alias("column_name"), "granularity", "gaps", "contiguous", "seasonal", F.when(F.col("contiguous"), 0.9).otherwise(0.7).alias("confidence"))
