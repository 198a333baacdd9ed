"""Profiles of all segments of a table at once, how far they lie from each other, and what sets them apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Values of a category that its distribution holds, and the share of one that it doesn't.
TOP, ABSENT = 10, 1e-4


def segment_profiles(df: DataFrame, segment: str, numbers: Sequence[str], categories: Sequence[str] = ()) -> DataFrame:
    """What describes each column in each segment, a row each; every statistic of all segments comes from two aggregations.

    ``kind`` is number or category; numbers have ``mean``, ``std``, ``min``, ``max``,
    ``centre`` (the mean between the ends, 0 to 1) and ``skewness``, categories ``mode``,
    ``mode_share``, ``entropy`` (bits) and ``distribution`` of their ten most frequent values.
    ``null_rate`` and ``unique_rate`` are of all rows. Rows without a segment are left out.
    """
    columns = [*numbers, *categories]
    own = df.filter(F.col(segment).isNotNull()).select(F.col(segment).cast("string").alias("segment"), *(F.col(c).cast("double").alias(c) for c in numbers), *(F.col(c).cast("string").alias(c) for c in categories))
    moments = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "lean": F.skewness}
    void = F.lit(None).cast("double")
    wide = own.groupBy("segment").agg(
        F.count("*").alias("rows"), *(F.count(c).alias(f"{c}__given") for c in columns),
        *((f(c) if c in numbers else F.first(void)).alias(f"{c}__{n}") for c in columns for n, f in moments.items()),
    )
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit("number" if c in numbers else "category").alias("kind"), *(F.col(f"`{c}__{n}`").alias(n) for n in ("given", *moments))) for c in columns))
    rows = wide.select("segment", "rows", F.explode(each).alias("s")).select("segment", "rows", "s.*")
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))
    counts = own.select("segment", F.explode(pairs).alias("p")).select("segment", "p.*").filter("value is not null").groupBy("segment", "column_name", "value").agg(F.count("*").alias("n"))
    distinct = counts.groupBy("segment", "column_name").agg(F.count("*").alias("cardinality"))
    # the ten first of a segment's values leave each task before they meet
    order = Window.partitionBy("segment", "column_name").orderBy(F.desc("n"), "value")
    top = counts.filter(F.col("column_name").isin(*categories)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    named = top.groupBy("segment", "column_name").agg(F.min_by("value", "rank").alias("mode"), F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("top"))
    out = rows.join(distinct, ["segment", "column_name"], "left").join(named, ["segment", "column_name"], "left")
    share = F.transform("top", lambda t: t["n"] / F.col("given"))
    return out.select(
        "segment", "column_name", "kind", "rows", (1 - F.col("given") / F.col("rows")).alias("null_rate"), (F.coalesce("cardinality", F.lit(0)) / F.col("rows")).alias("unique_rate"), F.coalesce("cardinality", F.lit(0)).alias("cardinality"),
        "mean", "std", "min", "max", F.try_divide(F.col("mean") - F.col("min"), F.col("max") - F.col("min")).alias("centre"), (F.col("lean") * F.pow((F.col("given") - 1) / F.col("given"), F.lit(1.5))).alias("skewness"),
        "mode", F.get(share, F.lit(0)).alias("mode_share"), F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p)).alias("entropy"), F.map_from_arrays(F.transform("top", lambda t: t["value"]), share).alias("distribution"),
    )


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two maps of shares, 0 to 1; a value that one lacks has a tiny share there."""
    keys = F.array_union(F.map_keys(p), F.map_keys(q))
    of = lambda m: F.transform(keys, lambda k: F.coalesce(F.try_element_at(m, k), F.lit(ABSENT)))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    a, b = of(p), of(q)
    one, two = F.transform(a, lambda x: x / total(a)), F.transform(b, lambda x: x / total(b))
    halves = F.zip_with(one, two, lambda x, y: x * F.log(2 * x / (x + y)) + y * F.log(2 * y / (x + y)))
    return F.least(total(halves) / 2 / F.log(F.lit(2.0)), F.lit(1.0))


def _mean_of(parts: list[Column]) -> Column:
    """Mean of those parts that aren't null."""
    given = F.array_compact(F.array(*parts))
    return F.aggregate(given, F.lit(0.0), lambda s, x: s + x) / F.size(given)


def column_gaps(profiles: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """How far each common column of two segments lies apart, 0 to 1; of every two segments, or of every one with those of ``other``.

    The mean of: the gap of null rates; of numbers those of centres, coefficients of
    variation and skewness; of categories those of the mode's share, of the distributions
    and of the cardinality; and half the gap of unique rates.
    """
    named = lambda df, n: df.select("column_name", "kind", *(F.col(c).alias(f"{c}_{n}") for c in df.columns if c not in ("column_name", "kind")))
    both = named(profiles, "a").join(named(profiles if other is None else other, "b"), ["column_name", "kind"])
    both = both.filter("segment_a < segment_b") if other is None else both
    gap = lambda c: F.abs(F.col(f"{c}_a") - F.col(f"{c}_b"))
    cv = lambda n: F.abs(F.try_divide(F.col(f"std_{n}"), F.col(f"mean_{n}")))
    capped = lambda x: F.when(x > 1, 1.0).otherwise(x)
    spread = F.when((F.col("mean_a") != 0) & (F.col("mean_b") != 0), capped(F.abs(cv("a") - cv("b")) / F.greatest(cv("a") + cv("b"), F.lit(0.001))))
    numbers = [gap("centre"), spread, capped(gap("skewness") / 4)]
    sizes = F.least("cardinality_a", "cardinality_b") / F.greatest("cardinality_a", "cardinality_b")
    held = F.col("distribution_a").isNotNull() & F.col("distribution_b").isNotNull()
    categories = [F.abs(F.coalesce("mode_share_a", F.lit(0.0)) - F.coalesce("mode_share_b", F.lit(0.0))), F.when(held, divergence(F.col("distribution_a"), F.col("distribution_b"))), F.when((F.col("cardinality_a") > 0) & (F.col("cardinality_b") > 0), 1 - sizes)]
    is_number = F.col("kind") == "number"
    parts = [gap("null_rate"), *(F.when(is_number, x) for x in numbers), *(F.when(~is_number, x) for x in categories), gap("unique_rate") * 0.5]
    return both.withColumn("distance", _mean_of(parts)).withColumn("mean_delta", F.col("mean_b") - F.col("mean_a")).withColumn("null_delta", F.col("null_rate_b") - F.col("null_rate_a"))


def segment_distances(profiles: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """Distance and similarity of every two segments, or of every one with those of ``other``.

    The mean gap of common columns, and a fifth of the share that aren't common, at most
    1; segments without a common column are 1 apart.
    """
    of = lambda df, n: df.groupBy(F.col("segment").alias(f"segment_{n}")).agg(F.first("rows").alias(f"rows_{n}"), F.count("*").alias(f"columns_{n}"))
    both = of(profiles, "a").crossJoin(of(profiles if other is None else other, "b"))  # the pairs are the result
    both = both.filter("segment_a < segment_b") if other is None else both
    gaps = column_gaps(profiles, other).groupBy("segment_a", "segment_b").agg(F.avg("distance").alias("gap"), F.count("*").alias("common"))
    distance = F.least(F.col("gap") + 0.2 * (1 - F.col("common") / F.greatest("columns_a", "columns_b")), F.lit(1.0))
    return both.join(gaps, ["segment_a", "segment_b"], "left").select("segment_a", "segment_b", "rows_a", "rows_b", F.coalesce(distance, F.lit(1.0)).alias("distance")).withColumn("similarity", 1 - F.col("distance"))


def segment_insights(profiles: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """What sets two segments apart, a row an insight: ``kind``, the column, and by how much.

    ``overall`` names the similarity; ``size`` a difference of over 20 percent; ``mean``
    (percent) and ``mode`` what changed in the three columns furthest apart, if over 0.3;
    ``nulls`` the two largest changes of null rates over 10 points.
    """
    keys = ["segment_a", "segment_b"]
    whole, gaps = segment_distances(profiles, other), column_gaps(profiles, other)
    void = F.lit(None).cast("string")
    level = F.when(F.col("similarity") >= 0.9, "alike").when(F.col("similarity") >= 0.7, "moderate").when(F.col("similarity") >= 0.5, "significant").otherwise("substantial")
    overall = whole.select(*keys, F.lit("overall").alias("kind"), void.alias("column_name"), F.col("similarity").alias("amount"), level.alias("detail"))
    growth = 100.0 * (F.col("rows_b") - F.col("rows_a")) / F.col("rows_a")
    size = whole.filter(F.abs(growth) > 20).select(*keys, F.lit("size").alias("kind"), void.alias("column_name"), growth.alias("amount"), void.alias("detail"))
    first = Window.partitionBy(*keys).orderBy(F.desc("distance"), "column_name")
    far = gaps.withColumn("rank", F.row_number().over(first)).filter("rank <= 3 and distance > 0.3")
    moved = F.col("mode_a").isNotNull() & F.col("mode_b").isNotNull() & (F.col("mode_a") != F.col("mode_b"))
    told = far.filter(((F.col("kind") == "number") & F.col("mean_delta").isNotNull()) | ((F.col("kind") == "category") & moved))
    is_number = F.col("kind") == "number"
    changed = told.select(*keys, F.when(is_number, "mean").otherwise("mode").alias("kind"), "column_name", F.when(is_number, F.coalesce(100 * F.try_divide(F.col("mean_delta"), F.col("mean_a")), F.lit(0.0))).alias("amount"), F.when(~is_number, F.concat_ws(" > ", "mode_a", "mode_b")).alias("detail"))
    most = Window.partitionBy(*keys).orderBy(F.desc(F.abs("null_delta")), "column_name")
    nulls = gaps.filter(F.abs("null_delta") > 0.1).withColumn("rank", F.row_number().over(most)).filter("rank <= 2").select(*keys, F.lit("nulls").alias("kind"), "column_name", (100 * F.col("null_delta")).alias("amount"), void.alias("detail"))
    return overall.unionByName(size).unionByName(changed).unionByName(nulls)


def segment_vectors(profiles: DataFrame) -> DataFrame:
    """``segment`` and its ``vector``: size, number of columns, and nine features of each column, by name."""
    is_kind = lambda k: (F.col("kind") == k).cast("double")
    features = F.array("null_rate", "unique_rate", is_kind("number"), is_kind("category"), F.lit(0.0), F.coalesce("centre", F.lit(0.5)), F.least(F.coalesce("skewness", F.lit(0.0)) / 3 + 0.5, F.lit(1.0)), F.coalesce("mode_share", F.lit(0.0)), F.least(F.coalesce("entropy", F.lit(0.0)) / 5, F.lit(1.0)))
    own = profiles.groupBy("segment").agg(F.first("rows").alias("rows"), F.array_sort(F.collect_list(F.struct("column_name", features.alias("f")))).alias("all"))  # as many as the table has columns
    return own.select("segment", F.concat(F.array(F.log10(F.col("rows") + 1), F.size("all") / 100.0), F.flatten(F.transform("all", lambda x: x["f"]))).alias("vector"))
