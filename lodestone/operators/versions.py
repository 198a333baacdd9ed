"""Two versions of a table compared by their sketches alone: deltas, step scores and weighted drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.drift import categorical_drift, numeric_drift
from lodestone.operators.stats import mad, top_values

#: Up to which absolute difference a step score holds; 1 beyond.
STEPS = ((0.01, 0.0), (0.05, 0.1), (0.1, 0.3), (0.2, 0.6))


def step_score(delta: Column) -> Column:
    """How much a difference counts, 0 to 1, in steps; 0 for null."""
    out = F.when(delta.isNull(), 0.0)
    for below, score in STEPS:
        out = out.when(F.abs(delta) < below, score)
    return out.otherwise(1.0)


def version_sketch(df: DataFrame, numbers: Sequence[str], categories: Sequence[str], exact: bool = True) -> DataFrame:
    """A row a column, all that a comparison needs: null percent, mean, deviation and MAD of numbers, the five most frequent values of categories.

    The MAD is exact, or of a sketched median and sketched deviations from it, whose
    ranks are off by a ten-thousandth at most. Its size depends on the columns alone.
    """
    columns = [*numbers, *categories]
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(f"{c}__given") for c in columns), *(f(c).alias(f"{c}__{n}") for c in numbers for n, f in (("mean", F.avg), ("std", F.stddev_samp))), *([] if exact else [F.percentile_approx(F.col(c).cast("double"), F.lit(0.5), F.lit(10_000)).alias(f"{c}__med") for c in numbers]))
    void = F.lit(None).cast("double")
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), (100 - 100.0 * F.col(f"{c}__given") / F.col("rows")).alias("null_percent"), *((F.col(f"{c}__{n}") if c in numbers else void).alias(n) for n in ("mean", "std"))) for c in columns))
    out = wide.select(F.explode(rows).alias("r")).select("r.*")
    if numbers and exact:
        out = out.join(F.broadcast(mad(df, list(numbers))), "column_name", "left")  # a row a column
    elif numbers:
        away = df.select(*numbers).crossJoin(F.broadcast(wide.select(*(f"{c}__med" for c in numbers)))).agg(*(F.percentile_approx(F.abs(F.col(c) - F.col(f"{c}__med")), F.lit(0.5), F.lit(10_000)).alias(c) for c in numbers))
        out = out.join(F.broadcast(away.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("mad")) for c in numbers))).alias("m")).select("m.*")), "column_name", "left")
    else:
        out = out.withColumn("mad", void)
    if not categories:
        return out.withColumn("top", F.lit(None).cast("array<string>"))
    top = top_values(df, list(categories), 5).groupBy("column_name").agg(F.collect_set(F.lower("value")).alias("top"))
    return out.join(F.broadcast(top), "column_name", "left")


def validated(source: DataFrame, target: DataFrame) -> DataFrame:
    """What changed from one sketch to another, a row a column of the source, with ``score`` from 0 to 1.

    Numbers score by the steps of their deltas of mean, deviation and MAD, at most 1;
    categories by 1 less the Jaccard similarity of their five most frequent values, 1 without
    any; a column that is missing in the target scores 1.
    """
    of = lambda df, n: df.select(F.lower("column_name").alias("key"), *([F.col("column_name")] if n == "a" else []), F.lit(True).alias(f"there_{n}"), *(F.col(c).alias(f"{c}_{n}") for c in ("null_percent", "mean", "std", "mad", "top")))
    both = of(source, "a").join(of(target, "b"), "key", "left")
    delta = lambda c: (F.col(f"{c}_b") - F.col(f"{c}_a")).alias(f"{c}_delta")
    overlap = F.try_divide(F.size(F.array_intersect("top_a", "top_b")), F.size(F.array_union("top_a", "top_b")))
    out = both.select("column_name", F.col("there_b").isNull().alias("missing"), F.col("top_a").isNotNull().alias("is_category"), *(delta(c) for c in ("null_percent", "mean", "std", "mad")), F.when(F.col("top_a").isNotNull() & F.col("top_b").isNotNull(), overlap).alias("top_overlap"))
    numbers = F.least(sum((step_score(F.col(f"{c}_delta")) for c in ("mean", "std", "mad")), F.lit(0.0)), F.lit(1.0))
    score = F.when(F.col("missing"), 1.0).when(F.col("is_category"), 1 - F.coalesce("top_overlap", F.lit(0.0))).otherwise(numbers)
    return out.withColumn("score", score).drop("is_category")


def validation_score(deltas: DataFrame) -> DataFrame:
    """One row: the largest score of all columns."""
    return deltas.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("drift_score"))


def weighted_drift(base: DataFrame, current: DataFrame, numbers: Sequence[str], categories: Sequence[str], others: Sequence[str] = (), ids: Sequence[str] = ()) -> DataFrame:
    """A row a column with its ``distance`` and ``weight``: numbers by the approximate KS distance, categories by Jensen-Shannon, others and ids by the changes of null and unique shares; ids weigh a tenth."""
    parts = []
    if numbers:
        parts.append(numeric_drift(base, current, numbers).select("column_name", F.col("ks").alias("distance"), F.lit(1.0).alias("weight")))
    if categories:
        parts.append(categorical_drift(base, current, categories).select("column_name", F.col("js_divergence").alias("distance"), F.lit(1.0).alias("weight")))
    plain = [*others, *ids]
    if plain:
        def shares(df: DataFrame, n: str) -> DataFrame:
            wide = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(f"{c}__given") for c in plain), *(F.countDistinct(c).alias(f"{c}__distinct") for c in plain))
            return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), (1 - F.col(f"{c}__given") / F.col("rows")).alias(f"nulls_{n}"), (F.col(f"{c}__distinct") / F.col("rows")).alias(f"unique_{n}")) for c in plain))).alias("r")).select("r.*")

        both = shares(base, "a").join(F.broadcast(shares(current, "b")), "column_name")  # a row a column
        gap = (F.abs(F.col("nulls_b") - F.col("nulls_a")) + F.abs(F.col("unique_b") - F.col("unique_a"))) / 2
        parts.append(both.select("column_name", gap.alias("distance"), F.when(F.col("column_name").isin(*ids), 0.1).otherwise(1.0).alias("weight")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def drift_of(weighted: DataFrame) -> DataFrame:
    """One row: the weighted mean of all distances."""
    return weighted.agg(F.coalesce(F.try_divide(F.sum(F.col("distance") * F.col("weight")), F.sum("weight")), F.lit(0.0)).alias("drift"))
