"""Target effects, tests, segmentation, anomalies and clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.ordering import numbered, tile
from lodestone.functions.scalars import clamp, normal_cdf, pearson
from lodestone.functions.vectors import cosine
from lodestone.operators.stats import per_column, rows_by_column, quantiles

#: Class names that stand for the outcome of interest, the first that occurs counts.
POSITIVE = ("1", "true", "yes", "y", "churn", "exited", "fraud", "late", "bad")


def positive_class(df: DataFrame, target: str) -> str | None:
    """The class to explain: the most frequent of the telling names, else the most frequent class."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("c")).agg(F.count("*").alias("n"))
    told = F.lower("c").isin(*POSITIVE)
    first = counts.orderBy(told.desc(), F.desc("n"), "c").first()  # one row
    return first["c"] if first else None


def numeric_effects(df: DataFrame, flag: Column, columns: Sequence[str], least_rows: int = 5) -> DataFrame:
    """Cohen's d of columns between the rows where ``flag`` holds and the others, in one aggregation."""
    own = df.select(flag.alias("flag"), *columns).filter("flag is not null")
    aggs = {}
    for c in columns:
        for side, when in (("1", F.col("flag")), ("0", ~F.col("flag"))):
            value = F.when(when, F.col(c).cast("double"))
            aggs[f"{c}__n{side}"], aggs[f"{c}__m{side}"], aggs[f"{c}__s{side}"] = F.count(value), F.avg(value), F.stddev_samp(value)
    wide = own.agg(*(e.alias(k) for k, e in aggs.items()))
    rows = rows_by_column(wide, columns, ["n1", "m1", "s1", "n0", "m0", "s0"]).filter((F.col("n1") >= least_rows) & (F.col("n0") >= least_rows))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("s1") * F.col("s1") + (F.col("n0") - 1) * F.col("s0") * F.col("s0")) / (F.col("n1") + F.col("n0") - 2))
    return rows.select("column_name", F.col("m1").alias("mean_with"), F.col("m0").alias("mean_without"), F.try_divide(F.col("m1") - F.col("m0"), pooled).alias("cohens_d"), F.col("n1").alias("n_with"), F.col("n0").alias("n_without"))


def categorical_effects(df: DataFrame, flag: Column, columns: Sequence[str], least_rows: int = 10) -> DataFrame:
    """The value of each column, of all that ``least_rows`` rows have, whose rate of ``flag`` is furthest from the overall rate."""
    own = df.select(flag.cast("int").alias("flag"), F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))).alias("p")).filter("flag is not null and p.value is not null")
    groups = own.groupBy("p.column_name", "p.value").agg(F.count("*").alias("n"), F.avg("flag").alias("rate")).filter(F.col("n") >= least_rows)
    base = F.broadcast(df.agg(F.avg(flag.cast("int")).alias("base_rate")))  # one row
    kept = groups.crossJoin(base).withColumn("delta", F.col("rate") - F.col("base_rate"))
    furthest = F.min(F.struct((-F.round(F.abs("delta"), 9)).alias("near"), (-F.col("n")).alias("less"), "value", "n", "rate", "base_rate", "delta"))
    return kept.groupBy("column_name").agg(furthest.alias("f")).select("column_name", "f.value", "f.n", "f.rate", "f.base_rate", "f.delta")


def ranked_effects(effects: DataFrame, magnitude: str, support: str, total: int, limit: int = 8) -> DataFrame:
    """Effects by magnitude times support, with an insight score."""
    share = F.col(support) / F.lit(total)
    score = 0.7 * clamp(F.abs(magnitude)) + 0.3 * clamp(share)
    return effects.withColumn("score", score).orderBy(F.desc(F.abs(magnitude) * share), effects.columns[0]).limit(limit)


def welch_t(df: DataFrame, group: str, value: str) -> DataFrame:
    """Welch's t between the two largest groups."""
    groups = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(group).cast("string").alias("g")).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s")).orderBy(F.desc("n"), "g").limit(2)
    placed = groups.withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "g")))  # two rows
    of = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    one = placed.agg(*(of(c, k).alias(f"{c}{k}") for c in "gnms" for k in (1, 2)))
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(F.col("s1") * F.col("s1") / F.col("n1") + F.col("s2") * F.col("s2") / F.col("n2")))
    return one.select(F.col("g1").alias("group_a"), F.col("g2").alias("group_b"), "n1", "n2", F.col("m1").alias("mean_a"), F.col("m2").alias("mean_b"), t.alias("t_statistic"))


def one_sample_t(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """t of each column's mean against zero."""
    return per_column(df, columns, {"n": F.count, "mean": lambda c: F.avg(c.cast("double")), "std": lambda c: F.stddev_samp(c.cast("double"))}).withColumn("t_statistic", F.try_divide(F.col("mean"), F.col("std") / F.sqrt("n")))


def correlation_significance(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation with its t statistic, and a normal p-value for more than 30 rows (-1 for fewer)."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(pearson(x, y).alias("r"), F.count("*").alias("n"))
    t = F.try_divide(F.col("r") * F.sqrt(F.col("n") - 2), F.sqrt(1 - F.col("r") * F.col("r")))
    return both.withColumn("t_statistic", t).withColumn("p_value", F.when(F.col("n") > 30, 2 * (1 - normal_cdf(F.abs("t_statistic")))).otherwise(-1.0)).withColumn("significant", F.col("p_value").between(0, 0.05))


def feature_importance(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Absolute correlation of features with a numeric target, in one aggregation."""
    wide = df.agg(*(F.abs(pearson(c, target)).alias(f"{c}__importance") for c in features))
    return rows_by_column(wide, list(features), ["importance"])


def ntile_segments(df: DataFrame, key: str, columns: Sequence[str], segments: int = 4) -> DataFrame:
    """Segments of equal size by the mean of min-max scaled columns: size, score and averages of each.

    Tiles come from the exact place of each row in the order of scores, ties by the key.
    """
    whole = df.filter(" and ".join(f"{c} is not null" for c in columns)).select(key, *columns)
    ends = F.broadcast(whole.agg(*(f(c).alias(f"{c}__{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max)))))  # one row
    scaled = [F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}__lo"), F.col(f"{c}__hi") - F.col(f"{c}__lo")), F.lit(0.0)) for c in columns]
    scored = whole.crossJoin(ends).withColumn("score", sum(scaled, F.lit(0.0)) / len(columns))
    placed = numbered(scored.select(key, "score", *columns), ["score", key])
    placed = placed.crossJoin(F.broadcast(placed.agg(F.count("*").alias("rows")))).withColumn("segment", tile(F.col("rn"), F.col("rows"), segments))
    return placed.groupBy("segment").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"), *(F.avg(c).alias(f"avg_{c}") for c in columns))


def anomalies(df: DataFrame, columns: Sequence[str], method: str = "zscore", threshold: float = 3.0) -> DataFrame:
    """Values beyond ``threshold`` deviations of the mean, or interquartile ranges of the quartiles."""
    if method == "zscore":
        wide = df.agg(*(f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in columns for n, f in (("a", F.avg), ("b", F.stddev_samp))))
    else:
        wide = quantiles(df, columns, {"a": 0.25, "b": 0.75})
    both = df.select(*columns).crossJoin(F.broadcast(wide))  # one row
    aggs = []
    for c in columns:
        a, b = F.col(f"{c}__a"), F.col(f"{c}__b")
        low, high = (a - threshold * b, a + threshold * b) if method == "zscore" else (a - threshold * (b - a), b + threshold * (b - a))
        out = (F.col(c) < low) | (F.col(c) > high)
        aggs += [F.max(low).alias(f"{c}__lower_bound"), F.max(high).alias(f"{c}__upper_bound"), F.count_if(out).alias(f"{c}__n"), F.min(F.when(out, F.col(c))).alias(f"{c}__smallest"), F.max(F.when(out, F.col(c))).alias(f"{c}__largest"), (100.0 * F.count_if(out) / F.count(c)).alias(f"{c}__percent")]
    return rows_by_column(both.agg(*aggs), list(columns), ["lower_bound", "upper_bound", "n", "smallest", "largest", "percent"])


def monthly_trend(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Slope of monthly means over their order, with its direction; three months at least."""
    months = df.filter(F.col(ts).isNotNull() & F.col(value).isNotNull()).groupBy(F.date_trunc("month", ts).alias("month")).agg(F.avg(value).alias("v"))
    placed = months.withColumn("i", (F.row_number().over(Window.orderBy("month")) - 1).cast("double"))  # a row a month
    fit = placed.agg(F.count("*").alias("periods"), F.regr_slope("v", "i").alias("slope"), F.avg("v").alias("mean")).filter("periods >= 3")
    return fit.withColumn("direction", F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("stable"))


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, id_col: str, vector: str, label: str, most: int = 10_000) -> DataFrame:
    """The centroid of largest cosine for each vector, ties to the smaller label.

    Up to ``most`` centroids are broadcast; more are dealt into blocks of about so many,
    which vectors meet block by block.
    """
    named = centroids.select(F.col(label).alias("nearest"), F.col("centroid"))
    n = named.count()
    if n <= most:
        pairs = vectors.select(id_col, vector).crossJoin(F.broadcast(named))
    else:
        blocks = -(-n // most)
        left = vectors.select(id_col, vector, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        pairs = left.join(named.withColumn("block", F.pmod(F.xxhash64("nearest"), F.lit(blocks)).cast("int")), "block")
    near = pairs.select(id_col, "nearest", cosine(F.col(vector), F.col("centroid")).alias("similarity"))
    best = F.max(F.struct("similarity", (-F.col("nearest")).alias("m")))
    return near.groupBy(id_col).agg(best.alias("b")).select(id_col, (-F.col("b.m")).alias("nearest"), F.col("b.similarity").alias("similarity"))


def k_means(vectors: DataFrame, vector: str, k: int = 5, seed: int = 42, rounds: int = 50) -> DataFrame:
    """Clusters by cosine distance; adds ``cluster``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    with_vector = vectors.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=rounds, distanceMeasure="cosine", featuresCol="__v", predictionCol="cluster").fit(with_vector)
    return model.transform(with_vector).drop("__v")


def insight_score(magnitude: Column, support: Column, novelty: Column) -> Column:
    """How much an insight is worth showing."""
    return 0.6 * clamp(magnitude) + 0.3 * clamp(support) + 0.1 * clamp(novelty)
