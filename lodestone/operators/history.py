"""Profiles over time: hashes of schemas, likeness of tables, shifts of dates, and statistics of a query's result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.ordering import middle
from lodestone.operators.stats import long_form


def date_shift(base: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """One row: days by which the first and the last date of a column moved."""
    ends = lambda df, n: df.agg(F.to_date(F.min(column)).alias(f"lo_{n}"), F.to_date(F.max(column)).alias(f"hi_{n}"))
    both = ends(base, "a").crossJoin(F.broadcast(ends(current, "b")))  # one row each
    return both.select(F.datediff("lo_b", "lo_a").alias("start_shift"), F.datediff("hi_b", "hi_a").alias("end_shift"))


def moment_changes(base: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Changes of nulls (points), mean and deviation (percent) and skewness of each column, in one pass over each table."""

    def moments(df: DataFrame, n: str) -> DataFrame:
        wide = df.agg(*(f.alias(f"{c}__{k}") for c in columns for k, f in (("nulls", 100.0 * F.count_if(F.col(c).isNull()) / F.count(F.lit(1))), ("mean", F.avg(c)), ("std", F.stddev_samp(c)), ("skew", F.skewness(c)))))
        rows = F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"{c}__{k}").alias(f"{k}_{n}") for k in ("nulls", "mean", "std", "skew"))) for c in columns))
        return wide.select(F.explode(rows).alias("r")).select("r.*")

    percent = lambda k: (100 * F.abs(F.try_divide(F.col(f"{k}_b") - F.col(f"{k}_a"), F.abs(f"{k}_a")))).alias(f"{k}_percent")
    both = moments(base, "a").join(F.broadcast(moments(current, "b")), "column_name")  # a row a column
    return both.select("column_name", (F.col("nulls_b") - F.col("nulls_a")).alias("null_points"), percent("mean"), percent("std"), (F.col("skew_b") - F.col("skew_a")).alias("skew_delta"))


def significant_changes(changes: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Whether each column's changes count: nulls or mean beyond the threshold, deviation beyond twice, skewness by half."""
    t = F.lit(100 * threshold)
    return changes.withColumn("significant", (F.abs("null_points") > t) | (F.coalesce("mean_percent", F.lit(0.0)) > t) | (F.coalesce("std_percent", F.lit(0.0)) > 2 * t) | (F.abs(F.coalesce("skew_delta", F.lit(0.0))) > 0.5))


def padded_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two vectors over the root of the longer length; the shorter one goes on with zeros."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)), F.lit(2)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)) / F.sqrt(F.greatest(F.size(a), F.size(b), F.lit(1)).cast("double"))


def nearest_profile(centroids: DataFrame, key: str, vector: str, wanted: DataFrame, within: float | None = None) -> DataFrame:
    """Distance of every stored centroid to one wanted, a row of ``wanted``; nearest first, those ``within`` alone if given."""
    one = F.broadcast(wanted.select(F.col(vector).alias("__wanted")).limit(1))
    out = centroids.crossJoin(one).select(key, padded_distance(F.col(vector), F.col("__wanted")).alias("distance"))
    return (out.filter(F.col("distance") <= within) if within is not None else out).orderBy("distance", key)


def signature(df: DataFrame) -> DataFrame:
    """One row: names, types, number of columns and the order of magnitude of the rows."""
    kinds = [(f.name.lower(), "number" if f.dataType.simpleString() in ("int", "bigint", "double", "float") else "time" if "time" in f.dataType.simpleString() or f.dataType.simpleString() == "date" else "text") for f in df.schema.fields]
    names, types = F.array(*(F.lit(n) for n, _ in kinds)), F.array(*(F.lit(k) for _, k in kinds))
    return df.agg(F.count("*").alias("rows")).select("rows", names.alias("names"), types.alias("types"), F.floor(F.log10(F.greatest("rows", F.lit(1)))).alias("bucket"))


def signature_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Likeness of two signatures (a row each), and whether it is the same table, a like one or another.

    Columns count 0.15, types 0.2, the rows' magnitude 0.1 and names 0.35; the whole is taken to 1.
    """
    named = lambda df, n: df.select(*(F.col(c).alias(f"{c}_{n}") for c in ("names", "types", "bucket")))
    both = named(a, "a").crossJoin(F.broadcast(named(b, "b")))
    size = lambda n: F.size(f"names_{n}")
    columns = F.least(size("a"), size("b")) / F.greatest(size("a"), size("b"))
    count = lambda n, k: F.size(F.filter(f"types_{n}", lambda x: x == k))
    types = sum((F.least(count("a", k), count("b", k)) for k in ("number", "time", "text")), F.lit(0)) / F.greatest(size("a"), size("b"))
    names = F.size(F.array_intersect("names_a", "names_b")) / F.size(F.array_union("names_a", "names_b"))
    score = (0.15 * columns + 0.2 * types + 0.1 * F.when(F.col("bucket_a") == F.col("bucket_b"), 1.0).otherwise(0.0) + 0.35 * names) / 0.8
    return both.select(score.alias("similarity")).withColumn("match", F.when(F.col("similarity") >= 0.95, "same").when(F.col("similarity") >= 0.8, "similar").otherwise("other"))


def schema_hashes(tables: DataFrame) -> DataFrame:
    """A hash of each table's columns, whatever their order, from rows of ``table_name``, ``column_name`` and ``column_type``."""
    own = F.concat_ws(":", F.lower("column_name"), "column_type")
    return tables.groupBy("table_name").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(own)), ","), 256).alias("schema_hash"))


def content_hash(df: DataFrame) -> DataFrame:
    """One row: a hash of a table's content, whatever its order; equal rows count each."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("content_hash"))


def kept_profiles(store: DataFrame, keep: int = 3) -> DataFrame:
    """Profiles (``schema_hash``, ``taken_at``, ``pinned``) that pruning leaves: the last ``keep`` of each schema and all pinned ones."""
    order = Window.partitionBy("schema_hash", "pinned").orderBy(F.desc("taken_at"))
    return store.withColumn("__rank", F.dense_rank().over(order)).filter(F.col("pinned") | (F.col("__rank") <= keep)).drop("__rank")


def result_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Statistics of a result's numeric columns, of text that is mostly numbers too: range, mean, quartiles and outliers."""
    values = long_form(df, columns).select("column_name", F.expr("try_cast(value as double)").alias("value"), F.lit(1).alias("one"))
    numeric = values.groupBy("column_name").agg(F.count("value").alias("n"), F.sum("one").alias("given"), F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.avg("value"), 4).alias("mean"), F.stddev_samp("value").alias("std")).filter("n >= 2 and n > given / 2")
    points = middle(values, "value", (0.25, 0.5, 0.75), ["column_name"])
    quartiles = points.groupBy("column_name").agg(*(F.max(F.when(F.col("share") == s, F.col("value"))).alias(n) for s, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))))
    joined = numeric.drop("given").join(F.broadcast(quartiles), "column_name")  # a row a column
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    outside = values.join(F.broadcast(joined.select("column_name", "q25", "q75")), "column_name").filter((F.col("value") < F.col("q25") - reach) | (F.col("value") > F.col("q75") + reach)).groupBy("column_name").agg(F.count("*").alias("outliers"))
    return joined.join(F.broadcast(outside), "column_name", "left").withColumn("outliers", F.coalesce("outliers", F.lit(0)))


def result_flags(stats: DataFrame) -> DataFrame:
    """What stands out in ``result_stats``: many outliers, a skewed centre, or hardly any spread."""
    flags = {"many outliers": F.col("outliers") > 0.1 * F.col("n"), "skewed": F.coalesce(F.try_divide(F.abs(F.col("mean") - F.col("median")), F.col("std")), F.lit(0.0)) > 0.5, "narrow": F.col("max") - F.col("min") < 0.01 * F.abs("mean")}
    each = F.array(*(F.struct(F.lit(name).alias("flag"), F.coalesce(there, F.lit(False)).alias("there")) for name, there in flags.items()))
    return stats.select("column_name", F.explode(each).alias("f")).filter("f.there").select("column_name", "f.flag")


def suggested_queries(df: DataFrame, table: str) -> list[str]:
    """Statements that a reader of a table may want to run next, from its columns alone."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    numbers = [c for c, k in kinds.items() if k in ("int", "bigint", "double", "float") and not c.lower().endswith(("id", "key"))]
    texts, times = [c for c, k in kinds.items() if k == "string"], [c for c, k in kinds.items() if k.startswith(("timestamp", "date"))]
    out = [f"SELECT count(*) AS n FROM {table}", f"SELECT * FROM {table} LIMIT 10"]
    out += [f"SELECT {texts[0]}, count(*) AS n FROM {table} GROUP BY {texts[0]} ORDER BY n DESC LIMIT 10"] if texts else []
    out += [f"SELECT min({numbers[0]}) AS lo, avg({numbers[0]}) AS mean, max({numbers[0]}) AS hi FROM {table}", f"SELECT * FROM {table} ORDER BY {numbers[0]} DESC LIMIT 10"] if numbers else []
    out += [f"SELECT {texts[0]}, avg({numbers[0]}) AS mean FROM {table} GROUP BY {texts[0]} ORDER BY mean DESC LIMIT 10"] if texts and numbers else []
    out += [f"SELECT date_trunc('month', {times[0]}) AS month, count(*) AS n FROM {table} GROUP BY 1 ORDER BY 1"] if times else []
    return out
