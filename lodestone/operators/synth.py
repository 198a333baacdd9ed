"""Synthetic rows that keep the shape of a profiled table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scalars import normal_cdf, pearson
from lodestone.operators.drift import categorical_drift, numeric_drift
from lodestone.operators.stats import histogram


def generation_policy(name: Column, kind: Column, unique_percent: Column, distinct: Column) -> Column:
    """How values of a column may be made: masked, invented, numbered, left out, copied, or drawn."""
    personal = F.lower(name).rlike(r"(?:^|_)(?:email|phone|ssn|passport|address|birth|dob|ip|name)(?:$|_)")
    return F.when(personal & (unique_percent > 90), "Faker").when(personal, "Mask").when(kind == "Id", "Sequential").when((kind == "Text") & (unique_percent > 90), "Exclude").when((kind == "Categorical") & (distinct <= 50), "CopySafe").otherwise("Synthetic")


def drawn_number(df: DataFrame, column: str, draw: Column, bins: int = 20) -> Column:
    """A number from the column's histogram for a draw between 0 and 1; the histogram has ``bins`` rows."""
    rows = [r for r in histogram(df, column, bins).orderBy("bin").collect() if r["n"]]
    if not rows:
        only = df.agg(F.first(column, ignorenulls=True)).first()[0]
        return F.lit(None if only is None else float(only))
    shares = np.cumsum([r["n"] for r in rows]) / sum(r["n"] for r in rows)
    value, start = F.lit(float(rows[-1]["upper_edge"])), 0.0
    for r, end in reversed(list(zip(rows, shares.tolist(), strict=True))):
        index = shares.tolist().index(end)
        start = shares[index - 1].item() if index else 0.0
        value = F.when(draw <= end, F.lit(r["lower_edge"]) + (draw - start) / (end - start) * (r["upper_edge"] - r["lower_edge"])).otherwise(value)
    return value


#: Parts of the unit interval in which a draw looks for its value.
CELLS = 1_024


def with_category(base: DataFrame, df: DataFrame, column: str, draw: str, least: int = 5) -> DataFrame:
    """``base`` with a value of the column for each ``draw`` between 0 and 1: of all values that at least ``least`` rows have, in proportion.

    Values stand in intervals of the draw, in an order by shares of the values' hashes; draws and
    values meet in the cells of those intervals, so there may be any number of values.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    shared = counts.withColumn("share", F.pmod(F.xxhash64("value"), F.lit(64)))
    sizes = shared.groupBy("share").agg(F.sum("n").alias("size"))
    before = F.broadcast(sizes.select("share", F.coalesce(F.sum("size").over(Window.orderBy("share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("size").over(Window.orderBy("share").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total")))  # 64 rows
    end = F.col("before") + F.sum("n").over(Window.partitionBy("share").orderBy("value"))
    placed = shared.join(before, "share").withColumn("end", end).select("value", ((F.col("end") - F.col("n")) / F.col("total")).alias("low"), (F.col("end") / F.col("total")).alias("high"))
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1))
    cells = placed.withColumn("__cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    drawn = base.withColumn("__cell", cell(F.col(draw)))
    met = drawn.join(cells, (drawn["__cell"] == cells["__cell"]) & (drawn[draw] >= cells["low"]) & (drawn[draw] < cells["high"]), "left").drop("__cell", "low", "high")
    return met.withColumnRenamed("value", f"__made_{column}")


def synthesize(df: DataFrame, rows: int, numbers: Sequence[str], categories: Sequence[str], key: str | None = None, seed: int = 42) -> DataFrame:
    """Rows drawn column by column from histograms and safe categories, numbers joined by their correlations.

    Correlated normal draws come from a Cholesky factor of a matrix as wide as
    ``numbers``; everything else is an expression over a range of rows.
    """
    n = len(numbers)
    wide = df.agg(*(F.coalesce(pearson(a, b), F.lit(0.0)).alias(f"r{i}_{j}") for i, a in enumerate(numbers) for j, b in enumerate(numbers) if i < j)).first() if n > 1 else None
    corr = np.eye(n)
    for i in range(n):
        for j in range(i + 1, n):
            corr[i, j] = corr[j, i] = wide[f"r{i}_{j}"]
    values, vectors = np.linalg.eigh(corr)
    factor = np.linalg.cholesky((vectors * np.clip(values, 1e-6, None)) @ vectors.T + 1e-9 * np.eye(n)) if n else corr
    base = df.sparkSession.range(rows).select("id", *(F.randn(seed + i).alias(f"__z{i}") for i in range(n)), *(F.rand(seed + 100 + i).alias(f"__u{i}") for i in range(len(categories))))
    out = [F.col("id").alias(key)] if key else []
    for i, c in enumerate(numbers):
        z = sum((F.lit(float(factor[i, j])) * F.col(f"__z{j}") for j in range(i + 1)), F.lit(0.0))
        out.append(drawn_number(df, c, normal_cdf(z)).alias(c))
    for i, c in enumerate(categories):
        base = with_category(base, df, c, f"__u{i}")
    return base.select(*out, *(F.col(f"__made_{c}").alias(c) for c in categories))


def fidelity(real: DataFrame, made: DataFrame, numbers: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """One row: how near made rows come to real ones, 0 to 100, and its parts."""
    num = numeric_drift(real, made, numbers).agg(F.avg(1 - F.col("ks")).alias("numbers"))
    cat = categorical_drift(real, made, categories).agg(F.avg(1 - F.col("js_divergence")).alias("categories"))
    return num.crossJoin(cat).withColumn("fidelity", 100 * (F.col("numbers") + F.col("categories")) / 2)
