"""Search and averages over vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vectors import cosine, dot, normalized
from lodestone.sources.scratch import stored


def top_k(vectors: DataFrame, query: Sequence[float], k: int, id_col: str, vector: str) -> DataFrame:
    """The ``k`` vectors of largest cosine with a query, ties to the smaller id."""
    target = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(id_col, cosine(F.col(vector), target).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)


def top_k_of_row(vectors: DataFrame, row: Column, k: int, id_col: str, vector: str) -> DataFrame:
    """The same for the vector of the one row that ``row`` names, which isn't among them."""
    target = F.broadcast(vectors.filter(row).select(F.col(vector).alias("target"), F.col(id_col).alias("own")).limit(1))  # one row
    near = vectors.crossJoin(target).filter(F.col(id_col) != F.col("own"))
    return near.select(id_col, cosine(F.col(vector), F.col("target")).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)


def centroids(vectors: DataFrame, label: str, vector: str, unit: bool = True) -> DataFrame:
    """Mean vector of each label, at length 1 if ``unit``; sums are formed map-side by position."""
    means = vectors.select(label, F.posexplode(vector).alias("at", "x")).groupBy(label, "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("centroid"))
    return whole.withColumn("centroid", normalized(F.col("centroid"))) if unit else whole


def upsert(kept: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``kept`` with those of the same key replaced by ``changes``."""
    return kept.join(changes.select(key), key, "left_anti").unionByName(changes)


def without_stale(kept: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Rows whose key is still alive."""
    return kept.join(live.select(key).distinct(), key, "left_semi")


def anchors(vectors: DataFrame, k: int, id_col: str, vector: str, kept_every: int = 8) -> DataFrame:
    """``k`` vectors that lie far from each other: the first by id, then each time the one farthest from its nearest anchor.

    Distance is 1 less the cosine, ties go to the smaller id. A round is one pass that
    carries each vector's distance to the anchors so far; every few rounds it is written
    down, so a plan never holds more than ``kept_every`` of them. Null vectors take no
    part; with ``k`` vectors or fewer, all are anchors. Returns ``place`` from 1, the id
    and ``distance``, null for the first.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col), normalized(F.col(vector)).alias("v")).filter(F.col("v").isNotNull() & F.col(id_col).isNotNull())
    state, chosen = own.withColumn("near", F.lit(float("inf"))), []
    best = state.orderBy(id_col).first()
    while best is not None:
        chosen.append((len(chosen) + 1, best[id_col], None if not chosen else best["near"]))  # k rows at most, on the driver
        if len(chosen) == k:
            break
        at = F.array(*(F.lit(x) for x in best["v"]))
        state = state.filter(F.col(id_col) != F.lit(best[id_col])).withColumn("near", F.least("near", 1 - dot(F.col("v"), at)))
        if len(chosen) % kept_every == 0:
            state = stored(state, "anchor-distances")
        best = state.orderBy(F.desc("near"), id_col).first()
    return spark.createDataFrame(chosen, f"place int, {id_col} {vectors.schema[id_col].dataType.simpleString()}, distance double")
