"""Customers: fuzzy segments, interests, recommendations; queues and sites."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scalars import clamp


@dataclass(frozen=True)
class Rule:
    """One test of a profile with partial credit: ``low`` gives nothing, ``high`` full credit."""

    column: str
    low: float
    high: float
    weight: float = 1.0

    def credit(self) -> Column:
        value = F.coalesce(F.col(self.column).cast("double"), F.lit(self.low))
        return clamp((value - self.low) / (self.high - self.low))


@dataclass(frozen=True)
class Segment:
    """Rules and how they combine: ``all`` (least), ``any`` (largest) or ``weighted`` (mean)."""

    name: str
    rules: Sequence[Rule]
    combine: str = "weighted"
    threshold: float = 0.5

    def score(self) -> Column:
        credits = [r.credit() for r in self.rules]
        if len(credits) == 1:
            return credits[0]
        if self.combine == "all":
            return F.least(*credits)
        if self.combine == "any":
            return F.greatest(*credits)
        return sum((r.weight * c for r, c in zip(self.rules, credits, strict=True)), F.lit(0.0)) / sum(r.weight for r in self.rules)


#: Segments of customers by what their orders show.
DEFAULT_SEGMENTS = (
    Segment("high value", [Rule("spent", 500_000, 2_000_000)]),
    Segment("frequent", [Rule("orders", 5, 20)]),
    Segment("big baskets", [Rule("avg_order", 100_000, 200_000)]),
    Segment("loyal", [Rule("orders", 5, 20, 2.0), Rule("spent", 500_000, 2_000_000, 1.0)]),
    Segment("loyal and rich", [Rule("orders", 5, 20), Rule("balance", 0, 8_000)], "all"),
    Segment("worth a look", [Rule("avg_order", 100_000, 300_000), Rule("balance", 5_000, 10_000)], "any"),
)


def memberships(profiles: DataFrame, id_col: str, segments: Sequence[Segment] = DEFAULT_SEGMENTS) -> DataFrame:
    """Segments that each profile belongs to, with score and how sure that is."""
    each = F.array(*(F.struct(F.lit(s.name).alias("segment"), F.round(s.score(), 3).alias("score"), F.lit(s.threshold).alias("threshold")) for s in segments))
    sure = F.when(F.col("score") >= 0.8, "high").when(F.col("score") >= 0.6, "medium").otherwise("low")
    return profiles.select(id_col, F.explode(each).alias("s")).select(id_col, "s.*").filter("score >= threshold").select(id_col, "segment", "score", sure.alias("confidence"))


def decayed(weight: Column, days: Column, rate: float = 0.02) -> Column:
    """An interest after so many days at a daily loss."""
    return weight * F.pow(F.lit(1 - rate), days)


def recommend(interests: DataFrame, items: DataFrame, seen: DataFrame, user: str, item: str, category: str, k: int = 5) -> DataFrame:
    """The ``k`` best unseen items of each user by interest in their categories, ties to the smaller item.

    ``interests`` has user, category and weight; ``items`` item, category and
    popularity from 0 to 1. Within a category only popularity tells items apart: a
    user meets its ``k`` most popular items and as many more as they have seen there.
    """
    best = items.withColumn("__place", F.row_number().over(Window.partitionBy(category).orderBy(F.desc("popularity"), item)))
    had = seen.select(user, item).distinct()
    counts = had.join(items.select(item, category), item).groupBy(user, category).agg(F.count("*").alias("__seen"))
    asked = interests.join(counts, [user, category], "left").withColumn("__most", k + F.coalesce("__seen", F.lit(0)))
    bound = asked.groupBy(category).agg(F.max("__most").alias("__bound"))
    met = asked.join(best.join(bound, category).filter(F.col("__place") <= F.col("__bound")), category).filter(F.col("__place") <= F.col("__most")).join(had, [user, item], "left_anti")
    scored = met.withColumn("score", 0.8 * F.col("weight") + 0.2 * F.col("popularity"))
    order = Window.partitionBy(user).orderBy(F.desc("score"), item)
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select(user, item, "score", "place")


def funnel(events: DataFrame, by: Sequence[str], kind: str, user: str, steps: Sequence[str]) -> DataFrame:
    """Events of each step, and the distinct users, of each group."""
    return events.groupBy(*by).agg(*(F.count_if(F.col(kind) == s).alias(f"n_{s}") for s in steps), F.countDistinct(user).alias("users"))


def queue_stats(jobs: DataFrame, status: str, queue: str) -> DataFrame:
    """Counts by status and by queue, in one pass."""
    return jobs.groupingSets([[status], [queue]], status, queue).agg(F.grouping(queue).cast("int").alias("by_status"), F.count("*").alias("n")).select("by_status", F.coalesce(status, queue).alias("name"), "n")


def next_jobs(jobs: DataFrame, queue: str, priority: str, due: str, id_col: str) -> DataFrame:
    """The job that each queue would take next."""
    first = F.min(F.struct(priority, due, id_col))
    return jobs.groupBy(queue).agg(first.alias("j")).select(queue, "j.*")


def referrers(hits: DataFrame, url: str, count: Column, exclude: Sequence[str] = ()) -> DataFrame:
    """Hits of each referring host, and the address with most of them."""
    host = F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))
    own = hits.select(host.alias("host"), F.col(url).alias("url"), count.alias("n")).filter(F.col("host").isNotNull() & ~F.col("host").isin(*exclude) if exclude else F.col("host").isNotNull())
    by_url = own.groupBy("host", "url").agg(F.sum("n").alias("n"))
    best = F.max_by("url", F.struct("n", "url"))
    return by_url.groupBy("host").agg(F.sum("n").alias("hits"), best.alias("top_url"))


def elevated(a: Column, b: Column) -> Column:
    """Two maps of weights as one: the larger weight of each key."""
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(x, y))


def stock(variations: DataFrame, reservations: DataFrame, product: str) -> DataFrame:
    """What is left of each product: the sum of its variations less the active reservations."""
    held = reservations.filter("active").groupBy(product).agg(F.sum("quantity").alias("held"))
    return variations.groupBy(product).agg(F.sum("quantity").alias("total")).join(held, product, "left").select(product, F.greatest(F.col("total") - F.coalesce("held", F.lit(0)), F.lit(0)).alias("available"))
