"""Segments of profiles by rules of seven kinds, each with partial credit."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a profile: maps of interests, tags, brands (shares) and traits (flags), the prices seen, counters, and when it was last seen.
PROFILE = "interests map<string, double>, tags map<string, double>, brands map<string, double>, traits map<string, boolean>, price_low double, price_high double, purchases long, sessions long, signals long, cart_adds long, last_seen timestamp"


@dataclass(frozen=True)
class Rule:
    """A test of one field of a profile: its kind, the field, how it is compared (<, <=, =, >=, >) and with what."""

    kind: str
    field: str
    compare: str
    value: float | bool | tuple[float, float]
    weight: float = 1.0


@dataclass(frozen=True)
class Segment:
    """Rules and how they combine: ``all`` (least), ``any`` (largest) or ``weighted`` (mean)."""

    name: str
    threshold: float
    rules: Sequence[Rule]
    combine: str = "weighted"


#: The segments that are there from the start, with their thresholds and rules.
DEFAULT_SEGMENTS = (
    Segment("high-value", 0.4, [Rule("statistic", "purchases", ">=", 3, 0.4), Rule("price", "", "", (100, 10_000), 0.3), Rule("recency", "", "<", 30, 0.3)]),
    Segment("tech-enthusiast", 0.35, [Rule("interest", "tech", ">=", 0.4, 0.6), Rule("tag", "gadgets", ">=", 0.2, 0.2), Rule("tag", "electronics", ">=", 0.2, 0.2)]),
    Segment("fashion-forward", 0.35, [Rule("interest", "fashion", ">=", 0.4, 0.7), Rule("statistic", "sessions", ">=", 2, 0.3)]),
    Segment("bargain-hunter", 0.3, [Rule("price", "", "", (0, 75), 0.5), Rule("trait", "prefersDeals", "=", True, 0.3), Rule("statistic", "cart_adds", ">", 5, 0.2)]),
    Segment("new-visitor", 0.5, [Rule("statistic", "sessions", "<=", 2, 0.5), Rule("statistic", "purchases", "=", 0, 0.5)]),
    Segment("cart-abandoner", 0.4, [Rule("statistic", "cart_adds", ">=", 3, 0.5), Rule("statistic", "purchases", "<", 2, 0.5)]),
    Segment("home-enthusiast", 0.35, [Rule("interest", "home", ">=", 0.4, 0.7), Rule("recency", "", "<", 14, 0.3)]),
    Segment("fitness-active", 0.35, [Rule("interest", "sport", ">=", 0.4, 0.7), Rule("trait", "healthConscious", "=", True, 0.3)]),
    Segment("loyal-customer", 0.45, [Rule("statistic", "purchases", ">=", 5, 0.4), Rule("statistic", "sessions", ">=", 10, 0.3), Rule("recency", "", "<", 14, 0.3)]),
    Segment("researcher", 0.35, [Rule("statistic", "signals", ">=", 20, 0.5), Rule("trait", "browsesExtensively", "=", True, 0.3), Rule("statistic", "purchases", "<=", 3, 0.2)]),
)
#: Least scores of the levels of confidence.
LEVELS = ((0.8, "Very High"), (0.6, "High"), (0.4, "Medium"), (0.2, "Low"))


def _interest(rule: Rule, now: Column) -> Column:
    x, t = F.try_element_at("interests", F.lit(rule.field)), F.lit(float(rule.value))
    if rule.compare == ">":
        return F.when(x > t, F.least(x / t, F.lit(1.0))).otherwise(0.5 * x / t)
    if rule.compare == ">=":
        return F.when(x >= t, F.least(x / t, F.lit(1.0))).otherwise(0.5 * x / t)
    if rule.compare == "<":
        return F.when(x < t, 1 - x / t).otherwise(F.when(x.isNotNull(), 0.0))
    return F.when(x >= t, 1.0).otherwise(x / t)


def _brand(rule: Rule, now: Column) -> Column:
    x, t = F.try_element_at("brands", F.lit(rule.field)), F.lit(float(rule.value))
    return F.when(x >= t, 1.0).otherwise(x / t)


def _tag(rule: Rule, now: Column) -> Column:
    x, t = F.try_element_at("tags", F.lit(rule.field)), F.lit(float(rule.value))
    return F.when(x >= t, F.least(x, F.lit(1.0))).otherwise(x / t)


def _trait(rule: Rule, now: Column) -> Column:
    return (F.try_element_at("traits", F.lit(rule.field)) == F.lit(bool(rule.value))).cast("double")


def _price(rule: Rule, now: Column) -> Column:
    (low, high), middle = rule.value, (F.col("price_low") + F.col("price_high")) / 2
    below = 1 - (F.lit(float(low)) - middle) / F.lit(float(low)) if low else F.lit(0.0)
    return F.when(middle.between(low, high), 1.0).when(middle < low, below).otherwise(1 - (middle - high) / F.lit(float(high)))


def _statistic(rule: Rule, now: Column) -> Column:
    x, t = F.coalesce(F.col(rule.field).cast("double"), F.lit(0.0)), F.lit(float(rule.value))
    if rule.compare == "=":
        return (x == t).cast("double")
    if rule.compare in (">", ">="):
        return F.when(x > t if rule.compare == ">" else x >= t, 1.0).otherwise(x / F.greatest(t, F.lit(1.0)))
    return F.when(x < t if rule.compare == "<" else x <= t, 1.0).otherwise(F.coalesce(1 - F.try_divide(x - t, t), F.lit(0.0)))


def _recency(rule: Rule, now: Column) -> Column:
    days, t = (F.unix_micros(now) - F.unix_micros("last_seen")) / 86_400_000_000, F.lit(float(rule.value))
    if rule.compare == "<":
        return F.when(days < t, 1.0).otherwise(1 - (days - t) / t)
    if rule.compare == ">":
        return F.when(days > t, 1.0).otherwise(days / t)
    return 1 - days / F.greatest(2 * t, F.lit(1.0))


KINDS: dict[str, Callable[[Rule, Column], Column]] = {"interest": _interest, "brand": _brand, "tag": _tag, "trait": _trait, "price": _price, "statistic": _statistic, "recency": _recency}


def credit(rule: Rule, now: Column) -> Column:
    """How far a profile meets a rule, 0 to 1; what a profile doesn't know gives nothing."""
    if rule.kind not in KINDS:
        raise ValueError(f"no rule of kind {rule.kind}")
    given = KINDS[rule.kind](rule, now)
    return F.when(given.isNull(), 0.0).otherwise(F.greatest(F.least(given, F.lit(1.0)), F.lit(0.0)))


def segment_score(segment: Segment, now: Column) -> Column:
    """Score of a segment, 0 to 1; 0 without rules or without any weight."""
    credits = [credit(r, now) for r in segment.rules]
    total = sum(r.weight for r in segment.rules)
    if not credits or (segment.combine == "weighted" and total <= 0):
        return F.lit(0.0)
    if segment.combine in ("all", "any"):
        return credits[0] if len(credits) == 1 else (F.least if segment.combine == "all" else F.greatest)(*credits)
    return sum((F.lit(float(r.weight)) * c for r, c in zip(segment.rules, credits, strict=True)), F.lit(0.0)) / F.lit(float(total))


def segment_members(profiles: DataFrame, id_col: str, now: Column, segments: Sequence[Segment] = DEFAULT_SEGMENTS, members_only: bool = True) -> DataFrame:
    """Segments of each profile (columns as in ``PROFILE``): ``score`` to three places, ``is_member`` and ``confidence``; members alone or all.

    Membership goes by the score before it is rounded. Null maps and counters are empty ones.
    """
    each = F.array(*(F.struct(F.lit(s.name).alias("segment"), segment_score(s, now).alias("exact"), F.lit(s.threshold).alias("threshold")) for s in segments))
    out = profiles.select(id_col, F.explode(each).alias("s")).select(id_col, "s.segment", F.round("s.exact", 3).alias("score"), (F.col("s.exact") >= F.col("s.threshold")).alias("is_member"))
    level = F.when(F.lit(False), "")
    for least, name in LEVELS:
        level = level.when(F.col("score") >= least, name)
    return (out.filter("is_member") if members_only else out).withColumn("confidence", level.otherwise("Very Low"))
