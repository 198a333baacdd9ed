"""Rules of every kind against expected credits."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.operators import membership
from lodestone.operators.membership import Rule, Segment

NOW = datetime.datetime(2024, 2, 1)
PROFILE = ({"tech": 0.3, "home": 0.9}, {"gadgets": 0.25, "rare": 0.1}, {"acme": 0.2}, {"deals": True, "calm": False}, 40.0, 60.0, 2, 8, None, 0, datetime.datetime(2024, 1, 22))
NOTHING = (None,) * 11
CASES = [
    (Rule("interest", "home", ">=", 0.4), 1), (Rule("interest", "tech", ">=", 0.4), 0.375), (Rule("interest", "tech", ">", 0.3), 0.5), (Rule("interest", "home", ">", 0.3), 1), (Rule("interest", "tech", "<", 0.4), 0.25), (Rule("interest", "home", "<", 0.4), 0), (Rule("interest", "tech", "=", 0.6), 0.5), (Rule("interest", "none", "<", 0.4), 0),
    (Rule("brand", "acme", ">=", 0.4), 0.5), (Rule("brand", "acme", ">=", 0.1), 1), (Rule("brand", "other", ">=", 0.1), 0),
    (Rule("tag", "gadgets", ">=", 0.2), 0.25), (Rule("tag", "rare", ">=", 0.2), 0.5), (Rule("tag", "none", ">=", 0.2), 0),
    (Rule("trait", "deals", "=", True), 1), (Rule("trait", "calm", "=", True), 0), (Rule("trait", "calm", "=", False), 1), (Rule("trait", "none", "=", False), 0),
    (Rule("price", "", "", (0, 75)), 1), (Rule("price", "", "", (100, 200)), 0.5), (Rule("price", "", "", (0, 40)), 0.75), (Rule("price", "", "", (5, 10)), 0),
    (Rule("statistic", "purchases", ">=", 4), 0.5), (Rule("statistic", "purchases", ">", 2), 1), (Rule("statistic", "purchases", "<", 2), 1), (Rule("statistic", "sessions", "<=", 6), 1 - 2 / 6), (Rule("statistic", "cart_adds", "=", 0), 1), (Rule("statistic", "signals", ">=", 5), 0), (Rule("statistic", "purchases", "<", 0), 0),
    (Rule("recency", "", "<", 14), 1), (Rule("recency", "", "<", 8), 0.75), (Rule("recency", "", ">", 20), 0.5), (Rule("recency", "", "", 10), 0.5), (Rule("recency", "", "<", 3), 0),
]


def test_credit_of_every_kind_of_rule(spark):
    profiles = spark.createDataFrame([PROFILE, NOTHING], membership.PROFILE)
    now = F.lit(NOW)
    got, nothing = profiles.select(*(membership.credit(r, now).alias(f"c{i}") for i, (r, _) in enumerate(CASES))).collect()
    # sold 2 of over 2 gives 2 / 2, the rest as listed
    assert [round(x, 9) for x in got] == [round(float(want), 9) for _, want in CASES]
    assert all(x in (0.0, 1.0) for x in nothing) and all(x == 0 for (r, _), x in zip(CASES, nothing, strict=True) if r.kind != "statistic")
    with pytest.raises(ValueError, match="no rule"):
        membership.credit(Rule("expression", "", "", 1), now)


def test_combinations_thresholds_and_levels(spark):
    own = spark.createDataFrame([(7, *PROFILE)], f"id long, {membership.PROFILE}")
    rules = [Rule("interest", "home", ">=", 0.4, 3.0), Rule("brand", "acme", ">=", 0.4, 1.0)]
    segments = [Segment("w", 0.875, rules), Segment("all", 0.6, rules, "all"), Segment("any", 0.6, rules, "any"), Segment("none", 0.1, []), Segment("no weight", 0.0, [Rule("trait", "deals", "=", True, 0.0)])]
    got = {r["segment"]: (r["score"], r["is_member"], r["confidence"]) for r in membership.segment_members(own, "id", F.lit(NOW), segments, members_only=False).collect()}
    assert got == {"w": (0.875, True, "Very High"), "all": (0.5, False, "Medium"), "any": (1.0, True, "Very High"), "none": (0.0, False, "Very Low"), "no weight": (0.0, True, "Very Low")}
    assert {r["segment"] for r in membership.segment_members(own, "id", F.lit(NOW), segments).collect()} == {"w", "any", "no weight"}
