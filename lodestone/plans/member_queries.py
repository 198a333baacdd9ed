"""Queries of segments by rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import membership
from lodestone.plans.registry import Tables, query

#: Kinds of parts as the interests, and words of their names as the tags, that the segments ask for.
INTERESTS = {"ECONOMY": "home", "SMALL": "tech", "MEDIUM": "fashion", "LARGE": "sport"}
TAGS = {"gizmo": "gadgets", "widget": "electronics"}
NOW = "2001-08-02"


def _profiles(t: Tables) -> DataFrame:
    """Profiles of customers from what they ordered."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    named = lambda names, c: F.coalesce(*(F.when(c == k, v) for k, v in names.items()), F.lit("other"))
    own = lines.select("o_custkey", "l_discount", "p_partkey", F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("price"), named(INTERESTS, F.col("p_type")).alias("interest"), named(TAGS, F.substring_index("p_name", " ", -1)).alias("tag"))
    counts = own.groupBy("o_custkey").agg(F.count("*").alias("lines"), F.sum(F.round(100 * F.col("l_discount")).cast("long")).alias("discount"), F.countDistinct("p_partkey").alias("parts"), F.min("price").alias("price_low"), F.max("price").alias("price_high"))
    kinds = own.select("o_custkey", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("interest").alias("v")), F.struct(F.lit(1).alias("k"), F.col("tag").alias("v")))).alias("x")).groupBy("o_custkey", "x.k", "x.v").agg(F.count("*").alias("n"))
    shares = kinds.join(counts.select("o_custkey", "lines"), "o_custkey").groupBy("o_custkey").agg(*(F.map_from_entries(F.collect_list(F.when(F.col("k") == k, F.struct("v", (F.col("n") / F.col("lines")).alias("share"))))).alias(name) for k, name in ((0, "interests"), (1, "tags"))))
    bought = t.orders.groupBy("o_custkey").agg(F.count("*").alias("purchases"), F.countDistinct(F.to_date("o_orderdate")).alias("sessions"), F.max("o_orderdate").cast("timestamp").alias("last_seen"))
    every = t.customer.select(F.col("c_custkey").alias("o_custkey")).join(bought, "o_custkey", "left").join(counts, "o_custkey", "left").join(shares, "o_custkey", "left")
    traits = F.create_map(F.lit("prefersDeals"), F.col("discount") > 5 * F.col("lines"), F.lit("browsesExtensively"), F.col("parts") > 40)
    return every.select("o_custkey", "interests", "tags", F.create_map().cast("map<string, double>").alias("brands"), traits.alias("traits"), "price_low", "price_high", "purchases", "sessions", F.col("lines").alias("signals"), F.col("lines").alias("cart_adds"), "last_seen")


def _sql_rule(r: membership.Rule) -> str:
    """SQL of a rule's credit."""
    v = r.value
    if r.kind in ("interest", "tag"):
        met = f"least({r.field} / {v}, 1)" if r.kind == "interest" else f"least({r.field}, 1)"
        own = f"CASE WHEN {r.field} >= {v} THEN {met} ELSE {'0.5 * ' if r.kind == 'interest' else ''}{r.field} / {v} END"
    elif r.kind == "trait":
        own = f"CASE WHEN {r.field} THEN 1 ELSE 0 END"
    elif r.kind == "price":
        own = f"CASE WHEN price BETWEEN {v[0]} AND {v[1]} THEN 1 WHEN price < {v[0]} THEN 1 - ({v[0]} - price) / nullif({v[0]}, 0) ELSE 1 - (price - {v[1]}) / {v[1]} END"
    elif r.kind == "recency":
        own = f"CASE WHEN days < {v} THEN 1 ELSE 1 - (days - {v}) / {v} END"
    else:
        rest = f"{r.field} / greatest({v}, 1)" if r.compare in (">", ">=") else "0" if r.compare == "=" else f"1 - ({r.field} - {v}) / {v}"
        own = f"CASE WHEN {r.field} {r.compare} {v} THEN 1 ELSE {rest} END"
    return f"coalesce(least(greatest({own}, 0), 1), 0)"


SCORES = " UNION ALL ".join(f"SELECT o_custkey, '{s.name}' AS segment, {s.threshold} AS threshold, (" + " + ".join(f"{r.weight}::DOUBLE * {_sql_rule(r)}" for r in s.rules) + f") / {sum(r.weight for r in s.rules)}::DOUBLE AS score FROM p" for s in membership.DEFAULT_SEGMENTS)


@query(f"""WITH l AS (SELECT o_custkey, l_discount, p_partkey, round(l_extendedprice / l_quantity, 2) AS price, p_type, regexp_extract(p_name, '[^ ]+$') AS word FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
c AS (SELECT o_custkey, count(*) AS signals, sum(round(100 * l_discount)::BIGINT) > 5 * count(*) AS prefersDeals, count(DISTINCT p_partkey) > 40 AS browsesExtensively, (min(price) + max(price)) / 2 AS price,
{', '.join(f"nullif(count(*) FILTER (WHERE p_type = '{k}'), 0) / count(*) AS {v}" for k, v in INTERESTS.items())}, {', '.join(f"nullif(count(*) FILTER (WHERE word = '{k}'), 0) / count(*) AS {v}" for k, v in TAGS.items())} FROM l GROUP BY 1),
b AS (SELECT o_custkey, count(*) AS purchases, count(DISTINCT o_orderdate::DATE) AS sessions, epoch(TIMESTAMP '{NOW}' - max(o_orderdate)) / 86400 AS days FROM orders GROUP BY 1),
p AS (SELECT c_custkey AS o_custkey, coalesce(purchases, 0) AS purchases, coalesce(sessions, 0) AS sessions, coalesce(signals, 0) AS signals, coalesce(signals, 0) AS cart_adds, days, prefersDeals, browsesExtensively, NULL::BOOLEAN AS healthConscious, price, {', '.join([*INTERESTS.values(), *TAGS.values()])} FROM customer LEFT JOIN b ON c_custkey = b.o_custkey LEFT JOIN c ON c_custkey = c.o_custkey),
s AS ({SCORES}) SELECT o_custkey, segment, round(score, 3) AS score, true AS is_member, CASE WHEN round(score, 3) >= 0.8 THEN 'Very High' WHEN round(score, 3) >= 0.6 THEN 'High' WHEN round(score, 3) >= 0.4 THEN 'Medium' WHEN round(score, 3) >= 0.2 THEN 'Low' ELSE 'Very Low' END AS confidence FROM s WHERE score >= threshold""")
def default_segments(t: Tables) -> DataFrame:
    """Which of the ten segments every customer belongs to."""
    return membership.segment_members(_profiles(t), "o_custkey", F.lit(NOW).cast("timestamp"))
