"""Queries of segments and of versions of a table."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import segment_profiles as sp
from lodestone.operators import versions
from lodestone.plans.ml_queries import _years
from lodestone.plans.registry import Tables, query, rounded
from lodestone.sources.profile_store import ProfileStore
from lodestone.sources.scratch import scratch_path

SEGMENTS = """o AS (SELECT c_mktsegment AS segment, c_acctbal AS x, CAST(c_nationkey AS VARCHAR) AS v FROM customer WHERE c_mktsegment IS NOT NULL), w AS (SELECT segment, count(*) AS rows FROM o GROUP BY 1),
m AS (SELECT segment, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS lo, max(x) AS hi, count(x) AS given, count(DISTINCT x) AS d FROM o GROUP BY 1), k AS (SELECT segment, avg(power((x - mean) / std, 3)) AS skewness FROM o JOIN m USING (segment) GROUP BY 1),
c AS (SELECT segment, v, count(*) AS n, row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, v) AS rank FROM o WHERE v IS NOT NULL GROUP BY 1, 2), t AS (SELECT segment, count(*) AS d, sum(n)::BIGINT AS given FROM c GROUP BY 1),
top AS (SELECT segment, v, rank, n / given AS p FROM c JOIN t USING (segment) WHERE rank <= 10), e AS (SELECT segment, sum(-p * log2(p)) AS entropy, max(v) FILTER (WHERE rank = 1) AS mode, max(p) FILTER (WHERE rank = 1) AS mode_share FROM top GROUP BY 1),
profiles AS (SELECT segment, 'c_acctbal' AS column_name, 'number' AS kind, rows, 1 - given / rows AS null_rate, d / rows AS unique_rate, d AS cardinality, mean, std, lo AS min, hi AS max, (mean - lo) / (hi - lo) AS centre, skewness, NULL AS mode, NULL::DOUBLE AS mode_share, NULL::DOUBLE AS entropy FROM w JOIN m USING (segment) JOIN k USING (segment)
UNION ALL SELECT segment, 'c_nationkey', 'category', rows, 1 - given / rows, d / rows, d, NULL, NULL, NULL, NULL, NULL, NULL, mode, mode_share, entropy FROM w JOIN t USING (segment) JOIN e USING (segment))"""
SHOWN = ("null_rate", "unique_rate", "mean", "std", "min", "max", "centre", "skewness", "mode_share", "entropy")


def _segments(t: Tables) -> DataFrame:
    return sp.segment_profiles(t.customer, "c_mktsegment", ["c_acctbal"], ["c_nationkey"])


@query(f"WITH {SEGMENTS} SELECT segment, column_name, kind, rows, cardinality, mode, {', '.join(f'round({c}, 6) AS {c}' for c in SHOWN)} FROM profiles")
def segment_profiles(t: Tables) -> DataFrame:
    """What describes the balance and the nation of customers in every market segment."""
    return rounded(_segments(t).drop("distribution"), 6)


GAPS = f"""{SEGMENTS}, pairs AS (SELECT a.segment AS sa, b.segment AS sb FROM w a JOIN w b ON a.segment < b.segment), held AS (SELECT DISTINCT sa, sb, v FROM pairs JOIN top ON segment IN (sa, sb)),
shares AS (SELECT held.sa, held.sb, coalesce(a.p, 0.0001) AS p, coalesce(b.p, 0.0001) AS q FROM held LEFT JOIN top a ON a.segment = sa AND a.v = held.v LEFT JOIN top b ON b.segment = sb AND b.v = held.v),
unit AS (SELECT sa, sb, p / sum(p) OVER (PARTITION BY sa, sb) AS p, q / sum(q) OVER (PARTITION BY sa, sb) AS q FROM shares), js AS (SELECT sa, sb, least(sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2 / ln(2), 1) AS js FROM unit GROUP BY ALL),
gaps AS (SELECT sa AS segment_a, sb AS segment_b, a.column_name, a.kind, a.rows AS rows_a, b.rows AS rows_b, a.mean AS mean_a, b.mean AS mean_b, a.mode AS mode_a, b.mode AS mode_b,
CASE a.kind WHEN 'number' THEN (abs(a.null_rate - b.null_rate) + abs(a.centre - b.centre) + least(abs(abs(a.std / a.mean) - abs(b.std / b.mean)) / greatest(abs(a.std / a.mean) + abs(b.std / b.mean), 0.001), 1) + least(abs(a.skewness - b.skewness) / 4, 1) + abs(a.unique_rate - b.unique_rate) * 0.5) / 5
ELSE (abs(a.null_rate - b.null_rate) + abs(a.mode_share - b.mode_share) + js + 1 - least(a.cardinality, b.cardinality) / greatest(a.cardinality, b.cardinality) + abs(a.unique_rate - b.unique_rate) * 0.5) / 5 END AS distance
FROM js JOIN profiles a ON a.segment = sa JOIN profiles b ON b.segment = sb AND a.column_name = b.column_name), far AS (SELECT segment_a, segment_b, any_value(rows_a) AS rows_a, any_value(rows_b) AS rows_b, least(avg(distance), 1) AS distance FROM gaps GROUP BY 1, 2)"""


@query(f"WITH {GAPS} SELECT segment_a, segment_b, rows_a, rows_b, round(distance, 6) AS distance, round(1 - distance, 6) AS similarity FROM far")
def segment_distances(t: Tables) -> DataFrame:
    """How far the market segments of customers lie from each other."""
    return rounded(sp.segment_distances(_segments(t)), 6)


@query(f"""WITH {GAPS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY segment_a, segment_b ORDER BY distance DESC, column_name) AS rank FROM gaps)
SELECT segment_a, segment_b, 'overall' AS kind, NULL AS column_name, round(1 - distance, 6) AS amount, CASE WHEN distance <= 0.1 THEN 'alike' WHEN distance <= 0.3 THEN 'moderate' WHEN distance <= 0.5 THEN 'significant' ELSE 'substantial' END AS detail FROM far
UNION ALL SELECT segment_a, segment_b, 'size', NULL, round(100.0 * (rows_b - rows_a) / rows_a, 6), NULL FROM far WHERE abs(100.0 * (rows_b - rows_a) / rows_a) > 20
UNION ALL SELECT segment_a, segment_b, CASE kind WHEN 'number' THEN 'mean' ELSE 'mode' END, column_name, CASE kind WHEN 'number' THEN round(100 * (mean_b - mean_a) / mean_a, 6) END, CASE kind WHEN 'category' THEN mode_a || ' > ' || mode_b END FROM ranked WHERE rank <= 3 AND distance > 0.3 AND (kind = 'number' OR mode_a <> mode_b)""")
def segment_insights(t: Tables) -> DataFrame:
    """What sets the market segments of customers apart."""
    return rounded(sp.segment_insights(_segments(t)), 6)


SKETCH = """SELECT 'l_quantity' AS column_name, 100.0 * count(*) FILTER (WHERE l_quantity IS NULL) / count(*) AS nulls, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std, mad(l_quantity) AS mad, NULL AS top FROM {v}
UNION ALL SELECT 'l_discount', 100.0 * count(*) FILTER (WHERE l_discount IS NULL) / count(*), avg(l_discount), stddev_samp(l_discount), mad(l_discount), NULL FROM {v}
UNION ALL SELECT 'l_suppkey', 100.0 * count(*) FILTER (WHERE l_suppkey IS NULL) / count(*), NULL, NULL, NULL, (SELECT list(v) FROM (SELECT CAST(l_suppkey AS VARCHAR) AS v FROM {v} WHERE l_suppkey IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 5)) FROM {v}"""
STEP = "CASE WHEN {d} IS NULL OR abs({d}) < 0.01 THEN 0 WHEN abs({d}) < 0.05 THEN 0.1 WHEN abs({d}) < 0.1 THEN 0.3 WHEN abs({d}) < 0.2 THEN 0.6 ELSE 1 END"
VERSIONS = "x AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-17'), y AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-17')"


@query(f"""WITH {VERSIONS}, a AS ({SKETCH.format(v='x')}), b AS ({SKETCH.format(v='y')}), d AS (SELECT a.column_name, a.top AS ta, b.top AS tb, b.nulls - a.nulls AS dn, b.mean - a.mean AS dm, b.std - a.std AS ds, b.mad - a.mad AS dd FROM a JOIN b USING (column_name)),
s AS (SELECT *, len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) AS overlap FROM d)
SELECT column_name, false AS missing, round(dn, 6) AS null_percent_delta, round(dm, 6) AS mean_delta, round(ds, 6) AS std_delta, round(dd, 6) AS mad_delta, round(overlap, 6) AS top_overlap,
round(CASE WHEN ta IS NOT NULL THEN 1 - overlap ELSE least({' + '.join(STEP.format(d=c) for c in ('dm', 'ds', 'dd'))}, 1) END, 6)::DOUBLE AS score FROM s""")
def version_validation(t: Tables) -> DataFrame:
    """What changed in the lines shipped since a date against those before, by the sketches of both."""
    old, new = (versions.version_sketch(df, ["l_quantity", "l_discount"], ["l_suppkey"]) for df in _years(t))
    return rounded(versions.validated(old, new), 6)


@query(f"""WITH {VERSIONS}, v AS (SELECT count(*) AS n, count(DISTINCT l_orderkey) / count(*) AS a, count(DISTINCT l_partkey) / count(*) AS b FROM x), u AS (SELECT count(*) AS n, count(DISTINCT l_orderkey) / count(*) AS a, count(DISTINCT l_partkey) / count(*) AS b FROM y),
q AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS q FROM x), r AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS q FROM y),
f AS (SELECT l_returnflag AS k, count(*) / (SELECT n FROM v) AS p FROM x GROUP BY 1), g AS (SELECT l_returnflag AS k, count(*) / (SELECT n FROM u) AS p FROM y GROUP BY 1), j AS (SELECT greatest(coalesce(f.p, 0), 1e-10) AS a, greatest(coalesce(g.p, 0), 1e-10) AS b FROM f FULL JOIN g USING (k))
SELECT 'l_quantity' AS column_name, round(least((greatest(abs(r.q[1] - q.q[1]), abs(r.q[2] - q.q[2]), abs(r.q[3] - q.q[3])) / ((q.q[3] - q.q[1] + r.q[3] - r.q[1]) / 2) + abs((r.q[3] - r.q[1]) - (q.q[3] - q.q[1])) / (q.q[3] - q.q[1])) / 2, 1), 6) AS distance, 1.0::DOUBLE AS weight FROM q, r
UNION ALL SELECT 'l_returnflag', round(sum(a * ln(a / ((a + b) / 2)) + b * ln(b / ((a + b) / 2))) / 2 / ln(2.0), 6), 1.0 FROM j UNION ALL SELECT 'l_orderkey', round(abs(u.a - v.a) / 2, 6), 0.1 FROM u, v UNION ALL SELECT 'l_partkey', round(abs(u.b - v.b) / 2, 6), 1.0 FROM u, v""")
def weighted_drift(t: Tables) -> DataFrame:
    """How far each kind of column of the lines shipped since a date has drifted, and how much it weighs."""
    return rounded(versions.weighted_drift(*_years(t), ["l_quantity"], ["l_returnflag"], ["l_partkey"], ["l_orderkey"]), 6)


@query("""WITH y AS (SELECT year(o_orderdate) AS y, count(*) AS rows, row_number() OVER (ORDER BY year(o_orderdate) DESC) AS k FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1)
SELECT 'orders of ' || y AS source, rows, 6 AS columns, y = (SELECT min(y) + 1 FROM y) AS is_baseline, y = (SELECT min(y) + 1 FROM y) AS pinned FROM y WHERE k <= 2 OR y = (SELECT min(y) + 1 FROM y)""")
def profile_history(t: Tables) -> DataFrame:
    """Profiles of the orders of each year, stored; the second is pinned, the last year's stored twice, and all but two pruned."""
    store = ProfileStore(t.spark, scratch_path(t.spark, "profile-store"))
    years = [r["y"] for r in t.orders.select(F.year("o_orderdate").alias("y")).distinct().filter("y is not null").orderBy("y").collect()]  # a few years
    ids = [store.store(t.orders.filter(F.year("o_orderdate") == y), f"orders of {y}", datetime.datetime(y, 12, 31), ["o_totalprice"], ["o_orderstatus"]) for y in [*years, years[-1]]]
    store.pin(ids[1], datetime.datetime(years[-1] + 1, 1, 1))
    store.prune(datetime.datetime(years[-1] + 1, 1, 2), 2)
    chosen = F.broadcast(store.baselines().select("id", F.lit(True).alias("is_baseline")))  # a row a schema
    return store.entries().join(chosen, "id", "left").select("source", "rows", "columns", F.coalesce("is_baseline", F.lit(False)).alias("is_baseline"), "pinned")
