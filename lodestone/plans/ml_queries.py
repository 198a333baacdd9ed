"""Queries of target analysis, tests, segments, anomalies, drift and constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import constraints, drift, mltools
from lodestone.operators import profile as prof
from lodestone.plans.registry import Tables, query, rounded

LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("\nUNION ALL\n".join(f"""SELECT '{c}' AS column_name, round(avg({c}) FILTER (WHERE f), 4) AS mean_with, round(avg({c}) FILTER (WHERE NOT f), 4) AS mean_without,
round((avg({c}) FILTER (WHERE f) - avg({c}) FILTER (WHERE NOT f)) / sqrt(((count(*) FILTER (WHERE f) - 1) * var_samp({c}) FILTER (WHERE f) + (count(*) FILTER (WHERE NOT f) - 1) * var_samp({c}) FILTER (WHERE NOT f)) / (count(*) - 2)), 4) AS cohens_d,
count(*) FILTER (WHERE f) AS n_with, count(*) FILTER (WHERE NOT f) AS n_without FROM (SELECT *, l_returnflag = 'R' AS f FROM lineitem)""" for c in LINE))  # fmt: skip
def target_effects_numeric(t: Tables) -> DataFrame:
    return rounded(mltools.numeric_effects(t.lineitem, F.col("l_returnflag") == "R", LINE))


@query("""WITH j AS (SELECT lang, source, quality = 1 AS f FROM documents JOIN labels USING (doc_id)), b AS (SELECT avg(f::INT) AS base FROM j),
g AS (SELECT 'lang' AS column_name, lang AS value, count(*) AS n, avg(f::INT) AS rate FROM j WHERE lang IS NOT NULL GROUP BY 2 HAVING count(*) >= 10 UNION ALL SELECT 'source', source, count(*), avg(f::INT) FROM j WHERE source IS NOT NULL GROUP BY 2 HAVING count(*) >= 10),
r AS (SELECT *, rate - base AS delta, row_number() OVER (PARTITION BY column_name ORDER BY round(abs(rate - base), 9) DESC, n DESC, value) AS k FROM g, b)
SELECT column_name, value, n, round(rate, 4) AS rate, round(base, 4) AS base_rate, round(delta, 4) AS delta FROM r WHERE k = 1""")
def target_effects_categorical(t: Tables) -> DataFrame:
    return rounded(mltools.categorical_effects(t.documents.join(t.labels, "doc_id"), F.col("quality") == 1, ["lang", "source"]))


@query("""WITH g AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s, row_number() OVER (ORDER BY count(*) DESC, l_returnflag) AS k FROM lineitem GROUP BY 1)
SELECT a.g AS group_a, b.g AS group_b, a.n AS n1, b.n AS n2, round(a.m, 4) AS mean_a, round(b.m, 4) AS mean_b, round((a.m - b.m) / sqrt(a.s * a.s / a.n + b.s * b.s / b.n), 4) AS t_statistic FROM g a, g b WHERE a.k = 1 AND b.k = 2""")
def welch_t(t: Tables) -> DataFrame:
    return rounded(mltools.welch_t(t.lineitem, "l_returnflag", "l_extendedprice"))


@query("""WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem), s AS (SELECT *, r * sqrt(n - 2) / sqrt(1 - r * r) AS t FROM c), k AS (SELECT *, 1 / (1 + 0.2316419 * abs(t)) AS u FROM s)
SELECT round(r, 4) AS r, n, round(t, 4) AS t_statistic, round(2 * (exp(-t * t / 2) / sqrt(2 * pi()) * (0.319381530 * u - 0.356563782 * u ^ 2 + 1.781477937 * u ^ 3 - 1.821255978 * u ^ 4 + 1.330274429 * u ^ 5)), 4) AS p_value, 2 * (exp(-t * t / 2) / sqrt(2 * pi()) * (0.319381530 * u - 0.356563782 * u ^ 2 + 1.781477937 * u ^ 3 - 1.821255978 * u ^ 4 + 1.330274429 * u ^ 5)) <= 0.05 AS significant FROM k""")
def corr_significance(t: Tables) -> DataFrame:
    return rounded(mltools.correlation_significance(t.lineitem, "l_quantity", "l_extendedprice"))


@query("\nUNION ALL\n".join(f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(avg({c}) / (stddev_samp({c}) / sqrt(count({c}))), 4) AS t_statistic FROM lineitem" for c in LINE[:2]))
def one_sample_t(t: Tables) -> DataFrame:
    return rounded(mltools.one_sample_t(t.lineitem, LINE[:2]))


@query("\nUNION ALL\n".join(f"SELECT '{c}' AS column_name, round(abs(corr({c}, l_extendedprice)), 4) AS importance FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def feature_importance(t: Tables) -> DataFrame:
    return rounded(mltools.feature_importance(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]))


@query("""SELECT CAST(segment AS INTEGER) AS segment, count(*) AS n, round(avg(score), 4) AS avg_score, round(avg(p_retailprice), 4) AS avg_p_retailprice, round(avg(p_size), 4) AS avg_p_size FROM (
SELECT *, ntile(4) OVER (ORDER BY score, p_partkey) AS segment FROM (SELECT p_partkey, p_retailprice, p_size, ((p_retailprice - a) / (b - a) + (p_size - c) / (d - c)::DOUBLE) / 2 AS score FROM part, (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b, min(p_size) AS c, max(p_size) AS d FROM part))) GROUP BY 1""")
def ntile_segments(t: Tables) -> DataFrame:
    return rounded(mltools.ntile_segments(t.part, "p_partkey", ["p_retailprice", "p_size"]))


OUT = "SELECT '{c}' AS column_name, round(lo, 4) AS lower_bound, round(hi, 4) AS upper_bound, count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS n, round(min({c}) FILTER (WHERE {c} < lo OR {c} > hi), 4) AS smallest, round(max({c}) FILTER (WHERE {c} < lo OR {c} > hi), 4) AS largest, round(100.0 * count(*) FILTER (WHERE {c} < lo OR {c} > hi) / count({c}), 4) AS percent FROM {t}, ({b}) GROUP BY lo, hi"


@query(OUT.format(c="value", t="events", b="SELECT avg(value) - 3 * stddev_samp(value) AS lo, avg(value) + 3 * stddev_samp(value) AS hi FROM events"))
def anomaly_zscore(t: Tables) -> DataFrame:
    return rounded(mltools.anomalies(t.events, ["value"]))


@query(OUT.format(c="value", t="events", b="SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo, quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi FROM events"))
def anomaly_iqr(t: Tables) -> DataFrame:
    return rounded(mltools.anomalies(t.events, ["value"], "iqr", 1.5))


@query("""SELECT count(*) AS periods, round(regr_slope(v, i), 4) AS slope, round(avg(v), 4) AS mean, CASE WHEN regr_slope(v, i) > 0 THEN 'increasing' WHEN regr_slope(v, i) < 0 THEN 'decreasing' ELSE 'stable' END AS direction FROM (
SELECT v, CAST(row_number() OVER (ORDER BY m) - 1 AS DOUBLE) AS i FROM (SELECT date_trunc('month', o_orderdate) AS m, avg(o_totalprice) AS v FROM orders GROUP BY 1))""")
def monthly_trend(t: Tables) -> DataFrame:
    return rounded(mltools.monthly_trend(t.orders, "o_orderdate", "o_totalprice"))


@query()
def kmeans_segments(t: Tables) -> DataFrame:
    return mltools.k_means(t.embeddings, "embedding").groupBy("cluster").agg(F.count("*").alias("n"))


def _years(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Lines shipped before and from the middle of the period."""
    early = F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp_ntz")
    return t.lineitem.filter(early), t.lineitem.filter(~early)


BOTH = """WITH l AS (SELECT *, l_shipdate < TIMESTAMP '1995-06-17' AS early FROM lineitem WHERE l_shipdate IS NOT NULL),
u AS (SELECT early, 'l_returnflag' AS column_name, l_returnflag AS value, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT early, 'l_linestatus', l_linestatus, count(*) FROM l GROUP BY ALL),
s AS (SELECT early, column_name, value, n / sum(n) OVER (PARTITION BY early, column_name) AS share FROM u),
f AS (SELECT coalesce(a.column_name, b.column_name) AS column_name, coalesce(a.value, b.value) AS value, a.share AS p, b.share AS q FROM (SELECT * FROM s WHERE early) a FULL JOIN (SELECT * FROM s WHERE NOT early) b ON a.column_name = b.column_name AND a.value = b.value)"""


@query(BOTH + """ SELECT column_name, round(abs(sum((q4 - p4) * ln(q4 / p4))), 4) AS psi, round(sum(a * ln(a / ((a + b) / 2)) + b * ln(b / ((a + b) / 2))) / 2 / ln(2.0), 4) AS js_divergence
FROM (SELECT column_name, greatest(coalesce(p, 0.0001), 0.0001) AS p4, greatest(coalesce(q, 0.0001), 0.0001) AS q4, greatest(coalesce(p, 1e-10), 1e-10) AS a, greatest(coalesce(q, 1e-10), 1e-10) AS b FROM f) GROUP BY 1""")
def psi_js_drift(t: Tables) -> DataFrame:
    return rounded(drift.categorical_drift(*_years(t), ["l_returnflag", "l_linestatus"]))


SHIFT = """WITH o AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS value, o_orderdate < TIMESTAMP '1995-10-01' AS early FROM orders), f AS (SELECT value, count(*) FILTER (WHERE early) / (SELECT count(*) FROM o WHERE early) AS p, count(*) FILTER (WHERE NOT early) / (SELECT count(*) FROM o WHERE NOT early) AS q FROM o GROUP BY 1)
SELECT 'year' AS column_name, value, round(100 * (q - p), 4) AS points, p = 0 AS is_new, q = 0 AS is_removed FROM f WHERE abs(100 * (q - p)) >= 5"""


@query(SHIFT)
def category_shifts(t: Tables) -> DataFrame:
    own = t.orders.withColumn("year", F.year("o_orderdate").cast("string"))
    bound = F.lit("1995-10-01").cast("timestamp_ntz")
    return rounded(drift.category_shifts(own.filter(F.col("o_orderdate") < bound), own.filter(F.col("o_orderdate") >= bound), ["year"]))


NUM = "SELECT '{c}' AS column_name, avg({c}) AS m, stddev_samp({c}) AS s, quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.5) AS b, quantile_cont({c}, 0.75) AS d FROM lineitem WHERE {w}"


@query("WITH o AS (" + " UNION ALL ".join(NUM.format(c=c, w="l_shipdate < TIMESTAMP '1995-06-17'") for c in LINE[:2]) + "), n AS (" + " UNION ALL ".join(NUM.format(c=c, w="l_shipdate >= TIMESTAMP '1995-06-17'") for c in LINE[:2]) + """)
SELECT column_name, round(100 * (n.m - o.m) / abs(o.m), 4) AS mean_change, round(100 * (n.s - o.s) / abs(o.s), 4) AS std_change, round(least(greatest(0.1 * abs(n.m - o.m) / sqrt((o.s * o.s + n.s * n.s) / 2) + 0.1 * ln(greatest(o.s, n.s) / least(o.s, n.s)), 0), 1), 4) AS psi,
round(least((greatest(abs(n.a - o.a), abs(n.b - o.b), abs(n.d - o.d)) / ((o.d - o.a + n.d - n.a) / 2) + abs((n.d - n.a) - (o.d - o.a)) / (o.d - o.a)) / 2, 1), 4) AS ks FROM o JOIN n USING (column_name)""")
def numeric_drift(t: Tables) -> DataFrame:
    return rounded(drift.numeric_drift(*_years(t), LINE[:2]))


@query("SELECT * FROM (VALUES ('c_mktsegment', 'removed', 'string', NULL), ('c_acctbal', 'type changed', 'double', 'int'), ('c_extra', 'added', NULL, 'int')) v(column_name, change, old_type, new_type)")
def schema_diff(t: Tables) -> DataFrame:
    return drift.schema_diff(t.customer, t.customer.drop("c_mktsegment").withColumn("c_acctbal", F.col("c_acctbal").cast("int")).withColumn("c_extra", F.lit(1)))


@query("SELECT count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1995-06-17') AS rows_before, count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '1995-06-17') AS rows_now, round(100.0 * (count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '1995-06-17') - count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1995-06-17')) / count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1995-06-17'), 4) AS change, abs(100.0 * (count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '1995-06-17') - count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1995-06-17')) / count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1995-06-17')) > 10 AS significant FROM lineitem")
def row_change(t: Tables) -> DataFrame:
    return rounded(drift.row_change(*_years(t)))


PSI = "(SELECT abs(sum((greatest(coalesce(q, 0.0001), 0.0001) - greatest(coalesce(p, 0.0001), 0.0001)) * ln(greatest(coalesce(q, 0.0001), 0.0001) / greatest(coalesce(p, 0.0001), 0.0001)))) AS v FROM f GROUP BY column_name)"


@query(BOTH + f""", r AS (SELECT 100.0 * (count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '1995-06-17') - count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1995-06-17')) / count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1995-06-17') AS change FROM lineitem),
v AS (SELECT v FROM {PSI} UNION ALL SELECT 0.3 * least(abs(change) / 100, 1) FROM r WHERE abs(change) > 10) SELECT round(least(avg(v), 1), 4) AS drift_score, least(avg(v), 1) > 0.2 AS has_drift FROM v""")
def drift_score(t: Tables) -> DataFrame:
    old, new = _years(t)
    return rounded(drift.drift_score(drift.categorical_drift(old, new, ["l_returnflag", "l_linestatus"]), drift.schema_diff(old, new), drift.row_change(old, new)))


CENTRE = "SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) / count(*) AS ns, count(DISTINCT {c}) / count(*) AS us, (max(m) - min({c})) / (max({c}) - min({c})) AS ce, least(greatest(avg(power(({c} - m) / s, 3)) / 3 + 0.5, 0), 1) AS le FROM lineitem, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem WHERE {w}) WHERE {w}"


@query("WITH a AS (" + " UNION ALL ".join(CENTRE.format(c=c, w="l_shipdate < TIMESTAMP '1995-06-17'") for c in LINE[:2]) + "), b AS (" + " UNION ALL ".join(CENTRE.format(c=c, w="l_shipdate >= TIMESTAMP '1995-06-17'") for c in LINE[:2]) + ") SELECT round(least(avg((abs(a.ns - b.ns) + abs(a.us - b.us) + abs(a.ce - b.ce) + abs(a.le - b.le)) / 4), 1), 4) AS distance FROM a JOIN b USING (column_name)")
def centroid_distance(t: Tables) -> DataFrame:
    old, new = _years(t)
    return rounded(drift.centroid_distance(drift.centroid(old, LINE[:2]), drift.centroid(new, LINE[:2])))


RULE_ROWS = [("RowCountBetween", None, 1.0, 1e12, None), ("ColumnCount", None, 6.0, 6.0, None), ("ColumnExists", "o_custkey", None, None, None), ("ColumnExists", "o_missing", None, None, None), ("NotNull", "o_orderkey", None, None, None), ("MinBetween", "o_totalprice", 0.0, 1e9, None), ("MeanBetween", "o_totalprice", 0.0, 1.0, None), ("Unique", "o_orderkey", None, None, None), ("Unique", "o_custkey", None, None, None), ("ColumnType", "o_orderdate", None, None, "DateTime")]


@query("""SELECT 'RowCountBetween' AS rule, NULL AS column_name, round(count(*), 4)::DOUBLE AS found, count(*) BETWEEN 1 AND 1e12 AS holds FROM orders UNION ALL SELECT 'ColumnCount', NULL, 6, true UNION ALL SELECT 'ColumnExists', 'o_custkey', NULL, true UNION ALL SELECT 'ColumnExists', 'o_missing', NULL, false
UNION ALL SELECT 'NotNull', 'o_orderkey', round(100.0 * count(*) FILTER (WHERE o_orderkey IS NULL) / count(*), 4), count(*) FILTER (WHERE o_orderkey IS NULL) = 0 FROM orders UNION ALL SELECT 'MinBetween', 'o_totalprice', round(min(o_totalprice), 4), min(o_totalprice) BETWEEN 0 AND 1e9 FROM orders
UNION ALL SELECT 'MeanBetween', 'o_totalprice', round(avg(o_totalprice), 4), avg(o_totalprice) BETWEEN 0 AND 1 FROM orders UNION ALL SELECT 'Unique', 'o_orderkey', round(100.0 * count(DISTINCT o_orderkey) / count(*), 4), 100.0 * count(DISTINCT o_orderkey) / count(*) >= 99.9 FROM orders
UNION ALL SELECT 'Unique', 'o_custkey', round(100.0 * count(DISTINCT o_custkey) / count(*), 4), 100.0 * count(DISTINCT o_custkey) / count(*) >= 99.9 FROM orders UNION ALL SELECT 'ColumnType', 'o_orderdate', NULL, true""")
def constraints_check(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([(r, c, low, high, text) for r, c, low, high, text in RULE_ROWS], constraints.RULES)
    return rounded(constraints.check(prof.typed(prof.profile(t.orders)), rules))


@query()
def constraints_suggest(t: Tables) -> DataFrame:
    profiled = prof.typed(prof.profile(t.orders))
    return constraints.check(profiled, constraints.suggest(profiled)).agg(F.count("*").alias("rules"), F.count_if("holds").alias("kept"))
