"""Queries of the column and group statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import stats
from lodestone.plans.registry import Tables, query, rounded

LINEITEM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _each(sql: str, columns: tuple[str, ...]) -> str:
    """The SQL once for each column, all rows together; ``{c}`` is the column."""
    return "\nUNION ALL\n".join(sql.replace("{c}", c) for c in columns)


@query(_each("""SELECT '{c}' AS column_name, count(*) AS row_count, count(*) FILTER (WHERE {c} IS NULL) AS null_count,
round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q75,
count(DISTINCT {c}) AS distinct_count FROM lineitem""", LINEITEM))  # fmt: skip
def profile_numeric_lineitem(t: Tables) -> DataFrame:
    return rounded(stats.numeric_profile(t.lineitem, LINEITEM))


@query(_each("""SELECT '{c}' AS column_name, round(avg(power(({c} - m) / s, 3)), 4) AS skewness, round(avg(power(({c} - m) / s, 4)), 4) AS kurtosis
FROM lineitem, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem)""", ("l_extendedprice", "l_quantity")) + """
UNION ALL SELECT 'value', round(avg(power((value - m) / s, 3)), 4), round(avg(power((value - m) / s, 4)), 4)
FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)""")  # fmt: skip
def profile_skew_kurt(t: Tables) -> DataFrame:
    return rounded(stats.skew_kurtosis(t.lineitem, ["l_extendedprice", "l_quantity"]).unionByName(stats.skew_kurtosis(t.events, ["value"])))


@query(_each("""SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outlier_count, count(*) FILTER (WHERE {c} = 0) AS zero_count
FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)""", LINEITEM) + """
UNION ALL SELECT 'value', count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)), count(*) FILTER (WHERE value = 0)
FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)""")  # fmt: skip
def profile_outliers_zero(t: Tables) -> DataFrame:
    return stats.outliers_and_zeros(t.lineitem, LINEITEM).unionByName(stats.outliers_and_zeros(t.events, ["value"]))


@query(_each("""SELECT '{c}' AS column_name, round(quantile_cont(abs({c} - m), 0.5), 4) AS mad
FROM lineitem, (SELECT quantile_cont({c}, 0.5) AS m FROM lineitem)""", ("l_extendedprice", "l_quantity")))  # fmt: skip
def profile_mad(t: Tables) -> DataFrame:
    return rounded(stats.mad(t.lineitem, ["l_extendedprice", "l_quantity"]))


@query("""WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer),
b AS (SELECT i AS bin, lo + i * ((hi - lo) / 20) AS lower_edge, CASE WHEN i = 19 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 20) END AS upper_edge FROM e, range(20) r(i))
SELECT CAST(bin AS INTEGER) AS bin, round(lower_edge, 4) AS lower_edge, round(upper_edge, 4) AS upper_edge,
(SELECT count(*) FROM customer WHERE c_acctbal >= lower_edge AND (c_acctbal < upper_edge OR (bin = 19 AND c_acctbal <= upper_edge))) AS n FROM b""")  # fmt: skip
def profile_histogram(t: Tables) -> DataFrame:
    return rounded(stats.histogram(t.customer, "c_acctbal", 20))


TOP = """SELECT column_name, value, n, CAST(rank AS INTEGER) AS rank, round(100.0 * n / total, 4) AS percent, distinct_count FROM (
SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank, sum(n) OVER (PARTITION BY column_name)::BIGINT AS total, count(*) OVER (PARTITION BY column_name) AS distinct_count FROM (
SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM orders WHERE o_custkey IS NOT NULL GROUP BY ALL)) WHERE rank <= 10"""


@query(TOP)
def topk_values(t: Tables) -> DataFrame:
    return rounded(stats.top_values(t.orders, ["o_orderstatus", "o_orderpriority", "o_custkey"]))


@query(f"""SELECT column_name, round(sum(-(n * 1.0 / total) * log2(n * 1.0 / total)), 4) AS entropy, max_by(value, -rank) AS mode,
round(max(100.0 * n / total) / (100.0 / max(distinct_count)), 4) AS imbalance_ratio, (SELECT count(*) FROM orders) - sum(n)::BIGINT AS other_count,
round(100.0 * ((SELECT count(*) FROM orders) - sum(n)::BIGINT) / (SELECT count(*) FROM orders), 4) AS other_percent FROM ({TOP.replace("round(100.0 * n / total, 4) AS percent", "total")}) GROUP BY column_name""")
def entropy_imbalance(t: Tables) -> DataFrame:
    return rounded(stats.entropy_imbalance(t.orders, ["o_orderstatus", "o_orderpriority", "o_custkey"]))


@query("""SELECT 'documents.text' AS column_name, round(avg(length(text)), 4) AS avg_length, CAST(max(length(text)) AS INTEGER) AS max_length, CAST(min(length(text)) AS INTEGER) AS min_length, count(*) FILTER (WHERE trim(text, ' ') = '') AS empty_count FROM documents
UNION ALL SELECT 'conversations.text', round(avg(length(text)), 4), max(length(text)), min(length(text)), count(*) FILTER (WHERE trim(text, ' ') = '') FROM conversations""")  # fmt: skip
def text_stats(t: Tables) -> DataFrame:
    named = lambda table, name: stats.text_stats(table, ["text"]).withColumn("column_name", F.lit(name))
    return rounded(named(t.documents, "documents.text").unionByName(named(t.conversations, "conversations.text")))


PAIRS = [(a, b) for i, a in enumerate(LINEITEM) for b in LINEITEM[i + 1 :]]


@query("SELECT column_a, column_b, round(r, 4) AS r, CASE WHEN abs(r) >= 0.8 THEN 'Very Strong' WHEN abs(r) >= 0.6 THEN 'Strong' WHEN abs(r) >= 0.4 THEN 'Moderate' WHEN abs(r) >= 0.2 THEN 'Weak' ELSE 'Negligible' END AS strength FROM (" + "\nUNION ALL\n".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM lineitem" for a, b in PAIRS) + ")")
def corr_matrix(t: Tables) -> DataFrame:
    return rounded(stats.correlations(t.lineitem, LINEITEM, least=0.0))


@query("""SELECT l_returnflag AS category, round(avg(l_extendedprice), 4) AS avg_value, round(sum(l_extendedprice), 2) AS sum_value, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1""")
def agg_by_category(t: Tables) -> DataFrame:
    return stats.aggregate_by(t.lineitem, "l_returnflag", "l_extendedprice").select("category", F.round("avg_value", 4).alias("avg_value"), F.round("sum_value", 2).alias("sum_value"), "n")


@query("""SELECT c_mktsegment, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM customer GROUP BY 1""")
def count_by_category(t: Tables) -> DataFrame:
    return stats.share_of_rows(t.customer, "c_mktsegment")


CRAMER = """SELECT '{a}' AS column_a, '{b}' AS column_b, round(least(1.0, sqrt(sum((n - na * nb / t) ^ 2 / (na * nb / t)) / (max(t) * (least(count(DISTINCT a), count(DISTINCT b)) - 1)))), 4) AS cramers_v
FROM (SELECT a, b, n, sum(n) OVER (PARTITION BY a)::DOUBLE AS na, sum(n) OVER (PARTITION BY b)::DOUBLE AS nb, sum(n) OVER ()::DOUBLE AS t FROM (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {t} GROUP BY ALL))"""


@query(CRAMER.format(a="l_returnflag", b="l_linestatus", t="lineitem") + " UNION ALL " + CRAMER.format(a="o_orderstatus", b="o_orderpriority", t="orders"))
def cramers_v(t: Tables) -> DataFrame:
    return rounded(stats.cramers_v(t.lineitem, [("l_returnflag", "l_linestatus")]).unionByName(stats.cramers_v(t.orders, [("o_orderstatus", "o_orderpriority")])))


@query("""SELECT * FROM (SELECT o_orderstatus AS parent_value, o_orderpriority AS child_value, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 4) AS probability FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE probability >= 0.01""")
def conditional_distribution(t: Tables) -> DataFrame:
    return rounded(stats.conditional_distribution(t.orders, "o_orderstatus", "o_orderpriority"))


@query("""SELECT event_type AS group_value, count(*) AS n, round(avg(value), 4) AS avg_value, round(min(value), 4) AS min_value, round(max(value), 4) AS max_value FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, group_value LIMIT 10""")
def compare_groups(t: Tables) -> DataFrame:
    return rounded(stats.compare_groups(t.events, "event_type", ["value"]))


@query("""SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 10""")
def having_min_rows(t: Tables) -> DataFrame:
    return stats.having_at_least(t.lineitem, ["l_suppkey"], 10)


@query("""SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, round(avg(o_totalprice), 4) AS avg_value, count(*) AS n FROM orders GROUP BY 1""")
def period_aggregate(t: Tables) -> DataFrame:
    return rounded(t.orders.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("period")).agg(F.avg("o_totalprice").alias("avg_value"), F.count("*").alias("n")))
