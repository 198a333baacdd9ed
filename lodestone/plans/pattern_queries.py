"""Queries of the profile and of pattern detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import patterns, stats
from lodestone.operators import profile as prof
from lodestone.plans.registry import ORACLES, Tables, query, rounded

ORDER_COLUMNS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
COUNTED = "\nUNION ALL\n".join(f"SELECT '{c}' AS column_name, '{k}' AS data_type, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT {c}) AS uniq FROM orders" for c, k in ORDER_COLUMNS.items())
TYPED = f"""SELECT *, CASE WHEN lower(column_name) LIKE '%id' OR lower(column_name) LIKE '%uuid%' OR lower(column_name) LIKE '%guid%' OR (data_type = 'bigint' AND 100.0 * uniq / rows > 95) THEN 'Id'
WHEN data_type LIKE 'timestamp%' THEN 'DateTime' WHEN data_type IN ('bigint', 'double') THEN CASE WHEN uniq <= 10 AND rows > 100 THEN 'Categorical' ELSE 'Numeric' END
ELSE CASE WHEN 100.0 * uniq / rows < 5 OR uniq <= 50 THEN 'Categorical' ELSE 'Text' END END AS inferred_type FROM ({COUNTED})"""


@query(f"SELECT column_name, data_type, uniq AS distinct_count, nulls AS null_count, inferred_type FROM ({TYPED})")
def infer_types(t: Tables) -> DataFrame:
    return prof.typed(prof.profile(t.orders)).select("column_name", "data_type", "distinct_count", "null_count", "inferred_type")


@query(f"""SELECT column_name, round(-(100.0 * nulls / rows) / 20 + CASE WHEN uniq <= 1 THEN -10 ELSE 0 END + CASE WHEN 100.0 * uniq / rows > 1 AND 100.0 * uniq / rows < 90 THEN 2 ELSE 0 END
+ CASE WHEN column_name LIKE '%id' OR column_name LIKE '%key' THEN -5 ELSE 0 END + CASE WHEN data_type = 'bigint' AND 100.0 * uniq / rows > 95 THEN -3 ELSE 0 END + CASE WHEN data_type IN ('bigint', 'double') AND uniq > 1 THEN 2 ELSE 0 END
+ CASE WHEN data_type LIKE 'timestamp%' THEN 3 ELSE 0 END + CASE WHEN regexp_matches(column_name, 'price|amount|cost|total|revenue|salary|balance') THEN 2 ELSE 0 END, 4)::DOUBLE AS interest FROM ({TYPED})""")
def interest_score(t: Tables) -> DataFrame:
    return rounded(prof.interest(prof.profile(t.orders)).select("column_name", "interest"))


@query(f"""SELECT column_name, CASE WHEN inferred_type = 'Id' THEN 'identifier' WHEN inferred_type = 'Categorical' AND uniq BETWEEN 2 AND 100 AND 100.0 * uniq / rows < 50 THEN 'low-cardinality category'
WHEN inferred_type = 'DateTime' THEN 'date range' WHEN regexp_matches(column_name, '(_id|Id|_key)$') THEN 'key name' ELSE 'flag' END AS reason FROM ({TYPED})
WHERE inferred_type IN ('Id', 'DateTime') OR (inferred_type = 'Categorical' AND uniq BETWEEN 2 AND 100 AND 100.0 * uniq / rows < 50) OR regexp_matches(column_name, '(_id|Id|_key)$') OR uniq = 2""")
def index_advisor(t: Tables) -> DataFrame:
    return prof.index_advice(prof.typed(prof.profile(t.orders)))


EVENT_VALUE = "(SELECT avg(value) AS m, stddev_samp(value) AS s, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n, count(DISTINCT value) AS u FROM events)"


@query(f"""SELECT column_name, alert, severity FROM (
SELECT 'value' AS column_name, 'HighSkewness' AS alert, 'Info' AS severity, abs(avg(power((value - m) / s, 3))) > 2 AS holds FROM events, {EVENT_VALUE}
UNION ALL SELECT 'value', 'Outliers', CASE WHEN 100.0 * count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) / count(*) > 5 THEN 'Warning' ELSE 'Info' END, 100.0 * count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) / count(*) > 1 FROM events, {EVENT_VALUE} GROUP BY q1, q3
UNION ALL SELECT 'value', 'HighNulls', CASE WHEN 100.0 * count(*) FILTER (WHERE value IS NULL) / count(*) > 50 THEN 'Warning' ELSE 'Info' END, 100.0 * count(*) FILTER (WHERE value IS NULL) / count(*) > 10 FROM events
UNION ALL SELECT 'value', 'Constant', 'Warning', count(DISTINCT value) = 1 FROM events
UNION ALL SELECT 'value', 'ZeroInflated', 'Info', 100.0 * count(*) FILTER (WHERE value = 0) / count(*) > 30 FROM events) WHERE holds""")
def alerts(t: Tables) -> DataFrame:
    return prof.alerts(prof.typed(prof.profile(t.events.select("value"))))


@query(f"""SELECT CAST(greatest(100 - (SELECT count(*) FROM (SELECT 1 FROM (SELECT c_acctbal, q1, q3 FROM customer, (SELECT quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer)) HAVING count(*) FILTER (WHERE c_acctbal < q1 - 1.5 * (q3 - q1) OR c_acctbal > q3 + 1.5 * (q3 - q1)) > 0.1 * count(*))) * 2
- (SELECT CASE WHEN stddev_samp(c_acctbal) = 0 THEN 1 ELSE 0 END + CASE WHEN 100.0 * count(*) FILTER (WHERE c_acctbal IS NULL) / count(*) > 50 THEN 5 WHEN 100.0 * count(*) FILTER (WHERE c_acctbal IS NULL) / count(*) > 10 THEN 2 ELSE 0 END FROM customer), 0) AS INTEGER) AS quality_score, CAST(2 AS BIGINT) AS columns""")
def quality_score(t: Tables) -> DataFrame:
    return prof.quality_score(prof.typed(prof.profile(t.customer.select("c_acctbal", "c_mktsegment"))))


NUMBERS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, avg(power(({c} - m) / s, 3)) AS sk, avg(power(({c} - m) / s, 4)) AS ku, count(*) FILTER (WHERE {c} < q[1] - 1.5 * (q[2] - q[1]) OR {c} > q[2] + 1.5 * (q[2] - q[1])) AS off, count(*) FILTER (WHERE {c} = 0) AS zero FROM orders, (SELECT avg({c}) AS m, stddev_samp({c}) AS s, quantile_cont({c}, [0.25, 0.75]) AS q FROM orders)" for c in ("o_orderkey", "o_custkey", "o_totalprice"))
TOPS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, max(n) / sum(n) AS top FROM (SELECT count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY {c})" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))


@query(f"""WITH p AS (SELECT *, 100.0 * nulls / rows AS np, 100.0 * uniq / rows AS up, off / rows AS ratio, inferred_type = 'Numeric' AS num, inferred_type = 'Categorical' AS cat FROM ({TYPED}) LEFT JOIN ({NUMBERS}) USING (column_name) LEFT JOIN ({TOPS}) USING (column_name)),
a AS (SELECT count(*) AS k, sum((np > 50)::INT + (uniq = 1)::INT + coalesce(ratio > 0.05, false)::INT + (cat AND up > 90 AND uniq > 100)::INT) AS w,
sum((np > 10 AND np <= 50)::INT + (up > 95 AND inferred_type NOT IN ('Numeric', 'Id', 'DateTime'))::INT + coalesce(abs(sk) > 2, false)::INT + coalesce(ratio > 0.01 AND ratio <= 0.05, false)::INT + (cat AND top * uniq > 5)::INT + coalesce(zero / rows > 0.3, false)::INT) AS i,
0.3 * avg(np) / 100 + 0.4 * max(np) / 100 + 0.3 * count(*) FILTER (WHERE np > 20) / count(*) AS nulls,
0.4 * least(coalesce(avg(ratio) FILTER (WHERE num AND off > 0), 0) * 10, 1) + 0.4 * least(coalesce(max(ratio) FILTER (WHERE num AND off > 0), 0) * 5, 1) + 0.2 * count(*) FILTER (WHERE num AND ratio > 0.05) / count(*) FILTER (WHERE num) AS outliers,
(0.3 * count(*) FILTER (WHERE num AND abs(sk) > 2) + 0.4 * count(*) FILTER (WHERE num AND abs(sk) > 5) + 0.3 * count(*) FILTER (WHERE num AND abs(ku) > 7)) / count(*) FILTER (WHERE num) AS distribution,
0.5 * count(*) FILTER (WHERE uniq <= 1) / count(*) + 0.3 * count(*) FILTER (WHERE up > 95 AND inferred_type <> 'Id') / count(*) + 0.2 * count(*) FILTER (WHERE cat AND up > 50) / count(*) FILTER (WHERE cat) AS cardinality,
CASE WHEN count(*) / max(rows) > 0.1 THEN 0.3 ELSE 0 END + CASE WHEN count(*) FILTER (WHERE num) / count(*) < 0.1 AND count(*) > 5 THEN 0.1 ELSE 0 END AS schema FROM p),
s AS (SELECT 0.3 * least(w / greatest(k * 0.5, 1), 1) + 0.1 * least(i / k, 1) AS alerts, nulls, outliers, distribution, cardinality, schema FROM a), t AS (SELECT *, round(0.25 * alerts + 0.15 * nulls + 0.2 * outliers + 0.15 * distribution + 0.1 * cardinality + 0.15 * schema, 4) AS score FROM s)
SELECT round(alerts, 4)::DOUBLE AS alerts, round(nulls, 4)::DOUBLE AS nulls, round(outliers, 4)::DOUBLE AS outliers, round(distribution, 4)::DOUBLE AS distribution, round(cardinality, 4)::DOUBLE AS cardinality, round(schema, 4)::DOUBLE AS schema, score::DOUBLE AS score,
CASE WHEN score < 0.1 THEN 'Excellent' WHEN score < 0.2 THEN 'Good' WHEN score < 0.35 THEN 'Fair' WHEN score < 0.5 THEN 'Concerning' WHEN score < 0.7 THEN 'Poor' ELSE 'Critical' END AS label FROM t""")
def anomaly_score(t: Tables) -> DataFrame:
    typed = prof.typed(prof.profile(t.orders))
    return rounded(prof.anomaly_score(typed, prof.alerts(typed)))


FORM_SQL = "\nUNION ALL\n".join(f"SELECT '{c}' AS column_name, '{name}' AS form, round(100.0 * count(*) FILTER (WHERE regexp_matches({c}, '{rx}')) / count({c}), 1) AS percent FROM {table}" for table, c in (("pages", "url"), ("customer", "c_name")) for name, rx in patterns.FORMS.items())


@query(f"SELECT * FROM ({FORM_SQL}) WHERE percent >= 10")
def text_patterns(t: Tables) -> DataFrame:
    return patterns.form_rates(t.pages, ["url"]).unionByName(patterns.form_rates(t.customer, ["c_name"]))


@query("""WITH s AS (SELECT replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '[^A-Za-z0-9\\s]+', '~', 'g'), '[A-Za-z]+', 'A', 'g'), '[0-9]+', 'N', 'g'), '\\s+', 'W', 'g'), '~', 'S') AS shape, count(*) AS n
FROM (SELECT DISTINCT c_name AS v FROM customer WHERE length(c_name) BETWEEN 2 AND 100) GROUP BY 1 ORDER BY n DESC, shape LIMIT 5)
SELECT 'c_name' AS column_name, shape, n, round(n / (SELECT sum(n) FROM s), 4) AS share, '^' || replace(replace(replace(replace(replace(shape, 'S', '~'), 'A', '[a-zA-Z]+'), 'N', '[0-9]+'), 'W', '\\s+'), '~', '[^a-zA-Z0-9\\s]+') || '$' AS regex FROM s
WHERE n >= 0.7 * (SELECT sum(n) FROM s) ORDER BY n DESC, shape LIMIT 1""")
def novel_shapes(t: Tables) -> DataFrame:
    return rounded(patterns.novel_shape(t.customer, "c_name"))


@query("""WITH b AS (SELECT CAST(least(floor((value - lo) * 10 / (hi - lo)), 9) AS INTEGER) AS bin, count(*) AS n FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) WHERE value IS NOT NULL GROUP BY 1)
SELECT b.bin, b.n FROM b LEFT JOIN b AS p ON p.bin = b.bin - 1 LEFT JOIN b AS q ON q.bin = b.bin + 1 WHERE b.n > coalesce(p.n, 0) AND b.n > coalesce(q.n, 0)""")
def bimodality_peaks(t: Tables) -> DataFrame:
    return patterns.peaks(t.events, "value")


DIST = """SELECT '{c}' AS column_name, CASE WHEN abs(sk) < 0.5 AND abs(ku - 3) < 1 THEN 'Normal' WHEN ku < 2 AND sh > 0.4 AND sh < 0.6 THEN 'Uniform' WHEN sk > 2 AND ku > 10 THEN 'PowerLaw' WHEN sk > 0.5 AND ku > 6 THEN 'Exponential'
WHEN sk > 1 THEN 'RightSkewed' WHEN sk < -1 THEN 'LeftSkewed' ELSE 'Unknown' END AS distribution FROM (SELECT avg(power(({c} - m) / s, 3)) AS sk, avg(power(({c} - m) / s, 4)) AS ku, max(sh) AS sh
FROM {t}, (SELECT avg({c}) AS m, stddev_samp({c}) AS s, (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / (max({c}) - min({c})) AS sh FROM {t}))"""


@query(" UNION ALL ".join(DIST.format(c=c, t=t) for c, t in (("value", "events"), ("l_extendedprice", "lineitem"), ("c_acctbal", "customer"))))
def distribution_class(t: Tables) -> DataFrame:
    def one(df: DataFrame, c: str) -> DataFrame:
        both = stats.skew_kurtosis(df, [c]).join(stats.numeric_profile(df, [c]), "column_name")
        return both.select("column_name", patterns.distribution_class(F.col("skewness"), F.col("kurtosis"), F.try_divide(F.col("q75") - F.col("q25"), F.col("max") - F.col("min")), F.lit(False)).alias("distribution"))

    return one(t.events, "value").unionByName(one(t.lineitem, "l_extendedprice")).unionByName(one(t.customer, "c_acctbal"))


@query("""SELECT round(slope, 6) AS slope, round(r2, 6) AS r_squared, CASE WHEN slope > 0.001 THEN 'Increasing' WHEN slope < -0.001 THEN 'Decreasing' ELSE 'Stable' END AS direction, r2 > 0.3 OR abs(slope) > 0.001 AS reported
FROM (SELECT regr_slope(o_totalprice, d) AS slope, regr_r2(o_totalprice, d) AS r2 FROM (SELECT o_totalprice, CAST(date_diff('day', (SELECT min(o_orderdate)::DATE FROM orders), o_orderdate::DATE) AS DOUBLE) AS d FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL))""")
def trend_by_date(t: Tables) -> DataFrame:
    return rounded(patterns.trend_by_date(t.orders, "o_orderdate", "o_totalprice"), 6)


@query("""SELECT round(regr_slope(value, rn), 6) AS slope, round(regr_r2(value, rn), 6) AS r_squared, count(*) AS n FROM (SELECT value, CAST(row_number() OVER (ORDER BY event_id) AS DOUBLE) AS rn FROM events WHERE value IS NOT NULL)""")
def trend_row_order(t: Tables) -> DataFrame:
    return rounded(patterns.trend_by_order(t.events, "event_id", "value"), 6)


@query("""SELECT round(g, 4) AS median_gap, CASE WHEN g < 120 THEN 'Minute' WHEN g < 7200 THEN 'Hourly' WHEN g < 172800 THEN 'Daily' WHEN g < 864000 THEN 'Weekly' WHEN g < 5184000 THEN 'Monthly' WHEN g < 15552000 THEN 'Quarterly' ELSE 'Yearly' END AS granularity FROM (
SELECT quantile_cont(gap, 0.5) AS g FROM (SELECT CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (ORDER BY ts) AS gap FROM events WHERE ts IS NOT NULL) WHERE gap > 0)""")
def granularity(t: Tables) -> DataFrame:
    return rounded(patterns.granularity(t.events, "ts"))


@query("""SELECT expected, actual, greatest(expected - actual, 0) AS gaps, round(100.0 * greatest(expected - actual, 0) / n, 1) AS gap_percent, round(100.0 * greatest(expected - actual, 0) / n, 1) < 5 AS contiguous FROM (SELECT CAST(date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) + 1 AS BIGINT) AS expected, count(DISTINCT o_orderdate::DATE) AS actual, count(o_orderdate) AS n FROM orders)""")
def time_gaps(t: Tables) -> DataFrame:
    return patterns.time_gaps(t.orders, "o_orderdate")


@query("""SELECT count(*) AS days, round(stddev_samp(n) / avg(n), 4) AS variation, count(*) >= 5 AND stddev_samp(n) / avg(n) > 0.3 AS seasonal FROM (SELECT dayofweek(ts) AS dow, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1)""")
def seasonality_dow(t: Tables) -> DataFrame:
    return rounded(patterns.weekday_seasonality(t.events, "ts"))


ACF = """WITH h AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events WHERE value IS NOT NULL), c AS (SELECT rn, value - (SELECT avg(value) FROM h) AS c FROM h),
a AS (SELECT CAST(k AS INTEGER) AS lag, sum(x.c * y.c) / (SELECT sum(c * c) FROM c) AS acf FROM range(1, 61) r(k) JOIN c AS x ON true JOIN c AS y ON y.rn = x.rn + k GROUP BY k)"""


@query(ACF + " SELECT lag, round(acf, 4) AS acf FROM a")
def autocorrelation(t: Tables) -> DataFrame:
    return rounded(patterns.autocorrelation(t.events, ["ts", "event_id"], "value"))


@query(ACF + """ SELECT lag, round(acf, 4) AS acf, CASE WHEN lag = 7 THEN 'weekly' WHEN lag = 12 THEN 'monthly over a year' WHEN lag = 14 THEN 'fortnightly' WHEN lag = 24 THEN 'hourly over a day' WHEN lag IN (30, 31) THEN 'monthly' WHEN lag = 52 THEN 'weekly over a year' WHEN lag <= 3 THEN 'very short' WHEN lag <= 10 THEN 'short' ELSE 'long' END AS period
FROM (SELECT *, lag(acf) OVER (ORDER BY lag) AS b, lead(acf) OVER (ORDER BY lag) AS n FROM a) WHERE acf > 0.02 AND acf > b AND acf > n""")
def acf_peaks(t: Tables) -> DataFrame:
    return rounded(patterns.acf_peaks(patterns.autocorrelation(t.events, ["ts", "event_id"], "value"), least=0.02))


@query("""SELECT 'o_custkey' AS child, 'c_custkey' AS parent, count(*) AS distinct_values, count(c) AS found, round(count(c) / count(*), 4) AS overlap, count(c) / count(*) > 0.9 AS is_key FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM orders WHERE o_custkey IS NOT NULL) LEFT JOIN (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS c FROM customer) ON v = c""")
def fk_overlap(t: Tables) -> DataFrame:
    return rounded(patterns.key_overlap(t.orders, "o_custkey", t.customer, "c_custkey"))


@query("""SELECT *, CASE WHEN rising > 0.95 THEN 'Increasing' WHEN falling > 0.95 THEN 'Decreasing' ELSE 'None' END AS verdict FROM (SELECT round(avg(CASE WHEN step > 0 THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS rising, round(avg(CASE WHEN step < 0 THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS falling FROM (SELECT value - lag(value) OVER (ORDER BY event_id) AS step FROM events WHERE value IS NOT NULL) WHERE step IS NOT NULL)""")
def monotonic_share(t: Tables) -> DataFrame:
    return rounded(patterns.monotonic_share(t.events, "event_id", "value"))


@query("SELECT 'o_orderdate' AS column_name, min(o_orderdate)::DATE AS first_date, max(o_orderdate)::DATE AS last_date, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE)::INTEGER AS span_days FROM orders")
def date_ranges(t: Tables) -> DataFrame:
    return patterns.date_range(t.orders, ["o_orderdate"])


@query(f"SELECT 'ts' AS column_name, granularity, gaps, contiguous, seasonal, CASE WHEN contiguous THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM ({ORACLES['granularity']}) CROSS JOIN ({ORACLES['time_gaps'].replace('o_orderdate', 'ts').replace('FROM orders', 'FROM events')}) CROSS JOIN ({ORACLES['seasonality_dow']})")
def time_series(t: Tables) -> DataFrame:
    """Whether and how the events are a series in time."""
    return patterns.time_series_pattern(t.events)


RISK = """SELECT '{c}' AS column_name, [100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), least(100.0 * count(DISTINCT {c}) / count(*), 100), max(s), coalesce(avg(power(({c} - m) / s, 3)), 0), count(*) FILTER (WHERE {c} < q[1] - 1.5 * (q[2] - q[1]) OR {c} > q[2] + 1.5 * (q[2] - q[1])) / count({c}), 1, 0, 0, {n}, 0, 0, 0] AS f
FROM customer, (SELECT avg({c}) AS m, stddev_samp({c}) AS s, quantile_cont({c}, [0.25, 0.75]) AS q FROM customer)"""


@query(f"""WITH r AS ({' UNION ALL '.join(RISK.format(c=c, n=n) for c, n in (('c_custkey', 0), ('c_nationkey', 1), ('c_acctbal', 1)))}
UNION ALL SELECT 'c_name', [100.0 * count(*) FILTER (WHERE c_name IS NULL) / count(*), 100.0 * count(DISTINCT c_name) / count(*), 0, 0, 0, 1, avg(length(c_name)), max(length(c_name)), 0, 0, 0, 1] FROM customer
UNION ALL SELECT 'c_mktsegment', [100.0 * count(*) FILTER (WHERE c_mktsegment IS NULL) / count(*), 100.0 * count(DISTINCT c_mktsegment) / count(*), 0, 0, 0, (SELECT max(n) * count(*) / sum(n) FROM (SELECT count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment)), 0, 0, 0, 1, 0, 0] FROM customer)
SELECT column_name, CAST(i - 1 AS INTEGER) AS feature, round(f[i], 5)::DOUBLE AS value FROM (SELECT column_name, f, unnest(range(1, 13)) AS i FROM r)""")
def risk_features(t: Tables) -> DataFrame:
    """Twelve features of every column of customers."""
    own = prof.risk_vectors(prof.typed(prof.profile(t.customer)))
    return rounded(own.select("column_name", F.posexplode("features").alias("feature", "value")), 5)
