"""Queries of sources, logs and synthesis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import profile as prof
from lodestone.operators import synth
from lodestone.plans.registry import Tables, query, rounded
from lodestone.sources import logs, spec

ACCESS_LINE = "'10.0.' || (event_id % 256) || '.' || (user_id % 256) || ' - ' || CASE WHEN user_id % 3 = 0 THEN 'u' || user_id ELSE '-' END || ' [01/Jan/2024:10:00:' || lpad(CAST(event_id % 60 AS {s}), 2, '0') || ' +0000] \"GET /' || event_type || ' HTTP/1.1\" ' || (200 + event_id % 5) || ' ' || CASE WHEN event_id % 7 = 0 THEN '-' ELSE CAST(event_id AS {s}) END"


@query("""SELECT status, method, path, count(*) AS n, sum(bytes)::BIGINT AS bytes, count(usr) AS users, max(ts) AS last FROM (SELECT CAST(200 + event_id % 5 AS INTEGER) AS status, 'GET' AS method, '/' || event_type AS path, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id END AS bytes, CASE WHEN user_id % 3 = 0 THEN 1 END AS usr, TIMESTAMP '2024-01-01 10:00:00' + to_seconds(event_id % 60) AS ts FROM events) GROUP BY 1, 2, 3""")
def access_log(t: Tables) -> DataFrame:
    lines = t.events.select(F.expr(ACCESS_LINE.format(s="STRING")).alias("value"))
    parsed = logs.parse_access(lines)
    return parsed.groupBy("status", "method", "path").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.count("user").alias("users"), F.max("timestamp").cast("timestamp_ntz").alias("last"))


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 'error' ELSE 'warn' END AS level, count(*) AS n, count(*) FILTER (WHERE user_id % 2 = 0) AS clients, TIMESTAMP '2024-01-02 03:04:05' AS last FROM events GROUP BY 1")
def error_log(t: Tables) -> DataFrame:
    line = F.concat(F.lit("[Tue Jan 02 03:04:05 2024] ["), F.when(F.col("event_id") % 2 == 0, "error").otherwise("warn"), F.lit("]"), F.when(F.col("user_id") % 2 == 0, " [client 10.0.0.1]").otherwise(""), F.lit(" went wrong"))
    return logs.parse_error(t.events.select(line.alias("value"))).groupBy("level").agg(F.count("*").alias("n"), F.count("client_ip").alias("clients"), F.max("timestamp").cast("timestamp_ntz").alias("last"))


@query("SELECT CAST(200 + event_id % 5 AS VARCHAR) AS sc_status, count(*) AS n, count(CASE WHEN user_id % 3 <> 0 THEN 1 END) AS users FROM events GROUP BY 1")
def iis_log(t: Tables) -> DataFrame:
    line = F.concat_ws(" ", F.lit("2024-01-01"), F.when(F.col("user_id") % 3 == 0, "-").otherwise(F.col("user_id").cast("string")), (200 + F.col("event_id") % 5).cast("string"))
    return logs.parse_iis(t.events.select(line.alias("value")), "#Fields: date cs-username sc-status").groupBy("sc_status").agg(F.count("*").alias("n"), F.count("cs_username").alias("users"))


@query("SELECT * FROM (VALUES ('n_nationkey', 'int', true), ('n_name', 'string', true), ('n_regionkey', 'int', true)) v(column_name, column_type, nullable)")
def describe_source(t: Tables) -> DataFrame:
    return spec.describe(spec.read_source(t.spark, f"{t.directory}/nation.parquet"))


@query("SELECT * FROM (VALUES ('n_nationkey', 'INTEGER NOT NULL'), ('n_name', 'TEXT NOT NULL'), ('n_regionkey', 'INTEGER NOT NULL')) v(column_name, definition)")
def sink_types(t: Tables) -> DataFrame:
    return prof.sql_type(prof.profile(t.nation))


@query()
def synthesize(t: Tables) -> DataFrame:
    return rounded(synth.synthesize(t.orders, 1_000, ["o_totalprice", "o_custkey"], ["o_orderstatus", "o_orderpriority"], "o_orderkey"))


@query()
def synthesis_fidelity(t: Tables) -> DataFrame:
    made = synth.synthesize(t.orders, 2_000, ["o_totalprice", "o_custkey"], ["o_orderstatus", "o_orderpriority"], "o_orderkey")
    return rounded(synth.fidelity(t.orders, made, ["o_totalprice", "o_custkey"], ["o_orderstatus", "o_orderpriority"]))


@query("SELECT column_name, CASE WHEN column_name = 'c_name' THEN 'Faker' WHEN column_name = 'c_mktsegment' THEN 'CopySafe' WHEN column_name = 'c_custkey' THEN 'Sequential' WHEN column_name = 'c_nationkey' THEN 'Synthetic' ELSE 'Synthetic' END AS policy FROM (VALUES ('c_custkey'), ('c_name'), ('c_nationkey'), ('c_acctbal'), ('c_mktsegment')) v(column_name)")
def generation_policy(t: Tables) -> DataFrame:
    return prof.typed(prof.profile(t.customer)).select("column_name", synth.generation_policy(F.col("column_name"), F.col("inferred_type"), F.col("unique_percent"), F.col("distinct_count")).alias("policy"))
