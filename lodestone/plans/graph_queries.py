"""Queries of vectors, graphs, segments, sessions and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators import graph, mltools, segments, vector
from lodestone.plans.registry import Tables, query, rounded
from lodestone.streaming import sessions

COSINE = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))))"


@query(f"SELECT vec_id, round({COSINE.format(a='e.embedding', b='q.target')}, 6) AS similarity FROM embeddings e, (SELECT embedding AS target FROM embeddings WHERE vec_id = 0) q WHERE vec_id <> 0 ORDER BY {COSINE.format(a='e.embedding', b='q.target')} DESC, vec_id LIMIT 10")
def cosine_topk(t: Tables) -> DataFrame:
    return rounded(vector.top_k_of_row(t.embeddings, F.col("vec_id") == 0, 10, "vec_id", "embedding"), 6)


@query("""WITH m AS (SELECT label, dim, avg(x) AS m FROM (SELECT label, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL)
SELECT label, CAST(dim AS INTEGER) AS dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 5) AS x FROM m""")
def centroid_by_label(t: Tables) -> DataFrame:
    return rounded(vector.centroids(t.embeddings, "label", "embedding").select("label", F.posexplode("centroid").alias("dim", "x")), 5)


@query(f"""WITH m AS (SELECT label, dim, avg(x) AS m FROM (SELECT label, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY dim) AS centroid FROM m GROUP BY 1),
s AS (SELECT vec_id, c.label AS nearest, {COSINE.format(a='e.embedding', b='c.centroid')} AS similarity FROM embeddings e, c)
SELECT vec_id, nearest, round(similarity, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, nearest) AS k FROM s) WHERE k = 1""")
def nearest_centroid(t: Tables) -> DataFrame:
    return rounded(mltools.nearest_centroid(t.embeddings, vector.centroids(t.embeddings, "label", "embedding"), "vec_id", "embedding", "label"), 5)


BASKET = "(SELECT DISTINCT l_orderkey AS u, l_suppkey AS e FROM lineitem)"


@query(f"SELECT entity_a, entity_b, count(*) AS weight FROM (SELECT a.e AS entity_a, b.e AS entity_b FROM {BASKET} a JOIN {BASKET} b ON a.u = b.u AND a.e < b.e) GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY weight DESC, entity_a, entity_b LIMIT 500")
def cooccurrence_edges(t: Tables) -> DataFrame:
    return graph.cooccurrence(t.lineitem, "l_orderkey", "l_suppkey")


def _nation_edges(t: Tables) -> DataFrame:
    """Nations linked by suppliers that share orders."""
    own = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey").distinct()
    return graph.cooccurrence(own, "l_orderkey", "s_nationkey", least=2, limit=None).select(F.col("entity_a").alias("src"), F.col("entity_b").alias("dst"), "weight")


NATIONS = "n AS (SELECT DISTINCT l_orderkey AS u, s_nationkey AS e FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), g AS (SELECT a.e AS src, b.e AS dst, count(*) AS weight FROM n a JOIN n b ON a.u = b.u AND a.e < b.e GROUP BY 1, 2 HAVING count(*) >= 2)"
TREE = "SELECT c_custkey AS src, c_custkey // 10 AS dst FROM customer WHERE c_custkey > 0"


@query(f"""WITH e AS (SELECT src, dst FROM ({TREE}) UNION SELECT dst, src FROM ({TREE})), a AS (SELECT DISTINCT dst AS node FROM e WHERE src = 7 AND dst <> 7), b AS (SELECT DISTINCT dst AS node FROM e JOIN a ON src = a.node WHERE dst <> 7 AND dst NOT IN (SELECT node FROM a))
SELECT CAST(7 AS BIGINT) AS node, 0 AS hops UNION ALL SELECT node, 1 FROM a UNION ALL SELECT node, 2 FROM b""")
def graph_bfs_2hop(t: Tables) -> DataFrame:
    edges = t.customer.filter("c_custkey > 0").select(F.col("c_custkey").alias("src"), F.floor(F.col("c_custkey") / 10).alias("dst"))
    return graph.reach(edges, t.spark.range(1).select(F.lit(7).cast("bigint").alias("node")), 2)


@query(f"""WITH RECURSIVE e AS (SELECT src, dst FROM ({TREE}) UNION SELECT dst, src FROM ({TREE})), p AS (SELECT [CAST(123 AS BIGINT)] AS path UNION ALL SELECT list_append(path, dst) FROM p JOIN e ON src = path[-1] WHERE len(path) <= 3 AND NOT list_contains(path, dst))
SELECT array_to_string(path, ',') AS path FROM p WHERE path[-1] = 10 ORDER BY len(path), p.path LIMIT 1""")
def graph_path(t: Tables) -> DataFrame:
    edges = t.customer.filter("c_custkey > 0").select(F.col("c_custkey").alias("src"), F.floor(F.col("c_custkey") / 10).alias("dst"))
    return graph.shortest_path(edges, 123, 10, 3).select(F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query(f"""WITH {NATIONS}, c AS (SELECT src, dst, weight, a.n_regionkey AS ca, b.n_regionkey AS cb FROM g JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey), d AS (SELECT k, sum(weight) AS degree FROM (SELECT ca AS k, weight FROM c UNION ALL SELECT cb, weight FROM c) GROUP BY 1), i AS (SELECT ca AS k, sum(weight) AS inside FROM c WHERE ca = cb GROUP BY 1)
SELECT round(sum(coalesce(inside, 0) / m - (degree / (2 * m)) ^ 2), 5) AS modularity, count(*) AS communities FROM d LEFT JOIN i USING (k), (SELECT sum(weight)::DOUBLE AS m FROM c)""")
def modularity(t: Tables) -> DataFrame:
    communities = t.nation.select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))
    return rounded(graph.modularity(_nation_edges(t), communities), 5)


@query()
def community_labels(t: Tables) -> DataFrame:
    return graph.communities(_nation_edges(t))


@query("WITH RECURSIVE c AS (SELECT c_custkey AS ancestor, c_custkey AS descendant, 0 AS depth FROM customer WHERE c_custkey > 0 UNION ALL SELECT ancestor // 10, descendant, depth + 1 FROM c WHERE ancestor // 10 >= 1) SELECT * FROM c")
def comment_closure(t: Tables) -> DataFrame:
    parents = t.customer.filter("c_custkey > 0").select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") >= 10, F.floor(F.col("c_custkey") / 10)).alias("parent"))
    return graph.closure(parents)


@query(r"""WITH o AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) > 3)) AS entity FROM documents), d AS (SELECT entity, count(*) AS df, ln((SELECT count(*) FROM documents) / count(*)) AS idf FROM o GROUP BY 1)
SELECT least(df, 10) AS df_up_to_10, count(*) AS entities, round(avg(least(0.9, 0.4 + 0.05 * idf)), 4) AS confidence FROM d WHERE idf >= 3.5 GROUP BY 1""")
def entity_candidates(t: Tables) -> DataFrame:
    own = graph.rare_terms(t.documents, "doc_id", "text").select("entity", "df", "confidence").distinct()
    return rounded(own.groupBy(F.least("df", F.lit(10)).alias("df_up_to_10")).agg(F.count("*").alias("entities"), F.avg("confidence").alias("confidence")))


def _profiles(t: Tables) -> DataFrame:
    """What each customer's orders show."""
    spent = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("spent"), F.avg("o_totalprice").alias("avg_order"))
    return t.customer.join(spent, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("spent", F.lit(0.0)).alias("spent"), F.coalesce("avg_order", F.lit(0.0)).alias("avg_order"), F.col("c_acctbal").alias("balance"))


def _credit(column: str, low: float, high: float) -> str:
    return f"least(greatest((coalesce({column}, {low}) - {low}) / {high - low}, 0), 1)"


@query(f"""WITH p AS (SELECT c_custkey, coalesce(n, 0)::DOUBLE AS orders, coalesce(s, 0) AS spent, coalesce(a, 0) AS avg_order, c_acctbal AS balance FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s, avg(o_totalprice) AS a FROM orders GROUP BY 1) ON c_custkey = o_custkey),
s AS (SELECT c_custkey, 'high value' AS segment, {_credit('spent', 500000, 2000000)} AS score FROM p UNION ALL SELECT c_custkey, 'frequent', {_credit('orders', 5, 20)} FROM p UNION ALL SELECT c_custkey, 'big baskets', {_credit('avg_order', 100000, 200000)} FROM p
UNION ALL SELECT c_custkey, 'loyal', (2 * {_credit('orders', 5, 20)} + {_credit('spent', 500000, 2000000)}) / 3 FROM p UNION ALL SELECT c_custkey, 'loyal and rich', least({_credit('orders', 5, 20)}, {_credit('balance', 0, 8000)}) FROM p UNION ALL SELECT c_custkey, 'worth a look', greatest({_credit('avg_order', 100000, 300000)}, {_credit('balance', 5000, 10000)}) FROM p)
SELECT c_custkey, segment, round(score, 3)::DOUBLE AS score, CASE WHEN round(score, 3) >= 0.8 THEN 'high' WHEN round(score, 3) >= 0.6 THEN 'medium' ELSE 'low' END AS confidence FROM s WHERE round(score, 3) >= 0.5""")
def segment_membership(t: Tables) -> DataFrame:
    return segments.memberships(_profiles(t), "c_custkey")


@query("SELECT o_custkey, round(sum(0.98 ^ date_diff('day', o_orderdate::DATE, DATE '1998-12-31')), 4) AS interest FROM orders WHERE o_orderdate <= TIMESTAMP '1998-12-31' GROUP BY 1")
def interest_decay(t: Tables) -> DataFrame:
    now = F.lit("1998-12-31").cast("date")
    return rounded(t.orders.filter(F.col("o_orderdate") <= now.cast("timestamp_ntz")).groupBy("o_custkey").agg(F.sum(segments.decayed(F.lit(1.0), F.datediff(now, F.to_date("o_orderdate")))).alias("interest")))


def _shop(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Interests of customers in brands, parts with their popularity, and what each customer has had."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    mine = lines.groupBy("o_custkey", "p_brand").agg(F.sum("l_quantity").alias("q"))
    total = mine.groupBy("o_custkey").agg(F.sum("q").alias("all"))
    sold = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"))
    most = F.broadcast(sold.agg(F.max("n").alias("most")))  # one row
    items = t.part.join(sold, F.col("p_partkey") == F.col("l_partkey"), "left").crossJoin(most).select("p_partkey", "p_brand", (F.coalesce("n", F.lit(0)) / F.col("most")).alias("popularity"))
    return mine.join(total, "o_custkey").select("o_custkey", "p_brand", (F.col("q") / F.col("all")).alias("weight")), items, lines.select("o_custkey", "p_partkey")


@query("""WITH l AS (SELECT o_custkey, p_brand, p_partkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), i AS (SELECT o_custkey, p_brand, sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY o_custkey) AS weight FROM l GROUP BY 1, 2), s AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1),
a AS (SELECT p_partkey, p_brand, coalesce(n, 0) / (SELECT max(n) FROM s) AS popularity FROM part LEFT JOIN s ON p_partkey = l_partkey),
m AS (SELECT o_custkey, p_partkey, 0.8 * weight + 0.2 * popularity AS score FROM i JOIN a USING (p_brand) WHERE (o_custkey, p_partkey) NOT IN (SELECT o_custkey, p_partkey FROM l))
SELECT o_custkey, p_partkey, round(score, 4) AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, p_partkey) AS place FROM m) WHERE place <= 3""")
def recommend_topk(t: Tables) -> DataFrame:
    interests, items, seen = _shop(t)
    return rounded(segments.recommend(interests, items, seen, "o_custkey", "p_partkey", "p_brand", 3))


@query("SELECT date_trunc('month', ts)::TIMESTAMP AS month, count(*) FILTER (WHERE event_type = 'view') AS n_view, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def event_funnel(t: Tables) -> DataFrame:
    own = t.events.withColumn("month", F.date_trunc("month", "ts").cast("timestamp_ntz"))
    return segments.funnel(own, ["month"], "event_type", "user_id", ["view", "click", "purchase"])


@query("SELECT 0 AS by_status, o_orderpriority AS name, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 1, o_orderstatus, count(*) FROM orders GROUP BY 2")
def queue_stats(t: Tables) -> DataFrame:
    return segments.queue_stats(t.orders, "o_orderstatus", "o_orderpriority")


@query("SELECT o_orderstatus, o_orderpriority, o_orderdate, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def next_job(t: Tables) -> DataFrame:
    return segments.next_jobs(t.orders, "o_orderstatus", "o_orderpriority", "o_orderdate", "o_orderkey")


@query(r"SELECT host, sum(n)::BIGINT AS hits, max_by(url, (n, url)) AS top_url FROM (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, url, sum(length(html)) AS n FROM pages GROUP BY ALL) WHERE host <> '' GROUP BY 1")
def referrer_rollup(t: Tables) -> DataFrame:
    return segments.referrers(t.pages, "url", F.length("html").cast("long"))


GAPS = "SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)"


@query(f"SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS events, round(sum(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'add_to_cart' THEN 0.35 WHEN 'click' THEN 0.1 WHEN 'view' THEN 0.05 ELSE 0.05 END), 4)::DOUBLE AS weight FROM ({GAPS}) GROUP BY user_id, s")
def sessionize_30m(t: Tables) -> DataFrame:
    own = sessions.sessions(sessions.timed(t.events))
    return rounded(own.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz")))


@query("WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 1800 THEN 1 WHEN lag(t) OVER (PARTITION BY user_id ORDER BY t) IS NULL THEN 1 ELSE 0 END AS fresh FROM e), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS s FROM f), p AS (SELECT *, (t - min(t) OVER (PARTITION BY user_id, s)) // 86400 AS part FROM s) SELECT user_id, min(t) AS start, max(t) AS last, count(*) AS events FROM p GROUP BY user_id, s, part")
def capped_sessions(t: Tables) -> DataFrame:
    return sessions.capped_sessions(t.events)


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(t: Tables) -> DataFrame:
    own = sessions.tumbling_counts(sessions.timed(t.events))
    return rounded(own.withColumn("start", F.col("start").cast("timestamp_ntz")))


@query("SELECT user_id, event_id, t, recent FROM (SELECT user_id, event_id, t, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS recent FROM (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)) WHERE recent >= 3")
def sliding_anomaly(t: Tables) -> DataFrame:
    return sessions.sliding_alarms(t.events, width_s=86_400, least=3)


@query("SELECT user_id, t AS opened, back + 172800 AS closes FROM (SELECT user_id, t, lag(t, 2) OVER (PARTITION BY user_id ORDER BY t) AS back FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type = 'purchase')) WHERE t - back <= 172800")
def circuit_breaker(t: Tables) -> DataFrame:
    return sessions.breaker(t.events.filter("event_type = 'purchase'"), "user_id", least=3, width_s=172_800)


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS period, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 1")
def unique_visitors(t: Tables) -> DataFrame:
    own = sessions.unique_users(t.events)
    return own.withColumn("period", F.col("period").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 10")
def top_n_metrics(t: Tables) -> DataFrame:
    return sessions.top_metrics(t.events, "event_type")


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def streamed_counts(t: Tables) -> DataFrame:
    """The tumbling counts, from a stream that is read to its end."""
    schema = T.StructType([f for f in t.events.schema.fields])
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.directory)
    counts = sessions.complete_result(sessions.tumbling_counts(sessions.timed(stream, late="1 day")), "streamed-counts")
    return rounded(counts.withColumn("start", F.col("start").cast("timestamp_ntz")))
