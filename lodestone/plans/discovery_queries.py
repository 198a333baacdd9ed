"""Queries that find structure: keys, names that mean the same, anchors, and profiles that expired sessions add to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import tokens
from lodestone.operators import keys, naming, proximity, vector
from lodestone.plans.graph_queries import COSINE
from lodestone.plans.registry import Tables, query, rounded
from lodestone.sources.scratch import scratch_path
from lodestone.streaming import sessions, stateful

#: Columns of whole numbers, text and dates of all tables.
COLUMNS = {
    "benchmark": "item_id text", "conversations": "conv_id turn role text", "customer": "c_custkey c_name c_nationkey c_mktsegment", "documents": "doc_id text lang source n_chars", "embeddings": "vec_id label",
    "events": "event_id user_id event_type props", "labels": "doc_id quality toxic", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_returnflag l_linestatus", "nation": "n_nationkey n_name n_regionkey",
    "orders": "o_orderkey o_custkey o_orderstatus o_orderpriority", "pages": "page_id url html", "part": "p_partkey p_name p_brand p_type p_size", "region": "r_regionkey r_name", "supplier": "s_suppkey s_name s_nationkey",
}
VALUES = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, CAST({c} AS VARCHAR) AS v FROM {t}" for t, columns in COLUMNS.items() for c in columns.split())


@query(f"""WITH own AS (SELECT * FROM ({VALUES}) WHERE v IS NOT NULL), stats AS (SELECT t, c, count(*) AS n, count(DISTINCT v) AS d FROM own GROUP BY ALL HAVING max(length(v)) <= 64), each AS (SELECT DISTINCT t, c, v FROM own JOIN stats USING (t, c)),
met AS (SELECT a.t AS ta, a.c AS ca, b.t AS tb, b.c AS cb, count(*) AS found FROM each a JOIN (SELECT each.* FROM each JOIN stats USING (t, c) WHERE n = d) b ON a.v = b.v WHERE (a.t, a.c) <> (b.t, b.c) GROUP BY ALL)
SELECT ta AS child_table, ca AS child_column, tb AS parent_table, cb AS parent_column, d AS distinct_values, found, found / d AS overlap FROM met JOIN stats ON t = ta AND c = ca WHERE d > 1 AND found > 0.9 * d""")
def key_discovery(t: Tables) -> DataFrame:
    """Every pair of columns, over all tables, of which one refers to the other."""
    return keys.discover_keys({name: getattr(t, name) for name in COLUMNS})


FOLD = "list_reduce({names}, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: 1 - levenshtein(lower(x), lower(y)) / greatest(length(x), length(y))::DOUBLE >= 0.7 - 1e-9)) > 0 THEN acc ELSE list_append(acc, x) END, CAST([] AS VARCHAR[]))"


@query(f"""WITH n AS (SELECT p_name AS name, count(*) AS mentions FROM part GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY mentions DESC, name) AS place FROM n), led AS (SELECT {FOLD.format(names='list(name ORDER BY place)')} AS leaders FROM o),
l AS (SELECT name, place FROM o WHERE name IN (SELECT unnest(leaders) FROM led)),
j AS (SELECT o.name, o.mentions, CAST(o.place AS BIGINT) AS place, min_by(l.name, l.place) AS leader_name FROM o JOIN l ON l.place <= o.place AND 1 - levenshtein(lower(o.name), lower(l.name)) / greatest(length(o.name), length(l.name))::DOUBLE >= 0.7 - 1e-9 GROUP BY ALL)
SELECT * FROM j""")
def part_names(t: Tables) -> DataFrame:
    """Names of parts, the most frequent first, each with the one that stands for it."""
    names = t.part.groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("mentions")).withColumn("__less", -F.col("mentions"))
    return naming.normalised(names, ["__less", "name"], 0.7).select("name", "mentions", "place", "leader_name")


def _terms(t: Tables) -> DataFrame:
    """Terms of more than three characters of all documents and how many documents have each."""
    own = t.documents.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text"), 3))).alias("name"))
    return own.groupBy("name").agg(F.count("*").alias("mentions")).withColumn("__less", -F.col("mentions"))


@query()
def term_entities(t: Tables) -> DataFrame:
    """Entities of the documents' terms: a term with those that a greedy pass by frequency merges into it."""
    own = naming.normalised(_terms(t), ["__less", "name"])
    return own.groupBy("leader_name").agg(F.count("*").alias("names"), F.sum("mentions").alias("mentions"), F.min("place").alias("place"))


@query()
def term_groups(t: Tables) -> DataFrame:
    """The same, where a term joins the group of the term before it that it resembles most."""
    own = naming.normalised(_terms(t), ["__less", "name"], 0.85, by_best=True)
    return own.groupBy("leader_name").agg(F.count("*").alias("names"), F.sum("mentions").alias("mentions"), F.min("place").alias("place"))


def _anchor_sql(k: int) -> str:
    """Farthest-first choice of ``k`` vectors, a step a table."""
    steps = ["a1 AS (SELECT 1 AS place, vec_id, embedding, CAST(NULL AS DOUBLE) AS distance FROM embeddings ORDER BY vec_id LIMIT 1)"]
    for i in range(2, k + 1):
        so_far = " UNION ALL ".join(f"SELECT * FROM a{j}" for j in range(1, i))
        steps.append(f"a{i} AS (SELECT {i} AS place, e.vec_id, any_value(e.embedding) AS embedding, min(1 - {COSINE.format(a='e.embedding', b='a.embedding')}) AS distance FROM embeddings e, ({so_far}) a WHERE e.vec_id NOT IN (SELECT vec_id FROM ({so_far})) GROUP BY e.vec_id ORDER BY distance DESC, vec_id LIMIT 1)")
    return f"WITH {', '.join(steps)} SELECT place, vec_id, round(distance, 6) AS distance FROM ({' UNION ALL '.join(f'SELECT * FROM a{i}' for i in range(1, k + 1))})"


@query(_anchor_sql(6))
def topic_anchors(t: Tables) -> DataFrame:
    """Six vectors that lie farthest from each other."""
    return rounded(vector.anchors(t.embeddings, 6, "vec_id", "embedding"), 6)


def _events(t: Tables, late: str) -> DataFrame:
    """The events as a stream."""
    schema = T.StructType(list(t.events.schema.fields))
    return sessions.timed(t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.directory), late=late)


EXPIRED = """e AS (SELECT user_id, epoch_us(ts) AS t, event_type, CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'add_to_cart' THEN 0.35 WHEN 'click' THEN 0.1 ELSE 0.05 END::DOUBLE AS w FROM events WHERE ts IS NOT NULL),
f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM e WHERE user_id IS NOT NULL), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS s FROM f),
p AS (SELECT *, min(t) OVER (PARTITION BY user_id, s) AS first, (t - min(t) OVER (PARTITION BY user_id, s)) // 86400000000 AS part FROM g),
k AS (SELECT user_id, s, part, event_type, sum(w) AS w FROM p GROUP BY ALL), x AS (SELECT user_id, s, part, min(t) AS start, max(t) AS last, count(*) AS signals, count(*) FILTER (WHERE event_type = 'purchase') AS carts, sum(w) AS weight, min(first) AS first FROM p GROUP BY ALL),
z AS (SELECT * FROM x WHERE least(last + 1800000000, first + (part + 1) * 86400000000) <= (SELECT max(t) // 1000 * 1000 - 3600000000 FROM e))"""


@query(f"WITH {EXPIRED} SELECT user_id, make_timestamp(start) AS start, make_timestamp(last) AS last, signals, carts, round(weight, 4) AS weight FROM z")
def expired_sessions(t: Tables) -> DataFrame:
    """Sessions that the watermark of the events' stream has closed, by timers over keyed state."""
    closed = stateful.appended(stateful.expired_sessions(_events(t, "1 hour"), carts=("purchase",)), scratch_path(t.spark, "expired-sessions"))
    return rounded(closed.drop("interests").withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("last", F.col("last").cast("timestamp_ntz")))


@query(f"""WITH {EXPIRED}, l AS (SELECT c_custkey AS profile_id FROM customer WHERE c_acctbal >= 0), c AS (SELECT user_id AS profile_id, count(*) AS sessions, sum(signals)::BIGINT AS signals, sum(carts)::BIGINT AS carts, make_timestamp(max(last)) AS last_seen FROM z WHERE user_id IN (SELECT profile_id FROM l) GROUP BY 1),
i AS (SELECT user_id AS profile_id, event_type AS category, round(max(w), 4) AS score FROM z JOIN k USING (user_id, s, part) GROUP BY ALL) SELECT * FROM c JOIN i USING (profile_id)""")
def session_elevation(t: Tables) -> DataFrame:
    """Profiles of the customers that have one, with what their expired sessions added, an interest a row."""
    links = t.customer.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("user_id"), F.col("c_custkey").alias("profile_id"))
    log = stateful.elevate(stateful.expired_sessions(_events(t, "1 hour"), carts=("purchase",)), links, scratch_path(t.spark, "session-elevation"))
    return rounded(log.read().select("profile_id", "sessions", "signals", "carts", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), F.explode("interests").alias("category", "score")))


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), r AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS recent FROM e)
SELECT user_id, event_id, make_timestamp(t) AS at, recent FROM r WHERE recent >= 3 AND t <= (SELECT max(t) // 1000 * 1000 - 3600000000 FROM e)""")
def streamed_alarms(t: Tables) -> DataFrame:
    """Events at which a user has had three or more within a day, from the stream's ring of signals."""
    found = stateful.appended(stateful.signal_alarms(_events(t, "1 hour"), width=86_400, least=3, age=86_400), scratch_path(t.spark, "streamed-alarms"))
    return found.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query()
def graph_neighbours(t: Tables) -> DataFrame:
    """The twenty most similar vectors of every twentieth, from a walk over a proximity graph."""
    graph = proximity.build_graph(t.embeddings, "vec_id", "embedding")
    asked = t.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return rounded(proximity.search_graph(graph, asked, own=F.col("query") == F.col("node")), 6)
