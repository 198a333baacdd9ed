"""Queries of joins, groupings and choices of rows, and of profiles over time."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import graph, history, ordering, relations, retrieval, search, segments
from lodestone.plans.graph_queries import NATIONS, _nation_edges, _profiles
from lodestone.plans import graph_queries, text_queries  # noqa: F401  their SQL is part of some here
from lodestone.plans.registry import ORACLES, Tables, query, rounded

LEV = "(1 - levenshtein(lower({a}), lower({b})) / greatest(length({a}), length({b}))::DOUBLE)"
EARLY, LATE = "o_orderdate < TIMESTAMP '1996-01-01'", "o_orderdate >= TIMESTAMP '1996-01-01'"


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Orders before and since a date."""
    return t.orders.filter("o_orderdate < timestamp_ntz '1996-01-01'"), t.orders.filter("o_orderdate >= timestamp_ntz '1996-01-01'")


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders")
def chosen_columns(t: Tables) -> DataFrame:
    return relations.chosen_columns(t.orders, ["O_ORDERKEY", "o_totalprice", "o_custkey"], ["o_custkey"], "o_orderpriority")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer ORDER BY customer.c_custkey LIMIT 5")
def sample_rows(t: Tables) -> DataFrame:
    return relations.sample_rows(t.customer.drop("c_acctbal"), "c_custkey")


@query()
def random_sample(t: Tables) -> DataFrame:
    return relations.random_sample(t.orders, "o_orderkey", 500)


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%11%' OR c_name ILIKE '%22%' OR c_mktsegment ILIKE '%11%' OR c_mktsegment ILIKE '%22%'")
def named_any(t: Tables) -> DataFrame:
    return search.ask(t.customer, "customers named 11 or 22").select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE p_size IN (3, 7, 20) AND len(list_filter(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}_]+'), lambda x: contains(x, 'in'))) > 0")
def category_tags(t: Tables) -> DataFrame:
    return relations.in_categories(t.part, "p_size", [3, 7, 20], relations.tags_of("p_name"), "IN").select("p_partkey")


@query("SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R' GROUP BY 1")
def segment_filter(t: Tables) -> DataFrame:
    return t.lineitem.where("l_quantity > 30 AND l_returnflag = 'R'").groupBy("l_linestatus").agg(F.count("*").alias("n"))


@query(f"WITH {NATIONS} SELECT g.src, g.dst, weight, a.n_name AS src_name, b.n_name AS dst_name FROM g JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey WHERE src = 3 OR dst = 3")
def entity_neighbourhood(t: Tables) -> DataFrame:
    return relations.neighbourhood(_nation_edges(t), t.nation, "n_nationkey", "n_name", 3)


@query("SELECT r_regionkey, r_name, count(n_name) AS n, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS members FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1, 2")
def community_members(t: Tables) -> DataFrame:
    return relations.members(t.region, t.nation.withColumnRenamed("n_regionkey", "r_regionkey"), "r_regionkey", "n_name")


@query("WITH s AS (SELECT DISTINCT p_name AS slug FROM part), h AS (SELECT p_name AS slug, count(*) FILTER (WHERE p_size > 45) AS hits FROM part GROUP BY 1) SELECT slug, round(" + LEV.format(a="slug", b="'red gadget'") + " + least(0.3, 0.1 * coalesce(hits, 0)), 4)::DOUBLE AS score FROM s LEFT JOIN h USING (slug)")
def learned_redirects(t: Tables) -> DataFrame:
    learned = t.part.groupBy(F.col("p_name").alias("slug")).agg(F.count_if(F.col("p_size") > 45).alias("hits"))
    return rounded(relations.suggestions(t.part.select(F.col("p_name").alias("slug")).distinct(), "slug", "red gadget", learned))


@query("SELECT page_id, name FROM pages, (SELECT DISTINCT lower(name) AS name FROM (SELECT lang AS name FROM documents UNION ALL SELECT source FROM documents UNION ALL SELECT r_name FROM region UNION ALL SELECT event_type FROM events)) WHERE contains(lower(html), name)")
def contained_names(t: Tables) -> DataFrame:
    named = lambda df, c: df.select(F.col(c).alias("name"))
    names = named(t.documents, "lang").union(named(t.documents, "source")).union(named(t.region, "r_name")).union(named(t.events, "event_type"))
    return relations.containing(t.pages, "page_id", "html", names, "name")


@query("""WITH a AS (SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') THEN 1.0 ELSE 0 END + CASE WHEN starts_with(lower(p_name), 'red') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(p_type), 'red') THEN 0.7 ELSE 0 END + CASE WHEN contains(lower(p_brand), 'red') THEN 0.6 ELSE 0 END AS score FROM part), b AS (SELECT p_partkey, p_size / 50.0 AS score FROM part WHERE p_size >= 45)
SELECT p_partkey, round(CASE WHEN a.score IS NOT NULL AND b.score IS NOT NULL THEN 1.5 * greatest(a.score, b.score) ELSE coalesce(a.score, b.score) END, 4)::DOUBLE AS score FROM (SELECT * FROM a WHERE score > 0) a FULL JOIN b USING (p_partkey)""")
def hybrid_products(t: Tables) -> DataFrame:
    by_text = t.part.select("p_partkey", relations.text_match(F.col("p_name"), F.col("p_type"), F.col("p_brand"), "red").alias("score")).filter("score > 0")
    return rounded(relations.merged_scores(by_text, t.part.filter("p_size >= 45").select("p_partkey", (F.col("p_size") / 50).alias("score")), "p_partkey"))


@query(f"WITH {NATIONS} SELECT DISTINCT node FROM (SELECT src AS node FROM g UNION ALL SELECT dst FROM g) WHERE node NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def unseen_nodes(t: Tables) -> DataFrame:
    return relations.unseen(relations.nodes(_nation_edges(t)), t.nation.filter("n_regionkey = 2").select(F.col("n_nationkey").alias("node")), "node")


@query(f"SELECT segment, count(*) AS members, round(avg(score), 4) AS score, round(avg(coalesce(n, 0)), 4) AS orders, round(avg(coalesce(s, 0)), 2) AS spent FROM ({ORACLES['segment_membership']}) LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1) ON c_custkey = o_custkey GROUP BY 1")
def segment_stats(t: Tables) -> DataFrame:
    own = _profiles(t)
    stats = relations.group_stats(segments.memberships(own, "c_custkey"), own, "c_custkey", ["orders", "spent"])
    return stats.select("segment", "members", F.round("score", 4).alias("score"), F.round("orders", 4).alias("orders"), F.round("spent", 2).alias("spent"))


@query(r"SELECT path, sum(v)::BIGINT AS views FROM (SELECT regexp_replace(regexp_extract(url, '://[^/]+([^?#]*)', 1), '\.[a-z]{2}$', '') AS path, length(html) AS v FROM pages) WHERE starts_with(path, '/en/') GROUP BY 1 ORDER BY views DESC, path LIMIT 10")
def popular_pages(t: Tables) -> DataFrame:
    return relations.popular(t.pages, "url", F.length("html").cast("long"), "/en/")


@query("SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS \"values\" FROM documents GROUP BY 1")
def languages_of_sources(t: Tables) -> DataFrame:
    return relations.values_of(t.documents, "source", "lang")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) WHERE length(word) >= 3 AND starts_with(word, 'g') GROUP BY 1 ORDER BY n DESC, word LIMIT 10")
def word_suggestions(t: Tables) -> DataFrame:
    return relations.word_suggestions(t.part, "p_name", "g")


@query(r"""WITH o AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) > 3)) AS entity FROM documents), d AS (SELECT entity, count(*) AS df, ln((SELECT count(*) FROM documents) / count(*)) AS idf FROM o GROUP BY 1), c AS (SELECT entity, df AS mentions, least(0.9, 0.4 + 0.05 * idf) AS confidence FROM d WHERE idf >= 3.5)
SELECT mentions, count(*) AS entities FROM (SELECT * FROM c WHERE mentions >= 3 OR (confidence >= 0.8 AND mentions >= 2) ORDER BY mentions * confidence DESC, entity LIMIT 500) GROUP BY 1""")
def significant_entities(t: Tables) -> DataFrame:
    return relations.significant(graph.rare_terms(t.documents, "doc_id", "text")).groupBy("mentions").agg(F.count("*").alias("entities"))


@query(f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(regexp_extract(link, '://([^/?#:]+)', 1)), '(^|\\.)github\\.com$') THEN 'github' WHEN contains(link, '/blog/') THEN 'blog' ELSE 'site' END AS kind FROM ({ORACLES['page_links']})) GROUP BY 1")
def link_kinds(t: Tables) -> DataFrame:
    return retrieval.links(t.pages).groupBy(relations.link_kind(F.col("link")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {NATIONS} SELECT src, dst, weight * 2 AS weight FROM g")
def upserted_edges(t: Tables) -> DataFrame:
    return relations.upserted_edges(_nation_edges(t), _nation_edges(t)).withColumn("weight", F.col("weight").cast("bigint"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 100")
def outbox_poll(t: Tables) -> DataFrame:
    return relations.outbox(t.events.withColumn("done", F.col("event_type") != "error"), "done", ["ts", "event_id"]).select("event_id", "user_id")


@query(f"WITH p AS (SELECT p_partkey, p_retailprice * cos(p_size * {2 * math.pi / 50}) AS x, p_retailprice * sin(p_size * {2 * math.pi / 50}) AS y FROM part), e AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM p) SELECT p_partkey, round(2 * (x - a) / (b - a) - 1, 4) AS x, round(2 * (y - c) / (d - c) - 1, 4) AS y FROM p, e")
def polar_projection(t: Tables) -> DataFrame:
    return rounded(relations.projected(t.part, "p_partkey", F.col("p_size") * (2 * math.pi / 50), F.col("p_retailprice")))


@query("WITH w AS (SELECT DISTINCT p_partkey, unnest(regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand), '[\\p{L}\\p{N}_]+')) AS tag FROM part) SELECT p_partkey, count(*) AS shared FROM w WHERE p_partkey <> 17 AND tag IN (SELECT tag FROM w WHERE p_partkey = 17) GROUP BY 1 ORDER BY shared DESC, p_partkey LIMIT 5")
def similar_products(t: Tables) -> DataFrame:
    items = t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("all"))
    return relations.similar_by_tags(items, "p_partkey", relations.tags_of("all"), 17)


@query("WITH p AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS a, CAST(o_custkey AS VARCHAR) AS b FROM orders) SELECT o_orderkey, round(greatest(" + LEV.format(a="a", b="b") + ", CASE WHEN a = b THEN 1.0 WHEN greatest(a::DOUBLE, b::DOUBLE) = 0 THEN 0 ELSE 1 - abs(a::DOUBLE - b::DOUBLE) / greatest(abs(a::DOUBLE), abs(b::DOUBLE)) END), 4)::DOUBLE AS similarity FROM p")
def numeric_similarity(t: Tables) -> DataFrame:
    return rounded(t.orders.select("o_orderkey", relations.numeric_similarity(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("similarity")))


@query("WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id FROM p WHERE n <= 5 OR rn = 1 OR floor((rn - 1) * 4 / (n - 1)) > floor((rn - 2) * 4 / (n - 1))")
def stratified_rows(t: Tables) -> DataFrame:
    return relations.stratified(t.events, "user_id", ["ts", "event_id"], 5).select("user_id", "event_id")


@query(f"SELECT date_diff('day', (SELECT min(o_orderdate)::DATE FROM orders WHERE {EARLY}), (SELECT min(o_orderdate)::DATE FROM orders WHERE {LATE}))::INTEGER AS start_shift, date_diff('day', (SELECT max(o_orderdate)::DATE FROM orders WHERE {EARLY}), (SELECT max(o_orderdate)::DATE FROM orders WHERE {LATE}))::INTEGER AS end_shift")
def date_shift(t: Tables) -> DataFrame:
    return history.date_shift(*_halves(t), "o_orderdate")


SKEW = "(avg(power({c}, 3)) - 3 * avg({c}) * avg(power({c}, 2)) + 2 * power(avg({c}), 3)) / power(stddev_pop({c}), 3)"
CHANGES = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, (nb - na)::DOUBLE AS null_points, 100 * abs((mb - ma) / abs(ma)) AS mean_percent, 100 * abs((sb - sa) / abs(sa)) AS std_percent, kb - ka AS skew_delta FROM (SELECT 100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*) AS na, avg({c}) AS ma, stddev_samp({c}) AS sa, {SKEW.format(c=f'{c}::DOUBLE')} AS ka FROM orders WHERE {EARLY}), (SELECT 100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*) AS nb, avg({c}) AS mb, stddev_samp({c}) AS sb, {SKEW.format(c=f'{c}::DOUBLE')} AS kb FROM orders WHERE {LATE})"
    for c in ("o_orderkey", "o_custkey", "o_totalprice")
)


@query(f"SELECT column_name, round(null_points, 3) AS null_points, round(mean_percent, 3) AS mean_percent, round(std_percent, 3) AS std_percent, round(skew_delta, 3) AS skew_delta, abs(null_points) > 10 OR mean_percent > 10 OR std_percent > 20 OR abs(skew_delta) > 0.5 AS significant FROM ({CHANGES})")
def significant_changes(t: Tables) -> DataFrame:
    return rounded(history.significant_changes(history.moment_changes(*_halves(t), ["o_orderkey", "o_custkey", "o_totalprice"])), 3)


@query("WITH c AS (SELECT label, dim, avg(x) AS m FROM (SELECT label, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL), w AS (SELECT dim, m FROM c WHERE label = 0) SELECT label, round(sqrt(sum((c.m - w.m) ^ 2)) / sqrt(count(*)), 5) AS distance FROM c JOIN w USING (dim) GROUP BY 1")
def nearest_profiles(t: Tables) -> DataFrame:
    means = t.embeddings.select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    own = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda p: p["m"]).alias("v"))
    return rounded(history.nearest_profile(own, "label", "v", own.filter("label = 0")), 5)


@query("SELECT round((0.15 * 4 / 5 + 0.2 * 4 / 5 + 0.1 * (CASE WHEN floor(log10((SELECT count(*) FROM customer))) = floor(log10((SELECT count(*) FROM supplier))) THEN 1 ELSE 0 END) + 0.35 * 0 / 9) / 0.8, 4)::DOUBLE AS similarity, 'other' AS match")
def signature_likeness(t: Tables) -> DataFrame:
    return rounded(history.signature_similarity(history.signature(t.customer), history.signature(t.supplier)))


@query("SELECT count(*) AS versions, count(DISTINCT schema_hash) AS schemas FROM (SELECT v, sha256(string_agg(lower(column_name) || ':' || data_type, ',' ORDER BY lower(column_name) || ':' || data_type)) AS schema_hash FROM information_schema.columns, (SELECT unnest([1, 2]) AS v) WHERE table_name IN ('orders', 'customer', 'part') GROUP BY v, table_name)")
def schema_history(t: Tables) -> DataFrame:
    own = {"orders": t.orders, "customer": t.customer, "part": t.part}
    rows = [(f"{name}-{v}", f.name if v == 1 else f.name.upper(), f.dataType.simpleString()) for name, df in own.items() for v in (1, 2) for f in df.schema.fields]
    return history.schema_hashes(t.spark.createDataFrame(rows, "table_name string, column_name string, column_type string")).agg(F.count("*").alias("versions"), F.countDistinct("schema_hash").alias("schemas"))


RESULT = "SELECT c_mktsegment, count(*) AS n, sum(c_acctbal) AS balance, CAST(avg(c_nationkey) AS VARCHAR) AS nation FROM customer GROUP BY c_mktsegment, c_nationkey"
RESULT_STATS = f"""WITH r AS ({RESULT}), l AS (SELECT 'n' AS column_name, n::DOUBLE AS value FROM r UNION ALL SELECT 'balance', balance FROM r UNION ALL SELECT 'nation', nation::DOUBLE FROM r),
s AS (SELECT column_name, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75 FROM l GROUP BY 1),
o AS (SELECT *, (SELECT count(*) FROM l WHERE l.column_name = s.column_name AND (value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25))) AS outliers FROM s)"""


def _result(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance"), F.avg("c_nationkey").cast("string").alias("nation"))


@query(f"{RESULT_STATS} SELECT column_name, n, round(min, 3) AS min, round(max, 3) AS max, round(mean, 3) AS mean, round(std, 3) AS std, round(q25, 3) AS q25, round(median, 3) AS median, round(q75, 3) AS q75, outliers FROM o")
def result_stats(t: Tables) -> DataFrame:
    return rounded(history.result_stats(_result(t), ["n", "balance", "nation", "c_mktsegment"]), 3)


@query(f"{RESULT_STATS} SELECT column_name, 'many outliers' AS flag FROM o WHERE outliers > 0.1 * n UNION ALL SELECT column_name, 'skewed' FROM o WHERE abs(mean - median) / std > 0.5 UNION ALL SELECT column_name, 'narrow' FROM o WHERE max - min < 0.01 * abs(mean)")
def result_flags(t: Tables) -> DataFrame:
    return history.result_flags(history.result_stats(_result(t), ["n", "balance", "nation", "c_mktsegment"]))


@query("SELECT column_name, p::DOUBLE AS share, round(v, 4) AS value FROM (SELECT 'l_extendedprice' AS column_name, unnest([0.25, 0.5, 0.9]) AS p, unnest(quantile_cont(l_extendedprice, [0.25, 0.5, 0.9])) AS v FROM lineitem)")
def exact_percentiles(t: Tables) -> DataFrame:
    return rounded(ordering.middle(t.lineitem, "l_extendedprice", [0.25, 0.5, 0.9]).withColumn("column_name", F.lit("l_extendedprice")))
