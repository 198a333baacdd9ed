"""Queries of scores, searches, stores of rows, and files that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.vectors import euclidean
from lodestone.operators import constraints, lexicon, relations, retrieval, search, segments, vector
from lodestone.plans.registry import Tables, query, rounded
from lodestone.plans.text_queries import TOKENS
from lodestone.sources import sinks, spec
from lodestone.sources.scratch import scratch_path

CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _read_again(t: Tables, name: str, kind: str, by: list[str] | None = None) -> DataFrame:
    """Customers written as files of a kind and read as the source that their path names."""
    path = f"{scratch_path(t.spark, 'files')}/{name}"
    sinks.write_files(t.customer, path, kind, by)
    found = spec.read_source(t.spark, path)
    return found.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in t.customer.schema.fields))


@query(CUSTOMER)
def csv_files(t: Tables) -> DataFrame:
    return _read_again(t, "customer.csv", "csv")


@query(CUSTOMER)
def json_files(t: Tables) -> DataFrame:
    return _read_again(t, "customer.ndjson", "json")


@query(CUSTOMER)
def parquet_files(t: Tables) -> DataFrame:
    return _read_again(t, "customer.parquet", "parquet", ["c_mktsegment"])


@query("SELECT to_json({n_nationkey: n_nationkey, n_name: n_name, n_regionkey: n_regionkey})::VARCHAR AS json FROM nation")
def json_report(t: Tables) -> DataFrame:
    return sinks.as_json(t.nation)


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE 'CUST%1_5'")
def search_wildcard(t: Tables) -> DataFrame:
    return search.adaptive_search(t.customer, "cust*1?5", ["c_name"]).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate::DATE = DATE '1996-03-15'")
def search_dates(t: Tables) -> DataFrame:
    return search.adaptive_search(t.orders, "1996-03-15").select("o_orderkey", "o_orderdate")


@query("SELECT doc_id FROM labels WHERE toxic = 1")
def search_flags(t: Tables) -> DataFrame:
    return search.adaptive_search(t.labels.select("doc_id", (F.col("toxic") == 1).alias("toxic")), "yes", ["toxic"]).select("doc_id")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt')")
def named_parts(t: Tables) -> DataFrame:
    return t.part.filter(relations.any_of("p_name", ["Ring", "bolt"])).select("p_partkey", "p_name")


@query(r"""SELECT 'ValuesInSet' AS rule, 'o_orderstatus' AS column_name, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS violations, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) = 0 AS holds FROM orders
UNION ALL SELECT 'MatchesPattern', 'c_name', count(*) FILTER (WHERE NOT regexp_matches(c_name, '^Customer#[0-9]*[02468]$')), count(*) FILTER (WHERE NOT regexp_matches(c_name, '^Customer#[0-9]*[02468]$')) = 0 FROM customer""")
def value_rules(t: Tables) -> DataFrame:
    return constraints.values_in_set(t.orders, "o_orderstatus", ["F", "O"]).unionByName(constraints.matches_pattern(t.customer, "c_name", "^Customer#[0-9]*[02468]$"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def upserted_vectors(t: Tables) -> DataFrame:
    """Labels of vectors after every third was written anew and those without an English document went."""
    own = t.embeddings.select("vec_id", "label")
    changed = own.filter("vec_id % 3 = 0").withColumn("label", F.col("label") + 100)
    return vector.without_stale(vector.upsert(own.filter("vec_id % 6 <> 3"), changed, "vec_id"), t.documents.filter("lang = 'en'").select(F.col("doc_id").alias("vec_id")), "vec_id")


@query("SELECT e.vec_id, round(list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def euclidean_distances(t: Tables) -> DataFrame:
    one = F.broadcast(t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("q")))  # one row
    return rounded(t.embeddings.crossJoin(one).select("vec_id", euclidean(F.col("embedding"), F.col("q")).alias("distance")), 5)


@query("SELECT vec_id, round(s, 6) AS similarity FROM (SELECT vec_id, list_sum(CAST(embedding AS DOUBLE[])) / (8 * sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 10")
def nearest_to_vector(t: Tables) -> DataFrame:
    return rounded(vector.top_k(t.embeddings, [1.0] * 64, 10, "vec_id", "embedding"), 6)


@query("SELECT l_suppkey, greatest(sum(l_quantity) - coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0), 0) AS available FROM lineitem GROUP BY 1")
def stock_left(t: Tables) -> DataFrame:
    """What each supplier's lines hold, less those of one flag."""
    held = t.lineitem.select("l_suppkey", F.col("l_quantity").alias("quantity"), (F.col("l_returnflag") == "A").alias("active"))
    return segments.stock(held, held, "l_suppkey")


@query("WITH n AS (SELECT user_id, event_type, ts < TIMESTAMP '2024-01-15' AS early, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT user_id FROM n GROUP BY 1 HAVING count(DISTINCT early) = 2) SELECT user_id, event_type AS category, max(n)::DOUBLE AS weight FROM n JOIN b USING (user_id) GROUP BY ALL")
def elevated_interests(t: Tables) -> DataFrame:
    """Of two maps of each user's events, before and since a day, the larger of each kind."""
    half = lambda df: df.groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    day = F.lit("2024-01-15").cast("timestamp_ntz")
    old, new = half(t.events.filter(F.col("ts") < day)), half(t.events.filter(F.col("ts") >= day)).withColumnRenamed("m", "other")
    return old.join(new, "user_id").select("user_id", F.explode(segments.elevated(F.col("m"), F.col("other"))).alias("category", "weight"))


@query("SELECT doc_id, round(n_chars / 1000.0 + CASE WHEN lang = 'en' THEN 2 ELSE 0 END + CASE WHEN contains(text, 'the') THEN 1 ELSE 0 END + 1.5 * exp(-doc_id / 365.0) + log10(n_chars + 1) / 4, 5)::DOUBLE AS score FROM documents WHERE lang IS NOT NULL")
def boosted_documents(t: Tables) -> DataFrame:
    own = retrieval.boosted(F.col("n_chars") / 1000.0, F.col("lang") == "en", F.contains("text", F.lit("the")), F.col("doc_id").cast("double"), F.col("n_chars"))
    return rounded(t.documents.filter("lang is not null").select("doc_id", own.alias("score")), 5)


@query("SELECT lang, count(*) AS n, CAST(greatest(least(ceil(count(*) * 0.05), 100), 15) AS INTEGER) AS k, CAST(greatest(least(ceil(count(*) * 0.075), 100), 15) AS INTEGER) AS narrative FROM documents GROUP BY 1")
def kept_segments(t: Tables) -> DataFrame:
    """How many documents of each language a summary would keep."""
    return t.documents.groupBy("lang").agg(F.count("*").alias("n")).select("lang", "n", retrieval.adaptive_k(F.col("n")).alias("k"), retrieval.adaptive_k(F.col("n"), True).alias("narrative"))


ANSWERS = "(SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def _answers(t: Tables) -> DataFrame:
    """Turns and what follows them."""
    follows = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return t.conversations.select("conv_id", "turn", F.col("text").alias("question")).join(follows, ["conv_id", "turn"])


@query(f"WITH p AS (SELECT conv_id, turn, list_distinct({TOKENS.format(c='answer', n=3)}) AS a, {TOKENS.format(c='question', n=3)} AS q FROM {ANSWERS}), e AS (SELECT conv_id, turn, coalesce(len(list_intersect(a, q)) / nullif(len(a), 0), 0) AS e FROM p) SELECT conv_id, turn, round(e, 5) AS evidence, e > 0.5 AS supported, round(0.2 * e + 0.15 * 1 + 0.2 * e + 0.45 * e, 5)::DOUBLE AS quality FROM e")
def answer_evidence(t: Tables) -> DataFrame:
    """How far a turn's words are in the turn before, and what that would make of its quality."""
    own = lexicon.evidence(_answers(t), "question", "answer")
    quality = lexicon.summary_quality(F.col("evidence"), F.lit(1.0), F.col("evidence"), F.col("evidence"))
    return rounded(own.select("conv_id", "turn", "evidence", "supported", quality.alias("quality")), 5)


@query(r"SELECT doc_id, CAST(i - 1 AS INTEGER) AS place, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 10) AS s FROM documents))")
def document_sentences(t: Tables) -> DataFrame:
    return retrieval.sentences(t.documents)


def _tone(words: tuple[str, ...]) -> str:
    return f"len(list_filter(t, lambda x: x IN ({', '.join(map(repr, words))})))"


@query(f"SELECT conv_id, turn, CASE WHEN m = 0 THEN NULL WHEN {_tone(lexicon.TONES['sadness'])} = m THEN 'sadness' WHEN {_tone(lexicon.TONES['joy'])} = m THEN 'joy' WHEN {_tone(lexicon.TONES['fear'])} = m THEN 'fear' ELSE 'anger' END AS tone FROM (SELECT *, greatest({', '.join(_tone(w) for w in lexicon.TONES.values())}) AS m FROM (SELECT conv_id, turn, {TOKENS.format(c='text', n=1)} AS t FROM conversations))")
def emotional_tone(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", lexicon.tone(F.col("text")).alias("tone"))


NEXT = "(SELECT a.p_partkey, lower(a.p_name) AS x, lower(b.p_name) AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"
GRAMS = "list_transform(range(1, length({c}) - {n} + 2), lambda i: substr({c}, i, {n}))"
COUNT = "len(list_filter({l}, lambda h: h = g))"


def _next_names(t: Tables) -> DataFrame:
    """Names of parts and of the next part."""
    follows = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("y"))
    # names are short, so a file's few bytes are many pairs: they are dealt over all cores
    return t.part.select("p_partkey", F.col("p_name").alias("x")).join(follows, "p_partkey").repartition(4 * t.spark.sparkContext.defaultParallelism, "p_partkey")


@query(f"SELECT p_partkey, round(len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v))), 5) AS similarity FROM (SELECT p_partkey, list_distinct({GRAMS.format(c='x', n=3)}) AS u, list_distinct({GRAMS.format(c='y', n=3)}) AS v FROM {NEXT})")
def trigram_jaccard(t: Tables) -> DataFrame:
    return rounded(_next_names(t).select("p_partkey", tx.jaccard(tx.ngrams(F.col("x"), 3), tx.ngrams(F.col("y"), 3)).alias("similarity")), 5)


COSINE = f"""(SELECT p_partkey, x, y, list_sum(list_transform(list_distinct(u), lambda g: {COUNT.format(l='u')} * {COUNT.format(l='v')})) / sqrt(list_sum(list_transform(list_distinct(u), lambda g: {COUNT.format(l='u')} * {COUNT.format(l='u')})) * list_sum(list_transform(list_distinct(v), lambda g: {COUNT.format(l='v')} * {COUNT.format(l='v')}))) AS cosine
FROM (SELECT p_partkey, x, y, {GRAMS.format(c='x', n=2)} AS u, {GRAMS.format(c='y', n=2)} AS v FROM {NEXT}))"""


@query(f"SELECT p_partkey, round(cosine, 5) AS similarity FROM {COSINE}")
def bigram_cosine(t: Tables) -> DataFrame:
    return rounded(_next_names(t).select("p_partkey", tx.bigram_cosine(F.col("x"), F.col("y")).alias("similarity")), 5)


@query(f"""SELECT p_partkey, round(CASE WHEN x = y THEN 1 WHEN contains(x, y) OR contains(y, x) THEN 0.9 ELSE 0.5 * (j + 0.1 * (1 - j) * len(list_filter(range(1, least(length(x), length(y), 4) + 1), lambda i: left(x, i) = left(y, i)))) + 0.3 * (1 - levenshtein(x, y) / greatest(length(x), length(y))) + 0.2 * cosine END, 5)::DOUBLE AS similarity
FROM (SELECT *, jaro_similarity(x, y) AS j FROM {COSINE})""")
def name_similarity(t: Tables) -> DataFrame:
    return rounded(_next_names(t).select("p_partkey", tx.name_similarity(F.col("x"), F.col("y")).alias("similarity")), 5)
