"""Queries of personal data in columns, search, ranking and text scores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import fulltext, lexicon, privacy, retrieval, search, sections
from lodestone.plans.registry import Tables, query, rounded

def _kind(value: str) -> str:
    """SQL of the kind of a value."""
    fits = lambda forms: " AND ".join(f"regexp_matches({value}, '{form}')" for form in forms)
    return "CASE " + " ".join(f"WHEN {fits(forms)} THEN '{name}'" for name, forms in privacy.VALUE_FORMS) + " END"


def _names(kinds: tuple[str, ...]) -> str:
    return ", ".join(f"'{k}'" for k in kinds)


TOKENS = r"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) > {n})"


EDGES = r"""'^[,;:()<>"'']+|[.,;:()<>"'']+$'"""
MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"
PERSONAL = f"""SELECT 'c_name' AS column_name, c_name AS value FROM customer UNION ALL SELECT 'email', regexp_extract(text, '{MAIL}') FROM documents WHERE regexp_matches(text, '{MAIL}') UNION ALL SELECT 'url', url FROM pages"""
RISKY = f"""v AS (SELECT DISTINCT column_name, value FROM ({PERSONAL}) WHERE value IS NOT NULL),
k AS (SELECT column_name, {_kind("value")} AS kind, count(*) AS n FROM v GROUP BY 1, 2), r AS (SELECT *, n / sum(n) OVER (PARTITION BY column_name) AS rate FROM k),
scan AS (SELECT column_name, kind, n, rate, CASE WHEN kind IN ({_names(privacy.GRAVE)}) THEN CASE WHEN rate > 0.7 THEN 'Critical' ELSE 'High' END WHEN kind IN ({_names(privacy.PLAIN)}) THEN CASE WHEN rate > 0.7 THEN 'High' ELSE 'Medium' END ELSE CASE WHEN rate > 0.7 THEN 'Medium' ELSE 'Low' END END AS risk, rate > 0.5 AS is_pii FROM r WHERE kind IS NOT NULL AND rate > 0.1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY rate DESC, kind DESC) AS place FROM scan) WHERE place = 1)"""


def _each(t: Tables, build: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """What ``build`` finds in the columns that may hold personal data."""
    mails = t.documents.filter(F.col("text").rlike(MAIL)).select(F.regexp_extract("text", MAIL, 0).alias("email"))
    columns = [(t.customer.select("c_name"), ["c_name"]), (mails, ["email"]), (t.pages.select("url"), ["url"])]
    return reduce(DataFrame.unionByName, (build(df, names) for df, names in columns))


@query(f"""SELECT kind, count(*) AS n FROM (SELECT {_kind("token")} AS kind FROM (SELECT regexp_replace(token, {EDGES}, '', 'g') AS token FROM (SELECT unnest(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+')) AS token FROM documents))) WHERE kind IS NOT NULL GROUP BY 1""")
def pii_scan(t: Tables) -> DataFrame:
    return privacy.token_kinds(t.documents, "text")


@query(f"WITH {RISKY} SELECT column_name, kind, n, round(rate, 4) AS rate, risk, is_pii FROM scan")
def pii_columns(t: Tables) -> DataFrame:
    return rounded(_each(t, privacy.scan_columns))


@query(f"""WITH {RISKY} SELECT c.column_name, coalesce(kind, CASE WHEN c.column_name LIKE '%email%' THEN 'Email' END) AS kind, round(coalesce(rate, 0.3), 4) AS confidence, coalesce(risk, 'Medium') AS risk, coalesce(is_pii, true) AS is_pii, kind IS NULL AS from_name
FROM (SELECT DISTINCT column_name FROM v) c LEFT JOIN best USING (column_name) WHERE kind IS NOT NULL OR c.column_name LIKE '%email%'""")
def pii_risk_columns(t: Tables) -> DataFrame:
    return rounded(_each(t, privacy.columns_at_risk))


HINTED = ("customer_email", "Phone", "filename", "name", "first_name", "shipping_street", "credit_limit", "credit_card", "ip", "zip", "licence_no", "birthday", "passport_id", "SSN")


@query(f"""SELECT column_name, CASE WHEN n LIKE '%ssn%' THEN 'SSN' WHEN n LIKE '%credit%' AND (n LIKE '%card%' OR n LIKE '%number%') THEN 'CreditCard' WHEN n LIKE '%email%' THEN 'Email' WHEN regexp_matches(n, 'phone|mobile|cell|tel') THEN 'PhoneNumber'
WHEN regexp_matches(n, 'addr|street') THEN 'Address' WHEN n = 'name' OR regexp_matches(n, 'first_?name|last_?name|full_name') THEN 'PersonName' WHEN n = 'ip' OR n LIKE '%ip_address%' THEN 'IPAddress' WHEN regexp_matches(n, 'dob|birth') THEN 'DateOfBirth' WHEN n LIKE '%passport%' THEN 'PassportNumber' WHEN regexp_matches(n, 'licen[cs]e|dl_') THEN 'DriversLicense' END AS kind
FROM (SELECT column_name, lower(column_name) AS n FROM (SELECT unnest([{_names(HINTED)}]) AS column_name))""")
def pii_names(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(n,) for n in HINTED], "column_name string").select("column_name", privacy.name_kind(F.col("column_name")).alias("kind"))


@query(f"""WITH {RISKY} SELECT column_name, CASE risk WHEN 'Critical' THEN 'Error' WHEN 'High' THEN 'Error' WHEN 'Medium' THEN 'Warning' ELSE 'Info' END AS severity,
'Potential ' || kind || ' detected (' || CAST(round(100 * rate) AS INTEGER) || '% confidence). Risk level: ' || risk || '. Consider masking or excluding this column.' AS message FROM best WHERE is_pii""")
def pii_alerts(t: Tables) -> DataFrame:
    return privacy.alerts(_each(t, privacy.columns_at_risk))


@query(f"""WITH {RISKY}, form AS (SELECT column_name, bool_or(kind IN ('SSN', 'CreditCard', 'BankAccount')) AS grave, max(rate) AS rate FROM scan GROUP BY 1),
uses AS (SELECT column_name, count(DISTINCT value) / count(value) AS unique_share FROM ({PERSONAL}) GROUP BY 1),
levels AS (SELECT column_name, unique_share, greatest(CASE WHEN rate IS NULL THEN 0 WHEN grave THEN 4 WHEN rate > 0.7 THEN 3 ELSE 2 END, CASE WHEN unique_share > 0.99 THEN 3 WHEN unique_share > 0.9 THEN 2 ELSE 0 END) AS level FROM uses LEFT JOIN form USING (column_name))
SELECT column_name, round(unique_share, 4) AS unique_share, [{_names(privacy.LEVELS)}][level + 1] AS risk, [{_names(tuple(privacy.ACTIONS[x] for x in privacy.LEVELS))}][level + 1] AS action FROM levels""")
def pii_ensemble(t: Tables) -> DataFrame:
    return rounded(_each(t, privacy.ensemble_risk))


@query(f"""WITH tokens AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS part FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+') AS parts FROM documents)),
bare AS (SELECT doc_id, i, part, regexp_extract(part, '^[,;:()<>"'']+') AS lead, regexp_extract(part, '[.,;:()<>"'']+$') AS tail, regexp_replace(part, {EDGES}, '', 'g') AS b FROM tokens),
kinds AS (SELECT *, {_kind("b")} AS kind, least(2, length(b) // 2) AS seen FROM bare), stars AS (SELECT *, repeat('*', greatest(3, least(10, length(b) - 2 * seen))::INT) AS s FROM kinds),
shown AS (SELECT doc_id, i, CASE WHEN kind IS NULL THEN part ELSE lead || CASE WHEN kind = 'Email' THEN CASE WHEN length(split_part(b, '@', 1)) > seen THEN left(split_part(b, '@', 1), seen) ELSE '' END || s || '@' || s || '.' || split_part(b, '.', -1)
WHEN kind = 'SSN' AND contains(b, '-') THEN '***-**-' || right(b, 4) WHEN kind = 'CreditCard' THEN '**** **** **** ' || right(b, 4) WHEN kind = 'PhoneNumber' THEN '***-***-' || right(b, 4)
ELSE CASE kind {" ".join(f"WHEN '{k}' THEN '{v} '" for k, v in privacy.LABELS.items())} ELSE '' END || left(b, seen) || s || right(b, seen) END || tail END AS part FROM stars)
SELECT d.doc_id, coalesce(x.text, d.text) AS text FROM documents d LEFT JOIN (SELECT doc_id, string_agg(part, '' ORDER BY i) AS text FROM shown GROUP BY doc_id) x USING (doc_id)""")
def pii_redact(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", privacy.redact_text(F.col("text")).alias("text"))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'red') OR contains(lower(p_brand), 'red')")
def search_contains(t: Tables) -> DataFrame:
    return search.adaptive_search(t.part, "red").select("p_partkey", "p_name", "p_type")


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size > 20 AND p_retailprice < 1200")
def search_structured(t: Tables) -> DataFrame:
    return search.ask(t.part, "parts where p_size > 20 with p_retailprice under 1200").select("p_partkey", "p_size", "p_retailprice")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars BETWEEN 100 AND 300")
def search_range(t: Tables) -> DataFrame:
    return search.adaptive_search(t.documents, "100-300", ["n_chars"]).select("doc_id", "n_chars")


@query(f"SELECT doc_id FROM documents WHERE list_contains({TOKENS.format(c='text', n=0)}, 'the') AND NOT list_contains({TOKENS.format(c='text', n=0)}, 'license') AND len(list_filter({TOKENS.format(c='text', n=0)}, lambda x: starts_with(x, 'thor'))) > 0")
def site_search(t: Tables) -> DataFrame:
    return search.site_search(t.documents, "thor* -license", "text").filter(F.array_contains(tx.tokens(F.col("text"), 0), "the")).select("doc_id")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 20")
def guarded_sql(t: Tables) -> DataFrame:
    t.lineitem.createOrReplaceTempView("lineitem_data")
    return search.guarded_sql(t.spark, "SELECT l_returnflag, count(*) AS n FROM lineitem_data GROUP BY 1 ORDER BY 1")


BM25 = f"""WITH d AS (SELECT doc_id, {TOKENS.format(c='text', n=1)} AS t FROM documents), a AS (SELECT count(*) AS docs, avg(len(t)) AS al FROM d), q(term) AS (VALUES ('anea'), ('thion'), ('license')),
m AS (SELECT doc_id, len(t) AS length, term, len(list_filter(t, lambda x: x = term)) AS tf FROM d, q WHERE list_contains(t, term)), f AS (SELECT term, count(*) AS df FROM m GROUP BY 1),
s AS (SELECT doc_id, sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / al))) AS score FROM m JOIN f USING (term), a GROUP BY 1)"""


@query(BM25 + " SELECT doc_id, round(score, 4) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, doc_id LIMIT 20")
def bm25_topk(t: Tables) -> DataFrame:
    return rounded(retrieval.top(retrieval.bm25(t.documents, "anea thion license"), "doc_id", 20))


@query(BM25 + """, r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 50) UNION ALL SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50))
SELECT doc_id, round(sum(1.0 / (60 + rank)), 6)::DOUBLE AS score FROM r GROUP BY 1""")
def rrf_fusion(t: Tables) -> DataFrame:
    longest = retrieval.top(t.documents.select("doc_id", F.col("n_chars").alias("score")), "doc_id", 50)
    return rounded(retrieval.reciprocal_rank_fusion([retrieval.top(retrieval.bm25(t.documents, "anea thion license"), "doc_id", 50), longest], "doc_id"), 6)


@query(f"""WITH w AS (SELECT doc_id, {TOKENS.format(c='text', n=2)} AS t FROM documents), e AS (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM w), c AS (SELECT doc_id, length, term, count(*) AS tf FROM e GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
s AS (SELECT doc_id, term, tf / length * ln((SELECT count(*) FROM documents) / df) AS weight FROM c JOIN f USING (term)) SELECT doc_id, term, round(weight, 5) AS weight FROM s""")
def tfidf_terms(t: Tables) -> DataFrame:
    return rounded(retrieval.tf_idf(t.documents), 5)


@query(f"""WITH c AS (SELECT DISTINCT doc_id, unnest({TOKENS.format(c='text', n=2)}) AS term FROM documents), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1)
SELECT class, count(*) AS terms FROM (SELECT CASE WHEN df / (SELECT count(*) FROM documents) > 0.5 THEN 'Fact' WHEN df / (SELECT count(*) FROM documents) > 0.2 THEN 'Inference' ELSE 'Colour' END AS class FROM f) GROUP BY 1""")
def term_classes(t: Tables) -> DataFrame:
    return retrieval.term_classes(t.documents).groupBy("class").agg(F.count("*").alias("terms"))


def _isin(words: tuple[str, ...]) -> str:
    return "len(list_filter(t, lambda x: x IN (" + ", ".join(f"'{w}'" for w in words) + ")))"


@query(f"""SELECT conv_id, turn, round(CASE WHEN n = 0 THEN 0 ELSE least(greatest(2.0 * (p - m) / n, -1), 1) END, 4)::DOUBLE AS score, round(CASE WHEN p + m = 0 THEN 0.3 ELSE least(1.0, 5.0 * (p + m) / n) END, 4)::DOUBLE AS confidence, CASE WHEN n > 0 AND 2.0 * (p - m) / n > 0.1 THEN 'Positive' WHEN n > 0 AND 2.0 * (p - m) / n < -0.1 THEN 'Negative' ELSE 'Neutral' END AS class
FROM (SELECT conv_id, turn, {_isin(lexicon.POSITIVE)} AS p, {_isin(lexicon.NEGATIVE)} AS m, len(t) AS n FROM (SELECT conv_id, turn, {TOKENS.format(c='text', n=1)} AS t FROM conversations))""")
def lexicon_sentiment(t: Tables) -> DataFrame:
    return rounded(t.conversations.select("conv_id", "turn", lexicon.sentiment(F.col("text")).alias("s")).select("conv_id", "turn", "s.*"))


@query(f"""SELECT doc_id, round(CASE WHEN w = 0 THEN 0 ELSE (least(greatest(1 - w / e / 30, 0), 1) + least(greatest(1 - l / w / 10, 0), 1)) / 2 END, 4)::DOUBLE AS readability FROM (SELECT doc_id, len(t)::DOUBLE AS w, greatest(len(regexp_extract_all(text, '[.!?]+')), 1)::DOUBLE AS e, coalesce(list_sum(list_transform(t, lambda x: length(x))), 0)::DOUBLE AS l FROM (SELECT doc_id, text, {TOKENS.format(c='text', n=0)} AS t FROM documents))""")
def readability(t: Tables) -> DataFrame:
    return rounded(t.documents.select("doc_id", lexicon.readability(F.col("text")).alias("readability")))


@query(f"""SELECT conv_id, turn, round(CASE WHEN f + c = 0 THEN 0.5 ELSE f / (f + c) END, 4)::DOUBLE AS formality, round(CASE WHEN s + o = 0 THEN 0.5 ELSE s / (s + o) END, 4)::DOUBLE AS subjectivity FROM (SELECT conv_id, turn, {_isin(lexicon.FORMAL)} + len(regexp_extract_all(lower(text), '\\b(?:was|were|been|is|are) [a-z]+ed\\b')) AS f, {_isin(lexicon.CASUAL)} + len(regexp_extract_all(lower(text), '[a-z]''(?:t|s|re|ve|ll|d|m)\\b')) AS c, {_isin(lexicon.SUBJECTIVE)} AS s, {_isin(lexicon.OBJECTIVE)} AS o FROM (SELECT *, {TOKENS.format(c='text', n=1)} AS t FROM conversations))""")
def formality(t: Tables) -> DataFrame:
    return rounded(t.conversations.select("conv_id", "turn", lexicon.formality(F.col("text")).alias("formality"), lexicon.subjectivity(F.col("text")).alias("subjectivity")))


def _name_pairs(t: Tables, similarity: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs of parts of one brand and size, and how similar their names are: each pair of names is compared once.

    Names repeat, so pairs of distinct names are few beside pairs of parts; they meet the parts by equal joins, and the
    rows that come out of the last one go nowhere else.
    """
    group = ["p_brand", "p_size"]
    parts = t.part.select(*group, "p_partkey", "p_name")
    names = parts.select(*group, F.col("p_name").alias("name_a")).distinct()
    met = names.join(names.withColumnRenamed("name_a", "name_b"), group)
    once = rounded(met.select("name_a", "name_b").distinct().withColumn("similarity", similarity(F.col("name_a"), F.col("name_b"))))
    scored = met.join(once.withColumnsRenamed({"name_a": "x", "name_b": "y"}), F.col("name_a").eqNullSafe(F.col("x")) & F.col("name_b").eqNullSafe(F.col("y"))).drop("x", "y")
    of = lambda side: parts.select(*group, F.col("p_partkey").alias(side), F.col("p_name").alias(f"__{side}"))
    same = lambda side: F.col(f"name_{side}").eqNullSafe(F.col(f"__{side}"))
    left = scored.withColumnsRenamed({c: f"__{c}" for c in group}).join(of("a"), (F.col("__p_brand") == F.col("p_brand")) & (F.col("__p_size") == F.col("p_size")) & same("a")).select(*group, "a", "name_b", "similarity")
    right = of("b").withColumnsRenamed({c: f"__{c}" for c in group})
    both = left.join(right, (F.col("__p_brand") == F.col("p_brand")) & (F.col("__p_size") == F.col("p_size")) & same("b") & (F.col("a") < F.col("b")))
    return both.select("a", "b", "similarity")


NAMES = "(SELECT x.p_partkey AS a, y.p_partkey AS b, x.p_name AS name_a, y.p_name AS name_b FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.p_partkey < y.p_partkey)"


@query(f"SELECT a, b, round(1 - levenshtein(lower(name_a), lower(name_b)) / greatest(length(name_a), length(name_b)), 4) AS similarity FROM {NAMES}")
def levenshtein_match(t: Tables) -> DataFrame:
    return _name_pairs(t, tx.levenshtein_similarity)


@query(f"SELECT a, b, round(j + 0.1 * (1 - j) * len(list_filter(range(1, least(length(x), length(y), 4) + 1), lambda i: left(x, i) = left(y, i))), 4) AS similarity FROM (SELECT a, b, lower(name_a) AS x, lower(name_b) AS y, jaro_similarity(lower(name_a), lower(name_b)) AS j FROM {NAMES})")
def jaro_winkler_match(t: Tables) -> DataFrame:
    return _name_pairs(t, tx.jaro_winkler)


@query(f"SELECT a, b, round(len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v))), 4) AS similarity FROM (SELECT a, b, list_distinct(string_split(name_a, ' ')) AS u, list_distinct(string_split(name_b, ' ')) AS v FROM {NAMES})")
def jaccard_tags(t: Tables) -> DataFrame:
    return _name_pairs(t, lambda a, b: tx.jaccard(F.split(a, " "), F.split(b, " ")))


@query(f"""SELECT a, b, round(least(1 - levenshtein(x, y) / greatest(length(x), length(y), 1) + CASE WHEN contains(x, y) OR contains(y, x) THEN 0.2 ELSE 0 END + 0.1 * len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: left(x, i) = left(y, i))) / greatest(least(length(x), length(y)), 1), 1), 4)::DOUBLE AS similarity FROM (SELECT a, b, lower(replace(name_a, ' ', '-')) AS x, lower(replace(name_b, ' ', '-')) AS y FROM {NAMES})""")
def slug_similarity(t: Tables) -> DataFrame:
    slug = lambda c: F.regexp_replace(c, " ", "-")
    return _name_pairs(t, lambda a, b: tx.slug_similarity(slug(a), slug(b)))


@query()
def mmr_summary(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", "label", "embedding", (1 / (1 + F.col("vec_id"))).alias("relevance"))
    return retrieval.mmr(rows, "label", "vec_id", "relevance", "embedding")


@query(r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk, c[i] AS text FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, list_reduce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> ''),
lambda acc, x: CASE WHEN len(acc) > 0 AND length(acc[-1]) + length(x) < 2048 THEN list_append(acc[1 : len(acc) - 1], acc[-1] || chr(10) || x) ELSE list_append(acc, x) END, CAST([] AS VARCHAR[])) AS c FROM documents WHERE text IS NOT NULL))""")
def text_chunks(t: Tables) -> DataFrame:
    return retrieval.chunks(t.documents)


@query(f"""WITH t AS (SELECT doc_id, unnest({TOKENS.format(c='text', n=0)}) AS w FROM documents), n AS (SELECT doc_id, ('0x' || substr(sha256(w), 1, 8))::BIGINT % 128 AS place, count(*) AS n FROM t GROUP BY 1, 2), m AS (SELECT doc_id, map(list(place ORDER BY place), list(n ORDER BY place)) AS m, sqrt(sum(n * n)) AS norm FROM n GROUP BY 1)
SELECT doc_id, list_transform(range(128), lambda i: coalesce(m[i], 0) / norm) AS embedding FROM m""")
def hash_embeddings(t: Tables) -> DataFrame:
    return rounded(retrieval.hash_embedding(t.documents))


@query(r"""SELECT page_id, link, CASE WHEN NOT regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN true ELSE regexp_extract(link, '://([^/?#:]+)', 1) = regexp_extract(url, '://([^/?#:]+)', 1) END AS same_host FROM (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html, 'href\s*=\s*["'']([^"''#]+)', 1)) AS link FROM pages)""")
def page_links(t: Tables) -> DataFrame:
    return retrieval.links(t.pages)


@query()
def page_main_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", retrieval.page_text(F.col("html")).alias("text"))


#: Words, a phrase, an exclusion and an alternative.
WEBSEARCH = '"of the" ndin -thand OR hehely'
INDEXED = r"""w AS (SELECT doc_id, f, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT doc_id, 0 AS f, regexp_extract_all(lower(source), '[\p{L}\p{N}_]+') AS w FROM documents UNION ALL SELECT doc_id, 1, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') FROM documents)),
lens AS (SELECT doc_id, coalesce(len(regexp_extract_all(lower(source), '[\p{L}\p{N}_]+')), 0) + 1 AS shift FROM documents), t AS (SELECT doc_id, f, w, i + CASE f WHEN 0 THEN 0 ELSE shift END AS p, CASE f WHEN 0 THEN 1.0 ELSE 0.1 END::DOUBLE AS weight FROM w JOIN lens USING (doc_id) WHERE w IN ('of', 'the', 'ndin', 'thand', 'hehely'))"""


@query(f"""WITH {INDEXED}, e AS (SELECT a.doc_id, a.p, a.p + 1 AS q, 0 AS own, 2 AS size, a.weight FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.f = b.f AND b.p = a.p + 1 AND a.w = 'of' AND b.w = 'the' UNION ALL SELECT doc_id, p, p, 1, 1, weight FROM t WHERE w = 'ndin' UNION ALL SELECT doc_id, p, p, 2, 1, weight FROM t WHERE w = 'hehely'),
h AS (SELECT doc_id, bool_or(own = 0) AND bool_or(own = 1) AND doc_id NOT IN (SELECT doc_id FROM t WHERE w = 'thand') AS one, bool_or(own = 2) AS two FROM e GROUP BY 1), o AS (SELECT e.*, one, two, row_number() OVER (PARTITION BY doc_id ORDER BY q, p, own) AS n FROM e JOIN h USING (doc_id) WHERE one OR two),
l AS (SELECT *, sum(1 / weight) OVER s AS inv, sum(size) OVER s AS words, {', '.join(f"max(CASE own WHEN {k} THEN n END) OVER s AS n{k}" for k in range(3))} FROM o WINDOW s AS (PARTITION BY doc_id ORDER BY n)),
s AS (SELECT l.*, {', '.join(f"x{k}.p AS p{k}" for k in range(3))} FROM l {' '.join(f"LEFT JOIN o x{k} ON x{k}.doc_id = l.doc_id AND x{k}.n = l.n{k}" for k in range(3))}),
b AS (SELECT *, greatest(CASE WHEN one AND n0 IS NOT NULL AND n1 IS NOT NULL THEN least({{p: p0, n: n0}}, {{p: p1, n: n1}}) END, CASE WHEN two AND n2 IS NOT NULL THEN {{p: p2, n: n2}} END) AS start FROM s),
c AS (SELECT *, lag(start.n) OVER (PARTITION BY doc_id ORDER BY n) AS last FROM b), d AS (SELECT c.*, f.inv - 1 / f.weight AS inv0, f.words - f.size AS words0 FROM c JOIN l f ON f.doc_id = c.doc_id AND f.n = c.start.n WHERE last IS NULL OR c.start.n > last)
SELECT doc_id, round(sum((n - start.n + 1) / (inv - inv0) / (1 + greatest(q - start.p + 1 - (words - words0), 0))), 5) AS rank FROM d GROUP BY 1""")
def fulltext_rank(t: Tables) -> DataFrame:
    """Documents that a search finds, by how densely they cover it; the source weighs ten times the text."""
    index = fulltext.text_index(t.documents, "doc_id", ["source", "text"])
    return rounded(fulltext.search_text(index, WEBSEARCH, [1.0, 0.1]).withColumnRenamed("id", "doc_id"), 5)


@query()
def page_chunks(t: Tables) -> DataFrame:
    """Pages cut at their headings into chunks of 50 to 200 tokens."""
    marked = t.pages.select("page_id", sections.marked_headings(F.col("html")).alias("text"))
    return sections.chunk_sections(marked, "page_id", "text", 6, 200, 50).drop("path")
