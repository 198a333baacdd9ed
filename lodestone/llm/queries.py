"""Queries that apply each training-data operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.bpe import encode_decode
from lodestone.llm.chat import format_and_read
from lodestone.llm.common import scratch_path
from lodestone.llm.decontaminate import find_contamination
from lodestone.llm.licenses import find_licenses
from lodestone.llm.nearest import every_twentieth
from lodestone.llm.ngram_join import jaccard_join
from lodestone.llm.phrases import mine_phrases
from lodestone.llm.pii import find_pii
from lodestone.llm.secrets import find_secrets
from lodestone.llm.shards import shard_table
from lodestone.llm.token_counts import token_counts
from lodestone.llm.toxicity import score_toxicity
from lodestone.llm.whitening import whiten
from lodestone.sources.tables import read_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document. Null and empty texts get the bias's score; without labels all are alike; repeated rows repeat."""
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and set size of every document at three words and 0.9. Null, empty and wordless texts stand alone; null ids have no component."""
    return jaccard_join(read_table(spark, sf_dir, "documents"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read back from shards of token ids. A null text has the end id only; null ids come first; repeated ids are all kept."""
    return shard_table(read_table(spark, sf_dir, "documents"), scratch_path(spark, "token-shards"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes they decode to. A null text is an empty one."""
    return encode_decode(read_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document. A null text has none; repeated rows repeat."""
    return find_secrets(read_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document. A null text has none; no text is too long."""
    return token_counts(read_table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates of every document. A null text has no words."""
    return find_licenses(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of benchmark items. Null texts and items have no words."""
    return find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, by fixed forms and by context. A null text has none."""
    return find_pii(read_table(spark, sf_dir, "documents"))


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest vectors of every twentieth. Null, zero and non-finite vectors take no part; ties go to the smaller id."""
    return every_twentieth(read_table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened coordinates of every vector. Null and non-finite vectors are dropped; a component without variance has none."""
    return whiten(read_table(spark, sf_dir, "embeddings"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 leading phrases of each language. Null texts have no words; a null language is und."""
    return mine_phrases(read_table(spark, sf_dir, "documents"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, read back from its files. A null text is an empty one."""
    return format_and_read(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_token_shards": op3_token_shards,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_secrets": op5_secrets,
    "op6_token_counts": op6_token_counts,
    "op7_licenses": op7_licenses,
    "op8_decontamination": op8_decontamination,
    "op9_pii": op9_pii,
    "op10_nearest_vectors": op10_nearest_vectors,
    "op11_whitening": op11_whitening,
    "op12_phrases": op12_phrases,
    "op13_chat_format": op13_chat_format,
}

ORACLES: dict[str, str] = {
    "op8_decontamination": r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM windows
), runs AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS run
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words CROSS JOIN sizes WHERE len(w) >= size)
), found AS (
  SELECT doc_id, size, i, item_id FROM runs JOIN windows USING (size, run)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id
), held AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)
""",
    "op12_phrases": r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k) GROUP BY ALL
), total AS (
  SELECT lang, sum(f)::HUGEINT AS n FROM grams WHERE k = 1 GROUP BY 1
), candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE f >= 100 AND k > 1
), subs AS (
  SELECT lang, a AS longer, array_to_string(w[i : i + j - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM candidates))
), absorbing AS (
  SELECT lang, phrase, max(longer) AS longer FROM subs GROUP BY ALL
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN absorbing USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
), cuts AS (
  SELECT lang, phrase, a, c, array_to_string(w[1 : c], ' ') AS head, array_to_string(w[c + 1 : k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, c, h.f AS l, t.f AS r, n, (1000 * a::HUGEINT * n) // (h.f::HUGEINT * t.f::HUGEINT) AS score
  FROM cuts JOIN grams h ON h.lang = cuts.lang AND h.phrase = head JOIN grams t ON t.lang = cuts.lang AND t.phrase = rest JOIN total ON total.lang = cuts.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= 2000
""",
    "op13_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped AS (
  SELECT *, length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '\[(/?(?:INST|SYS|ROLE|TURN)\])', '[\\\1', 'g'), '<(/?s>)', '<\\\1', 'g')) AS chars,
    length(regexp_replace(regexp_replace(replace(role, '\', '\\'), '\[(/?(?:INST|SYS|ROLE|TURN)\])', '[\\\1', 'g'), '<(/?s>)', '<\\\1', 'g')) AS role_chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(chars + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 4 ELSE 19 + role_chars END))::BIGINT AS formatted_chars,
  false AS rewritten
FROM escaped GROUP BY conv_id
""",
}
