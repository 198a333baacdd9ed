"""Ranking of texts: BM25, TF-IDF, fusion of rankings, selection and chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.functions.scalars import bound
from lodestone.functions.text import tokens
from lodestone.sources.scratch import stored


def term_counts(docs: DataFrame, id_col: str, text: str, longer_than: int = 1) -> DataFrame:
    """How often each document has each term, and how many terms it has.

    A document's terms are counted in its own row, so nothing is shuffled for it; only
    where ids repeat are the rows of an id of the same length added up.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("length", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("t")
            row, terms = lists.value_parent_indices().to_numpy(), lists.flatten().dictionary_encode()
            size = max(1, len(terms.dictionary))
            key, tf = np.unique(row * size + terms.indices.to_numpy(), return_counts=True)
            ids, length = batch.column("id"), lists.value_lengths()
            for i in range(0, len(key), 50_000):
                at, term = pa.array(key[i : i + 50_000] // size), pa.array(key[i : i + 50_000] % size)
                yield pa.RecordBatch.from_arrays([ids.take(at), length.take(at), terms.dictionary.take(term), pa.array(tf[i : i + 50_000])], names=schema.names)

    own = docs.select(F.col(id_col).alias("id"), tokens(F.col(text), longer_than).alias("t")).filter(F.size("t") > 0)
    counts = own.mapInArrow(count, schema)
    if docs.groupBy(id_col).count().filter("count > 1").isEmpty():
        return counts
    return counts.groupBy("id", "length", "term").agg(F.sum("tf").alias("tf"))


def bm25(docs: DataFrame, query: str, id_col: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 score of every document that has a term of the query.

    Only the query's terms leave the scan: a document contributes one row for each
    of them that it has.
    """
    spark = docs.sparkSession
    terms = [r["t"] for r in spark.range(1).select(F.explode(F.array_distinct(tokens(F.lit(query)))).alias("t")).collect()]
    own = docs.select(F.col(id_col).alias("id"), tokens(F.col(text)).alias("t"))
    totals = F.broadcast(own.agg(F.count("*").alias("docs"), F.avg(F.size("t")).alias("avg_length")))  # one row
    matches = own.select("id", F.size("t").alias("length"), F.explode(F.filter("t", lambda t: t.isin(*terms))).alias("term")).groupBy("id", "length", "term").agg(F.count("*").alias("tf"))
    df = F.broadcast(matches.groupBy("term").agg(F.count("*").alias("df")))  # a row a term of the query
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    return matches.join(df, "term").crossJoin(totals).groupBy("id").agg(F.sum(weight).alias("score")).filter("score > 0").withColumnRenamed("id", id_col)


def top(scored: DataFrame, id_col: str, k: int, score: str = "score") -> DataFrame:
    """The ``k`` best rows, ties to the smaller id."""
    return scored.orderBy(F.desc(score), id_col).limit(k)


def tf_idf(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Weight of each term in each document: its share of the document times the log of its rarity."""
    counts = term_counts(docs, id_col, text, 2)
    n = F.broadcast(docs.agg(F.count("*").alias("docs")))  # one row
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    return counts.join(df, "term").crossJoin(n).select(F.col("id").alias(id_col), "term", (F.col("tf") / F.col("length") * F.log(F.col("docs") / F.col("df"))).alias("weight"))


def term_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Terms by the share of documents that have them: facts, inferences and colour."""
    df = term_counts(docs, id_col, text, 2).groupBy("term").agg(F.count("*").alias("df"))
    n = F.broadcast(docs.agg(F.count("*").alias("docs")))  # one row
    share = F.col("df") / F.col("docs")
    return df.crossJoin(n).select("term", "df", F.when(share > 0.5, "Fact").when(share > 0.2, "Inference").otherwise("Colour").alias("class"))


def reciprocal_rank_fusion(rankings: Sequence[DataFrame], id_col: str, k: int = 60, score: str = "score") -> DataFrame:
    """Sum of 1 / (k + rank) over rankings; each has an id and a score, and should be cut to its best rows before."""
    ranked = [r.select(id_col, F.row_number().over(Window.orderBy(F.desc(score), id_col)).alias("rank")) for r in rankings]
    out = ranked[0]
    for other in ranked[1:]:
        out = out.unionByName(other)
    return out.groupBy(id_col).agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def boosted(score: Column, category: Column, title: Column, age_days: Column, views: Column) -> Column:
    """A score with what a category match, a title match, freshness and popularity add."""
    return score + F.when(category, 2.0).otherwise(0.0) + F.when(title, 1.0).otherwise(0.0) + 1.5 * F.exp(-age_days / 365) + F.log10(views + 1) / 4


def adaptive_k(n: Column, narrative: bool = False) -> Column:
    """How many segments to keep of so many: a twentieth, half as much again for narrative, from 15 to 100."""
    wanted = F.ceil(n * 0.05 * (1.5 if narrative else 1.0))
    return F.greatest(F.least(wanted, F.lit(100)), F.lit(15)).cast("int")


def sentences(docs: DataFrame, id_col: str = "doc_id", text: str = "text", longer_than: int = 10) -> DataFrame:
    """Sentences in order, with their places."""
    parts = F.filter(F.split(F.col(text), "(?<=[.!?])\\s+"), lambda s: F.length(s) > longer_than)
    return docs.select(id_col, F.posexplode(parts).alias("place", "sentence"))


def chunks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", target: int = 512) -> DataFrame:
    """Paragraphs of a text merged up to ``target`` tokens of four characters; a longer paragraph stands alone."""
    schema = docs.select(F.col(id_col)).schema.add("chunk", T.IntegerType()).add("text", T.StringType())

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, places, texts = [], [], []
            for key, value in zip(frame[id_col], frame[text], strict=True):
                own: list[str] = []
                for part in (p.strip() for p in (value or "").split("\n")):
                    if part and own and len(own[-1]) + len(part) < 4 * target:
                        own[-1] += "\n" + part
                    elif part:
                        own.append(part)
                ids += [key] * len(own)
                places += range(len(own))
                texts += own
            yield pd.DataFrame({id_col: ids, "chunk": places, "text": texts})

    return docs.select(id_col, text).mapInPandas(cut, schema)


def hash_embedding(docs: DataFrame, id_col: str = "doc_id", text: str = "text", dim: int = 128) -> DataFrame:
    """Unit vectors of hashed term counts: a stand-in for a model, the same on every run.

    A document's terms are counted in its own row, and each distinct term of some rows
    is hashed once; only the counts are shuffled, so that rows of one id are added up.
    """
    schema = docs.select(id_col).schema.add("counts", T.ArrayType(T.LongType()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("t")
            row, terms = lists.value_parent_indices().to_numpy(), lists.flatten().dictionary_encode()
            place = np.array([int(hashlib.sha256(t.encode()).hexdigest()[:8], 16) % dim for t in terms.dictionary.to_pylist()], np.int64)
            counts = np.bincount(row * dim + (place[terms.indices.to_numpy()] if len(place) else 0), minlength=batch.num_rows * dim).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.ListArray.from_arrays(pa.array(np.arange(0, len(counts) + 1, dim), pa.int32()), pa.array(counts))], names=[id_col, "counts"])

    own = docs.select(id_col, tokens(F.col(text), 0).alias("t")).filter(F.size("t") > 0).mapInArrow(count, schema)
    added = own.groupBy(id_col).agg(F.collect_list("counts").alias("all"))
    total = F.aggregate(F.slice("all", 2, F.size("all")), F.element_at("all", 1), lambda a, x: F.zip_with(a, x, lambda m, n: m + n))
    norm = lambda n: F.sqrt(F.aggregate(n, F.lit(0).cast("bigint"), lambda a, x: a + x * x))
    return added.select(id_col, bound(total, lambda n: bound(norm(n), lambda length: F.transform(n, lambda x: x / length))).alias("embedding"))


def mmr(candidates: DataFrame, group: str, id_col: str, relevance: str, vector: str, k: int = 5, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance: in each group ``k`` rows that are relevant and unlike each other.

    Each of ``k`` rounds picks the best row of every group in one aggregation, and
    the others remember how near they are to what has been picked; ties go to the
    more relevant row and then to the smaller id. A group may be of any size.
    """
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform(F.col(vector), lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))
    rows = stored(candidates.select(group, id_col, F.col(relevance).cast("double").alias("__r"), unit.alias("__v"), F.lit(None).cast("double").alias("__near")), "mmr-rows")
    gain = weight * F.col("__r") - (1 - weight) * F.coalesce("__near", F.lit(0.0))
    picks = []
    for place in range(1, k + 1):
        best = stored(rows.groupBy(group).agg(F.min_by(F.struct(id_col, "__v"), F.struct(-gain, -F.col("__r"), F.col(id_col))).alias("b")).select(group, F.col(f"b.{id_col}").alias("__id"), F.col("b.__v").alias("__p")), "mmr-picks")
        picks.append(best.select(group, F.col("__id").alias(id_col), F.lit(place).alias("place")))
        if place < k:
            near = F.aggregate(F.zip_with("__v", "__p", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
            rows = stored(rows.join(best, group).filter(F.col(id_col) != F.col("__id")).select(group, id_col, "__r", "__v", F.greatest("__near", near).alias("__near")), "mmr-rows")
    return reduce(DataFrame.unionByName, picks)


def links(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Distinct addresses that pages link to, and whether on their own host."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""href\s*=\s*["']([^"'#]+)"""), F.lit(1))
    own = pages.select(id_col, F.parse_url(F.col(url), F.lit("HOST")).alias("host"), F.explode(found).alias("link")).distinct()
    target = F.try_parse_url(F.col("link"), F.lit("HOST"))
    return own.select(id_col, "link", (target.isNull() | (target == F.col("host"))).alias("same_host"))


def page_text(html: Column) -> Column:
    """Text of a page without its scripts, styles, navigation and markup."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|aside)\b.*?</\1>", " ")
    plain = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))
