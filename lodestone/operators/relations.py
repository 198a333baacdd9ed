"""Joins, unions, groupings and choices of rows that reports are made of."""

from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.functions.text import levenshtein_similarity, tokens


def chosen_columns(df: DataFrame, include: Collection[str] = (), exclude: Collection[str] = (), target: str | None = None) -> DataFrame:
    """Columns by name, case aside: those included (all if none), less the excluded ones; the target comes first in any case."""
    wanted, unwanted, first = {c.lower() for c in include}, {c.lower() for c in exclude}, (target or "").lower()
    kept = [c for c in df.columns if (not wanted or c.lower() in wanted) and c.lower() not in unwanted and c.lower() != first]
    return df.select(*[c for c in df.columns if c.lower() == first], *kept)


def sample_rows(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows in an order as texts, a null as ``NULL``."""
    return df.orderBy(order).limit(n).select(*(F.coalesce(F.col(c).cast("string"), F.lit("NULL")).alias(c) for c in df.columns))


def random_sample(df: DataFrame, key: str, n: int = 5_000, seed: int = 42) -> DataFrame:
    """``n`` rows drawn at random, the same on every run with a seed."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def any_of(column: str, texts: Sequence[str]) -> Column:
    """Whether a column's text holds any of several texts, case aside."""
    low = F.lower(F.col(column).cast("string"))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(t.lower())) for t in texts))


def in_categories(df: DataFrame, category: str, wanted: Sequence, tags: Column, tag: str) -> DataFrame:
    """Rows of some categories of which any tag holds a text, case aside."""
    return df.filter(F.col(category).isin(*wanted) & F.exists(tags, lambda x: F.contains(F.lower(x), F.lit(tag.lower()))))


def named_edges(edges: DataFrame, names: DataFrame, node: str, name: str) -> DataFrame:
    """Edges ``src``, ``dst`` with the names of both ends."""
    of = lambda end: names.select(F.col(node).alias(end), F.col(name).alias(f"{end}_name"))
    return edges.join(of("src"), "src").join(of("dst"), "dst")


def neighbourhood(edges: DataFrame, names: DataFrame, node: str, name: str, centre: object) -> DataFrame:
    """The named edges that touch a node."""
    return named_edges(edges.filter((F.col("src") == F.lit(centre)) | (F.col("dst") == F.lit(centre))), names, node, name)


def nodes(edges: DataFrame) -> DataFrame:
    """Distinct ids of both ends of edges."""
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def unseen(found: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key hasn't been seen."""
    return found.join(seen.select(key).distinct(), key, "left_anti")


def members(groups: DataFrame, rows: DataFrame, key: str, name: str) -> DataFrame:
    """Every group with the sorted names of its rows, joined by commas; a group without rows has none."""
    listed = rows.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(name)), ",").alias("members"))
    return groups.join(listed, key, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "members": F.coalesce("members", F.lit(""))})


def containing(texts: DataFrame, id_col: str, text: str, names: DataFrame, name: str, width: int = 3, slots: int = 1 << 16) -> DataFrame:
    """Pairs of a text and a name that stands somewhere in it, case aside.

    A name is looked for only in texts that have its first ``width`` characters: an equal join instead of all pairs, under
    hashes of which there are ``slots``, a power of two. Texts themselves stay out of that join and meet only the names
    found for them.
    """
    wanted = names.select(F.lower(name).alias("name")).filter("name <> ''").distinct().withColumn("slot", F.pmod(F.xxhash64(F.substring("name", 1, width)), F.lit(slots)).cast("int"))
    lengths = wanted.select("slot", F.least(F.length("name"), F.lit(width)).alias("n")).distinct().collect()  # ``slots`` times ``width`` pairs at most
    known, sizes = frozenset(r["slot"] for r in lengths), sorted({r["n"] for r in lengths})

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, low in enumerate(batch.column(1)):
                own = low.as_py() or ""
                grams = {own[j : j + n] for n in sizes for j in range(len(own) - n + 1)}
                here = known & {xxhash.xxh64_intdigest(g, seed=42) & (slots - 1) for g in grams}  # what ``xxhash64`` gives in Spark
                at += [i] * len(here)
                found += here
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.int32())], names=["__id", "slot"])

    lows = texts.select(F.col(id_col).alias("__id"), F.lower(text).alias("__low"))
    ids = lows.mapInArrow(starts, lows.select("__id").schema.add("slot", T.IntegerType()))
    found = ids.join(wanted, "slot").groupBy("__id").agg(F.collect_set("name").alias("__names"))
    met = texts.select(id_col, F.lower(text).alias("__low")).join(found, F.col(id_col).eqNullSafe(F.col("__id")))
    return met.select(id_col, F.explode(F.filter("__names", lambda n: F.contains(F.col("__low"), n))).alias("name"))


def suggestions(slugs: DataFrame, slug: str, asked: str, learned: DataFrame, most: float = 0.3) -> DataFrame:
    """Slugs by their likeness to an asked one, and more for those that readers were led to before (``slug``, ``hits``)."""
    return slugs.join(learned, slug, "left").select(slug, (levenshtein_similarity(F.col(slug), F.lit(asked)) + F.least(F.lit(most), 0.1 * F.coalesce("hits", F.lit(0)))).alias("score"))


def text_match(name: Column, category: Column, brand: Column, text: str) -> Column:
    """How well a product fits a text: its name counts 1 and half as much again at its start, its category 0.7, its brand 0.6."""
    there = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
    score = F.when(there(name), 1.0).otherwise(0.0) + F.when(F.lower(name).startswith(text.lower()), 0.5).otherwise(0.0)
    return score + F.when(there(category), 0.7).otherwise(0.0) + F.when(there(brand), 0.6).otherwise(0.0)


def merged_scores(by_text: DataFrame, by_vector: DataFrame, key: str, boost: float = 1.5) -> DataFrame:
    """One score of each key of two lists: its own, or the larger of both times ``boost`` where both have it."""
    both = by_text.select(key, F.col("score").alias("a")).join(by_vector.select(key, F.col("score").alias("b")), key, "full_outer")
    return both.select(key, F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.greatest("a", "b") * boost).otherwise(F.coalesce("a", "b")).alias("score"))


def group_stats(memberships: DataFrame, profiles: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Members, mean score and centroid of each segment."""
    return memberships.join(profiles.select(key, *columns), key).groupBy("segment").agg(F.count("*").alias("members"), F.avg("score").alias("score"), *(F.avg(c).alias(c) for c in columns))


def popular(pages: DataFrame, url: str, views: Column, below: str, k: int = 10) -> DataFrame:
    """The most viewed pages whose path starts with ``below``, the languages of a page taken together."""
    path = F.regexp_replace(F.regexp_extract(url, "://[^/]+([^?#]*)", 1), r"\.[a-z]{2}$", "")
    return pages.select(path.alias("path"), views.alias("v")).filter(F.col("path").startswith(below)).groupBy("path").agg(F.sum("v").alias("views")).orderBy(F.desc("views"), "path").limit(k)


def values_of(df: DataFrame, key: str, value: str) -> DataFrame:
    """The distinct values of each key in order, joined by commas."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias("values"))


def word_suggestions(df: DataFrame, text: str, prefix: str, k: int = 10) -> DataFrame:
    """The most frequent words of three or more characters with a prefix."""
    words = df.select(F.explode(F.split(F.lower(text), " ")).alias("word")).filter((F.length("word") >= 3) & F.col("word").startswith(prefix))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def significant(candidates: DataFrame, limit: int = 500) -> DataFrame:
    """Entities named in three texts, or surely in two, by their mentions times their confidence: the first ``limit`` of them."""
    own = candidates.groupBy("entity").agg(F.count("*").alias("mentions"), F.max("confidence").alias("confidence"))
    kept = own.filter((F.col("mentions") >= 3) | ((F.col("confidence") >= 0.8) & (F.col("mentions") >= 2)))
    return kept.orderBy(F.desc(F.col("mentions") * F.col("confidence")), "entity").limit(limit)


def link_kind(link: Column) -> Column:
    """What a link leads to: code, a post, or another site."""
    host = F.lower(F.regexp_extract(link, "://([^/?#:]+)", 1))
    return F.when(host.rlike(r"(^|\.)github\.com$"), "github").when(link.contains("/blog/"), "blog").otherwise("site")


def upserted_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with the weights of both tables added up."""
    return old.select("src", "dst", "weight").unionByName(new.select("src", "dst", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def outbox(messages: DataFrame, processed: str, order: Sequence[str], batch: int = 100) -> DataFrame:
    """The next ``batch`` unprocessed messages in order."""
    return messages.filter(~F.col(processed)).orderBy(*order).limit(batch)


def projected(df: DataFrame, key: str, angle: Column, radius: Column) -> DataFrame:
    """Polar places as ``x`` and ``y``, each scaled to -1 to 1 over all rows."""
    own = df.select(key, (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))
    ends = F.broadcast(own.agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max)))))  # one row
    scaled = lambda c: F.coalesce(F.try_divide(2 * (F.col(c) - F.col(f"lo_{c}")), F.col(f"hi_{c}") - F.col(f"lo_{c}")) - 1, F.lit(0.0)).alias(c)
    return own.crossJoin(ends).select(key, scaled("x"), scaled("y"))


def similar_by_tags(items: DataFrame, key: str, tags: Column, item: object, k: int = 5) -> DataFrame:
    """The ``k`` other items that share most tags with one item; only its own tags are joined."""
    each = items.select(key, F.explode(F.array_distinct(tags)).alias("tag"))
    mine = each.filter(F.col(key) == F.lit(item)).select("tag")
    return each.filter(F.col(key) != F.lit(item)).join(mine, "tag").groupBy(key).agg(F.count("*").alias("shared")).orderBy(F.desc("shared"), key).limit(k)


def numeric_similarity(a: Column, b: Column) -> Column:
    """Likeness of two texts, or of the numbers that they are if that is greater."""
    x, y = a.try_cast("double"), b.try_cast("double")
    near = 1 - F.try_divide(F.abs(x - y), F.greatest(F.abs(x), F.abs(y)))
    return F.greatest(levenshtein_similarity(a, b), F.coalesce(near, F.when(x == y, 1.0), F.lit(0.0)))


def stratified(df: DataFrame, group: str, order: Sequence[str], k: int) -> DataFrame:
    """``k`` rows of each group: its first, its last and others evenly between; all of a smaller group."""
    rn, n = F.row_number().over(Window.partitionBy(group).orderBy(*order)), F.count("*").over(Window.partitionBy(group))
    placed = df.withColumns({"__rn": rn, "__n": n})
    at = lambda i: F.floor((i - 1) * (k - 1) / (F.col("__n") - 1))  # noqa: E731  the step of a row; a row that starts one is kept
    return placed.filter((F.col("__n") <= k) | (F.col("__rn") == 1) | (at(F.col("__rn")) > at(F.col("__rn") - 1))).drop("__rn", "__n")


def sentiment_likeness(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Likeness of two texts by their sentiment (-1 to 1), formality and subjectivity (0 to 1) and their leading emotion."""
    sentiment = 1 - F.abs(a[0] - b[0]) / 2
    return 0.4 * sentiment + 0.2 * (1 - F.abs(a[1] - b[1])) + 0.2 * (1 - F.abs(a[2] - b[2])) + 0.2 * F.when(a[3] == b[3], 1.0).otherwise(0.5)


def tags_of(text: str) -> Column:
    """Words of a text as tags."""
    return tokens(F.col(text), 0)
