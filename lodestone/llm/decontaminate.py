"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A benchmark item is the set of its windows, ten consecutive words each; a window is
the set of its shingles, each with its place. A document holds a window only if it
holds all its shingles, so the rarest one is a prefix that suffices to find it:
shingles are ordered by how often all documents hold them, only the rarest of each
window is joined, and bounds on position and length discard what can't be a whole
window. A candidate then looks up its other shingles at the few places where they
must stand, and nowhere else. A window that several items share is looked for once.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import fresh, row_key, stored

#: What stands between words once A-Z are lowered.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 3
#: Shingles of a benchmark up to which their table is broadcast: some 20 MB.
BROADCAST_SHINGLES = 200_000


def words(text: Column) -> Column:
    """Words of a text: A-Z lowered, runs of digits, letters and characters beyond ASCII. Null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, GAP, -1), "")


def shingles(own: Column, k: int) -> Column:
    """Runs of ``k`` words, joined by spaces, in order."""
    run = lambda i: F.concat_ws(" ", *(F.get(own, i + j) for j in range(k)))
    return F.when(F.size(own) >= k, F.transform(F.sequence(F.lit(0), F.size(own) - k), run)).otherwise(F.array().cast("array<string>"))


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` (id, ``row``, ``n_words``), and those with windows: ``row``, ``n_hit``, ``items``."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(item_text)).alias("w")).filter(F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(window)))
    held = items.select("item", "length", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1), lambda i: F.array_join(F.slice("w", i, F.col("length")), " "))).alias("window"))
    held = stored(held.select("item", "length", F.concat_ws(":", F.xxhash64("window"), F.xxhash64(F.lit(1), "window")).alias("wid"), "window").distinct(), "benchmark-windows")
    # one of at most k sizes for each window: k for all but windows of fewer words
    cut = held.select("wid", "length", F.split("window", " ").alias("w"), F.least("length", F.lit(k)).alias("k")).dropDuplicates(["wid"])
    own = F.lit(None).cast("array<string>")
    for size in range(1, k + 1):
        own = F.when(F.col("k") == size, shingles(F.col("w"), size)).otherwise(own)
    runs = stored(cut.select("wid", "length", "k", (F.col("length") - F.col("k") + 1).alias("need"), F.posexplode(own).alias("at", "shingle")), "benchmark-shingles")
    sizes = sorted(r["k"] for r in runs.select("k").distinct().collect())  # k of them at most
    distinct = runs.select("shingle", "k").distinct()
    small = distinct.count() <= BROADCAST_SHINGLES

    read = docs.select(F.col(id_col), row_key(id_col, text_col).alias("row"), words(F.col(text_col)).alias("w"))
    rows = F.array(F.lit("")) if small else F.array().cast("array<string>")
    listed = read.select(id_col, "row", F.size("w").alias("n_words"), F.posexplode(F.concat(rows, *(shingles(F.col("w"), size) for size in sizes))).alias("place", "shingle"))
    before = F.lit(int(small))
    for size in sizes:  # where the shingles of each size start
        before = before + F.when(F.col("k") > size, F.greatest(F.col("n_words") - (size - 1), F.lit(0))).otherwise(0)
    columns = [id_col, "row", "n_words", "shingle", F.when(F.col("k") > 0, F.col("place") - before).alias("pos")]
    if small:  # an empty shingle stands before the others of a document, and keeps a row for it
        kept = distinct.unionByName(docs.sparkSession.createDataFrame([("", 0)], "shingle string, k int"))
        met = stored(listed.join(F.broadcast(kept), "shingle").select(columns), "benchmark-meetings")
        every = met.filter(F.col("pos").isNull())
    else:
        met = stored(listed.join(distinct, "shingle").select(columns), "benchmark-meetings")
        every = read.select(id_col, "row", F.size("w").alias("n_words"))
    hits = met.filter(F.col("pos").isNotNull()).select("row", "n_words", "shingle", "pos").distinct()

    rarity = hits.groupBy("shingle").agg(F.count("*").alias("freq"))
    # a window some shingle of which no document holds can't occur
    prefixes = runs.join(rarity, "shingle", "left").groupBy("wid", "length", "need").agg(F.min(F.struct("freq", "shingle", "at")).alias("first"), F.count("freq").alias("there")).filter("there = need").select("wid", "length", "need", "first.shingle", "first.at")
    start = F.col("pos") - F.col("at")
    candidates = stored(hits.join(prefixes, "shingle").filter((start >= 0) & (start + F.col("length") <= F.col("n_words"))).select("row", "wid", "length", "need", start.alias("start"), F.col("at").alias("first_at")), "benchmark-candidates")
    # each other shingle of a candidate at the one place where it must stand
    others = candidates.join(runs.select("wid", "at", "shingle"), "wid").filter("at <> first_at").select("row", "wid", "length", "need", "start", "shingle", (F.col("start") + F.col("at")).alias("pos"))
    whole = others.join(hits.select("row", "shingle", "pos"), ["row", "shingle", "pos"], "left_semi").groupBy("row", "wid", "length", "need", "start").agg(F.count("*").alias("n")).filter("n = need - 1")
    found = stored(whole.select("row", "wid", "length", "start").unionByName(candidates.filter("need = 1").select("row", "wid", "length", "start")), "benchmark-found")

    # words inside are counted over merged stretches, however many windows overlap
    along = Window.partitionBy("row").orderBy("start", "end")
    stretches = found.select("row", "start", (F.col("start") + F.col("length")).alias("end")).distinct().withColumn("reach", F.coalesce(F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hit = stretches.groupBy("row").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "reach"), F.lit(0))).cast("long").alias("n_hit"))
    names = found.select("row", "wid").distinct().join(held.select("wid", "item"), "wid").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return every.select(id_col, "row", F.col("n_words").cast("long").alias("n_words")), hit.join(names, "row", "left")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """Words of documents inside occurrences of windows of benchmark items.

    A window is ten (``window``) consecutive words of an item; an item with fewer
    words, but not none, is one window. Returns a row for each row of ``docs``: its
    id, ``n_words``, ``n_hit`` (words inside any occurrence), ``n_items`` (items
    with occurring windows), ``items_sha256`` (of their ids, as strings in order,
    joined by commas) and ``contaminated``. A null text has no words; whole texts
    are read, however long; repeated documents give repeated results, repeated
    items count once; words that only items with a null id mark count as hit, but
    those items don't count. Other columns are ignored. Without items nothing is
    hit, without documents there are no rows.
    """
    rows, found = find_windows(docs, benchmark, id_col=id_col, **options)
    none = F.array().cast("array<string>")
    return rows.join(found, "row", "left").select(id_col, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of ``docs``, with all their columns, whatever their names, that hold no window of a benchmark item."""
    _, found = find_windows(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    own = fresh(docs, "own_row")
    return docs.withColumn(own, row_key(id_col, text_col)).join(found.select(F.col("row").alias(own)), own, "left_anti").select(docs.columns)
