"""Graphs as tables of edges: co-occurrence, neighbourhoods, paths, communities."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.sources.scratch import stored

#: Pairs that a task counts.
TASK_PAIRS = 2_000_000


def rare_terms(docs: DataFrame, id_col: str, text: str, least_idf: float = 3.5, longer_than: int = 3) -> DataFrame:
    """Distinct rare terms of each document with a confidence: candidates for entities."""
    own = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(tokens(F.col(text), longer_than))).alias("entity"))
    n = F.broadcast(docs.agg(F.count("*").alias("docs")))  # one row
    df = own.groupBy("entity").agg(F.count("*").alias("df")).crossJoin(n).select("entity", "df", F.log(F.col("docs") / F.col("df")).alias("idf")).filter(F.col("idf") >= least_idf)
    return own.join(df, "entity").select(F.col("id").alias(id_col), "entity", "df", F.least(F.lit(0.9), 0.4 + 0.05 * F.col("idf")).alias("confidence"))


def cooccurrence(mentions: DataFrame, unit: str, entity: str, least: int = 2, limit: int | None = 500, block: int = 200) -> DataFrame:
    """Unordered pairs of entities that share units, the most frequent first.

    A unit of at most ``block`` mentions is paired in its own row, in tasks of some ``TASK_PAIRS``
    pairs each, so a task's memory doesn't grow with the input. The entities of a larger unit are
    dealt over blocks, which meet all of the unit's entities in tasks of their own: no unit is left out.
    """
    own = mentions.select(F.col(unit).alias("u"), F.col(entity).alias("e")).filter("u is not null and e is not null")
    sizes = own.groupBy("u").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > block).select("u")
    some, most = sizes.agg(F.sum(F.when(F.col("n") <= block, F.col("n") * (F.col("n") - 1) / 2)), F.max("n")).first()
    split = (most or 0) > block
    small = own.join(large, "u", "left_anti") if split else own
    tasks = max(own.sparkSession.sparkContext.defaultParallelism, math.ceil((some or 0) / TASK_PAIRS))
    listed = small.repartition(tasks, "u").groupBy("u").agg(F.array_sort(F.collect_set("e")).alias("own")).filter(F.size("own") > 1)
    pairs = listed.select("own", F.posexplode("own").alias("at", "entity_a")).select("entity_a", F.explode(F.slice("own", F.col("at") + 2, F.size("own"))).alias("entity_b"))
    if split:
        pairs = pairs.unionByName(_block_pairs(own.join(large, "u", "left_semi").distinct(), block))
    counts = pairs.groupBy("entity_a", "entity_b").agg(F.count("*").alias("weight")).filter(F.col("weight") >= least)
    return counts.orderBy(F.desc("weight"), "entity_a", "entity_b").limit(limit) if limit else counts


def _block_pairs(own: DataFrame, block: int) -> DataFrame:
    """Pairs of the distinct entities of large units, by blocks."""
    sized = own.join(own.groupBy("u").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "u")
    left = sized.select("u", F.pmod(F.xxhash64("e"), "blocks").cast("int").alias("block"), F.col("e").alias("entity_a"))
    right = sized.select("u", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("e").alias("entity_b"))
    return left.join(right, ["u", "block"]).filter("entity_a < entity_b").select("entity_a", "entity_b")


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges ``src``, ``dst`` and their reverse."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reach(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """Nodes within so many undirected hops of ``start`` (a column ``node``), with their distance."""
    links = both_ways(edges)
    seen = start.select("node").distinct().withColumn("hops", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        front = stored(front.join(links, front["node"] == links["src"]).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop)), "reached")
        seen = seen.unionByName(front)
    return seen


def shortest_path(edges: DataFrame, source: object, target: object, hops: int = 3) -> DataFrame:
    """One shortest path of at most so many undirected hops, as an array of nodes; nothing if there is none."""
    links = both_ways(edges)
    paths = edges.sparkSession.range(1).select(F.array(F.lit(source)).alias("path"))
    found = paths.filter(F.element_at("path", -1) == F.lit(target))
    for _ in range(hops):
        last = F.element_at("path", -1)
        ahead = paths.select("path", last.alias("src")).join(links, "src").filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        # of the paths to a node the smallest is enough
        paths = ahead.groupBy(F.element_at("path", -1).alias("end")).agg(F.min("path").alias("path")).select("path")
        found = found.unionByName(paths.filter(F.element_at("path", -1) == F.lit(target)))
    return found.orderBy(F.size("path"), "path").limit(1)


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: modularity of communities (``node``, ``community``) over weighted undirected edges."""
    c = communities.select("node", "community")
    named = edges.join(c.select(F.col("node").alias("src"), F.col("community").alias("ca")), "src").join(c.select(F.col("node").alias("dst"), F.col("community").alias("cb")), "dst")
    total = F.broadcast(named.agg(F.sum("weight").alias("m")))  # one row
    inside = named.filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("inside"))
    degree = named.select(F.explode(F.array("ca", "cb")).alias("community"), "weight").groupBy("community").agg(F.sum("weight").alias("degree"))
    share = F.coalesce("inside", F.lit(0)) / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), F.lit(2))
    return degree.join(inside, "community", "left").crossJoin(total).agg(F.sum(share).alias("modularity"), F.count("*").alias("communities"))


def communities(edges: DataFrame, most_rounds: int = 500) -> DataFrame:
    """Communities of weighted undirected edges by local moving: rounds of moves that raise the modularity.

    In a round each node looks at the communities around it and may move to the one
    where the modularity gains most, ties to the smaller one; nodes of one half move
    in even rounds, of the other in odd ones, so that neighbours don't swap for ever.
    It ends when two rounds in a row gain nothing, and gives the best state seen; not to
    end within ``most_rounds`` is an error.
    """
    links = stored(edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).filter("src <> dst"), "community-links")
    degrees = links.groupBy("src").agg(F.sum("weight").alias("degree")).select(F.col("src").alias("node"), "degree")
    total = degrees.agg(F.sum("degree")).first()[0]
    labels = stored(degrees.select("node", "degree", F.col("node").alias("community")), "communities")
    if not total:
        return labels.select("node", "community")

    def quality(labels: DataFrame) -> float:
        inside = links.join(labels.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst").filter("a = b").agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
        squares = labels.groupBy("community").agg(F.sum("degree").alias("d")).agg(F.sum(F.pow(F.col("d") / F.lit(float(total)), F.lit(2)))).first()[0]
        return float(inside) / float(total) - squares

    best, idle = (quality(labels), labels), 0
    for turn in range(most_rounds):
        own = labels.select(F.col("node").alias("src"), F.col("community").alias("now"), "degree")
        sizes = labels.groupBy("community").agg(F.sum("degree").alias("size"))
        around = links.join(labels.select(F.col("node").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.sum("weight").alias("w"))
        # a node's own community is an option even without a link into it
        options = around.unionByName(own.select("src", F.col("now").alias("community"), F.lit(0).cast(around.schema["w"].dataType).alias("w"))).groupBy("src", "community").agg(F.sum("w").alias("w"))
        rest = F.col("size") - F.when(F.col("community") == F.col("now"), F.col("degree")).otherwise(0)
        gain = F.round(F.col("w") - F.col("degree") * rest / F.lit(float(total)), 9)
        stay = (F.col("community") != F.col("now")).cast("int")
        chosen = options.join(own, "src").join(sizes, "community").groupBy("src").agg(F.min_by("community", F.struct(-gain, stay, "community")).alias("next"))
        moves = F.pmod(F.xxhash64("node"), F.lit(2)) == turn % 2
        labels = stored(labels.join(chosen, labels["node"] == chosen["src"], "left").select("node", "degree", F.when(moves, F.coalesce("next", "community")).otherwise(F.col("community")).alias("community")), "communities")
        now = quality(labels)
        idle = 0 if now > best[0] + 1e-9 else idle + 1
        best = max(best, (now, labels), key=lambda x: x[0])
        if idle == 2:
            return best[1].select("node", "community")
    raise RuntimeError("communities did not settle")


def closure(parents: DataFrame) -> DataFrame:
    """All ``ancestor``, ``descendant`` pairs with their depth, from ``node`` and ``parent``; a node is its own at depth 0.

    Levels are added until one is empty, however deep; a cycle is an error.
    """
    own = parents.select("node", "parent")
    level = own.select(F.col("node").alias("ancestor"), F.col("node").alias("descendant"), F.lit(0).alias("depth"))
    out, depth = level, 0
    while True:
        depth += 1
        level = stored(level.join(own, level["ancestor"] == own["node"]).filter("parent is not null").select(F.col("parent").alias("ancestor"), "descendant", F.lit(depth).alias("depth")), "closure-level")
        if level.isEmpty():
            return out
        if not level.filter("ancestor = descendant").isEmpty():
            raise ValueError("a node is its own ancestor")
        out = out.unionByName(level)
