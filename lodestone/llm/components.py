"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import drop_stored, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation: links of each node move to the smallest node that it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sides = both if large else both.filter("b < a")
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = (both.filter("b > a") if large else sides).join(least, "a").select(F.col("b").alias("x"), F.col("m"))
    own = least.select(F.col("a").alias("x"), "m")
    out = (moved if large else moved.unionByName(own)).filter("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b"))
    return out.distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """For each node of the links ``a``, ``b`` that isn't the smallest of its component: ``node`` and ``component``.

    Large and small stars alternate until every link joins a node to the smallest
    of its component, in a number of rounds that grows as the logarithm of the
    nodes. A hub's links are aggregated before the exchange and joined by a key
    that adaptive execution can split; each round is a table in the shared folder.
    """
    current = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "stars")
    state = _state(current)
    for _ in range(most_rounds):
        before, current = current, stored(_star(_star(current, True), False), "stars")
        state, last = _state(current), state
        drop_stored(before)
        if state == last:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError("components did not settle")


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The components that links ``a``, ``b`` make of components already known: again ``node`` and ``component``.

    Only the graph of components is searched: links within one leave before, and the
    nodes of a component follow its smallest.
    """
    of = lambda end: groups.select(F.col("node").alias(end), F.col("component").alias(f"root_{end}"))
    ends = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    roots = stored(connected(ends.filter("a <> b").distinct()), "star-roots")
    moved = groups.join(roots.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return moved.unionByName(roots)
