"""Nearest vectors by a proximity graph.

Every vector has links to vectors like it. Vectors are dealt over cells around
centres that are fitted on a bounded sample, each into the cells of its nearest
centres, and linked to the best they meet there. A search walks the graph best
first, all queries at once: a round expands the best vectors that each query has
met and not expanded yet, and it ends when no query has any left among its best.
A query keeps its best only, and a vector's row holds what it links to with their
vectors in bytes, so a round moves the queries' fronts and not the vectors; the
best of a query are measured exactly in the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.vectors import dot, normalized
from lodestone.sources.scratch import drop_stored, stored

#: Vectors a centre, cells that a vector is dealt into, and the most vectors that are compared with each other at once.
CELL, CELLS, MOST = 1_500, 4, 8_192
#: Vectors a centre, and at most, of the sample that centres are fitted on.
SAMPLE, MOST_SAMPLE = 64, 50_000
#: Queries that a task brings up to date together, and rows of the front whose links it measures together.
TOGETHER, SLICE = 200, 500


@dataclass(frozen=True)
class Graph:
    """Unit vectors (``node``, ``v``) and links (``src``, ``dst``, ``similarity``), the ``k`` best of each vector."""

    nodes: DataFrame
    links: DataFrame
    k: int


def _nodes(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """One unit vector an id; null ids, and vectors that are null or zero, take no part."""
    own = vectors.select(F.col(id_col).alias("node"), normalized(F.col(vector)).alias("v")).filter(F.col("node").isNotNull() & F.exists("v", lambda x: x != 0))
    return own.groupBy("node").agg(F.min("v").alias("v"))


def _first(links: DataFrame, k: int) -> DataFrame:
    """The ``k`` best links of each vector; ties to the smaller id."""
    order = Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")
    return links.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= k).drop("__k")


def _best(links: DataFrame, k: int) -> DataFrame:
    """The ``k`` best links of each vector, each once."""
    return _first(links.repartition("src").groupBy("src", "dst").agg(F.max("similarity").alias("similarity")), k)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float32)


def _centres(nodes: DataFrame, count: int, n: int, seed: int) -> np.ndarray:
    """Unit centres of a sample of the vectors, by so many that there are."""
    share = min(SAMPLE * count, MOST_SAMPLE) / n
    own = nodes.filter(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy("node").select("v").toPandas()  # a bounded sample
    m = _matrix(own["v"]) if len(own) else _matrix(nodes.limit(1).toPandas()["v"])
    rng = np.random.default_rng(seed)
    centres = m[rng.permutation(len(m))[:count]]
    for _ in range(8):
        nearest = np.argmax(m @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, m)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
    return centres


def _side_by_side(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """Links between vectors of the same cell; a cell of more than ``MOST`` vectors is parted at random, another way than other cells."""
    kind = nodes.schema["node"].dataType.simpleString()
    n = nodes.count()
    centres = _centres(nodes, max(1, math.ceil(n / CELL)), n, seed)
    cells = min(CELLS, len(centres))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in frames:
            if len(own):
                m = _matrix(own["v"])
                at = np.argpartition(-(m @ centres.T), cells - 1, axis=1)[:, :cells]
                for i in range(cells):
                    yield pd.DataFrame({"cell": at[:, i], "node": own["node"], "v": list(m)})

    def compare(own: pd.DataFrame) -> pd.DataFrame:
        m, ids = _matrix(own["v"]), own["node"].to_numpy()
        take, found = min(k, len(own) - 1), []
        for i in range(0, len(own) if take > 0 else 0, SLICE):
            s = m[i : i + SLICE] @ m.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
            at = np.argpartition(-s, take - 1, axis=1)[:, :take]
            found.append(pd.DataFrame({"src": np.repeat(ids[i : i + SLICE], take), "dst": ids[at.ravel()], "similarity": np.take_along_axis(s, at, 1).ravel().astype(float)}))
        return pd.concat(found) if found else pd.DataFrame({"src": ids[:0], "dst": ids[:0], "similarity": []})

    dealt = nodes.mapInPandas(deal, f"cell int, node {kind}, v array<float>")
    parts = F.broadcast(dealt.groupBy("cell").agg(F.ceil(F.count("*") / MOST).alias("parts")))  # a row a cell
    parted = dealt.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("node", "cell"), "parts"))
    return parted.groupBy("cell", "part").applyInPandas(compare, f"src {kind}, dst {kind}, similarity double")


def _around(links: DataFrame, k: int) -> DataFrame:
    """``node`` and ``near``: each vector's links, and of the links to it as many again, the best."""
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "similarity")
    both = links.select("src", "dst").unionByName(_first(back, k).select("src", "dst")).distinct()
    return both.select(F.col("src").alias("node"), F.col("dst").alias("near"))


def _packed(graph: Graph, dim: int) -> DataFrame:
    """``node``, ``near`` and ``codes``: what a vector links to, with a scale and a byte a component of each."""
    kind = graph.nodes.schema["node"].dataType.simpleString()

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in frames:
            if len(own):
                m = _matrix(own["v"])
                out = np.empty(len(m), _record(dim))
                out["scale"] = np.abs(m).max(axis=1) / 127
                out["code"] = np.rint(m / out["scale"][:, None])
                yield pd.DataFrame({"near": own["node"], "code": [x.tobytes() for x in out]})

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in frames:
            yield pd.DataFrame({"node": own["node"], "near": own["near"], "codes": [b"".join(x) for x in own["codes"]]})

    codes = graph.nodes.mapInPandas(coded, f"near {kind}, code binary")
    listed = _around(graph.links, graph.k).join(codes, "near").groupBy("node").agg(F.collect_list(F.struct("near", "code")).alias("own"))
    return listed.select("node", F.col("own.near").alias("near"), F.col("own.code").alias("codes")).mapInPandas(pack, f"node {kind}, near array<{kind}>, codes binary")


def _record(dim: int) -> np.dtype:
    return np.dtype([("scale", "<f4"), ("code", "i1", (dim,))])


def build_graph(vectors: DataFrame, id_col: str, vector: str, k: int = 32, seed: int = 3) -> Graph:
    """A graph of the ``k`` most similar vectors (cosine) that each meets in its cells.

    Null ids and null or zero vectors take no part; of a repeated id one vector counts.
    """
    nodes = stored(_nodes(vectors, id_col, vector), "graph-nodes")
    if nodes.isEmpty():
        return Graph(nodes, nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("similarity")), k)
    return Graph(nodes, stored(_best(_side_by_side(nodes, k, seed), k), "graph-links"), k)


def search_graph(graph: Graph, queries: DataFrame, k: int = 20, reach: int = 256, width: int = 32, entries: int = 64, own: Column | None = None) -> DataFrame:
    """``query``, ``rank``, ``node`` and ``similarity``: the ``k`` most similar vectors that a best-first walk finds.

    ``queries`` has ``query`` and ``q``. A query starts from ``entries`` vectors, expands up
    to ``width`` a round, and looks on as long as one of its ``reach`` best isn't expanded.
    ``own`` is a condition on query and node that keeps a query from finding itself.
    """
    asked = stored(queries.select("query", normalized(F.col("q")).alias("q")).filter(F.exists("q", lambda x: x != 0)), "graph-queries")
    kind, of = graph.nodes.schema["node"].dataType.simpleString(), asked.schema["query"].dataType.simpleString()
    first = graph.nodes.orderBy(F.xxhash64("node"), "node").limit(entries).toPandas()  # so many rows
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "node")
    if not len(first):
        return graph.nodes.crossJoin(asked).limit(0).withColumn("similarity", F.lit(0.0)).withColumn("rank", F.row_number().over(best)).select("query", "rank", "node", "similarity")
    ids, m = first["node"].to_numpy(), _matrix(first["v"])
    dim = m.shape[1]
    packed = stored(_packed(graph, dim), "graph-around")
    shape = f"query {of}, q array<float>, node array<{kind}>, similarity array<float>, done array<boolean>, open boolean"

    def kept(node: np.ndarray, similarity: np.ndarray, done: np.ndarray) -> tuple:
        """The best that a query has met, each once; of the same the one that comes first."""
        node, at = np.unique(node, return_index=True)
        order = np.lexsort((np.arange(len(node)), -similarity[at]))[:reach]
        done = done[at][order]
        return node[order], similarity[at][order], done, bool((~done).any())

    def start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            if len(rows):
                q = _matrix(rows["q"])
                met = [kept(ids, s, np.zeros(len(ids), bool)) for s in q @ m.T]
                yield pd.DataFrame({"query": rows["query"], "q": list(q)} | {c: list(x) for c, x in zip(("node", "similarity", "done", "open"), zip(*met, strict=True), strict=True)})

    def turn(done: np.ndarray) -> np.ndarray:
        """Places that a query expands next."""
        return np.flatnonzero(~np.asarray(done, bool))[:width]

    def fronts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            at = [turn(done) for done in rows["done"]]
            if sum(map(len, at)):
                i = np.repeat(np.arange(len(rows)), list(map(len, at)))
                floor = np.array([s[-1] if len(s) >= reach else -np.inf for s in rows["similarity"]], np.float32)
                yield pd.DataFrame({"query": rows["query"].to_numpy()[i], "q": rows["q"].to_numpy()[i], "floor": floor[i], "node": np.concatenate([x[t] for x, t in zip(rows["node"], at, strict=True)])})

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links of the front that can be among a query's best."""
        for frame in frames:
            for j in range(0, len(frame), SLICE):
                rows = frame[j : j + SLICE]
                count = rows["near"].map(len).to_numpy()
                codes, i = np.frombuffer(b"".join(rows["codes"]), _record(dim)), np.repeat(np.arange(len(rows)), count)
                s = np.einsum("ij,ij->i", codes["code"].astype(np.float32), _matrix(rows["q"])[i]) * codes["scale"]
                good = s > rows["floor"].to_numpy()[i]
                near, ends = np.concatenate(rows["near"].to_numpy())[good], np.cumsum(np.bincount(i[good], minlength=len(rows)))[:-1]
                yield pd.DataFrame({"query": rows["query"].to_numpy(), "node": np.split(near, ends), "similarity": np.split(s[good], ends)})

    def update(rows: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        more = met.groupby("query", sort=False).indices
        nodes, values, out = met["node"].to_numpy(), met["similarity"].to_numpy(), []
        for query, node, similarity, done in zip(rows["query"], rows["node"], rows["similarity"], rows["done"], strict=True):
            done = np.array(done, bool)
            done[turn(done)] = True
            at = more.get(query, [])
            fresh = np.concatenate([node, *(nodes[i] for i in at)]), np.concatenate([similarity, *(values[i] for i in at)])
            out.append(kept(*fresh, np.concatenate([done, np.zeros(len(fresh[0]) - len(done), bool)])))
        return pd.DataFrame({"query": rows["query"], "q": rows["q"]} | {c: list(x) for c, x in zip(("node", "similarity", "done", "open"), zip(*out, strict=True) if out else [[]] * 4, strict=True)})

    state = stored(asked.mapInPandas(start, shape), "graph-met")
    group = F.floor(F.pmod(F.xxhash64("query"), F.lit(1 << 40)) / F.lit((1 << 40) / max(1, state.count() // TOGETHER))).alias("g")
    ended = []
    while True:
        ended.append(state.filter("not open"))
        ahead = state.filter("open")
        if ahead.isEmpty():
            break
        front = ahead.select("query", "q", "node", "similarity", "done").mapInPandas(fronts, f"query {of}, q array<float>, floor float, node {kind}")
        met = front.join(packed, "node").select("query", "q", "floor", "near", "codes").mapInPandas(measure, f"query {of}, node array<{kind}>, similarity array<float>")
        state = stored(ahead.groupBy(group).cogroup(met.filter(F.size("node") > 0).groupBy(group)).applyInPandas(update, shape), "graph-met")
    found = ended[0]
    for part in ended[1:]:
        found = found.unionByName(part)
    found = found.select("query", F.explode(F.arrays_zip("node", "similarity")).alias("x")).select("query", "x.node", "x.similarity")
    found = found.filter(~own) if own is not None else found
    near = found.withColumn("__k", F.row_number().over(best)).filter(F.col("__k") <= 4 * k).select("query", "node")
    exact = near.join(asked, "query").join(graph.nodes, "node").select("query", "node", dot(F.col("q"), F.col("v")).alias("similarity"))
    return exact.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query", "rank", "node", "similarity")


def without_nodes(graph: Graph, gone: DataFrame) -> Graph:
    """The graph without some ids (column ``node``); what linked to them is linked to what they linked to."""
    lost = gone.select("node").distinct()
    nodes = stored(graph.nodes.join(lost, "node", "left_anti"), "graph-nodes")
    out = lost.join(graph.links, lost["node"] == graph.links["src"]).select("node", F.col("dst").alias("b"))
    into = lost.join(graph.links, lost["node"] == graph.links["dst"]).select("node", F.col("src").alias("a"))
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("v").alias(f"v_{c}"))
    around = into.join(out, "node").select("a", "b").filter("a <> b").distinct().join(of("a"), "a").join(of("b"), "b").select(F.col("a").alias("src"), F.col("b").alias("dst"), dot(F.col("v_a"), F.col("v_b")).alias("similarity"))
    left = graph.links.join(lost.select(F.col("node").alias("src")), "src", "left_anti").join(lost.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", "similarity")
    return Graph(nodes, stored(_best(left.unionByName(around), graph.k), "graph-links"), graph.k)


def with_nodes(graph: Graph, more: DataFrame, id_col: str, vector: str) -> Graph:
    """The graph with further vectors, in place of those of the same id: each is searched for and linked both ways."""
    fresh = stored(_nodes(more, id_col, vector), "graph-nodes")
    base = without_nodes(graph, fresh)
    if fresh.isEmpty():
        return base
    found = search_graph(base, fresh.select(F.col("node").alias("query"), F.col("v").alias("q")), graph.k).select(F.col("query").alias("src"), F.col("node").alias("dst"), "similarity")
    found = stored(found.unionByName(_side_by_side(fresh, graph.k, 1)), "graph-found")
    both = found.unionByName(found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "similarity"))
    return Graph(stored(base.nodes.unionByName(fresh), "graph-nodes"), stored(_best(base.links.unionByName(both), graph.k), "graph-links"), graph.k)
