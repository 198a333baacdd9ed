"""The proximity graph against brute force, also after deletes and upserts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import proximity


def recall(found, vectors: dict[int, np.ndarray], queries: dict[int, np.ndarray], k: int) -> float:
    """Share of the true ``k`` nearest that were found."""
    ids = np.array(list(vectors))
    m = np.array([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    hit = 0
    for q, v in queries.items():
        s = m @ (v / np.linalg.norm(v))
        s[ids == q] = -np.inf
        hit += len({int(i) for i in ids[np.argsort(-s)[:k]]} & {r["node"] for r in found if r["query"] == q})
    return hit / (k * len(queries))


@pytest.mark.parametrize("clusters", [0, 12])
def test_recall_after_building_deleting_and_upserting(spark, clusters):
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(clusters, 24)) * 3
    draw = lambda: rng.normal(size=24) + (centres[rng.integers(clusters)] if clusters else 0)
    own = {i: draw() for i in range(900)}
    table = lambda rows: spark.createDataFrame([(i, [float(x) for x in v], 1, 2.0) for i, v in rows.items()], "id long, e array<double>, node int, v double")
    rows = table(own).unionByName(spark.createDataFrame([(None, [1.0] * 24, 1, 2.0), (5_000, None, 1, 2.0), (5_001, [0.0] * 24, 1, 2.0)], table(own).schema))
    graph = proximity.build_graph(rows, "id", "e", k=16)
    asked = lambda of: table(of).select(F.col("id").alias("query"), F.col("e").alias("q"))
    search = lambda g, of: proximity.search_graph(g, asked(of), 10, reach=96, width=16, own=F.col("query") == F.col("node")).collect()
    queries = {i: own[i] for i in range(0, 900, 20)}
    found = search(graph, queries)
    assert recall(found, own, queries, 10) >= 0.9
    assert all(abs(r["similarity"] - own[r["query"]] @ own[r["node"]] / np.linalg.norm(own[r["query"]]) / np.linalg.norm(own[r["node"]])) < 1e-9 for r in found)
    assert sorted(r["rank"] for r in found if r["query"] == 0) == list(range(1, 11))
    gone = [i for i in own if i % 7 == 3]
    less = proximity.without_nodes(graph, spark.createDataFrame([(i,) for i in gone], "node long"))
    own = {i: v for i, v in own.items() if i not in gone}
    queries = {i: v for i, v in queries.items() if i in own}
    found = search(less, queries)
    assert recall(found, own, queries, 10) >= 0.9 and not {r["node"] for r in found} & set(gone)
    changed = {i: draw() for i in [*range(0, 300, 20), *range(1_000, 1_100)]}
    more = proximity.with_nodes(less, table(changed), "id", "e")
    own |= changed
    queries = {i: own[i] for i in [*queries, *range(1_000, 1_100, 10)]}
    assert more.nodes.count() == len(own) and recall(search(more, queries), own, queries, 10) >= 0.9
    assert search(proximity.build_graph(rows.limit(0), "id", "e"), {0: own[0]}) == []


def test_a_search_keeps_no_more_than_the_best_of_each_query(spark, monkeypatch):
    rng = np.random.default_rng(5)
    own = {i: rng.normal(size=8) for i in range(600)} | {i: np.ones(8) for i in range(600, 700)}
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in own.items()], "id long, e array<double>")
    for name, value in (("CELL", 16), ("MOST", 64)):
        monkeypatch.setattr(proximity, name, value, raising=False)
    graph = proximity.build_graph(table, "id", "e", k=16)
    sizes, stored = [], proximity.stored

    def counted(df, name):
        out = stored(df, name)
        column = F.size("node") if dict(out.dtypes).get("node", "").startswith("array") else F.lit(1)
        sizes.append((name, out.groupBy("query").agg(F.sum(column).alias("n")).agg(F.max("n")).first()[0] if "query" in out.columns else 0))
        return out

    monkeypatch.setattr(proximity, "stored", counted)
    queries = {i: own[i] for i in range(0, 600, 50)}
    found = proximity.search_graph(graph, table.filter("id % 50 = 0 and id < 600").select(F.col("id").alias("query"), F.col("e").alias("q")), 10, reach=64, width=16, own=F.col("query") == F.col("node")).collect()
    assert recall(found, own, queries, 10) >= 0.9
    assert sizes and all((n or 0) <= 64 for _, n in sizes), sizes
