"""Operators against plain versions on small tables: large groups, deep chains, and rows that heads would miss."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import graph, history, mltools, ordering, patterns, privacy, relations, retrieval, search, segments, synth
from lodestone.plans import score_queries, text_queries
from lodestone.plans.registry import Tables
from lodestone.sources import spec


def test_places_percentiles_and_tiles(spark):
    rng = random.Random(1)
    values = [(i, float(rng.choice([1, 2, 3, rng.randrange(1_000)]))) for i in range(3_000)]
    df = spark.createDataFrame(values, "k int, v double").repartition(7)
    placed = {r["k"]: r["rn"] for r in ordering.numbered(df, ["v", "k"]).collect()}
    assert placed == {k: i for i, (k, _) in enumerate(sorted(values, key=lambda x: (x[1], x[0])), 1)}
    got = {r["share"]: r["value"] for r in ordering.middle(df, "v", [0.0, 0.1, 0.5, 0.95, 1.0]).collect()}
    assert all(abs(got[s] - np.quantile([v for _, v in values], s)) < 1e-9 for s in got) and len(got) == 5
    tiles = spark.range(1, 11).select(ordering.tile(F.col("id"), F.lit(10), 4).alias("t")).collect()
    assert [r["t"] for r in tiles] == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4]


def test_closure_is_as_deep_as_its_chain_and_refuses_cycles(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(26)], "node int, parent int")
    assert graph.closure(chain).count() == 26 * 27 // 2
    with pytest.raises(ValueError, match="own ancestor"):
        graph.closure(spark.createDataFrame([(1, 2), (2, 1)], "node int, parent int"))


def test_pairs_of_a_unit_of_any_size(spark):
    mentions = spark.createDataFrame([("big", i) for i in range(230)] + [("small", 1), ("small", 2)], "u string, e int")
    got = {(r["entity_a"], r["entity_b"]): r["weight"] for r in graph.cooccurrence(mentions, "u", "e", least=1, limit=None, block=50).collect()}
    assert set(got) == set(combinations(range(230), 2)) and got[1, 2] == 2 and got[0, 1] == 1


def test_communities_of_two_cliques(spark):
    edges = [(a, b, 1) for group in (range(5), range(5, 10)) for a, b in combinations(group, 2)] + [(0, 5, 1)]
    got = {r["node"]: r["community"] for r in graph.communities(spark.createDataFrame(edges, "src int, dst int, weight int")).collect()}
    assert len({got[i] for i in range(5)}) == len({got[i] for i in range(5, 10)}) == 1 and got[0] != got[5]


def test_relevant_and_unlike_rows_of_a_large_group(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 1, float(1 / (1 + i // 50)), rng.normal(size=4).tolist()) for i in range(300)]
    got = [r["id"] for r in retrieval.mmr(spark.createDataFrame(rows, "id int, g int, r double, v array<double>"), "g", "id", "r", "v", k=4).orderBy("place").collect()]
    x = np.array([v for *_, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chosen: list[int] = []
    while len(chosen) < 4:
        near = (x @ x[chosen].T).max(1) if chosen else np.zeros(len(x))
        gain = 0.7 * np.array([r for _, _, r, _ in rows]) - 0.3 * near
        gain[chosen] = -np.inf
        chosen.append(int(gain.argmax()))
    assert got == chosen


def test_unseen_items_of_a_user_who_has_had_most(spark):
    items = spark.createDataFrame([(i, "c", 1 - i / 100) for i in range(60)], "item int, category string, popularity double")
    seen = spark.createDataFrame([(1, i) for i in range(50)], "user int, item int")
    interests = spark.createDataFrame([(1, "c", 0.5), (2, "c", 0.5)], "user int, category string, weight double")
    got = [(r["user"], r["item"]) for r in segments.recommend(interests, items, seen, "user", "item", "category", 3).orderBy("user", "place").collect()]
    assert got == [(1, 50), (1, 51), (1, 52), (2, 0), (2, 1), (2, 2)]


def test_filters_of_a_site_search(spark):
    rows = spark.createDataFrame([(1, "one red fox", "News", "2024-01-05"), (2, "one red fox", "Sport", "2024-03-05")], "id int, text string, category string, day string")
    ids = lambda q: [r["id"] for r in search.site_search(rows, q, "text", "category", "day").orderBy("id").collect()]
    assert ids("fox category:sport") == [2] and ids("fox after:2024-01-05 before:2024-02-01") == [1] and ids("category:news") == [1]
    with pytest.raises(ValueError, match="no column"):
        search.site_search(rows, "category:news", "text")


def test_rows_that_do_not_parse_are_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3,4,5,6\n7,8\n")
    df = spec.read_source(spark, str(tmp_path / "a.csv"))
    assert df.count() == 3 and [r[spec.CORRUPT] for r in df.filter(f"{spec.CORRUPT} is not null").collect()] == ["3,4,5,6"]


def test_content_hash_counts_equal_rows(spark):
    rows = [(1, "a"), (2, "b"), (2, "b")]
    of = lambda r: history.content_hash(spark.createDataFrame(r, "a int, b string")).first()["content_hash"]
    assert of(rows) == of(rows[::-1]) != of(rows[:1]) and of(rows[:1]) != of([(1, "a"), (3, "c"), (3, "c")])


def test_pruning_keeps_the_last_and_the_pinned(spark):
    store = spark.createDataFrame([("x", t, t == 1) for t in range(6)] + [("y", 0, False)], "schema_hash string, taken_at int, pinned boolean")
    assert {(r["schema_hash"], r["taken_at"]) for r in history.kept_profiles(store, 2).collect()} == {("x", 1), ("x", 4), ("x", 5), ("y", 0)}


def test_suggested_queries_run(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "id int, name string, price double").withColumn("day", F.lit("2024-01-01").cast("timestamp"))
    df.createOrReplaceTempView("suggested")
    assert len([spark.sql(q).collect() for q in history.suggested_queries(df, "suggested")]) == 7


def test_values_keep_their_kind_when_masked(spark):
    rows = [("a.user@mail.example.com", "Email"), ("123-45-6789", "SSN"), ("4111 1111 1111 1111", "CreditCard"), ("10.0.0.1", "IPAddress"), ("plain", None)]
    got = [r["m"] for r in spark.createDataFrame(rows, "v string, k string").select("*", privacy.value_kind(F.col("v")).alias("found"), privacy.masked(F.col("v"), F.col("k")).alias("m")).collect()]
    assert got == ["a.**********@**********.com", "***-**-6789", "**** **** **** 1111", "<IP> 10****.1", "plain"]
    assert [r["found"] for r in spark.createDataFrame(rows, "v string, k string").select(privacy.value_kind(F.col("v")).alias("found")).collect()] == ["Email", "SSN", "CreditCard", "IPAddress", None]


@pytest.mark.parametrize("seed", range(4))
def test_percentiles_are_exact(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.gauss(0, 1), float(rng.randrange(3)), rng.choice([None, 1e300, -1e300, 0.1]), None, rng.paretovariate(0.5)) for _ in range([1, 2, 999, 20_000][seed])]
    df = spark.createDataFrame(rows, "a double, b double, c double, none double, `odd name` double").repartition(7)
    shares = [0.0, 0.25, 0.5, 0.9, 0.9999, 1.0]
    got = {(r["column_name"], r["share"]): r["value"] for r in ordering.percentiles(df, df.columns, shares).collect()}
    want = {}
    for i, c in enumerate(df.columns):
        own = sorted(r[i] for r in rows if r[i] is not None)
        for s in shares if own else ():
            at = s * (len(own) - 1)
            lo, hi = own[int(at)], own[-int(-at // 1)]
            want[c, s] = lo + (at - int(at)) * (hi - lo)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-300) for k in want)
    # a bracket that is off is noticed and made up for
    odd = ordering.percentiles(df, ["a"], [0.5], slack=-0.2, accuracy=2)
    assert math.isclose(odd.first()["value"], want["a", 0.5], rel_tol=1e-12)


def test_lags_and_rows_before_across_blocks(spark, monkeypatch):
    rng = random.Random(3)
    values = [rng.gauss(0, 1) + (i % 7) for i in range(1_000)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double").repartition(9)
    monkeypatch.setattr(ordering.in_blocks, "__defaults__", ("rn", 64))
    got = {r["lag"]: r["acf"] for r in patterns.autocorrelation(df, ["i"], "v", lags=100).collect()}
    mean = sum(values) / len(values)
    c = [v - mean for v in values]
    assert set(got) == set(range(1, 101))
    assert all(math.isclose(got[k], sum(a * b for a, b in zip(c, c[k:], strict=False)) / sum(a * a for a in c), abs_tol=1e-9) for k in got)
    near = {r["i"]: r["last"] for r in ordering.before(ordering.numbered(df, ["i"]), "v", "last").collect()}
    assert near == {i: values[i - 1] for i in range(1, 1_000)}
    assert patterns.autocorrelation(df.limit(0), ["i"], "v").count() == 0


def test_effects_and_made_rows_know_rare_values(spark):
    rows = [(f"common{i % 60}", 0) for i in range(60 * 40)] + [("rare", 1)] * 12
    df = spark.createDataFrame(rows, "c string, f int")
    assert mltools.categorical_effects(df, F.col("f") == 1, ["c"]).first()["value"] == "rare"
    made = synth.synthesize(df, 20_000, [], ["c"]).groupBy("c").count().collect()
    assert {r["c"] for r in made} == {r[0] for r in rows}
    assert sum(r["count"] for r in made) == 20_000 and abs(next(r["count"] for r in made if r["c"] == "rare") - 20_000 * 12 / len(rows)) < 60


def test_more_centroids_than_are_broadcast(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(50)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    centroids = spark.createDataFrame(rows[:30], "label long, centroid array<double>")
    few, many = ({tuple(r)[:2] for r in mltools.nearest_centroid(vectors, centroids, "id", "v", "label", most=m).collect()} for m in (100, 7))
    assert few == many and len(few) == 50


def test_each_pair_of_names_is_compared_once(spark, tmp_path):
    rows = [(i, "B", 1, ("red ring", "blue ring", None)[i % 3]) for i in range(300)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    compared = spark.sparkContext.accumulator(0)

    def counted(a: str, b: str) -> float:
        compared.add(1)
        return float(a == b)

    alike = F.udf(counted, "double")
    got = {(r["a"], r["b"]): r["similarity"] for r in text_queries._name_pairs(Tables(spark, str(tmp_path)), alike).collect()}
    assert got == {(i, j): float(rows[i][3] == rows[j][3]) for i, j in combinations(range(300), 2)}
    assert compared.value <= 2 * 9  # a column may be computed twice
    null = text_queries._name_pairs(Tables(spark, str(tmp_path)), tx.levenshtein_similarity).filter("a = 0 and b = 2").first()
    assert null["similarity"] is None


def test_names_are_found_in_long_texts_in_time_that_grows_with_them(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé ") for _ in range(300_000))
    rows = [(1, long + "Red Gadget"), (1, "ab"), (None, "x RED gadget"), (2, None), (3, "é")]
    names = spark.createDataFrame([("red gadget",), ("AB",), ("É",), ("",), (None,), (long[1_000:1_040],)], "name string")
    began = time.time()
    got = sorted(((r["id"] or 0, r["name"]) for r in relations.containing(spark.createDataFrame(rows, "id int, text string"), "id", "text", names, "name").collect()))
    assert time.time() - began < 40
    held = [x.lower() for x in ("red gadget", "AB", "É", long[1_000:1_040])]
    assert got == sorted((i or 0, n) for i, t in rows for n in held if n in (t or "").lower())


def test_pairs_are_counted_in_tasks_of_a_bounded_size(spark, monkeypatch):
    rows = [(u, e) for u in range(60) for e in range(u % 7)] * 2 + [(60, e) for e in range(90)] + [(None, 1), (None, 2), (61, None), (61, 4)]
    monkeypatch.setattr(graph, "TASK_PAIRS", 20, raising=False)
    pairs = graph.cooccurrence(spark.createDataFrame(rows, "u int, e int"), "u", "e", least=1, limit=None, block=50)
    expected = Counter()
    for own in ({e for v, e in rows if v == u} for u in range(61)):
        expected.update(combinations(sorted(own), 2))
    assert {(r["entity_a"], r["entity_b"]): r["weight"] for r in pairs.collect()} == expected
    tasks = re.findall(r"hashpartitioning\(u#\d+, (\d+)\), REPARTITION_BY_NUM", pairs._jdf.queryExecution().executedPlan().toString())
    assert tasks and int(tasks[0]) >= 20


def test_names_of_one_file_are_compared_on_all_cores(spark):
    found = score_queries.name_similarity(Tables(spark, "/root/testdata/sf0.01"))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_redaction_tries_the_forms_once_a_token_and_skips_runs_of_plain_words(spark):
    tokens = ["in", "word", "Wörter,", "(bob@x.org);", "123-45-6789", "ABCDEFGHJKLMNPRST", "words...", "a" * 16, "b" * 17, "x", "10.0.0.1", "...", "\"ME\"", "é", "end"]
    rng = random.Random(4)
    texts = [[rng.choice([*tokens, "plain", "words"]) if i % 2 else rng.choice([" ", "  ", "\n", "\t "]) for i in range(rng.randrange(1, 300))] for _ in range(40)]
    hide = privacy.redact_text(F.col("t"))
    alone = {r["t"]: r["x"] for r in spark.createDataFrame([(t,) for t in {t for own in texts for t in own}], "t string").select("t", hide.alias("x")).collect()}
    got = {r["i"]: r["x"] for r in spark.createDataFrame([*((i, "".join(own)) for i, own in enumerate(texts)), (-1, None), (-2, "")], "i int, t string").select("i", hide.alias("x")).collect()}
    assert got == {i: "".join(alone[t] for t in own) for i, own in enumerate(texts)} | {-1: None, -2: ""}
    assert alone["in"] != "in" and alone["(bob@x.org);"].startswith("(") and alone["word"] == "word"
    assert str(hide).count(privacy.VALUE_FORMS[0][1][0]) == 1


def test_hashed_counts_are_shuffled_once_a_document(spark):
    rows = [(1, "Ox ox cow"), (1, "cow hen"), (2, None), (3, " .. "), (None, "ox"), (4, "é_1 ox " * 500)]
    found = retrieval.hash_embedding(spark.createDataFrame(rows, "doc_id long, text string"), dim=16)
    expected = {}
    for i, terms in {1: ["ox", "ox", "cow", "cow", "hen"], None: ["ox"], 4: ["é_1", "ox"] * 500}.items():
        n = np.bincount([int(hashlib.sha256(t.encode()).hexdigest()[:8], 16) % 16 for t in terms], minlength=16)
        expected[i] = (n / np.sqrt((n * n).sum())).tolist()
    assert {r["doc_id"]: r["embedding"] for r in found.collect()} == {k: pytest.approx(v) for k, v in expected.items()}
    assert found._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_terms_are_counted_without_a_shuffle_and_rows_of_an_id_are_added(spark):
    rows = [(1, "Ox ox cow"), (2, None), (3, " .. a"), (None, "oxen"), (4, "é_1 oxen " * 500)]
    count = lambda own: retrieval.term_counts(spark.createDataFrame(own, "d long, x string"), "d", "x")
    plain = {(1, 3, "ox", 2), (1, 3, "cow", 1), (None, 1, "oxen", 1), (4, 1000, "é_1", 500), (4, 1000, "oxen", 500)}
    assert "Exchange" not in count(rows)._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, map(tuple, count(rows).collect()))) == sorted(map(str, plain))
    twice = plain - {(1, 3, "ox", 2)} | {(1, 3, "ox", 3), (1, 3, "hen", 2), (1, 1, "ox", 1)}
    assert sorted(map(str, map(tuple, count([*rows, (1, "hen ox hen"), (1, "ox")]).collect()))) == sorted(map(str, twice))
