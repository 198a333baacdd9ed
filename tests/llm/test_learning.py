"""Toxicity, similarity joins, nearest vectors and the pipeline."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import components, nearest, ngram_join, toxicity
from tests.llm.fixtures import documents, odd_rows


def toxic_rows(n: int = 600, seed: int = 5) -> tuple[list[tuple], list[tuple]]:
    """Texts, a fifth of them with telling words, and labels of most."""
    rng = random.Random(seed)
    common = ["".join(rng.choice("abcdeimnorst") for _ in range(rng.randrange(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        own = [rng.choice(common) for _ in range(rng.randrange(20, 80))]
        for _ in range(len(own) // 20 + 1) if bad else ():
            own.insert(rng.randrange(len(own)), rng.choice(["zorgish", "zorglike", "vilex"]))
        rows.append((i, " ".join(own)))
        if i % 7:
            labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_the_held_out_fold(spark):
    rows, labels = toxic_rows()
    docs = documents(spark, rows + [(None, "zorgish zorgish"), (9_000, None), (9_001, "")])
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, marks)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows) + 3
    truth = {i: int(i % 5 == 0) for i, _ in rows}
    held = [r for r in got.collect() if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert len(held) > 80 and right / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.collect())


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.score_toxicity(documents(spark, odd_rows()), none).collect()} == {0}
    assert toxicity.score_toxicity(documents(spark, []), none).count() == 0
    kept = toxicity.drop_toxic(documents(spark, odd_rows()), none)
    assert kept.count() == len(odd_rows()) and kept.columns == documents(spark, []).columns


def test_fit_equals_a_plain_estimator_of_the_risk():
    """Losses summed text by text, gradients by differences, and the same steps: weights agree, on both sides of the switch."""
    rng = np.random.default_rng(3)
    dense = np.round(rng.random((9, 3)), 2)
    positive = np.arange(9) < 4
    dense[positive, 0] += 2.0
    rows, columns = np.nonzero(dense)
    sides = set()
    for prior in (0.05, 0.9):

        def losses(w: np.ndarray) -> tuple[float, float]:
            toward = lambda sign, which: sum(math.log1p(math.exp(-sign * (w[3] + sum(x * v for x, v in zip(dense[i], w, strict=False))))) for i in range(9) if positive[i] == which) / (4 if which else 5)
            return prior * toward(1, True), toward(-1, False) - prior * toward(-1, True)

        start = np.append(np.random.default_rng(1).normal(0, 1e-3, 3), -2.0)
        w, m, v = start.copy(), np.zeros(4), np.zeros(4)
        for step in range(1, 41):
            side = losses(w)[1] >= 0
            sides.add(side)
            aim = lambda at: sum(losses(at)) if side else -losses(at)[1]  # noqa: E731, B023
            gradient = np.array([(aim(w + 1e-6 * e) - aim(w - 1e-6 * e)) / 2e-6 for e in np.eye(4)]) + np.append(1e-4 * w[:3], 0.0)
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, bias = toxicity.fit(rows, columns, dense[rows, columns], positive, 3, prior, 1, steps=40)
        assert np.allclose([*weights, bias], w, atol=1e-3)
    assert sides == {True, False}


def test_the_risk_is_never_negative_by_the_unlabelled():
    rng = np.random.default_rng(0)
    positive = np.arange(200) < 60
    columns = np.where(positive | (np.arange(200) % 10 == 0), 0, 1)
    weights, bias = toxicity.fit(np.arange(200), columns, np.ones(200), positive, 2, 0.1, int(rng.integers(10)))
    assert weights[0] + bias > 0 > weights[1] + bias


def sets_of(text: str | None) -> frozenset:
    low = (text or "").translate({k: k + 32 for k in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def plain_components(rows: list[tuple]) -> dict[int, int]:
    """Smallest id that links reach, by comparing all pairs; ids are distinct."""
    own = [(i, sets_of(t)) for i, t in rows]
    parent = {i: i for i, _ in own}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(own):
        for j, b in own[:k]:
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in own}


def near_copies(seed: int, groups: int = 6, copies: int = 45) -> list[tuple]:
    """Groups of copies of copies, from equal to far apart, and short and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows, key = [], 0
    passage = [word() for _ in range(60)]
    for g in range(groups):
        family = [[word() for _ in range(rng.choice([25, 60, 150, 400]))]]
        for _ in range(copies):
            own = list(rng.choice(family[:10] if g % 2 else family))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 8])):
                at = rng.randrange(len(own))
                own[at : at + rng.choice([0, 1, 1])] = [word() for _ in range(rng.choice([0, 1, 1, 2]))]
            family.append(own)
        for own in family:
            key += 1
            rows.append((rng.randrange(1 << 20) * 1_000 + key, " ".join(own)))
    for _ in range(30):
        key += 1
        rows.append((rng.randrange(1 << 20) * 1_000 + key, " ".join(passage + [word() for _ in range(rng.choice([0, 1, 5, 50]))])))
        rows.append((rng.randrange(1 << 20) * 1_000 + 900 + key % 100, " ".join(word() for _ in range(rng.choice([1, 2, 3, 4])))))
    return list(dict(rows).items())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_join_finds_every_component(spark, seed):
    rows = near_copies(seed)
    want = plain_components(rows)
    got = {r["doc_id"]: r for r in ngram_join.jaccard_join(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(sets_of(t)) for i, t in rows}


def test_jaccard_join_without_a_useful_order(spark, monkeypatch):
    """The order of shingles decides the cost alone: with every counter alike the links are the same."""
    monkeypatch.setattr(ngram_join, "_sketch", lambda docs, k: np.zeros(1 << 10, np.uint16))
    rows = near_copies(4)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_join(documents(spark, rows)).collect()} == plain_components(rows)


def test_jaccard_join_on_odd_rows(spark):
    rows = odd_rows()
    got = ngram_join.jaccard_join(documents(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((i, len(sets_of(t))) for i, t in rows)
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    # an id with two texts: each row goes by its own
    assert Counter((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] in (8, 9)) == {(8, 8): 1, (9, 8): 2, (9, 9): 1}
    assert ngram_join.jaccard_join(documents(spark, [])).count() == 0
    kept = ngram_join.one_of_each(documents(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in kept)[None] == 2 and sorted(r["text"] for r in kept if r["doc_id"] in (8, 9)) == ["another text under an id", "the same text twice over"]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1_000, i) for i in range(1_001, 1_200)] + [(5_000, 5_000)]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {i: 1_000 for i in range(1_001, 1_200)}


def test_nearest_vectors_reach_the_recall(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(1_500, 32)), np.tile(rng.normal(size=(1, 32)), (700, 1)), rng.normal(size=(300, 32)) * 0.1 + 3]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(10_000, None, 1), (10_020, [0.0] * 32, 1), (10_040, [float("nan")] * 32, 1), (10_060, [None] * 32, 1), (10_080, [1.0] * 5, 1), (None, x[0].tolist(), 1), (0, rows[0][1], 2)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, list int")
    got: dict[int, list] = {}
    for r in nearest.search(table, F.col("vec_id") % 20 == 0, block_rows=400, block_queries=40).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, len(x), 20))
    exact, found = x.astype(float), 0
    for q, rows_ in got.items():
        s = (exact * exact[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -s))[:20]
        assert [r[0] for r in rows_] == list(range(1, 21)) and all(abs(s[v] - score) < 1e-9 for _, v, score in rows_)
        assert [r[1] for r in rows_] == sorted((r[1] for r in rows_), key=lambda v: (-s[v], v))
        found += len(set(best.tolist()) & {r[1] for r in rows_})
    assert found / (20 * len(got)) >= 0.9


@pytest.mark.parametrize("kind", ["many dimensions", "tight clusters"])
def test_nearest_vectors_reach_the_recall_where_codes_tell_little(spark, kind):
    rng = np.random.default_rng(6)
    if kind == "many dimensions":
        x = rng.normal(size=(1_500, 384)).astype(np.float32)
    else:
        x = (rng.normal(size=(4, 64))[np.arange(6_000) % 4] + 0.02 * rng.normal(size=(6_000, 64))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got: dict[int, set] = {}
    for r in nearest.every_twentieth(table).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    exact, found = x.astype(float), 0
    for q in range(0, len(x), 20):
        s = exact @ exact[q]
        s[q] = -np.inf
        found += len(set(np.argsort(-s)[:20].tolist()) & got[q])
    assert found / (len(x) // 20 * 20) >= 0.9


def test_nearest_vectors_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], schema)
    assert [tuple(r) for r in nearest.every_twentieth(few).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert nearest.every_twentieth(spark.createDataFrame([], schema)).count() == 0
    assert nearest.every_twentieth(spark.createDataFrame([(1, [1.0])], schema)).count() == 0


@pytest.mark.parametrize("clusters", [False, True])
def test_nearest_vectors_look_into_few_lists_where_there_are_clusters(spark, clusters):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3_000, 16))
    x = x * 0.05 + rng.normal(size=(60, 16))[np.arange(3_000) % 60] if clusters else x
    book = nearest.fit(spark, x, 64)
    assert (nearest.probes_for(book, x, 20, 0.95) <= 6) == clusters


def test_nearest_vectors_fill_the_ranks_and_prefer_small_ids(spark):
    """Lonely queries go on to further lists until there are 20; of more equal vectors than ranks the smallest ids stay."""
    rows = [(i, [float(i == 0), float(i > 0), 0.0, 0.0]) for i in range(500)]
    got: dict[int, list] = {}
    for r in nearest.every_twentieth(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == set(range(0, 500, 20)) and got[0] == list(range(1, 21))
    assert all(v == [j for j in range(1, 22) if j != q][:20] for q, v in got.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_pipeline_stage_drops_near_copies_by_five_words(spark, seed):
    """The stage against brute force at five-word shingles and 0.8, with a copy that only these values link."""
    own = [f"w{seed}x{i}" for i in range(52)]
    rows = near_copies(seed) + [(1, " ".join(own)), (2, " ".join([*own[:26], "changed", *own[27:]])), (3, "a few words"), (4, "a few words")]
    sets = {}
    for i, text in rows:
        w = text.split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    least = {i: i for i in sets}  # spread the smallest id over links until nothing changes
    ids = sorted(sets)
    links = [(i, j) for k, j in enumerate(ids) for i in ids[:k] if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) > 0]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(least[i], least[j])
            changed |= least[i] != low or least[j] != low
            least[i] = least[j] = low
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()]
    assert sorted(kept) == [i for i in ids if least[i] == i] and 1 in kept and 2 not in kept


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null texts and ids, repeated rows, extra columns and long texts go through every stage; empty tables too."""
    rows = odd_rows()
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (8, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in out]
    assert {i for i in range(1, 8)} <= set(ids) and ids.count(8) <= 1 and ids.count(None) == 2
    none = tmp_path / "none"
    documents(spark, []).write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{none}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{none}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(none)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Each stage on planted cases: toxic texts, near copies, benchmark passages and personal data."""
    rows, labels = toxic_rows(200)
    base = "one unlike text of its own with words that nobody else has said before in this place and some more of them to make it long enough"
    passage = "which of the following planets in the solar system has the largest number of moons today"
    planted = [(1_001, base), (1_002, base + "!"), (1_003, f"copied: {passage} and then on"), (1_004, "please write to someone@example.com about that"), (1_005, base)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows + planted], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        docs = spark.createDataFrame(list(seen[name].values()), schema)
    toxic = {i for i, _ in rows if i % 5 == 0}
    kept = seen["toxicity"]
    assert len(toxic & set(kept)) <= 2 and len(set(kept) - toxic) >= 163
    assert 1_001 in seen["near duplicates"] and not {1_002, 1_005} & set(seen["near duplicates"])
    assert 1_003 in seen["near duplicates"] and 1_003 not in seen["benchmark decontamination"]
    assert seen["personal data"][1_004]["text"] == "please write to [EMAIL] about that"
    assert seen["personal data"][1_004]["n_chars"] == len("please write to [EMAIL] about that")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(seen["personal data"]) and all(len(r["ids"]) == r["n_tokens"] for r in out)


def test_followers_too_far_apart_make_no_pairs(spark):
    rng = np.random.default_rng(5)
    own = [np.unique(rng.integers(0, 1 << 63, 100, np.uint64)) for _ in range(60)]
    own.append(np.unique(np.concatenate([own[0][:97], own[1][:3]])))
    for a, b in itertools.combinations(own, 2):  # parities never say more than sets differ by
        x, y = (np.unpackbits(ngram_join._parities(s).view(np.uint8)) for s in (a, b))
        assert (x != y).sum() <= len(np.setxor1d(a, b))
    rows = spark.createDataFrame([(0, 7, i, 100, 0, i, 40, ngram_join._parities(s).tolist()) for i, s in enumerate(own)], "leader long, element long, node long, n int, pos int, component long, far int, bits array<long>")
    found = ngram_join._pairs(rows, ["leader", "element"], 80, True).collect()
    assert [(r["a"], r["b"]) for r in found] == [(0, 60)]  # of 1,830 that share a part
