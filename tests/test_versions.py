"""Segments, versions and the profile store against plain expectations."""

from __future__ import annotations

import datetime
import math
import random
import shutil
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.operators import segment_profiles as sp
from lodestone.operators import versions
from lodestone.sources.profile_store import ProfileStore


def normal(mean: float, deviation: float, n: int, seed: int) -> list[float]:
    rng = random.Random(seed)
    return [rng.gauss(mean, deviation) for _ in range(n)]


def test_segments_that_are_alike_and_that_are_not(spark):
    values = normal(50, 10, 1_000, 1)
    rows = [("control", v, "a" if i % 10 < 6 else "b", None) for i, v in enumerate(values)] + [("same", v, "a" if i % 10 < 6 else "b", None) for i, v in enumerate(values)]
    rows += [("moved", v, f"c{i % 40}", 1.0 if i % 2 else None) for i, v in enumerate(normal(75, 15, 700, 2))] + [(None, 1.0, "z", 1.0)]
    df = spark.createDataFrame(rows, "s string, value double, kind string, half double")
    profiles = sp.segment_profiles(df, "s", ["value", "half"], ["kind"]).cache()
    one = {(r["segment"], r["column_name"]): r for r in profiles.collect()}
    assert len(one) == 9 and one["control", "kind"]["mode"] == "a" and math.isclose(one["control", "kind"]["mode_share"], 0.6) and one["control", "kind"]["cardinality"] == 2
    assert math.isclose(one["control", "value"]["mean"], sum(values) / len(values)) and 0 < one["control", "value"]["centre"] < 1 and one["moved", "half"]["null_rate"] == 0.5
    far = {(r["segment_a"], r["segment_b"]): r for r in sp.segment_distances(profiles).collect()}
    assert len(far) == 3 and abs(far["control", "same"]["distance"]) < 1e-12 and 0 < far["control", "moved"]["distance"] < 1
    assert (far["control", "moved"]["rows_a"], far["control", "moved"]["rows_b"]) == (1_000, 700)
    told = {(r["segment_b"], r["kind"], r["column_name"]): r for r in sp.segment_insights(profiles).filter("segment_a = 'control'").collect()}
    assert told["same", "overall", None]["detail"] == "alike" and ("same", "size", None) not in told
    assert round(told["moved", "size", None]["amount"]) == -30 and told["moved", "mode", "kind"]["detail"] == "a > c0" and round(told["moved", "nulls", "half"]["amount"]) == -50
    other = sp.segment_profiles(df.withColumnRenamed("value", "elsewhere"), "s", ["elsewhere"])
    assert {r["distance"] for r in sp.segment_distances(profiles.filter("column_name = 'value'"), other).collect()} == {1.0}
    vectors = {r["segment"]: r["vector"] for r in sp.segment_vectors(profiles).collect()}
    assert len(vectors["control"]) == 2 + 9 * 3 and all(map(math.isclose, vectors["control"], vectors["same"])) and math.isclose(vectors["moved"][0], math.log10(701))
    assert sp.segment_profiles(df.limit(0), "s", ["value"], ["kind"]).count() == 0


def test_sketched_versions_are_near_exact_ones(spark):
    df = spark.createDataFrame([(v, str(i % 7)) for i, v in enumerate(normal(5, 2, 30_000, 3))], "v double, k string")
    exact, near = (versions.version_sketch(df, ["v"], ["k"], exact=e).filter("column_name = 'v'").first() for e in (True, False))
    values = sorted(r["v"] for r in df.collect())
    middle = (values[14_999] + values[15_000]) / 2
    away = sorted(abs(v - middle) for v in values)
    assert math.isclose(exact["mad"], (away[14_999] + away[15_000]) / 2, rel_tol=1e-9)
    ranks = [sum(a <= near["mad"] for a in away) - 15_000]
    assert abs(ranks[0]) <= 30_000 * 4e-4  # of the median and of the deviations from it
    delta = versions.validated(versions.version_sketch(df, ["v"], ["k"], exact=False), near_frame := versions.version_sketch(df.withColumn("v", F.col("v") + 0.07), ["v"], [], exact=False)).collect()
    assert {r["column_name"]: (r["missing"], round(r["score"], 6)) for r in delta} == {"v": (False, 0.3), "k": (True, 1.0)} and near_frame.count() == 1


@pytest.mark.parametrize(("delta", "score"), [(None, 0), (0.0, 0), (-0.02, 0.1), (0.07, 0.3), (-0.15, 0.6), (0.2, 1), (-9.0, 1)])
def test_step_scores(spark, delta, score):
    assert spark.range(1).select(versions.step_score(F.lit(delta).cast("double")).alias("s")).first()["s"] == score


def test_the_store_keeps_history_baselines_and_pins(spark, tmp_path):
    store, day = ProfileStore(spark, f"file://{tmp_path}/store"), lambda d: datetime.datetime(2024, 1, d)
    table = lambda n, seed, name="v": spark.createDataFrame([(i, x) for i, x in enumerate(normal(seed * 10.0, 1, n, seed))], f"id long, {name} double")
    assert store.entries().count() == 0 and store.baseline(table(5, 1)) is None and store.load("none") is None and not store.delete("none", day(1))
    ids = [store.store(table(20 + d, d), f"t{d}", day(d), ["v"]) for d in (1, 2, 3, 4)]
    other = store.store(table(9, 1, "w"), "other", day(2), ["w"])
    assert len({*ids, other}) == 5 and store.store(table(22, 2).orderBy(F.desc("id")), "again", day(9), ["v"]) == ids[1]
    assert [r["source"] for r in store.history(table(1, 1)).collect()] == ["t4", "t3", "t2", "t1"] and [r["source"] for r in store.history(table(1, 1), 2).collect()] == ["t4", "t3"]
    assert store.find_content(table(23, 3))["source"] == "t3" and store.find_content(table(24, 3)) is None
    assert store.baseline(table(1, 1))["source"] == "t1" and store.baseline(table(1, 1, "w"))["source"] == "other" and store.baseline(table(1, 1, "x")) is None
    near = [r["source"] for r in store.nearest(store.entries().filter("source = 't3'").first()["vector"]).collect()]
    assert near[0] == "t3" and len(near) == 5 and store.nearest([0.0], within=1e-6).count() == 0
    store.exclude(ids[0], day(10))
    assert store.baseline(table(1, 1))["source"] == "t2"
    store.pin(ids[2], day(11))
    assert store.baseline(table(1, 1))["source"] == "t3"
    assert sorted(store.prune(day(12), 1)) == sorted([ids[0], ids[1]]) and {r["source"] for r in store.entries().collect()} == {"t3", "t4", "other"}
    assert store.load(ids[0]) is None and store.load(ids[3]).filter("column_name = 'v'").first()["rows"] == 24
    store.pin(ids[2], day(13), on=False)
    assert store.delete(ids[2], day(14)) and store.store(table(23, 3), "t3 anew", day(15), ["v"]) == ids[2] and store.load(ids[2]) is not None


def test_the_store_survives_two_writers_and_a_broken_write(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    one, two = ProfileStore(spark, path), ProfileStore(spark, path)
    table = lambda seed: spark.createDataFrame([(x,) for x in normal(seed, 1, 30, seed)], "v double")
    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(lambda seed: (one, two)[seed % 2].store(table(seed % 4), f"t{seed % 4}", datetime.datetime(2024, 1, 1 + seed), ["v"]), range(8)))
    assert len(set(ids)) == 4 and {r["id"] for r in one.entries().collect()} == set(ids) == {r["id"] for r in two.entries().collect()}
    broken = Path(tmp_path) / "store" / "log" / "0broken"  # a record whose writer was lost before it was done
    shutil.copytree(next(p for p in broken.parent.iterdir() if p.is_dir()), broken)
    (broken / "_SUCCESS").unlink()
    half = Path(tmp_path) / "store" / "profiles" / ids[0] / "0half"
    half.mkdir()
    assert one.entries().count() == 4 and one.load(ids[0]).count() == 1
