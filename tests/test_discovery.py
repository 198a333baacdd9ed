"""Keys, greedy names, anchors and keyed state against plain versions."""

from __future__ import annotations

import datetime
import random
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lodestone.operators import keys, naming, vector
from lodestone.streaming import sessions, stateful


def plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(a: str, b: str, share: float) -> float | None:
    if not a or not b:
        return None
    a, b = a.lower(), b.lower()
    longest = max(len(a), len(b))
    d = plain_distance(a, b)
    return 1 - d / longest if d <= longest * (1 - share) + 1e-9 else None


def plain_greedy(names: list[str], share: float, by_best: bool) -> list[int]:
    """The leader of each name, by a loop."""
    leader: list[int] = []
    for i, name in enumerate(names):
        best = i
        if by_best:
            most = 0.0
            for group in dict.fromkeys(leader):
                for j in (j for j in range(i) if leader[j] == group):
                    s = alike(name, names[j], share)
                    if s is not None and round(s, 12) > most:
                        most, best = round(s, 12), group
        else:
            best = next((j for j in range(i) if leader[j] == j and alike(name, names[j], share) is not None), i)
        leader.append(best)
    return leader


@pytest.mark.parametrize(("share", "by_best", "seed"), [(0.8, False, 1), (0.7, False, 2), (0.85, True, 3), (0.7, True, 4), (0.6, False, 5)])
def test_greedy_names_against_a_loop(spark, share, by_best, seed):
    rng = random.Random(seed)
    names = ["", "", "a", "A", "ab", "Anna", "anna", "ανα", None]
    for _ in range(25):
        word = "".join(rng.choice("abcdeé🙂") for _ in range(rng.randrange(1, 14)))
        for _ in range(rng.randrange(1, 7)):
            w = list(word)
            for _ in range(rng.randrange(0, 4)):
                w.insert(rng.randrange(len(w) + 1), rng.choice("abXY")) if rng.random() < 0.5 else w and w.pop(rng.randrange(len(w)))
            names.append("".join(w))
            word = names[-1] if rng.random() < 0.5 else word  # chains of names, each like the one before
    rng.shuffle(names)
    rows = spark.createDataFrame([(i, n, 1, 2) for i, n in enumerate(names)], "id long, name string, k int, n int").repartition(3)
    got = {r["place"] - 1: r["leader"] - 1 for r in naming.normalised(rows, ["id"], share, by_best=by_best).collect()}
    assert got == dict(enumerate(plain_greedy([n or "" for n in names], share, by_best)))
    assert naming.normalised(rows.limit(0), ["id"]).count() == 0


def test_keys_against_all_pairs(spark):
    rng = random.Random(4)
    big = [(i, f"n{i}", i * 7) for i in range(3_000)]
    child = [(rng.randrange(3_000), f"n{rng.randrange(3_000)}" if rng.random() < 0.93 else f"x{i}", f"n{rng.randrange(3_000)}" if rng.random() < 0.5 else f"y{i}", "z" * 100, None, 1) for i in range(2_000)]
    tables = {"p": spark.createDataFrame(big, "id long, name string, seven long"), "c": spark.createDataFrame(child, "p_id long, name string, half string, long string, none string, place int"), "e": spark.createDataFrame([], "id long, v double")}
    got = {tuple(r)[:6] for r in keys.discover_keys(tables).collect()}
    columns = {(t, c): [str(r[c]) for r in df.select(c).collect() if r[c] is not None] for t, df in tables.items() for c in df.columns if c not in ("v", "long")}
    want = set()
    for (ta, ca), a in columns.items():
        for (tb, cb), b in columns.items():
            if (ta, ca) != (tb, cb) and len(set(a)) > 1 and len(set(b)) == len(b):
                found = len(set(a) & set(b))
                if found > 0.9 * len(set(a)):
                    want.add((ta, ca, tb, cb, len(set(a)), found))
    assert got == want and {("c", "p_id", "p", "id"), ("c", "name", "p", "name")} <= {w[:4] for w in want}
    assert keys.discover_keys({"e": tables["e"]}).count() == 0
    assert ("c", "p_id") not in {tuple(r)[:2] for r in keys.discover_keys(tables, most_distinct=100).collect()}


def test_anchors_against_a_loop(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(200)] + [(300, None), (301, [0.0] * 5)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / ((sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5 or 1.0)
    own = {i: v for i, v in rows if v}
    chosen = [0]
    while len(chosen) < 20:
        chosen.append(max((i for i in own if i not in chosen), key=lambda i: (round(min(1 - cos(own[i], own[j]) for j in chosen), 12), -i)))
    df = spark.createDataFrame([(i, v, 1.0, 2.0) for i, v in rows], "id long, e array<double>, v double, near double")
    got = vector.anchors(df, 20, "id", "e", kept_every=3).orderBy("place").collect()
    assert [r["id"] for r in got] == chosen and got[0]["distance"] is None
    assert vector.anchors(df, 500, "id", "e").count() == len(own) and vector.anchors(df.limit(0), 3, "id", "e").count() == 0


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, t long, state string"


def some_events(seed: int = 2) -> list[tuple]:
    """Events of a few users, close and far apart, two of whom never pause; nulls among them."""
    rng = random.Random(seed)
    start, rows = datetime.datetime(2024, 1, 1), []
    for i in range(900):
        user = rng.choice([1, 2, 3, 3, 3, None])
        at = start + datetime.timedelta(seconds=rng.randrange(5 * 86_400), microseconds=rng.randrange(1_000_000))
        rows.append((i, at if rng.random() > 0.02 else None, user, rng.choice(["view", "click", "add_to_cart", None]), 1, "s"))
    for k in range(400):
        rows.append((2_000 + k, start + datetime.timedelta(minutes=11 * k), 9, "click", 1, "s"))
    return rows


def written(spark, folder, rows: list[tuple], files: int, late_s: int, seed: int) -> str:
    """Events in files one after the other, dealt so that none comes later than the watermark allows."""
    rng = random.Random(seed)
    known = sorted((r for r in rows if r[1]), key=lambda r: r[1] + datetime.timedelta(seconds=rng.randrange(late_s)))
    known += [r for r in rows if not r[1]]
    size = -(-len(known) // files)
    for k in range(files):
        spark.createDataFrame(known[k * size : (k + 1) * size], EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/{k:03d}")
    return folder


def streamed(spark, folder: str, files: int):
    own = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(folder)
    return sessions.timed(own, late="1 hour")


def shown(df) -> Counter:
    return Counter((r["user_id"], r["start"], r["last"], r["signals"], r["carts"], round(r["weight"], 6), tuple(sorted((k, round(v, 6)) for k, v in r["interests"].items()))) for r in df.collect())


@pytest.mark.parametrize(("files", "per_trigger"), [(1, 1), (7, 1), (7, 3)])
def test_expired_sessions_are_those_of_the_batch(spark, tmp_path, files, per_trigger):
    rows = some_events()
    folder = written(spark, f"{tmp_path}/in", rows, files, 3_000, 5)
    got = stateful.appended(stateful.expired_sessions(streamed(spark, folder, per_trigger)), f"{tmp_path}/out")
    until = max(int(r[1].replace(tzinfo=datetime.UTC).timestamp() * 1_000) for r in rows if r[1]) * 1_000 - 3_600_000_000
    want = shown(stateful.sessions_of_batch(spark.createDataFrame(rows, EVENTS), F.lit(until)))
    assert shown(got) == want and len(want) > 30 and max(n for k, n in want.items()) == 1
    assert sum(k[0] == 9 for k in want) > 2  # a user without a pause, cut at the greatest length


def test_alarms_keep_a_ring_of_the_last_signals(spark, tmp_path):
    rows = [r for r in some_events(3) if r[1]]
    folder = written(spark, f"{tmp_path}/in", rows, 4, 3_000, 5)
    until = max(r[1] for r in rows) - datetime.timedelta(hours=1, milliseconds=1)
    for capacity in (1_000, 3):
        got = stateful.appended(stateful.signal_alarms(streamed(spark, folder, 1), width=4_000, least=3, capacity=capacity, age=5_000), f"{tmp_path}/out{capacity}")
        want = Counter()
        for i, at, user, *_ in rows:
            if user is not None and at <= until:
                recent = sum(u == user and at - datetime.timedelta(seconds=4_000) <= t and (t, j) <= (at, i) for j, t, u, *_ in rows)
                if min(recent, capacity) >= 3:
                    want[i, min(recent, capacity)] += 1
        assert want and Counter((r["event_id"], r["recent"]) for r in got.collect() if r["at"] <= until) == want


def test_elevation_merges_once_whatever_fails(spark, tmp_path):
    rows = some_events(4)
    links = spark.createDataFrame([(1, 11), (2, 12), (3, 11), (9, None)], "user_id long, profile_id long")
    whole = written(spark, f"{tmp_path}/whole", rows, 9, 3_000, 5)
    until = max(int(r[1].replace(tzinfo=datetime.UTC).timestamp() * 1_000) for r in rows if r[1]) * 1_000 - 3_600_000_000
    closed = stateful.sessions_of_batch(spark.createDataFrame(rows, EVENTS), F.lit(until)).collect()
    want: dict[int, list] = {}
    for s in closed:
        profile = {1: 11, 2: 12, 3: 11}.get(s["user_id"])
        if profile:
            own = want.setdefault(profile, [0, 0, 0, s["last"], {}])
            own[:4] = own[0] + 1, own[1] + s["signals"], own[2] + s["carts"], max(own[3], s["last"])
            for k, v in s["interests"].items():
                own[4][k] = max(own[4].get(k, 0.0), round(v, 6))

    def merged(log) -> dict[int, list]:
        return {r["profile_id"]: [r["sessions"], r["signals"], r["carts"], r["last_seen"], {k: round(v, 6) for k, v in r["interests"].items()}] for r in log.read().collect()}

    run = lambda path, every, after=lambda batch: None: stateful.elevate(stateful.expired_sessions(streamed(spark, whole, 1)), links, path, every=every, after=after)
    assert merged(run(f"{tmp_path}/once", 100)) == want
    failed = set()

    def fail_once(batch: int) -> None:
        if batch in (1, 3, 5) and batch not in failed:
            failed.add(batch)
            raise RuntimeError("lost after the merge was written")

    for every in (2, 4):
        failed.clear()
        for _ in range(3):
            with pytest.raises(StreamingQueryException):
                run(f"{tmp_path}/broken{every}", every, fail_once)
        log = run(f"{tmp_path}/broken{every}", every, fail_once)
        assert merged(log) == want
        assert merged(run(f"{tmp_path}/broken{every}", every)) == want  # nothing new, nothing merged again


@pytest.mark.parametrize("by_best", [False, True])
def test_chains_of_names_keep_every_plan_small(spark, monkeypatch, by_best):
    # a chain settles a name or two a round: no table may read one more file list with each of them
    scans = []
    first = naming.stored

    def watched(df, name):
        scans.append(str(df._jdf.queryExecution().optimizedPlan()).count("Relation"))
        return first(df, name)

    monkeypatch.setattr(naming, "stored", watched)
    n = 24
    nodes = spark.range(1, n + 1).select(F.col("id").alias("place"))
    pairs = nodes.filter(f"place < {n}").select(F.col("place").alias("a"), (F.col("place") + 1).alias("b"), F.lit(0.9).alias("similarity"))
    led = (naming.best_leaders if by_best else naming.first_leaders)(nodes, pairs)
    assert {r["place"]: r["leader"] for r in led.collect()} == {i: 1 if by_best else i - (i + 1) % 2 for i in range(1, n + 1)}
    scans.append(str(led._jdf.queryExecution().optimizedPlan()).count("Relation"))
    assert max(scans) <= 5


@pytest.mark.parametrize("share", [0.8, 0.7, 0.6])
def test_names_are_compared_with_leaders_and_not_with_followers(spark, monkeypatch, share):
    monkeypatch.setattr(naming, "FIRST", 6, raising=False)
    monkeypatch.setattr(naming, "TIMES", 3, raising=False)
    rng, first, pairs = random.Random(9), naming.stored, []

    def watched(df, name):
        own = first(df, name)
        if name == "greedy-edges":
            pairs.append(own.count())
        return own

    words = ["".join(rng.choice("abcdefgh") for _ in range(size)) for size in (5, 8, 10, 12, 14, 15, 17, 19, 21, 24)]
    names = [*words]
    for word in words * 8:  # all like the first one of its kind, by one or two edits, and so like each other
        at = rng.randrange(len(word))
        names.append(rng.choice([word[:at] + "x" + word[at:], word[:at] + word[at + 1 :], word[:at] + "Y" + word[at + 1 :]]))
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string").repartition(3)
    monkeypatch.setattr(naming, "stored", watched)
    got = {r["place"] - 1: r["leader"] - 1 for r in naming.normalised(rows, ["id"], share).collect()}
    assert got == dict(enumerate(plain_greedy(names, share, False)))
    assert sum(pairs) < len(names)


def test_common_parts_make_no_pairs_of_names(spark):
    rng = random.Random(1)
    syllables = ["anth", "tion", "oure", "blei"]
    words = sorted({"".join(rng.choice(syllables) for _ in range(2)) + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(600)})
    rows = spark.createDataFrame(list(enumerate(words)), "k long, t string").withColumn("n", F.length("t"))
    found = naming._deletions(rows, 0.85).filter("k < k2").distinct().count()
    close = sum(plain_distance(a, b) <= 1 for i, a in enumerate(words) for b in words[:i] if abs(len(a) - len(b)) <= 1 and a[:2] == b[:2])
    assert close <= found <= 4 * close + 40


def test_elevation_runs_the_state_once_a_trigger_and_broadcasts_no_links(spark, tmp_path, monkeypatch):
    plans = []
    add = stateful.ProfileLog.add

    def watched(self, closed, batch):
        plans.append(closed._jdf.queryExecution().sparkPlan().toString())
        add(self, closed, batch)

    monkeypatch.setattr(stateful.ProfileLog, "add", watched)
    folder = written(spark, f"{tmp_path}/in", some_events(), 1, 3_000, 5)
    links = spark.range(1, 10).select(F.col("id").alias("user_id"), (F.col("id") + 10).alias("profile_id"))
    log = stateful.elevate(stateful.expired_sessions(streamed(spark, folder, 1)), links, f"{tmp_path}/out")
    assert {r["profile_id"] for r in log.read().collect()} == {11, 12, 13, 19}
    assert plans and all("FileScan parquet" in p and "Broadcast" not in p for p in plans)
