"""Secret, license, personal-data and benchmark scans against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, licenses, pii, queries, secrets
from tests.llm.fixtures import documents, odd_rows

LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def random_rows(pieces: list[str], seed: int, n: int = 60) -> list[tuple]:
    """Texts strung together from telling pieces."""
    rng = random.Random(seed)
    return [(1_000 + i, "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40)))) for i in range(n)]


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def plain_secrets(text: str) -> list[tuple[str, int, int]]:
    word = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = re.compile(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(found)]


def test_secrets(spark):
    rows = odd_rows() + random_rows(["Password", "api_key", "apikey", "toKen", "=", ": ", "\"", "'", "abc123", "AKIA", "ABCDEFGH12345678", "deadbeef00112233", "ſecret", " ", "\n", "é", "x"], 1)
    got = secrets.find_secrets(documents(spark, rows))
    assert got.count() == len(rows)
    want = Counter()
    for key, text in rows:
        spans = plain_secrets(text or "")
        counts = Counter(k for k, _, _ in spans)
        want[key, counts["assign"], counts["access"], counts["hex"], digest(spans)] += 1
    assert Counter(tuple(r)[:5] for r in got.collect()) == want
    assert secrets.find_secrets(documents(spark, [])).count() == 0


def test_novel_strings_in_a_sensitive_context(spark):
    rows = [(1, "use client_id: zX9qLw3vRt7bNm2kPd8s here"), (2, "session = abcdefghijklmnopqrstuvwxyz0123456789"), (3, "the weather: zX9qLw3vRt7bNm2kPd8s")]
    got = {r["doc_id"]: r for r in secrets.find_secrets(documents(spark, rows)).collect()}
    assert got[1]["n_novel"] == 1 and got[1]["spans"] == "novel:15:35"
    assert got[2]["n_novel"] == 0 and got[3]["n_novel"] == 0


def test_novelty_on_planted_strings(spark):
    """Recall on keys of several alphabets, single and repeated nearby; words, names of the corpus and paths stay."""
    rng = random.Random(8)
    key = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    full, base32, upper_hex = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEF"
    planted = [key(a, n) for a in (full, base32, upper_hex) for n in (24, 40, 64, 120) for _ in range(3)]
    rows = [(i, f"session_key: {k} and more words" if i % 2 else f"session_key: {k}\nsession_key: {k}\n") for i, k in enumerate(planted)]
    common = ["render_page_header_twice", "load-user-profile-data", "parseConfigurationFileNow"]
    rows += [(1_000 + i, f"client key: {common[i % 3]}2 here {common[i % 3]}") for i in range(30)]
    got = {r["doc_id"]: r for r in secrets.find_secrets(documents(spark, rows)).collect()}
    found = sum(got[i]["n_novel"] == (1 if i % 2 else 2) for i in range(len(planted)))
    assert found / len(planted) >= 0.9
    assert sum(got[1_000 + i]["n_novel"] for i in range(30)) == 0


def test_licenses(spark):
    rows = odd_rows() + random_rows(["cc ", "by ", "CC-BY\n", "general ", "public ", "license ", "all rights ", "reserved. ", "é "], 2)
    got = licenses.find_licenses(documents(spark, rows))
    assert got.count() == len(rows)
    want = Counter()
    for key, text in rows:
        own, places, labels = words(text), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(own)) if own[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want[key, len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))] += 1
    assert Counter(tuple(r)[:6] for r in got.collect()) == want
    for r in got.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.find_licenses(documents(spark, [])).count() == 0


def test_license_templates_with_words_put_in_and_left_out(spark):
    mit = licenses.TEMPLATES["mit"].split()
    rows = [(1, " ".join(mit)), (2, " ".join([*mit[:10], "indeed", *mit[10:20], *mit[21:]])), (3, " ".join(mit[:12])), (4, " ".join(reversed(mit)))]
    got = {r["doc_id"]: r for r in licenses.find_licenses(documents(spark, rows)).collect()}
    assert got[1]["labels"] == "mit" and got[1]["score"] == 1.0
    assert got[2]["labels"] == "mit" and 0.8 <= got[2]["score"] < 1
    assert got[3]["labels"] == "" and 0 < got[3]["score"] < 0.8
    assert got[4]["labels"] == ""


def luhn(digits: str) -> bool:
    return sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 else d for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_pii(text: str) -> list[tuple[str, int, int]]:
    digits = lambda m: re.sub("[^0-9]", "", m)
    forms = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(name, m.start(), m.end()) for name, form, ok in forms for m in re.finditer(form, text) if ok(m[0])]


def test_pii(spark):
    pieces = ["a.b", "@", "mail", ".com", ".", "%x", "_", "1.2.3.4", "255", ".0", "256", "4111 1111 1111 1111", "4111-1111-", "1111", " ", "-", "+1 (555) ", "555-1234", "+", "é", "🙂", "\n", "00", "x@y@z.com", "a@b.c_d@e.f"]
    rows = odd_rows() + random_rows(pieces, 3, 200) + [(1, "1" * 30_000), (2, "1 " * 20_000 + "+" * 3_000), (3, "a@" * 5_000)]
    got = pii.find_pii(documents(spark, rows))
    want = Counter()
    for key, text in rows:
        spans = plain_pii(text or "")
        counts = Counter(k for k, _, _ in spans)
        want[key, *(counts[k] for k in ("email", "ip", "card", "phone")), digest(spans)] += 1
    assert Counter(tuple(r)[:6] for r in got.collect()) == want
    assert pii.find_pii(documents(spark, [])).count() == 0


def test_contexts_discover_other_identifiers(spark):
    seeds = [(i, f"please write to member {i:03d}a@mail.com today and rest") for i in range(30)]
    seeds = [(i, f"please write to user{i}@mail{i}.com today") for i in range(30)]
    rows = [*seeds, (100, "please write to AB-998877665 today"), (101, "nothing at all AB-112233445 else")]
    got = {r["doc_id"]: r for r in pii.find_pii(documents(spark, rows)).collect()}
    assert got[100]["n_context"] == 1 and got[100]["spans"] == "context:16:28"
    assert got[101]["n_context"] == 0


def plain_bootstrap(edges: set[tuple[str, str, bool]], least_seeds: int, least_trust: float) -> tuple[set[str], int]:
    """The scores of patterns and instances, round by round, in plain loops until none rises; and the rounds."""
    seeds = {i for _, i, s in edges if s}
    score = {i: float(i in seeds) for _, i, _ in edges}
    of, around = {}, {}
    for p, i, _ in edges:
        of.setdefault(p, []).append(i)
        around.setdefault(i, []).append(p)
    rounds, rose = 0, True
    while rose:
        rounds, rose, trust = rounds + 1, False, {}
        for p, own in of.items():
            own = [score[i] for i in own]
            if sum(x >= pii.CERTAIN for x in own) >= least_seeds and sum(own) / (len(own) + 1) >= least_trust:
                trust[p] = sum(own) / (len(own) + 1)
        for i in set(score) - seeds:
            doubt = 1.0
            for p in around[i]:
                doubt *= 1 - trust.get(p, 0.0)
            new = max(score[i], min(1 - doubt, pii.MOST))
            rose, score[i] = rose or new - score[i] > pii.SETTLED, new
    return {i for i, x in score.items() if least_trust <= x < 1}, rounds


@pytest.mark.parametrize("seed", [1, 2])
def test_bootstrap_equals_plain_loops(spark, seed):
    rng = random.Random(seed)
    instances = [(f"i{n}", n < 25) for n in range(60)]
    edges = {(f"p{rng.randrange(12)}", *rng.choice(instances[: rng.choice([25, 30, 60])])) for _ in range(300)}
    table = spark.createDataFrame(list(edges), "pattern string, instance string, seed boolean")
    got = {r["instance"] for r in pii._trusted(table, 3, 0.6).collect()}
    assert got == plain_bootstrap(edges, 3, 0.6)[0] and got


def test_bootstrap_goes_on_until_it_settles(spark):
    """Each level of strings is vouched for by the level before it alone, so every level takes a round."""
    levels = [[f"l{k}-{n}" for n in range(30)] for k in range(12)]
    edges = {(f"p{k}{ab}", i, k == 0 and own is levels[0]) for k in range(11) for ab in "abc" for own in (levels[k], levels[k + 1][:8] if k < 10 else levels[k + 1]) for i in own}
    edges |= {(f"q{k}{ab}", i, k == 0) for k in range(11) for ab in "abc" for i in levels[k]} | {(f"q{k}{ab}", i, False) for k in range(11) for ab in "abc" for i in levels[k + 1][8 + 7 * "abc".index(ab) : 22 + 7 * "abc".index(ab)]}
    want, rounds = plain_bootstrap(edges, 3, 0.6)
    assert rounds > 8 and any(i.startswith("l11") for i in want)
    table = spark.createDataFrame(list(edges), "pattern string, instance string, seed boolean")
    assert {r["instance"] for r in pii._trusted(table, 3, 0.6).collect()} == want


def test_identifiers_of_several_forms_are_discovered(spark):
    """Recall and precision on planted strings: forms that no rule lists, in contexts of seeds and out of them."""
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    forms = [lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: f"AB{digits(2)}CD{digits(3)}", lambda: digits(4), lambda: f"GB{digits(2)} {digits(4)} {digits(4)} {digits(4)}", lambda: f"user_{digits(3)}x", lambda: f"#{digits(6)}"]
    contexts = ["Contact: {} as agreed", "please write to {} today", "reach the owner {} soon"]
    rows = [(i, rng.choice(contexts).format(f"user{i}@mail{i}.com")) for i in range(150)]
    planted = {1_000 + i: (rng.choice(contexts), rng.choice(forms)()) for i in range(30)}
    rows += [(i, c.format(x)) for i, (c, x) in planted.items()]
    rows += [(2_000 + i, rng.choice(["in chapter {} we saw", "about {} apples", "Total: {} units"]).format(rng.choice(forms)())) for i in range(60)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(documents(spark, rows)).collect()}
    found = sum(f"context:{c.index('{')}:{c.index('{') + len(x)}" in got[i] for i, (c, x) in planted.items())
    assert found / len(planted) >= 0.9
    assert not any("context" in got[2_000 + i] for i in range(60))


def test_redact(spark):
    rows = [(1, "mail é🙂 a@b.com or +1 555 555 1234."), (2, "clean"), (3, None), (3, "a@b.com a@b.com"), (4, "at the end 10.0.0.1")]
    got = pii.redact(documents(spark, rows))
    assert got.columns == documents(spark, rows).columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(1, "mail é🙂 [EMAIL] or [PHONE]."), (2, "clean"), (3, None), (3, "[EMAIL] [EMAIL]"), (4, "at the end [IP]")])


def plain_contamination(text: str | None, items: list[tuple]) -> tuple[int, int, list[str]]:
    own, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        n = min(10, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(own) - n + 1):
            if windows and tuple(own[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found |= {str(item)} if item is not None else set()
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize(("seed", "small"), [(1, True), (2, True), (2, False)])
def test_contamination(spark, seed, small, monkeypatch):
    if not small:
        monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 0)
    rng = random.Random(seed)
    vocabulary = ["A", "b", "c", "Dé"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 14])))) for i in range(12)] + [(50, None), (51, ""), (None, "a b c a b c a b c a"), (52, "two words"), (52, "two words")]
    rows = odd_rows() + [(2_000 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 12, 60])))) for i in range(60)] + [(3_000 + i, f"x {b} y, {b}") for i, (_, b) in enumerate(items)]
    got = decontaminate.find_contamination(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit(1)))
    want = Counter()
    for key, text in rows:
        n, hit, found = plain_contamination(text, items)
        want[key, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0] += 1
    assert Counter(map(tuple, got.collect())) == want
    kept = decontaminate.drop_contaminated(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter((i, t) for i, t in rows if not plain_contamination(t, items)[1])


def test_contamination_against_its_sql(spark):
    import duckdb

    directory = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE VIEW documents AS SELECT * FROM '{directory}/documents.parquet'; CREATE VIEW benchmark AS SELECT * FROM '{directory}/benchmark.parquet'")
    want = duckdb.sql(queries.ORACLES["op8_decontamination"])
    got = queries.QUERIES["op8_decontamination"](spark, directory)
    assert Counter(map(tuple, got.select(want.columns).collect())) == Counter(want.fetchall())


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = [(1, "some text"), (2, None)]
    assert {(r["doc_id"], r["n_words"], r["contaminated"]) for r in decontaminate.find_contamination(documents(spark, rows), none).collect()} == {(1, 2, False), (2, 0, False)}
    assert decontaminate.find_contamination(documents(spark, []), none).count() == 0
