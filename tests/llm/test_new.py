"""Whitening, phrases and chat formatting against plain versions and SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, phrases, queries, whitening
from tests.llm.fixtures import documents, odd_rows

DIRECTORY = "/root/testdata/sf0.01"
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def vectors(spark, rows):
    """A table of vectors, with columns whose names the operator might use."""
    return spark.createDataFrame([(i, v, 1, 2, "x", 0.5) for i, v in rows], "vec_id long, embedding array<double>, n int, component int, v string, whitened double")


def plain_whitening(rows: list[tuple]) -> tuple[list[int], np.ndarray]:
    """Exact deviations, and the covariance from exact fractions."""
    x = [[math.floor(Fraction(c) * 1024) + 100_000 for c in v] for _, v in rows]
    n, dim = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(dim)]
    centred = [[n * r[d] - sums[d] for d in range(dim)] for r in x]
    scatter = [[Fraction(sum(r[i] * r[j] for r in centred), n**3) for j in range(dim)] for i in range(dim)]
    return [sum(d * d for d in r) for r in centred], np.array([[float(v) for v in r] for r in scatter]), np.array([[d / n for d in r] for r in centred])


@pytest.mark.parametrize("far", [0.0, 3e9])
def test_whitening_against_fractions(spark, far):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(0, 1, 5) * [3, 1, 2, 1, 0.5] + far]) for i in range(60)] + [(7, [far] * 5), (None, [far - 1] * 5)]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, [float("inf")] * 5), (105, [1.0])]
    got = whitening.whiten(vectors(spark, rows + bad), components=4).collect()
    deviations, covariance, centred = plain_whitening(rows)
    assert len(got) == 4 * len(rows) and {r["n"] for r in got} == {len(rows)}
    assert Counter((r["vec_id"], int(r["deviation_exact"])) for r in got if r["component"] == 1) == Counter((i, d) for (i, _), d in zip(rows, deviations, strict=True))
    assert all(r["deviation"] == (int(r["deviation_exact"]) if r["deviation_exact"] < 1 << 63 else None) for r in got)
    values, own = np.linalg.eigh(covariance)
    for k in range(4):
        value, direction = values[-1 - k], own[:, -1 - k]
        want = sorted(centred @ direction / np.sqrt(value), key=abs)
        have = sorted((r["whitened"] for r in got if r["component"] == k + 1), key=abs)
        assert np.allclose(np.abs(want), np.abs(have), rtol=1e-6, atol=1e-6)
        assert {round(r["explained"] / (value / values.sum()), 4) for r in got if r["component"] == k + 1} == {1.0}
    assert {r["identity_error"] for r in got}.pop() < 1e-6


def test_whitening_parts_are_exact():
    rng = random.Random(2)
    for bits in (5, 17, 18, 30, 50, 61, 90):
        z = [[rng.randrange(-(1 << bits), 1 << bits) for _ in range(3)] for _ in range(40)]
        own = np.array(z, object if bits > 61 else np.int64)
        want = [[sum(r[i] * r[j] for r in z) for j in range(3)] for i in range(3)]
        assert whitening.gram(own).tolist() == want
        assert whitening.squares(own) == [sum(x * x for x in r) for r in z]
        for value in z[0] + z[1]:
            assert sum(v << (whitening.SENT * p) for _, _, p, v in whitening._sent(0, 0, value)) == value


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, 0.0, None), (2, 0, None, 0.0, None)]
    huge = whitening.whiten(vectors(spark, [(1, [1e308, 1.0]), (2, [-1e308, 2.0]), (3, [0.0, 3.0])])).collect()
    first = {r["vec_id"]: r["whitened"] for r in huge if r["component"] == 1}
    assert len(huge) == 6 and math.isclose(abs(first[1]), math.sqrt(1.5)) and first[1] == -first[2] and {r["deviation"] for r in huge} == {None, (3 * 1_024) ** 2}


def plain_phrases(rows: list[tuple], least: int, longest: int, top: int) -> set[tuple]:
    """All phrases by counting every run of words."""
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = set()
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        kept = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        parts = {q: 0 for q in kept}
        for p, c in kept.items():
            for j in range(2, len(p)):
                for i in range(len(p) - j + 1):
                    parts[p[i : i + j]] = max(parts[p[i : i + j]], c)
        best = []
        for p, a in kept.items():
            if parts[p] < a:
                score, _, left, right = min((1000 * a * n // (f[p[:c]] * f[p[c:]]), c, f[p[:c]], f[p[c:]]) for c in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        out |= {(lang, rank, p.decode(), -a, left, right, n, -score) for rank, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1)}
    return out


@pytest.mark.parametrize(("least", "top", "block"), [(2, 2_000, 1 << 21), (3, 40, 500)])
def test_phrases_against_counting(spark, monkeypatch, least, top, block):
    monkeypatch.setattr(phrases, "BLOCK", block)
    rng = random.Random(8)
    words = ["Der", "der", "a", "b", "\x1c", "é", "x\x00y", "long" * 20, "a b", "a\tb", "und", "🙂"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ".", ", ", "\r\n", "!?"]) for _ in range(rng.randrange(60)))) for _ in range(80)]
    rows += [("en", None), ("en", ""), ("en", " . "), ("fr", "a a a a a a a a"), *[("en", t) for _, t in odd_rows()]]
    docs = spark.createDataFrame([(lang, t, 1, "k", 2, 3) for lang, t in rows], "lang string, text string, size int, phrase string, f int, rank int").repartition(5)
    got = phrases.mine_phrases(docs, least=least, top=top)
    want = plain_phrases(rows, least, 5, top)
    assert want and {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert phrases.mine_phrases(docs.limit(0)).count() == 0
    assert phrases.mine_phrases(documents(spark, [(1, "one two three")])).count() == 0


def test_word_hashes_are_those_of_spark(spark):
    row = spark.sql("SELECT xxhash64('en', 'wörd'), xxhash64('und', '')").first()
    assert list(row) == [int(phrases.word_keys("en", ["wörd"]).view(np.int64)[0]), int(phrases.word_keys("und", [""]).view(np.int64)[0])]


def test_phrase_lists_go_to_python_a_few_blocks_at_a_time(spark, monkeypatch):
    name, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    before, whole = spark.conf.get(name), phrases.stored

    def watched(df, table):
        rows.setdefault(table, []).append(int(spark.conf.get(name)))
        return whole(df, table)

    monkeypatch.setattr(phrases, "stored", watched)
    assert phrases.mine_phrases(documents(spark, [(i, "one two three four") for i in range(9)]), least=3).count()
    assert max(rows["phrase-words"]) <= 2_000 and max(rows["phrase-lists"][1:] + rows["phrase-hashes"] + rows["phrase-counts"]) <= 4
    assert spark.conf.get(name) == before


def test_phrase_lists_lie_packed_in_the_rows_of_spark(spark, monkeypatch):
    held, settings, whole = [], ["spark.sql.parquet.columnarReaderBatchSize", "spark.sql.parquet.compression.codec"], phrases.stored
    before = [spark.conf.get(name) for name in settings]

    def watched(df, table):
        own = whole(df, table)
        if table == "phrase-lists":
            held.append(own.toArrow().nbytes)
        return own

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(300)]
    lines = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(2_000)]
    text = ".".join(lines + lines)
    monkeypatch.setattr(phrases, "stored", watched)
    found = phrases.mine_phrases(documents(spark, [(1, text)]), least=2, top=None)
    assert found.count() and len(held) == 5 and max(held) < 2 * len(text)
    assert [spark.conf.get(name) for name in settings] == before


@pytest.mark.parametrize("name", ["op12_phrases", "op13_chat_format"])
def test_query_against_its_sql(spark, name):
    own = duckdb.connect()
    for table in ("documents", "conversations"):
        own.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DIRECTORY}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, DIRECTORY), own.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())


CONTROLS = ["[INST]", "[/INST]", "</s>", "<s>", "\\", "[SYS]", "[", "]", "/", "word ", "é🙂", "INST]", "[ROLE]", "[TURN]", "\n"]


def chats(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "conv_id long, turn long, role string, text string, place int, piece string, start int").repartition(4)


def test_chats_against_a_plain_version(spark):
    rng = random.Random(5)
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice(CONTROLS) for _ in range(rng.randrange(8)))
    rows = [(rng.choice([1, 2, 3, None, *range(10, 30)]), t, rng.choice(["user", "assistant", "assistant", "system", "tool", "[ROLE]", "", None]), text()) for t in [*range(300), None, 7, 7]]
    rows += [(99, t, ("user", "assistant")[t % 2], f"turn {t} </s>") for t in range(400)] + [(98, 0, "assistant", "x" * 300_000)]
    rows += [rows[0], rows[0]]
    formatted = chat.format_chats(chats(spark, rows))
    assert formatted.count() == len(rows) and not formatted.filter("rewrites or altered").count()
    texts = {}
    for r in formatted.orderBy("place").collect():
        whole = texts.get(r["conv_id"], "")
        assert (r["start"], r["end"]) == (len(whole), len(whole) + len(r["piece"]))
        texts[r["conv_id"]] = whole + r["piece"]
    null_first = lambda x: (x is not None, x if x is not None else 0)
    want = {}
    for conv in {r[0] for r in rows}:
        turns = [(role or "", t or "") for _, _, role, t in sorted((r for r in rows if r[0] == conv), key=lambda r: (null_first(r[1]), (r[2] or "").encode(), (r[3] or "").encode()))]
        assert texts[conv] == chat.render_marked(turns) and chat.parse_marked(texts[conv]) == turns
        loss = "".join(t for role, t in turns if role == "assistant")
        want[conv] = (len(turns), hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(texts[conv]), False)
    assert {r["conv_id"]: tuple(r)[1:] for r in chat.read_chats(formatted).collect()} == want
    assert chat.format_chats(chats(spark, [])).count() == 0 and chat.read_chats(chat.format_chats(chats(spark, []))).count() == 0


def plainly(turns):
    return "".join(f"{role}: {text}\n" for role, text in turns)


def only_last_thought(turns):
    """A template that takes the thoughts out of all answers but the last."""
    return "".join(f"{role}: {text if i == len(turns) - 1 else re.sub('<think>.*</think>', '', text)}\n" for i, (role, text) in enumerate(turns))


def numbered(turns):
    return "".join(f"{i} {role}: {text}\n" for i, (role, text) in enumerate(turns))


def stripped(turns):
    return "".join(f"{role}: {text.strip()}\n" for role, text in turns)


def template(render, memory=None):
    return chat.Template(render, lambda t: t, lambda piece: [tuple(line.split(": ", 1)) for line in piece.splitlines()], memory)


def test_templates_that_rewrite_alter_or_remember(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "<think>t</think>a"), (1, 2, "user", "r"), (2, 0, "user", "q"), (2, 1, "assistant", " b ")]
    own = chat.format_chats(chats(spark, rows), template(only_last_thought))
    assert [(r["conv_id"], r["place"]) for r in own.collect() if r["rewrites"]] == [(1, 2)]
    last = own.filter("conv_id = 1 and place = 2").first()
    assert (last["start"], last["piece"]) == (len("user: q\nassistant: "), "a\nuser: r\n")
    read = {r["conv_id"]: r for r in chat.read_chats(own, template(only_last_thought)).collect()}
    assert read[1]["rewritten"] and read[1]["n_turns"] is None and not read[2]["rewritten"] and read[2]["n_turns"] == 2 and read[2]["loss_chars"] == 3
    assert [(r["conv_id"], r["place"]) for r in chat.format_chats(chats(spark, rows), template(stripped)).collect() if r["altered"]] == [(2, 1)]
    with pytest.raises(Exception, match="depends on more turns"):
        chat.format_chats(chats(spark, rows), template(numbered, memory=1)).collect()
    long = [(1, t, "user", f"t{t}") for t in range(50)]
    for memory in (None, 0, 1, 3):
        got = chat.format_chats(chats(spark, long), template(plainly, memory)).orderBy("place").collect()
        assert "".join(r["piece"] for r in got) == plainly([(r, t) for _, _, r, t in long])
    assert "".join(r["piece"] for r in chat.format_chats(chats(spark, long), template(numbered)).orderBy("place").collect()) == numbered([(r, t) for _, _, r, t in long])
