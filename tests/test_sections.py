"""Chunks by headings against a plain version, and a stream of them."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import sections
from lodestone.plans import catalogue


def plain_chunks(text: str | None, deepest: int, target: int, least: int) -> list[tuple]:
    """Heading, level, path and text of each chunk, by walking over the lines."""
    text = text or ""
    level = lambda line: len(m[1]) if (m := re.match("(#+) ", line)) and len(m[1]) <= deepest else 0
    found: list[list] = []
    if any(level(x) for x in text.split("\n")):
        found, stack = [["", 0, (), []]], {}
        for line in text.split("\n"):
            if own := level(line):
                path = tuple(stack[j] for j in sorted(stack) if j < own)
                stack = {j: h for j, h in stack.items() if j < own} | {own: re.sub("^[# ]+", "", line)}
                found.append([stack[own], own, path, []])
            else:
                found[-1][3].append(line)
        found = [[h, n, p, "\n".join(c).strip(" \t\n\r\f\v")] for h, n, p, c in found]
        found = [f for f in found if f[1] or f[3]]
    else:
        for part in re.split(r"\r?\n[ \t\n\r\f\v]*\r?\n", text):
            part = part.strip(" \t\n\r\f\v")
            if part:
                end = next((i for i, c in enumerate(part) if c in ".!?"), -1)
                if 0 < end < 100:
                    name = part[: end + 1]
                elif len(part) < 100:
                    name = part
                else:
                    cut = part.rfind(" ", 0, 81)
                    name = part[: 80 if cut < 20 else cut] + "..."
                found.append([name, 1, (), part])
    chunks, tokens = [], 0
    for h, n, p, c in found:
        whole = f"## {h}\n\n{c}" if h else c
        if not chunks or (tokens + len(whole) // 4 > target and tokens >= least):
            chunks.append([h, n, p, [c]])
            tokens = len(c) // 4
        else:
            chunks[-1][3].append(whole)
            tokens += len(whole) // 4
    out = [(h, n, p, "\n\n".join(c).strip(" \t\n\r\f\v")) for h, n, p, c in chunks]
    return [x for x in out if x[3]]


@pytest.mark.parametrize(("deepest", "target", "least"), [(2, 40, 10), (3, 12, 0), (6, 4_000, 500)])
def test_chunks_against_a_walk_over_the_lines(spark, deepest, target, least):
    rng = random.Random(deepest)
    piece = lambda: rng.choice(["# One", "## Two two", "### Three", "###### Six", "#none", "some words here. And more", "", "", "  ", "x" * 120, "word " * 30, "é🙂 line?", "## "])
    texts = ["\n".join(piece() for _ in range(rng.randrange(25))) for _ in range(60)] + [None, "", "\n \n", "no heading at all", "first.\r\n\r\nsecond\n\n\n" + "long " * 60]
    docs = spark.createDataFrame([(i, t, 1, "l") for i, t in enumerate(texts)], "doc long, body string, section int, level string").repartition(3)
    got: dict[int, list] = {}
    for r in sections.chunk_sections(docs, "doc", "body", deepest, target, least).orderBy("doc", "chunk").collect():
        assert r["chunk"] == len(got.setdefault(r["doc"], []))
        got[r["doc"]].append((r["heading"], r["level"], tuple(r["path"]), r["text"]))
    assert got == {i: c for i, t in enumerate(texts) if (c := plain_chunks(t, deepest, target, least))}
    assert sections.chunk_sections(docs.limit(0), "doc", "body").count() == 0


def test_pages_become_marked_text(spark):
    html = "<html><nav><h1>no</h1></nav><h1 class='x'>Title &amp; more</h1><p>One <b>two</b></p><!-- h --><p>three</p><h3>\nSub</h3><ul><li>a</li><li>b</li></ul></html>"
    got = spark.createDataFrame([(html,), ("plain",), (None,)], "h string").select(sections.marked_headings(F.col("h")).alias("t")).collect()
    assert [r["t"] for r in got] == ["# Title & more\nOne two\n\nthree\n### Sub\na\n\nb", "plain", None]


def test_a_stream_of_chunks_adds_each_content_once(spark, tmp_path):
    rows = [(i, f"# Doc {i % 4}\nbody {i % 4}\n# Other {i}\nmore {i}") for i in range(12)]
    read = lambda: spark.readStream.schema("doc long, body string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for k in range(3):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], "doc long, body string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    store = sections.chunk_stream(read(), f"{tmp_path}/out", "doc", "body", target=2, least=0)
    want = {x[3] for _, t in rows for x in plain_chunks(t, 2, 2, 0)}
    texts = [r["text"] for r in store.read().collect()]
    assert set(texts) == want and len(texts) == len(want)
    spark.createDataFrame([(100 + i, t) for i, t in rows], "doc long, body string").write.parquet(f"{tmp_path}/in/9")  # the same contents again
    assert sections.chunk_stream(read(), f"{tmp_path}/out", "doc", "body", target=2, least=0).read().count() == len(want)
    store.add(sections.chunk_sections(spark.createDataFrame(rows[:4], "doc long, body string"), "doc", "body", target=2, least=0), 0)  # a trigger that is repeated
    assert store.read().count() == len(want)


def test_chunks_of_pages_equal_the_plain_version(spark):
    directory = "/root/testdata/sf0.001"
    marked = {r["page_id"]: r["t"] for r in spark.read.parquet(f"{directory}/pages.parquet").select("page_id", sections.marked_headings(F.col("html")).alias("t")).collect()}
    got: dict[int, list] = {}
    for r in catalogue.QUERIES["page_chunks"](spark, directory).orderBy("page_id", "chunk").collect():
        got.setdefault(r["page_id"], []).append((r["heading"], r["level"], r["text"]))
    assert got == {i: [(h, n, x) for h, n, _, x in c] for i, t in marked.items() if (c := plain_chunks(t, 6, 200, 50))} and len(got) > 10
