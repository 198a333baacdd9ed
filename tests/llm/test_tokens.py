"""Token operators against the libraries."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import bpe, chunks, shards, token_counts
from tests.llm.fixtures import documents, odd_rows


@pytest.fixture(scope="module")
def multi() -> tiktoken.Encoding:
    with open(public_tokenizers.path(bpe.RANKS_FILE), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_rank_bitmap_finds_the_lowest():
    rng, own = random.Random(1), set()
    bits = bpe.RankBitmap(50_257)
    for r in rng.sample(range(50_257), 500):
        bits.add(r)
        own.add(r)
    while own:
        assert bits.first() == min(own)
        bits.discard(min(own))
        own.remove(min(own))
    assert bits.first() == -1


def test_encoder_equals_library_on_random_and_repetitive_texts(multi):
    rng, encoder = random.Random(2), bpe.TextEncoder()
    texts = ["".join(rng.choice("aab the\n  \t'sé🙂ßñ1 23.,-_/　\xa0\x85\x1c") for _ in range(rng.choice([0, 1, 3, 10, 200]))) for _ in range(800)]
    texts += ["a" * 3_000, "ab" * 2_000, "the" * 2_000, "abcabcabd" * 700, "".join(chr(rng.randrange(97, 123)) for _ in range(10_000))]
    for text in texts:
        assert encoder.encode(text) == multi.encode_ordinary(text)
        assert encoder.bpe.decode(encoder.encode(text)) == text.encode()


def test_encode_decode_rows(spark, multi):
    rows = odd_rows()
    got = Counter(tuple(r) for r in bpe.encode_decode(documents(spark, rows)).collect())
    want = Counter()
    for key, text in rows:
        ids = multi.encode_ordinary(text or "")
        want[key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encode_decode(documents(spark, [])).count() == 0
    with_ids = {r["doc_id"]: r["ids"] for r in bpe.encode_decode(documents(spark, rows), with_ids=True).collect()}
    assert with_ids[5] == multi.encode_ordinary("two words")


def test_shards_come_back_in_order(spark, tmp_path):
    rows = odd_rows()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(shards.VOCABULARY))
    got = sorted(shards.shard_table(documents(spark, rows), str(tmp_path / "t"), shard_ids=500, bucket_keys=16).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"] is not None, r["doc_id"]) for r in got] == sorted(((i is not None, i) for i, _ in rows), key=lambda x: (x[0], x[1] or 0))
    want = Counter()
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want[key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert {i for i, _ in rows if i is not None} == {r["doc_id"] for r in got if r["indexed"]}
    assert shards.shard_table(documents(spark, []), str(tmp_path / "e")).count() == 0


def test_index_rejects_unknown_keys(spark, tmp_path):
    shards.write_shards(documents(spark, [(i, f"text {i}") for i in range(300)]), str(tmp_path / "s"))
    entries = shards.directory(spark, str(tmp_path / "s"))
    buckets = shards.write_index(entries, str(tmp_path / "i"), 300, 64)
    asked = spark.createDataFrame([(str(i),) for i in range(250, 400)] + [(None,)], "key string")
    found = {r["key"] for r in shards.look_up(asked, str(tmp_path / "i"), buckets).collect()}
    assert found == {str(i) for i in range(250, 300)}


def test_keyed_reads_equal_the_library(spark, tmp_path):
    """Ids by key against the library, over several shards: present, absent, null and repeated keys."""
    rows = [r for r in odd_rows() if r[0] != 9]
    shards.write_shards(documents(spark, rows), str(tmp_path / "s"), shard_ids=400)
    entries = shards.directory(spark, str(tmp_path / "s"))
    buckets = shards.write_index(entries, str(tmp_path / "i"), entries.count(), 16)
    asked = spark.createDataFrame([(str(i),) for i in [*range(1, 9), *range(110, 400)]] + [("x",), (None,), ("7",)], "key string")
    got = {r["key"]: r["ids"] for r in shards.read_ids(asked, str(tmp_path / "s"), str(tmp_path / "i"), buckets).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path(shards.VOCABULARY))
    want = {str(i): [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows if i is not None and (i < 9 or i >= 110)}
    assert got == want and len(got) > 50


def test_keys_of_equal_hashes_are_told_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "key_hash", lambda: F.xxhash64(F.substring("key", 1, 2)))
    shards.write_shards(documents(spark, [(i, f"text {i}") for i in range(1, 400)]), str(tmp_path / "s"), shard_ids=200)
    buckets = shards.write_index(shards.directory(spark, str(tmp_path / "s")), str(tmp_path / "i"), 399, 64)
    asked = spark.createDataFrame([(str(i),) for i in range(100, 401, 7)], "key string")
    got = {int(r["key"]): r["ids"] for r in shards.read_ids(asked, str(tmp_path / "s"), str(tmp_path / "i"), buckets).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path(shards.VOCABULARY))
    assert got == {i: [*tokenizer.encode(f"text {i}").ids, 2] for i in range(100, 400, 7)}


def test_a_keyed_read_opens_only_the_files_it_needs(spark, tmp_path):
    """Every file that the asked keys don't need is spoilt: opening one would fail."""
    shards.write_shards(documents(spark, [(i, f"text {i}") for i in range(1, 400)]), str(tmp_path / "s"), shard_ids=200)
    entries = shards.directory(spark, str(tmp_path / "s")).cache()
    buckets = shards.write_index(entries, str(tmp_path / "i"), 399, 8)
    asked = ["7", "8"]
    parts = {r["part"] for r in entries.filter(F.col("key").isin(asked)).collect()}
    slices = {r["slice"] for r in spark.createDataFrame([(k,) for k in asked], "key string").select(F.pmod(F.pmod(shards.key_hash(), F.lit(buckets)), F.lit(shards.SLICES)).alias("slice")).collect()}
    spoilt = [f for folder, name, needed in (("s", "part", parts), ("i", "slice", slices)) for f in (tmp_path / folder).glob(f"{name}=*/*.parquet") if int(f.parent.name.split("=")[1]) not in needed]
    assert len(spoilt) > 10
    for f in spoilt:
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
        f.write_bytes(b"spoilt")
    got = {r["key"]: r["ids"] for r in shards.read_ids(spark.createDataFrame([(k,) for k in asked], "key string"), str(tmp_path / "s"), str(tmp_path / "i"), buckets).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path(shards.VOCABULARY))
    assert got == {k: [*tokenizer.encode(f"text {k}").ids, 2] for k in asked}
    assert shards.read_ids(spark.createDataFrame([], "key string"), str(tmp_path / "s"), str(tmp_path / "i"), buckets).count() == 0


@pytest.mark.parametrize("space", [chr(c) for c in range(0x3100) if chr(c).isspace()])
def test_white_space_is_known_at_the_ends(space):
    import pyarrow as pa
    import pyarrow.compute as pc

    assert pc.match_substring_regex(pa.array([space + "a", "a" + space, "a", f"a{space}b", "", "ā.", "\u200ba"]), chunks.ENDS_IN_SPACE).to_pylist() == [True, True, False, False, True, False, False]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100, 3_000, 20_000])
def test_perfect_hash_is_minimal(n):
    hashes = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    assert sorted(shards.PerfectHash.build(hashes).slots(hashes).tolist()) == list(range(n))


def test_counts_at_every_prefix_equal_the_library():
    counter, rng = token_counts.PrefixCounter(), random.Random(4)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    for _ in range(150):
        text = "".join(rng.choice("aab the\n  \t'sé🙂ßñ1 23.,-_/▁　") for _ in range(rng.choice([0, 1, 3, 10, 40])))
        want = [len(library.encode(text[:i])) for i in range(len(text) + 1)]
        assert counter.prefixes(text).tolist() == want
        for limit in (0, 1, 4, 9):
            assert counter.longest_prefix(text, limit) == max(i for i, n in enumerate(want) if n <= limit)


def test_counts_of_real_words_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    counter, words = token_counts.PrefixCounter(), set()
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        words |= set((r["text"] or "").split())
    words = sorted(words)
    assert counter.words([" " + w for w in words]).tolist() == [len(x) for x in library.encode(words)]


def test_stored_prefixes_answer_budgets(spark):
    """Counts at word ends, and the prefix of whole words for several budgets, against the library."""
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    rows = [(i, t) for i, t in odd_rows() if i != 9 and len(t or "") < 400]
    table = token_counts.prefix_counts(documents(spark, rows))
    texts = dict(rows)
    for r in table.filter("doc_id is not null").collect():
        text = texts[r["doc_id"]] or ""
        assert r["counts"] == [len(library.encode(text[:e])) for e in r["ends"]] and (r["ends"] or [0])[-1] == len(text)
    for limit in (0, 3, 12):
        for r in table.filter("doc_id is not null").withColumn("kept", token_counts.longest_within(F.col("counts"), F.col("ends"), limit)).collect():
            assert r["kept"] == max([e for e, c in zip(r["ends"], r["counts"], strict=True) if c <= limit], default=0)
    assert table.count() == len(rows)


def test_token_counts_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    rows = odd_rows()
    got = Counter(tuple(r)[:4] for r in token_counts.token_counts(documents(spark, rows), limit=50).collect())
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 50) for i, t in rows)
    assert got == want
    texts = dict(rows)
    for r in token_counts.token_counts(documents(spark, rows), limit=50).filter("over_limit and doc_id <> 9").collect():
        text = texts[r["doc_id"]]
        assert len(library.encode(text[: r["kept_chars"]])) <= 50 < len(library.encode(text[: r["kept_chars"] + 1]))
    assert token_counts.token_counts(documents(spark, [])).count() == 0
