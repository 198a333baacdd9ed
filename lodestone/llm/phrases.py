"""Phrase collocations by vertical positional inverted lists.

Documents are dealt into blocks of one language. In a block every frequent word
has a list of the positions at which it stands, and so has every frequent phrase.
A list of a phrase of k words is extended by a merge join: where the postings of a
word hold a position just behind an occurrence, the two are an occurrence of a
phrase of k + 1 words. The lengths of a phrase's lists over all blocks add up to
its exact frequency.

What is frequent is known only over all blocks. A round therefore counts the
extensions under hashes, marks the hashes that reach the least frequency in a
bitmap of bounded size, and writes lists for marked extensions alone. A mark can
be wrong only by letting a rare phrase pass; the lists carry the words, and
counting those drops it. So hashes save work and never decide.

The lists of a block go from step to step as one packed value. Spark's own rows and
files then hold no strings of them, whose buffers would grow with what is frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.chunks import give_back
from lodestone.llm.common import drop_stored, small_batches, stored

#: Characters at which a piece of text ends; no phrase goes across one.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
#: A-Z lowered and every end of a piece as the same one, which is therefore never part of a word.
TABLE = bytes(0x2E if chr(b) in PIECE_ENDS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Bytes of text of a block, unless one text alone has more.
BLOCK = 1 << 21
#: Bits of the bitmap: at least, and at most (16 MB). Beyond, more rare extensions pass and are counted.
BITS = (1 << 16, 1 << 27)
#: Hashes or phrases of single blocks that a task holds before it adds up what is the same and hands it on.
HELD = 1_000_000
#: Blocks that are read from files and go to Python at a time. A block's packed lists take a megabyte or two.
BLOCKS_AT_ONCE = 1

LISTS = "lang string, lists binary"
#: What ``lists`` holds: phrases with their hashes, the lengths of their lists and the positions, and the same of the words behind them.
PACKED = pa.schema([("phrases", pa.list_(pa.string())), ("keys", pa.binary()), ("lens", pa.list_(pa.int32())), ("at", pa.binary()), ("next_words", pa.list_(pa.string())), ("next_lens", pa.list_(pa.int32())), ("next_at", pa.binary())])


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list[str]]]:
    """Texts of one language, about ``size`` bytes of them at a time; a task holds eight times that at most, or one text."""
    give_back()
    held: dict[str, list[str]] = {}
    room: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            room[lang] = room.get(lang, 0) + len(text)
            if room[lang] >= size:
                del room[lang]
                yield lang, held.pop(lang)
            elif len(held) > 8 and sum(room.values()) >= 8 * size:
                yield from held.items()
                held, room = {}, {}
    yield from held.items()


def coded(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, their codes in order with ends of pieces among them, and whether a code is a word."""
    data = ".".join(texts).encode().translate(TABLE).replace(b".", b" . ")
    flat = pc.ascii_split_whitespace(pa.array([data], pa.large_string())).flatten().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False)
    is_word = ~pc.is_in(flat.dictionary, pa.array(["", "."], pa.large_string())).to_numpy(zero_copy_only=False)
    blank = pc.index(flat.dictionary, pa.scalar("", pa.large_string())).as_py()
    return flat.dictionary, codes if blank < 0 else codes[codes != blank], is_word


def word_keys(lang: str, words: list[str]) -> np.ndarray:
    """Hash of each word in its language: what ``xxhash64(lang, word)`` gives in Spark."""
    seed = xxhash.xxh64_intdigest(lang, seed=42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed=seed) for w in words), np.uint64, len(words))


def mixed(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hash of a phrase that a word extends."""
    with np.errstate(over="ignore"):
        out = (keys * np.uint64(0x9E3779B97F4A7C15)) ^ (words + np.uint64(0xD6E8FEB86659FD93))
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))


def marked(keys: DataFrame) -> np.ndarray | None:
    """Bitmap of the hashes in column ``key``, sixteen bits for each as long as ``BITS`` allows; None if there are none."""
    n = keys.count()
    if not n:
        return None
    bits = min(BITS[1], max(BITS[0], 1 << (16 * n).bit_length()))
    slot = F.shiftrightunsigned("key", 20).bitwiseAND(F.lit(bits - 1))
    ones = keys.select(slot.alias("slot")).select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    rows = ones.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # bits / 64 rows at most
    table = np.zeros(bits // 64, np.int64)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return table.view(np.uint64)


def is_marked(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slots = (keys >> np.uint64(20)) & np.uint64(64 * len(marks) - 1)
    return ((marks[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1)).astype(bool)


class Lists:
    """Inverted lists of a block: occurrences in the order of their positions, and whose they are."""

    def __init__(self, lens: np.ndarray, at: bytes):
        own, places = np.repeat(np.arange(len(lens)), lens), np.frombuffer(at, np.int32)
        order = np.argsort(places, kind="stable")
        self.at, self.own = places[order], own[order]

    @staticmethod
    def vertical(own: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, bytes]:
        """Lengths of ``n`` lists and their positions, list by list, each in rising order."""
        order = np.argsort(own, kind="stable")
        return np.bincount(own, minlength=n), at[order].astype(np.int32).tobytes()

    def find(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rising positions: whether a list holds each, and whose it is."""
        place = np.minimum(np.searchsorted(self.at, at), len(self.at) - 1)
        return self.at[place] == at, self.own[place]


def extended(row: dict, size: int) -> tuple[np.ndarray, ...] | None:
    """Extensions of a block's phrases of ``size`` words by one: positions, whose, and for each distinct one its phrase, word and hash."""
    own = Lists(row["lens"], row["at"])
    after = own if size == 1 else Lists(row["next_lens"], row["next_at"])
    if not len(own.at) or not len(after.at):
        return None
    fits, word = after.find(own.at + size)
    if size > 1:  # the phrase without its first word has to be frequent too
        fits &= own.find(own.at + 1)[0]
    pairs, which = np.unique(own.own[fits] * (int(after.own.max()) + 1) + word[fits], return_inverse=True)
    phrase, word = np.divmod(pairs, int(after.own.max()) + 1)
    keys = np.frombuffer(row["keys"], np.uint64)
    word_hash = keys if size == 1 else word_keys(row["lang"], row["next_words"].to_pylist())
    return own.at[fits], which, phrase, word, mixed(keys[phrase], word_hash[word])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks with their lists unpacked, one at a time."""
    give_back()
    for batch in batches:
        for lang, packed in zip(batch.column(0), batch.column(1), strict=True):
            own = pa.ipc.open_stream(packed.as_buffer()).read_next_batch()
            row = {name: own.column(name)[0] for name in PACKED.names}
            words = {name: row[name].values for name in ("phrases", "next_words")}
            lens = {name: None if row[name].values is None else row[name].values.to_numpy() for name in ("lens", "next_lens")}
            yield {"lang": lang.as_py()} | words | lens | {name: row[name].as_py() for name in ("keys", "at", "next_at")}


def listed(lang: str, *lists: pa.Array | np.ndarray | bytes | None) -> pa.RecordBatch:
    """A block's row, with what ``PACKED`` names packed."""
    columns = []
    for kind, own in zip(PACKED.types, lists, strict=True):
        if own is None or isinstance(own, bytes):
            columns.append(pa.array([own], kind))
        else:
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own if isinstance(own, pa.Array) else pa.array(own, kind.value_type)))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, PACKED, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as out:
        out.write_batch(pa.RecordBatch.from_arrays(columns, schema=PACKED))
    return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["lang", "lists"])


@contextmanager
def set_to(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of reading and writing Parquet for what is planned and run here; the session's own come back."""
    names = {f"spark.sql.parquet.{name}": value for name, value in values.items()}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@contextmanager
def few_blocks(spark: SparkSession) -> Iterator[None]:
    """Blocks are read, handed to Python and written few at a time, and not packed again."""
    with small_batches(spark, BLOCKS_AT_ONCE), set_to(spark, **{"columnarReaderBatchSize": str(BLOCKS_AT_ONCE), "compression.codec": "uncompressed"}):
        yield


def word_counts(texts: DataFrame) -> DataFrame:
    """Occurrences of each word in each language, of columns ``lang`` and ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, own in blocks(batches, BLOCK):
            words, codes, is_word = coded(own)
            kept = np.flatnonzero(is_word)
            n = np.bincount(codes, minlength=len(words))[kept]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kept), pa.string()), words.take(pa.array(kept)).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])

    return texts.mapInArrow(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def word_lists(texts: DataFrame, marks: np.ndarray) -> DataFrame:
    """Blocks with the lists of marked words that stand beside another one."""
    frequent = texts.sparkSession.sparkContext.broadcast(marks)  # BITS at most

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, own in blocks(batches, BLOCK):
            words, codes, is_word = coded(own)
            keys = word_keys(lang, words.to_pylist())
            good = (is_word & is_marked(frequent.value, keys))[codes]
            beside = np.zeros(len(good), bool)
            beside[:-1] |= good[1:]
            beside[1:] |= good[:-1]
            at = np.flatnonzero(good & beside)
            if len(at):
                kept, which = np.unique(codes[at], return_inverse=True)
                lens, places = Lists.vertical(which, at, len(kept))
                yield listed(lang, words.take(pa.array(kept)).cast(pa.string()), keys[kept].tobytes(), lens, places, None, None, None)

    return texts.mapInArrow(index, LISTS)


def extension_counts(lists: DataFrame, size: int) -> DataFrame:
    """Occurrences under each hash of the extensions of phrases of ``size`` words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0

        def handed() -> pa.RecordBatch:
            keys, which = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(which, weights=np.concatenate([n for _, n in held]), minlength=len(keys))
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

        for row in rows_of(batches):
            found = extended(row, size)
            if found is None:
                continue
            held.append((found[4], np.bincount(found[1], minlength=len(found[4]))))
            total += len(found[4])
            if total >= HELD:
                yield handed()
                held, total = [], 0
        if held:
            yield handed()

    return lists.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def extended_lists(lists: DataFrame, size: int, marks: np.ndarray) -> DataFrame:
    """Blocks with the lists of marked phrases of ``size`` words and one more, and the postings of the words behind them."""
    frequent = lists.sparkSession.sparkContext.broadcast(marks)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            found = extended(row, size)
            if found is None:
                continue
            at, which, phrase, word, keys = found
            good = is_marked(frequent.value, keys)
            kept = np.flatnonzero(good)
            if not len(kept):
                continue
            place = np.cumsum(good) - 1
            at, which = at[good[which]], place[which[good[which]]]
            words = row["phrases"] if size == 1 else row["next_words"]
            after = Lists(row["lens"], row["at"]) if size == 1 else Lists(row["next_lens"], row["next_at"])
            stands, follower = after.find(at + size + 1)
            next_at, follower = (at + size + 1)[stands], follower[stands]
            used, follower = np.unique(follower, return_inverse=True)
            lens, places = Lists.vertical(which, at, len(kept))
            next_lens, next_places = Lists.vertical(follower, next_at, len(used))
            phrases = pc.binary_join_element_wise(row["phrases"].take(pa.array(phrase[kept])), words.take(pa.array(word[kept])), " ")
            yield listed(row["lang"], phrases, keys[kept].tobytes(), lens, places, words.take(pa.array(used)), next_lens, next_places)

    return lists.mapInArrow(extend, LISTS)


def frequencies(lists: DataFrame, least: int) -> DataFrame:
    """Exact frequency of each listed phrase: the lengths of its lists added up, first within each task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        total = 0

        def handed() -> Iterator[pa.RecordBatch]:
            own = pa.Table.from_batches(held).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
            yield from own.select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"]).to_batches(HELD // 20)

        for row in rows_of(batches):
            n = len(row["phrases"])
            held.append(pa.RecordBatch.from_arrays([pa.repeat(row["lang"], n), row["phrases"], pa.array(row["lens"], pa.int64())], names=["lang", "phrase", "n"]))
            total += n
            if total >= HELD:
                yield from handed()
                held, total = [], 0
        if held:
            yield from handed()

    return lists.mapInArrow(add, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)


def mine_phrases(docs: DataFrame, least: int = 100, longest: int = 5, absorbed: int = 100, top: int | None = 2_000, lang_col: str = "lang", text_col: str = "text", no_lang: str = "und") -> DataFrame:
    """Phrases of 2 to ``longest`` words that stand together more often than their parts suggest.

    Everything is counted per language. A phrase qualifies if it occurs ``least``
    times or more, overlaps included. Cut behind its first words, its parts occur
    ``l`` and ``r`` times; of all cuts the one with the lowest score
    ``floor(1000 * a * n / (l * r))`` counts, ``n`` being the words of the language,
    ties to the shorter first part. A phrase goes if it lies within a longer one
    that has ``absorbed`` percent of its occurrences or more.

    Returns ``lang``, ``rank`` (by score, then ``a``, both falling, then the phrase),
    ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``; the first ``top`` of each
    language, or all. A null language is ``no_lang``; null and blank texts have no
    words; repeated rows count each time; whole texts are read, and a text is held
    whole by the task that reads it. Other columns are ignored. Without a qualifying
    phrase there are no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(no_lang)).alias("lang"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    with small_batches(spark):
        words = stored(word_counts(texts), "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.filter(F.col("f") >= least)
    known = [frequent.withColumn("size", F.lit(1))]
    marks = marked(frequent.select(F.xxhash64("lang", "phrase").alias("key")))
    with small_batches(spark), set_to(spark, **{"compression.codec": "uncompressed"}):
        lists = stored(word_lists(texts, marks), "phrase-lists") if marks is not None else None
    for size in range(1, longest):
        if lists is None:
            break
        with few_blocks(spark):
            hashes = stored(extension_counts(lists, size).filter(F.col("n") >= least), "phrase-hashes")
        marks = marked(hashes)
        with few_blocks(spark):
            longer = stored(extended_lists(lists, size, marks), "phrase-lists") if marks is not None else None
            drop_stored(lists)
            lists = longer
            if lists is not None:
                known.append(stored(frequencies(lists, least), "phrase-counts").withColumn("size", F.lit(size + 1)))
    if lists is not None:
        drop_stored(lists)
    every = known[0]
    for more in known[1:]:
        every = every.unionByName(more)
    parts = every.select("lang", "phrase", "f")
    candidates = every.filter("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", F.split("phrase", " ").alias("w"))
    # a longer phrase with as many occurrences has one of one word more between
    within = candidates.filter("size > 2").select("lang", F.col("a").alias("more"), F.explode(F.array(F.expr("slice(w, 1, size - 1)"), F.expr("slice(w, 2, size - 1)"))).alias("part"))
    absorbing = within.groupBy("lang", F.array_join("part", " ").alias("phrase")).agg(F.max("more").alias("more"))
    left = candidates.join(absorbing, ["lang", "phrase"], "left").filter(F.col("more").isNull() | (100 * F.col("more") < absorbed * F.col("a")))
    cuts = left.withColumn("cut", F.explode(F.expr("sequence(1, size - 1)"))).withColumn("first", F.array_join(F.expr("slice(w, 1, cut)"), " ")).withColumn("rest", F.array_join(F.expr("slice(w, cut + 1, size)"), " "))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    exact = F.expr("(1000 * cast(a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    scored = cuts.join(totals, "lang").withColumn("score", exact.cast("long"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top:  # first within shares of a language, so that no task ranks all its phrases
        share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
        best = best.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return (ranked.filter(F.col("rank") <= top) if top else ranked).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
