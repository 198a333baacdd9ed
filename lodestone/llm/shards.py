"""Token-id shards in a binary format, with a minimal perfect hash index.

A shard is one binary value: a header, the documents' lengths and keys, and last
the raw ids, little-endian, two bytes wide where the vocabulary allows and four
bytes otherwise. Shards lie in ascending order of the document id, written as they
are through Spark's Parquet writer, so that a task that is run again replaces what
it wrote and any file system Spark knows can hold them.

The index maps a document's key to its shard and offset in constant time: a key
belongs to one bucket of about ``BUCKET_KEYS`` keys by its hash; the bucket's
minimal perfect hash gives the key's slot, and the slot's stored fingerprint
rejects keys that aren't there. A document's ids are then a slice of its shard's
bytes: no shard is decoded to read them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.chunks import ChunkedBatch, IdCache
from lodestone.llm.common import stored

VOCABULARY = "byte_bpe_50k.json"
MAGIC, HEADER = b"TOKSHRD1", struct.Struct("<8sBIQ")
#: Ids of a shard, about; a document is never split.
SHARD_IDS = 262_144
#: Keys of an index bucket, about; one bucket is built in one task.
BUCKET_KEYS = 8_192
SHARD_SCHEMA = "part int, seq int, n_docs long, n_ids long, payload binary"


@lru_cache(maxsize=2)
def _tokenizer(path: str | None):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))


class LibraryEncoder:
    """The tokenizers library over distinct chunks."""

    def __init__(self, path: str | None = None):
        self.tokenizer = _tokenizer(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        # a character of a byte-level entry is a byte
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))

    def chunks(self, chunks: list[str], step: int = 2_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, joined, and their numbers; in steps, so that few objects live at a time."""
        flat, lengths = [], []
        for at in range(0, len(chunks), step):
            own = chunks[at : at + step]
            found = self._together(own)
            if found is None:
                ids = [e.ids for e in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
                found = np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))
            flat.append(found[0])
            lengths.append(found[1])
        return (np.concatenate(flat), np.concatenate(lengths)) if flat else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The same for one text made of all chunks; None where that text isn't cut before every chunk.

        A chunk that starts with a space before other characters, after one that
        ends in no white space, is cut off by the pre-tokenizer as in any text. The
        bytes of the ids then tell which ids are whose.
        """
        if any(len(c) < 2 or c[0] != " " or c[1].isspace() or c[-1].isspace() for c in chunks):
            return None
        ids = np.asarray(self.tokenizer.encode_batch_fast(["".join(chunks)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum(np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks)))
        reached = np.cumsum(self.sizes[ids])
        last = np.searchsorted(reached, ends)
        if last[-1] != len(ids) - 1 or not np.array_equal(reached[last], ends):
            return None
        return ids, np.diff(last, prepend=-1)


@lru_cache(maxsize=2)
def _encoder(path: str | None) -> tuple[LibraryEncoder, IdCache]:
    """The encoder and what it has met; kept by a Python worker from task to task."""
    encoder = LibraryEncoder(path)
    return encoder, IdCache(encoder.chunks, 900_000)


def pack(lengths: np.ndarray, keys: list[bytes | None], ids: np.ndarray, width: int) -> bytes:
    """The bytes of a shard."""
    sizes = np.fromiter((-1 if k is None else len(k) for k in keys), np.int32, len(keys))
    return b"".join([HEADER.pack(MAGIC, width, len(keys), len(ids)), lengths.astype("<i8").tobytes(), sizes.astype("<i4").tobytes(), b"".join(k or b"" for k in keys), ids.astype(f"<u{width}").tobytes()])


def unpack(payload: bytes) -> tuple[np.ndarray, list[bytes | None], np.ndarray]:
    """Lengths, keys and ids of a shard."""
    magic, width, n, total = HEADER.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = HEADER.size
    lengths = np.frombuffer(payload, "<i8", n, at)
    sizes = np.frombuffer(payload, "<i4", n, at + 8 * n)
    at += 12 * n
    keys: list[bytes | None] = []
    for size in sizes.tolist():
        keys.append(None if size < 0 else payload[at : at + size])
        at += max(size, 0)
    return lengths, keys, np.frombuffer(payload, f"<u{width}", total, at)


def write_shards(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode every text, append ``end_id``, and write shards in ascending order of the id.

    A null text has the end id only; null ids come first. Rows that repeat an id
    are all written, in the order of a hash of their texts. The order comes from a
    range partitioning on both, so no id, however often repeated, fills one task.
    """
    tie = F.xxhash64(text_col)
    ordered = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"), F.col(id_col).alias("order_id"), tie.alias("tie")).repartitionByRange("order_id", "tie").sortWithinPartitions("order_id", "tie").select("key", "text", F.spark_partition_id().alias("part"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, cache = _encoder(tokenizer)
        lengths, keys, ids, size, seq, part = [], [], [], 0, 0, 0

        def shard() -> pa.RecordBatch:
            payload = pack(np.concatenate(lengths), keys, np.concatenate(ids), encoder.width)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())], names=["part", "seq", "n_docs", "n_ids", "payload"])

        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                batch = whole.slice(at, 2_000)
                chunked = ChunkedBatch(batch.column(1))
                chosen = cache.slots(chunked.keys)[chunked.codes]
                counts = chunked.per_text(cache.lengths[chosen])
                flat = cache.gather(chosen)
                ends = np.cumsum(counts)
                part = batch.column(2)[0].as_py()
                lengths.append(counts + 1)
                keys += [None if k is None else k.encode() for k in batch.column(0).to_pylist()]
                ids.append(np.insert(flat, ends, end_id))
                size += len(flat) + len(counts)
                if size >= shard_ids:
                    yield shard()
                    lengths, keys, ids, size, seq = [], [], [], 0, seq + 1
        if keys:
            yield shard()

    ordered.mapInArrow(encode, SHARD_SCHEMA).write.option("compression", "uncompressed").option("parquet.block.size", 8 << 20).partitionBy("part").parquet(out)


def directory(spark: SparkSession, out: str) -> DataFrame:
    """A row for each document, read from the shards: key, shard, offset, length and checksum."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, keys, ids = unpack(batch.column(2)[i].as_py())
                offsets = np.cumsum(lengths) - lengths
                raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
                sums = [zlib.crc32(raw[4 * o : 4 * (o + n)]) for o, n in zip(offsets.tolist(), lengths.tolist(), strict=True)]
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array([None if k is None else k.decode() for k in keys], pa.string()), pa.array(np.full(n, batch.column(0)[i].as_py()), pa.int32()), pa.array(np.full(n, batch.column(1)[i].as_py()), pa.int32()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], names=["key", "part", "seq", "offset", "n_tokens", "ids_crc32"])

    shards = spark.read.schema(SHARD_SCHEMA).parquet(out).select("part", "seq", "payload")
    return shards.mapInArrow(read, "key string, part int, seq int, offset long, n_tokens long, ids_crc32 long")


def shard_starts(spark: SparkSession, out: str) -> DataFrame:
    """For each shard the number of ids in all shards before it; no payloads are read.

    Shards are summed within their part and parts among each other: a row for each
    part, as many as the range partitioning had, is all that meets in one place.
    """
    sizes = spark.read.schema(SHARD_SCHEMA).parquet(out).select("part", "seq", "n_ids")
    ahead = lambda window: F.coalesce(F.sum("n_ids").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", ahead(Window.orderBy("part")).alias("before"))
    return sizes.withColumn("within", ahead(Window.partitionBy("part").orderBy("seq"))).join(F.broadcast(parts), "part").select("part", "seq", (F.col("before") + F.col("within")).alias("base"))


def _mix(keys: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """A seeded 64-bit mixing of hashes."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + (np.asarray(seed).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit hashes: hash, displace, and fill.

    Groups of about four keys each get a seed that sends their keys to free slots,
    the largest groups first; all of one size try the same seeds at once. Groups of
    one key get a free slot itself, stored as its complement.
    """

    def __init__(self, seeds: np.ndarray, size: int):
        self.seeds, self.size = seeds, size

    @staticmethod
    def build(hashes: np.ndarray) -> PerfectHash:
        n = len(hashes)
        groups = max(1, (n + 3) // 4)
        group = (_mix(hashes, 0) % np.uint64(groups)).astype(np.int64)
        counts = np.bincount(group, minlength=groups)
        order = np.argsort(group, kind="stable")
        seeds, taken = np.zeros(groups, np.int32), np.zeros(n, bool)
        for size in range(int(counts.max(initial=0)), 1, -1):
            own = np.flatnonzero(counts == size)
            keys = hashes[order[np.isin(group[order], own)]].reshape(-1, size)
            seed = 1
            while len(own):
                many = max(1, min(64, 4_096 // keys.size))  # seeds to try at once
                slots = np.sort((_mix(keys[None], np.arange(seed, seed + many)[:, None, None]) % np.uint64(n)).astype(np.int64), axis=2)
                good = ~taken[slots].any(2) & (slots[:, :, 1:] != slots[:, :, :-1]).all(2)
                first = good.argmax(0)
                able = np.flatnonzero(good.any(0))
                wanted = slots[first[able], able]
                # of the groups that want a slot the first has it; a group has all its slots or none
                _, winners = np.unique(wanted, return_index=True)
                won = np.zeros(wanted.size, bool)
                won[winners] = True
                done = able[won.reshape(-1, size).all(1)]
                seeds[own[done]] = seed + first[done]
                taken[slots[first[done], done].ravel()] = True
                left = np.setdiff1d(np.arange(len(own)), done, assume_unique=True)
                keys, own, seed = keys[left], own[left], seed + many
        singles = np.flatnonzero(counts == 1)
        seeds[singles] = ~np.flatnonzero(~taken)[: len(singles)]
        return PerfectHash(seeds, n)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each key of the set; of other keys some slot."""
        seed = self.seeds[(_mix(hashes, 0) % np.uint64(len(self.seeds))).astype(np.int64)]
        return np.where(seed < 0, ~seed.astype(np.int64), (_mix(hashes, np.maximum(seed, 0)) % np.uint64(max(1, self.size))).astype(np.int64)) % max(1, self.size)


#: Folders into which an index is dealt, and parts or folders up to which a look-up names those that it opens.
SLICES, NAMED = 256, 1_000
INDEX_SCHEMA = "bucket int, seeds binary, prints binary, parts binary, seqs binary, offsets binary, lengths binary, clashes array<struct<key:string,part:int,seq:int,offset:long,n_tokens:long>>"


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (_mix(hashes, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def key_hash() -> Column:
    return F.xxhash64("key")


def write_index(entries: DataFrame, out: str, n_rows: int, bucket_keys: int = BUCKET_KEYS) -> int:
    """Write the index of a directory of ``n_rows`` rows; returns its number of buckets.

    The first row of a repeated key is indexed. Null keys aren't. Keys whose
    64-bit hashes are equal are kept in their bucket in full.
    """
    firsts = entries.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct("part", "seq", "offset", "n_tokens")).alias("at")).select("key", "at.*")
    buckets = max(1, -(-n_rows // bucket_keys))

    def build_bucket(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        twice = own["h"].duplicated(keep=False)
        clashes = own.loc[twice, ["key", "part", "seq", "offset", "n_tokens"]].to_dict("records")
        own = own[~twice]
        hashes = own["h"].to_numpy().astype(np.uint64)
        mph = PerfectHash.build(hashes)
        order = np.argsort(mph.slots(hashes))
        column = lambda name, kind: own[name].to_numpy()[order].astype(kind).tobytes()
        return pd.DataFrame([{"bucket": key[0], "seeds": mph.seeds.tobytes(), "prints": fingerprints(hashes)[order].tobytes(), "parts": column("part", np.int32), "seqs": column("seq", np.int32), "offsets": column("offset", np.int64), "lengths": column("n_tokens", np.int64), "clashes": clashes}])

    firsts.withColumn("h", key_hash()).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int")).groupBy("bucket").applyInPandas(build_bucket, INDEX_SCHEMA).withColumn("slice", F.pmod("bucket", F.lit(SLICES)).cast("int")).write.partitionBy("slice").parquet(out)
    return buckets


def opened(table: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows of the folders of ``table``, by its partition column, that ``wanted`` names; all if those are more than ``NAMED``."""
    named = [r[0] for r in wanted.select(column).distinct().limit(NAMED + 1).collect()]
    return table.filter(F.col(column).isin(named) if named else F.lit(False)) if len(named) <= NAMED else table


def look_up(keys: DataFrame, index: str, buckets: int, few: bool = False) -> DataFrame:
    """Shard, offset and length of each distinct key of ``keys`` that the index holds; of ``few`` keys only the folders they need are opened."""
    spark = keys.sparkSession
    asked = keys.select("key").filter(F.col("key").isNotNull()).distinct().withColumn("h", key_hash()).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))

    def find(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for row in rows.itertuples():
            clashes = {c["key"]: c for c in row.clashes} if row.clashes is not None else {}
            if clashes:
                found.append(pd.DataFrame([clashes[k] for k in asked["key"] if k in clashes], columns=["key", "part", "seq", "offset", "n_tokens"]))
            prints = np.frombuffer(row.prints, np.uint32)
            if len(prints):
                hashes = asked["h"].to_numpy().astype(np.uint64)
                slots = PerfectHash(np.frombuffer(row.seeds, np.int32), len(prints)).slots(hashes)
                ok = (prints[slots] == fingerprints(hashes)) & ~asked["key"].isin(list(clashes)).to_numpy()
                at = slots[ok]
                found.append(pd.DataFrame({"key": asked["key"][ok].to_numpy(), "part": np.frombuffer(row.parts, np.int32)[at], "seq": np.frombuffer(row.seqs, np.int32)[at], "offset": np.frombuffer(row.offsets, np.int64)[at], "n_tokens": np.frombuffer(row.lengths, np.int64)[at]}))
        return pd.concat(found) if found else pd.DataFrame({"key": [], "part": [], "seq": [], "offset": [], "n_tokens": []})

    table = opened(spark.read.schema(f"{INDEX_SCHEMA}, slice int").parquet(index), "slice", asked.withColumn("slice", F.pmod("bucket", F.lit(SLICES)).cast("int"))).drop("slice") if few else spark.read.schema(INDEX_SCHEMA).parquet(index)
    return asked.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInPandas(find, "key string, part int, seq int, offset long, n_tokens long")


def read_ids(keys: DataFrame, shards: str, index: str, buckets: int) -> DataFrame:
    """The ids of each distinct ``key`` that the index holds, with its end id: ``key``, ``n_tokens``, ``ids``.

    The index gives the shard and the offset; the ids are cut from the shard's
    bytes there. Absent and null keys have no row; of a repeated key the first
    document is read. Only the folders of the index that the keys' buckets name, and
    only the folders of the parts that the index leads to, are opened, unless those
    are more than a thousand.
    """
    places = stored(look_up(keys, index, buckets, few=True), "token-places")
    payloads = opened(keys.sparkSession.read.schema(SHARD_SCHEMA).parquet(shards), "part", places)
    width = F.conv(F.hex(F.substring("payload", len(MAGIC) + 1, 1)), 16, 10).cast("int")
    behind = F.col("n_ids") - F.col("offset")  # ids from the document's first to the shard's last
    raw = F.expr("substring(payload, cast(length(payload) - width * behind + 1 as int), cast(width * n_tokens as int))")
    cut = payloads.join(places, ["part", "seq"]).select("key", "n_tokens", "payload", width.alias("width"), behind.alias("behind")).select("key", "n_tokens", "width", raw.alias("raw"))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(r.as_py(), f"<u{w.as_py()}").astype(np.int64) for w, r in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64()))], names=["key", "n_tokens", "ids"])

    return cut.mapInArrow(unpacked, "key string, n_tokens long, ids array<long>")


def shard_table(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Write the shards and their index below ``out``, and read every document back.

    Returns a row for each row of ``docs``, from the files: the id, ``start`` (ids
    of all documents before it), ``n_tokens`` with the end id, ``ids_crc32`` (of
    the ids as little-endian unsigned 32-bit integers) and ``indexed``, whether
    the index leads from the document's key to this very place: true but for null
    ids and later rows of a repeated id. A null text has the end id only; a long
    text is one document of one shard; other columns are ignored; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    write_shards(docs, f"{out}/shards", tokenizer, end_id, id_col, text_col, shard_ids)
    entries = directory(spark, f"{out}/shards")
    entries.write.parquet(f"{out}/directory")
    entries = spark.read.schema(entries.schema).parquet(f"{out}/directory")
    n_rows = spark.read.schema(SHARD_SCHEMA).parquet(f"{out}/shards").agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    buckets = write_index(entries, f"{out}/index", n_rows, bucket_keys)
    places = look_up(entries, f"{out}/index", buckets).withColumn("indexed", F.lit(True))
    kind = docs.schema[id_col].dataType
    return entries.join(shard_starts(spark, f"{out}/shards"), ["part", "seq"]).join(places, ["key", "part", "seq", "offset", "n_tokens"], "left").select(F.col("key").cast(kind).alias(id_col), (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", F.coalesce("indexed", F.lit(False)).alias("indexed"))
