"""N-gram Jaccard join with set-relation skipping.

A document's set is its distinct three-word shingles, ordered by how common they
are. Two sets that are similar enough share a shingle among the first few of each,
so index lists hold those alone; a set stands only in lists of sets about as large.

* A list of a few sets is compared pair by pair.
* In a longer list all sets are compared with one that leads it, and what they
  answer to the others is derived from that answer alone: sets differ from one
  another exactly where their differences to the leader differ. Sets whose
  differences are small together are linked with the leader, so nothing is left
  to ask; the others can only be linked if the rarest parts of their differences
  meet. Those parts are index lists again, a row for each place, dealt into
  blocks by position: two blocks that stand so late, or hold sets of such sizes
  and distances, that the difference would be too large are passed over whole.
* Pairs that are connected already are not compared.

A group of near copies so costs its size, not its square. A sketch of 64 bytes
bounds the difference of two sets from below, so that only sets that may link are
compared whole; so do parities of its elements within the join of followers. They decide cost alone, never a result.

Sets are compared as 64-bit hashes of their shingles. Equal sets are one class
from the start, so copies, however many, cost a row each.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.chunks import LOWER_BYTES, WordedBatch, in_steps, rolling
from lodestone.llm.common import drop_stored, fresh, small_batches, stored
from lodestone.llm.components import connected, merged

SHINGLE = 3
#: Counters of the sketch that orders shingles: from the first to the second number of them, by the bytes of the
#: texts; 2 to 16 MB. The order decides the cost, never the result.
COUNTERS, SLICES = (1 << 20, 1 << 23), 64
#: Bytes of text for each counter.
BYTES_A_COUNTER = 64
#: Bits of the table that tells which texts are to be read again; 4 MB, whatever the input. A clash costs time only.
MARKS = 1 << 25
#: Sets of a list up to which it is compared pair by pair: 15 pairs at most.
FEW = 6
#: Cells of a set's own sketch, a byte each.
CELLS = 64
#: Words of 64 bits of a set's parities, which the join of pairs tests.
PARITIES = 8
#: Texts that are cut into shingles at a time.
STEP = 250


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The set of each text: hashes of its distinct runs of ``k`` words, in order; of fewer words, of all as one."""
    own = WordedBatch(texts, LOWER_BYTES)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, own.words), np.uint64, len(own.words))[own.codes]
    runs = rolling(hashes, k)
    bounds = own.offsets.tolist()
    for start, end in zip(bounds[:-1], bounds[1:], strict=True):
        yield np.unique(runs[start : end - k + 1]) if end - start >= k else rolling(hashes[start:end], end - start) if end > start else runs[:0]


def required(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any set it links with."""
    return -(-n * percent // 100)


def counters(n_bytes: int) -> int:
    """Counters of the sketch for texts of so many bytes: a power of two."""
    return min(COUNTERS[1], max(COUNTERS[0], 1 << (n_bytes // BYTES_A_COUNTER).bit_length()))


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Count the documents of all shingles in a table of bounded size, in the tasks and then in two steps of sums."""
    cells = counters(docs.select(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0])
    width = cells // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.uint8)
        for batch in in_steps(batches, STEP):
            sets = list(shingle_sets(batch.column(0), k))
            if sets:
                at, n = np.unique((np.concatenate(sets) & np.uint64(cells - 1)).astype(np.int32), return_counts=True)
                # a task's count of a cell stops at 255: what is so common comes last anyhow
                counts[at] = np.minimum(counts[at] + n, 255)
        parts = [zlib.compress(p.tobytes(), 1) for p in counts.reshape(SLICES, width)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    def add(kind: str, own: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for part in own["counts"]:
            total += np.frombuffer(zlib.decompress(part), kind)
        return pd.DataFrame({"slice": own["slice"].iloc[:1], "counts": [zlib.compress(np.minimum(total, 0xFFFF).astype("<u2").tobytes(), 1)]})

    parts = docs.mapInArrow(count, "slice int, counts binary").withColumn("group", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = parts.groupBy("slice", "group").applyInPandas(lambda own: add("u1", own), "slice int, counts binary")
    rows = some.groupBy("slice").applyInPandas(lambda own: add("<u2", own), "slice int, counts binary").collect()  # SLICES rows, 16 MB at most
    table = np.zeros((SLICES, width), np.uint16)
    for row in rows:
        table[row["slice"]] = np.frombuffer(zlib.decompress(row["counts"]), "<u2")
    return table.ravel()


def _counts(table: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Counts of hashes."""
    return table[(own & np.uint64(len(table) - 1)).astype(np.int64)]


def _marks(nodes: DataFrame) -> np.ndarray:
    """Words of a bitmap with a bit set for the hash of each ``node``; ``MARKS`` bits, however many nodes."""
    bits = nodes.select(_slot("node").alias("slot")).select(F.shiftright("slot", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    rows = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # MARKS / 64 rows at most
    table = np.zeros(MARKS >> 6, np.int64)
    table[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return table


def _slot(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(MARKS).cast("long"))


def _sets_of(nodes: DataFrame, texts: DataFrame, repeated: bool, k: int) -> DataFrame:
    """The sets of the texts ``id``, ``text`` whose ids are among ``nodes``; the rest are passed over by their marks."""
    marks = texts.sparkSession.sparkContext.broadcast(_marks(nodes))  # of fixed size

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = marks.value
        for batch in in_steps(batches, STEP):
            slots = batch.column(2).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((table[slots >> 6] >> (slots & 63)) & 1 == 1))
            own = list(shingle_sets(batch.column(1), k))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in own])]), pa.int32())
            flat = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64()))], names=["node", "shingles"])

    schema = T.StructType([T.StructField("node", texts.schema["id"].dataType), T.StructField("shingles", T.ArrayType(T.LongType()))])
    sets = texts.filter("id is not null").select("id", "text", _slot("id").alias("slot")).mapInArrow(read, schema)
    return sets.distinct() if repeated else sets


def _sketched(own: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each cell, 255 at most."""
    return np.minimum(np.bincount((own >> np.uint64(58)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def _parities(own: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's hashes falls into each of ``64 * PARITIES`` bits: those of two sets differ in no more bits than the sets do in elements."""
    odd = np.bincount(((own >> np.uint64(32)) & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` that may link: the cells of two sketches differ by no more in all than the sets do."""
    of = lambda end, size, sketch: classes.select(F.col("node").alias(end), F.col("n").alias(size), F.col("sketch").alias(sketch))
    both = pairs.join(of("a", "n", "of_a"), "a").join(of("b", "m", "of_b"), "b").select("a", "b", (F.col("n") + F.col("m")).alias("sum"), "of_a", "of_b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int32) for i in (3, 4))
            sums = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            near = (100 + percent) * np.abs(one - two).sum(1) <= (100 - percent) * sums
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return both.mapInArrow(keep, T.StructType([pairs.schema["a"], pairs.schema["b"]]))


def _both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` with their sets and the sizes ``n`` and ``m`` of those."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    return both.withColumns({"n": F.size("of_a"), "m": F.size("of_b")})


def _links(compared: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs whose sets differ by ``far`` in all that are linked."""
    return compared.filter((100 + percent) * F.col("far") <= (100 - percent) * (F.col("n") + F.col("m"))).select("a", "b")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` with the sizes of their sets and of the difference of those."""
    return _both(pairs, sets).select("a", "b", "n", "m", (F.col("n") + F.col("m") - 2 * F.size(F.array_intersect("of_a", "of_b"))).alias("far"))


def _several(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows of those keys under which nodes of more than one ``component`` meet."""
    kept = rows.groupBy(*keys).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select(*keys)
    return rows.join(kept, list(keys), "left_semi")


def _pairs(rows: DataFrame, keys: list[str], percent: int, far: bool) -> DataFrame:
    """Distinct pairs ``a``, ``b`` of the ``node`` of rows that share the ``keys``, are of two ``component`` and may link by their sizes and positions.

    With ``far`` the rows are of differences to a leader, and ``far`` their sizes; they have the ``bits`` of the sets, by
    which the join leaves out pairs that differ too much, however many followers of a leader share a part.
    """
    own = ["node", "n", "pos", "component", *(["far", "bits"] if far else [])]
    two = rows.select(*keys, *(F.col(c).alias(f"other_{c}") for c in own))
    n, m, p, q = F.col("n"), F.col("other_n"), F.col("pos"), F.col("other_pos")
    room = (n + m) * (100 - percent)
    may = (F.col("component") < F.col("other_component")) & (n * 100 >= m * percent) & (m * 100 >= n * percent) & ((100 + percent) * (p + q) <= room)
    if far:
        lead = F.col("far") - F.col("other_far")
        may &= ((100 + percent) * (2 * p - lead) <= room) & ((100 + percent) * (2 * q + lead) <= room)
        apart = reduce(Column.__add__, (F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("other_bits")[i])) for i in range(PARITIES)))
        may &= (100 + percent) * apart <= room
    return rows.join(two, keys).filter(may).select(F.col("node").alias("a"), F.col("other_node").alias("b")).distinct()


def _differences(led: DataFrame, sets: DataFrame, common: Broadcast, percent: int) -> DataFrame:
    """Pairs of a set ``a`` and its leader ``b``, with ``n``, ``m``, ``far`` and the first elements of their difference.

    Elements stand in an order that all followers of a leader share: by how many
    of them have it in their difference, as the sketch tells. What the leader
    lacks is so counted itself; what it has, by those that lack it.
    """
    followers = led.groupBy("b").agg(F.count("*").alias("followers"))
    both = _both(led.join(followers, "b"), sets).select("a", "b", "n", "m", F.col("followers"), F.array_except("of_a", "of_b").alias("added"), F.array_except("of_b", "of_a").alias("removed"))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common.value
        for batch in in_steps(batches, STEP):
            far, firsts = [], []
            for n, followers, added, removed in zip(*(batch.column(i) for i in (2, 4, 5, 6)), strict=True):
                ours, theirs = (x.values.to_numpy().view(np.uint64) for x in (added, removed))
                more, fewer = _counts(table, ours).astype(np.int64), _counts(table, theirs).astype(np.int64)
                usual = max(followers.as_py(), int(np.median(fewer)) if len(fewer) else 0)
                elements = np.concatenate([ours, theirs])
                place = np.lexsort((elements, np.concatenate([more, np.maximum(usual - fewer, 0)])))
                most = n.as_py() * (100 - percent) // percent + 1  # no link bears more: n + m is at most n + n * 100 / percent
                far.append(len(elements))
                firsts.append(elements[place[:most]].view(np.int64))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in firsts])]), pa.int32())
            flat = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(far, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64()))], names=["a", "b", "n", "m", "far", "first"])

    schema = T.StructType([*(both.schema[c] for c in ("a", "b", "n", "m")), T.StructField("far", T.IntegerType()), T.StructField("first", T.ArrayType(T.LongType()))])
    return both.mapInArrow(order, schema)


def _unconnected(differences: DataFrame, groups: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` of followers of a leader that are not connected and that may link by their differences to it."""
    placed = differences.select(F.col("a").alias("node"), F.col("b").alias("leader"), "n", "far", "first").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lists = _several(placed, "leader").select("node", "leader", "n", "far", "component", F.posexplode("first").alias("pos", "element"))
    lists = stored(_several(lists, "leader", "element"), "shingle-differences")
    spread = [f(c).alias(f"{low}_{c}") for c in ("n", "far", "component") for low, f in (("lo", F.min), ("hi", F.max))]
    blocks = lists.groupBy("leader", "element", "pos").agg(*spread)
    other = blocks.select("leader", "element", *(F.col(c).alias(f"other_{c}") for c in blocks.columns[2:]))
    room = (F.col("hi_n") + F.col("other_hi_n")) * (100 - percent)
    reach = (100 + percent) * (F.col("pos") + F.col("other_pos")) <= room
    for one, two in (("", "other_"), ("other_", "")):
        reach &= ((100 + percent) * (F.col(f"{one}lo_far") - F.col(f"{two}hi_far")) <= room) & (F.col(f"{one}hi_n") * 100 >= F.col(f"{two}lo_n") * percent)
    apart = ~((F.col("lo_component") == F.col("hi_component")) & (F.col("other_lo_component") == F.col("other_hi_component")) & (F.col("lo_component") == F.col("other_lo_component")))
    met = stored(blocks.join(other, ["leader", "element"]).filter(reach & apart).select("leader", "element", "pos", "other_pos"), "shingle-blocks")
    # the rows of the blocks that reach another
    rows = lists.join(met.select("leader", "element", "pos").distinct(), ["leader", "element", "pos"], "left_semi")
    return _pairs(rows.join(classes.select("node", "bits"), "node"), ["leader", "element"], percent, True)


def _joined(docs: DataFrame, percent: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """For each row of ``docs``: ``id``, ``text_hash``, ``n``, ``component`` and ``copies``."""
    with small_batches(docs.sparkSession):
        return _join(docs, percent, k, id_col, text_col)


def _join(docs: DataFrame, percent: int, k: int, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(_sketch(texts.filter("id is not null").select("text"), k))  # of bounded size

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common.value
        for batch in in_steps(batches, STEP):
            sizes, digests, sketches, bits, prefixes, lengths, odd = [], [], [], [], [], [], []
            for own in shingle_sets(batch.column(1), k):
                n = len(own)
                counts = _counts(table, own)
                first = n - required(n, percent) + 1 if n else 0
                sizes.append(n)
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if n else None)
                sketches.append(_sketched(own))
                bits.append(_parities(own))
                odd.append(2 * int((counts <= 1).sum()) - n)
                prefixes.append(own[np.argsort(counts, kind="stable")[:first]].view(np.int64))
                lengths.append(first)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(odd, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64()))], names=["id", "text_hash", "n", "digest", "sketch", "bits", "odd", "prefix"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("text_hash", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("digest", T.BinaryType()), T.StructField("sketch", T.BinaryType()), T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("odd", T.IntegerType()), T.StructField("prefix", T.ArrayType(T.LongType()))])
    rows = stored(texts.select("id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(read, schema), "shingle-rows")
    repeated = not rows.filter("id is not null").groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").isEmpty()
    # one set of each class of equal sets, under the smallest id that has it
    classes = stored(rows.filter("id is not null and n > 0").groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n", "sketch", "bits", "odd", "prefix"))), "shingle-classes")

    # sizes that can link lie in one step of a geometric scale or in two neighbours: each list is cut into such doubles
    step = F.floor(F.log("n") / float(np.log(100 / percent) * (1 + 1e-6))) if percent < 100 else F.col("n")
    lists = classes.select("node", "n", "odd", step.cast("int").alias("step"), F.posexplode("prefix").alias("pos", "shingle"))
    held = lists.groupBy("shingle").agg(F.count("*").alias("sets")).filter("sets > 1").select("shingle")  # most shingles aren't
    lists = stored(lists.join(held, "shingle"), "shingle-entries").withColumn("size", F.explode(F.array(F.col("step"), F.col("step") - 1)))
    shared = lists.groupBy("shingle", "size").agg(F.count("*").alias("sets"), F.min(F.struct("odd", "node")).alias("l"), F.min("step").alias("lo"), F.max("step").alias("hi"))
    # a list of one step alone is met as the lower half of a double; the upper half of another holds no more pairs
    shared = shared.filter("sets > 1 and (lo < hi or lo = size)").select("shingle", "size", "sets", F.col("l.node").alias("leader"))
    lists = stored(lists.join(shared, ["shingle", "size"]).select("shingle", "size", "sets", "node", "n", "pos", "leader"), "shingle-lists")

    led = stored(lists.filter((F.col("sets") > FEW) & (F.col("node") != F.col("leader"))).select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "shingle-leaders")
    # only the sets that are to be compared are read from the texts again
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node"))
    sets = stored(_sets_of(ends(led), texts, repeated, k), "shingle-sets")
    differences = stored(_differences(led, sets, common, percent), "shingle-compared")
    links = stored(_links(differences, percent).distinct(), "shingle-links")
    groups = stored(connected(links), "shingle-groups")
    # a short list matters where the long ones have left sets of it unconnected
    short = lists.filter(F.col("sets") <= FEW).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    few = stored(_near(_pairs(_several(short, "shingle", "size"), ["shingle", "size"], percent, False), classes, percent), "shingle-few")
    few_sets = stored(_sets_of(ends(few), texts, repeated, k), "shingle-sets")
    more = stored(merged(groups, _links(_compared(few, few_sets), percent)), "shingle-groups")
    pairs = stored(_near(_unconnected(differences, more, classes, percent), classes, percent), "shingle-pairs")
    components = stored(merged(more, _links(_compared(pairs, sets), percent)), "shingle-groups")
    drop_stored(lists, led, sets, differences, links, groups, few, few_sets, more, pairs)

    named = classes.select("digest", "node", "copies").join(components, "node", "left").select("digest", "copies", F.coalesce("component", "node").alias("component"))
    joined = rows.select("id", "text_hash", "n", "digest").join(named, "digest", "left")
    alone = F.col("id").isNotNull()
    return joined.select("id", "text_hash", "n", F.when(alone, F.coalesce("component", "id")).alias("component"), F.when(alone & (F.col("n") > 0), F.col("copies")).otherwise(1).cast("long").alias("copies"))


def jaccard_join(docs: DataFrame, percent: int = 90, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Words are what white space parts once A-Z are lowered. Returns a row for each
    row of ``docs``: its id, ``n_shingles`` (the size of its set), ``component_id``
    (the smallest id that links reach, its own included) and ``n_copies`` (rows
    with an equal set, itself included). A null or empty text has an empty set and
    links with nothing. Rows with a null id take no part in links and have a null
    component. Rows that repeat an id are joined each by its own text. Whole texts
    are compared, however long; other columns are ignored; an empty table gives none.
    """
    joined = _joined(docs, percent, k, id_col, text_col)
    return joined.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"), F.col("copies").alias("n_copies"))


def one_of_each(docs: DataFrame, percent: int = 90, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, less those linked with a row of a smaller id.

    Of rows that repeat an id and a text one stays. Rows with a null id stay. Columns may
    have any names.
    """
    own = fresh(docs, "own_id"), fresh(docs, "own_hash")
    joined = stored(_joined(docs, percent, k, id_col, text_col).filter("id is not null").select(F.col("id").alias(own[0]), F.col("text_hash").alias(own[1]), F.col("component").alias("component")), "shingle-components")
    keyed = docs.withColumns({own[0]: F.col(id_col), own[1]: F.xxhash64(text_col)})
    kept = keyed.join(joined.filter(F.col(own[0]) != F.col("component")).select(*own), [*own], "left_anti")
    repeated = joined.groupBy(*own).agg(F.count("*").alias("rows")).filter("rows > 1").select(*own)
    if repeated.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(repeated, [*own], "left_semi").dropDuplicates([*own])
    return kept.join(repeated, [*own], "left_anti").unionByName(once).select(docs.columns)
