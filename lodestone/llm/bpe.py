"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Every merge rank has a bucket of positions in a linked list of symbols. A bitmap
with summary levels tells which buckets hold entries; find-first-set picks the
next rank. An entry whose pair has changed since it was queued is stale and is
skipped when its bucket is drained. One queue serves all distinct pre-tokens of a
batch together: their lists never touch, so draining a bucket for all of them is
the same as draining it for each, and a single pre-token of a million bytes costs
no more a byte than short ones.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.chunks import ChunkedBatch, IdCache, in_steps

NONE = np.iinfo(np.int32).max
RANKS_FILE = "byte_bpe_multi_50k.tiktoken"


class RankBitmap:
    """A set of ranks with find-first-set, in levels of 64-bit words."""

    def __init__(self, size: int):
        self.levels: list[list[int]] = []
        while True:
            size = (size + 63) // 64
            self.levels.append([0] * size)
            if size == 1:
                break

    def add(self, rank: int) -> None:
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            if level[word] & bit:
                return
            level[word] |= bit
            rank = word

    def discard(self, rank: int) -> None:
        for level in self.levels:
            word = rank >> 6
            level[word] &= ~(1 << (rank & 63))
            if level[word]:
                return
            rank = word

    def first(self) -> int:
        """The lowest rank in the set, or -1."""
        word = 0
        for level in reversed(self.levels):
            bits = level[word]
            if not bits:
                return -1
            word = (word << 6) | ((bits & -bits).bit_length() - 1)
        return word


class RankQueueBPE:
    """Encoder and decoder for a vocabulary of byte strings ranked by merge order."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs: dict[int, int] = {}
        early = np.zeros(len(self.tokens), bool)
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is None or right is None:
                    continue
                pairs[left << 20 | right] = rank
                # a merge that makes `left` (or `right`) can be followed by one of a lower rank
                early[left] |= rank < left
                early[right] |= rank < right
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.early = early
        size = 1 << max(4, int(len(pairs) * 4 - 1).bit_length())
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self._hash_table(size)

    def _hash_table(self, size: int) -> None:
        """Open addressing: a pair's rank in a few vector operations."""
        self.table_keys = np.full(size + 64, -1, np.int64)
        self.table_ranks = np.full(size + 64, NONE, np.int32)
        slots, left, probes = self._slots(self.pair_keys), np.arange(len(self.pair_keys)), 0
        while len(left):
            at = slots[left] + probes
            free = self.table_keys[at] == -1
            chosen, first = np.unique(at[free], return_index=True)
            put = left[free][first]
            self.table_keys[chosen], self.table_ranks[chosen] = self.pair_keys[put], self.pair_ranks[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            probes += 1
        self.probes = probes

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, NONE where it makes none."""
        keys = left.astype(np.int64) << 20 | right
        slots = self._slots(keys)
        found = self.table_keys[slots]
        out = np.where(found == keys, self.table_ranks[slots], NONE).astype(np.int32)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            at = slots[open_] + probe
            found = self.table_keys[at]
            hit = found == keys[open_]
            out[open_[hit]] = self.table_ranks[at[hit]]
            open_ = open_[~hit & (found != -1)]
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens, joined, and the number of ids of each."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(pieces), np.int64)
        tok = self.of_byte[data]
        nxt = np.arange(1, n + 1, dtype=np.int32)
        prv = np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(sizes)
        lasts = ends[sizes > 0] - 1
        nxt[lasts] = -1
        prv[(lasts + 1)[:-1]] = -1
        alive = np.ones(n, bool)
        pair = np.full(n, NONE, np.int32)
        inner = np.flatnonzero(nxt >= 0)
        pair[inner] = self.rank_of(tok[inner], tok[nxt[inner]])

        buckets: dict[int, list[np.ndarray]] = {}
        queue = RankBitmap(len(self.tokens))

        def push(at: np.ndarray) -> None:
            ranks = pair[at]
            at, ranks = at[ranks != NONE], ranks[ranks != NONE]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, own in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts) if len(cuts) else [at], strict=True):
                if rank in buckets:
                    buckets[rank].append(own)
                else:
                    buckets[rank] = [own]
                    queue.add(rank)

        push(inner)
        while (rank := queue.first()) >= 0:
            queue.discard(rank)
            entries = buckets.pop(rank)
            at = entries[0] if len(entries) == 1 else np.concatenate(entries)
            at = at[pair[at] == rank]  # the others are stale
            if not len(at):
                continue
            if len(entries) > 1:
                at = np.unique(at)
            if self.early[rank] and len(at) > 1:
                # a lower rank may come up within the pre-token: merge its leftmost pair only
                piece = np.searchsorted(ends, at, side="right")
                lead = np.concatenate([[True], piece[1:] != piece[:-1]])
                if not lead.all():
                    buckets[rank] = [at[~lead]]
                    queue.add(rank)
                    at = at[lead]
            right = nxt[at]
            if len(at) > 1:
                chained = right[:-1] == at[1:]
                if chained.any():  # pairs that overlap, as in aaa: every other one from the left
                    index = np.arange(len(at))
                    start = np.maximum.accumulate(np.where(np.concatenate([[True], ~chained]), index, 0))
                    keep = (index - start) % 2 == 0
                    at, right = at[keep], right[keep]
            after = nxt[right]
            tok[at] = rank
            alive[right] = False
            pair[right] = NONE
            nxt[at] = after
            has = after >= 0
            prv[after[has]] = at[has]
            before = prv[at]
            pair[at[~has]] = NONE
            changed = np.concatenate([at[has], before[before >= 0]])
            if len(changed):
                if len(changed) > 1:
                    changed = np.unique(changed)
                pair[changed] = self.rank_of(tok[changed], tok[nxt[changed]])
                push(changed)
        totals = np.concatenate([[0], np.cumsum(alive)])
        return tok[alive].astype(np.uint32), totals[ends] - totals[ends - sizes]

    def decode(self, ids: Iterable[int]) -> bytes:
        """Bytes that the ids stand for."""
        return b"".join(map(self.tokens.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=2)
def load(path: str | None) -> tuple[RankQueueBPE, regex.Pattern]:
    """Encoder and pre-token pattern; once in each Python worker."""
    import public_tokenizers

    return RankQueueBPE(read_ranks(path or public_tokenizers.path(RANKS_FILE))), regex.compile(public_tokenizers.PATTERN)


class TextEncoder:
    """Encodes texts: each match of the pre-token pattern apart."""

    def __init__(self, path: str | None = None):
        self.bpe, self.pattern = load(path)

    def chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks of text, joined, and the number of ids of each."""
        find = self.pattern.findall
        place: dict[str, int] = {}
        codes: list[int] = []
        counts = np.zeros(len(chunks), np.int64)
        for i, chunk in enumerate(chunks):
            found = find(chunk)
            counts[i] = len(found)
            codes += [place.setdefault(p, len(place)) for p in found]
        flat, lengths = self.bpe.encode([p.encode("utf-8", "surrogatepass") for p in place])
        slots = np.asarray(codes, np.int64)
        starts = np.cumsum(lengths) - lengths
        own = lengths[slots]
        ends = np.cumsum(own)
        ids = flat[np.repeat(starts[slots] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)]
        totals = np.concatenate([[0], ends])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return ids, totals[bounds[1:]] - totals[bounds[:-1]]

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        return self.chunks([text])[0].tolist()


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every text by the ranks in ``path`` and decode the ids again.

    Returns a row for each row of ``docs``: its id, ``n_tokens``, ``ids_sha256``
    (of the decimal ids joined by commas), ``decoded_sha256`` (of the bytes that
    the ids decode to) and, if ``with_ids``, ``ids``. A null text is an empty text:
    no ids, digests of nothing. Repeated rows give repeated results, an empty
    table an empty one; other columns of ``docs`` are ignored.
    """
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(path)
        cache = IdCache(encoder.chunks, 300_000)
        decimal: list[str] = []
        decoded: list[bytes] = []
        age = cache.age
        for batch in in_steps(batches, 500):
            chunked = ChunkedBatch(batch.column(1))
            slots = cache.slots(chunked.keys)
            if cache.age != age:
                decimal, decoded, age = [], [], cache.age
            fresh = np.arange(len(decimal), len(cache.place))
            if len(fresh):
                ids = cache.gather(fresh).tolist()
                at = 0
                for n in cache.lengths[fresh].tolist():
                    own = ids[at : at + n]
                    at += n
                    decimal.append(",".join(map(str, own)))
                    decoded.append(encoder.bpe.decode(own))
            chosen = slots[chunked.codes]
            counts = chunked.per_text(cache.lengths[chosen])
            places, bounds = chosen.tolist(), chunked.offsets.tolist()
            digests, backs = [], []
            for i in range(len(bounds) - 1):
                own = places[bounds[i] : bounds[i + 1]]
                digests.append(hashlib.sha256(",".join([decimal[p] for p in own]).encode()).hexdigest())
                backs.append(hashlib.sha256(b"".join([decoded[p] for p in own])).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(backs, pa.string())]
            if with_ids:
                flat = cache.gather(chosen).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(encode, T.StructType(fields))
