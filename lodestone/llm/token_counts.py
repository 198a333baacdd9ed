"""Exact token counts at every prefix of a text, by dynamic programming.

The model gives a table of pieces with their ranks, and of pairs of pieces that may
stand side by side: those that merging leaves apart. A prefix of a word ends in one
piece only, the one that ends there and may stand beside the last piece of the
prefix before it; so the count at a prefix is the count at that earlier prefix and
one. The programme fills in last pieces and counts from the left, each word once.

A text is a sequence of words, each a run of spaces with the characters that follow
it. No piece reaches across a word's start, so the count at a word's end is the
count before it plus the word's own. Counts at all word ends are stored, and
questions of truncation and budget are look-ups in them: nothing is encoded again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.chunks import ChunkedBatch, IdCache, in_steps

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
WORD = re.compile(" +[^ ]*")


def split_words(text: str) -> list[str]:
    """Words of a text that has the library's own space before it; a written space sign is a space."""
    return WORD.findall(" " + text.replace(SPACE, " ")) if text else []


@lru_cache(maxsize=2)
def counter(path: str | None) -> PrefixCounter:
    return PrefixCounter(path)


class PrefixCounter:
    """Counts at the prefixes of texts, as the sentencepiece library gives them for the whole prefix."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
        own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        # the better a piece's score, the earlier it is merged
        self.ranks = {model.id_to_piece(i): -model.get_score(i) for i in own}
        if any(SPACE in p.lstrip(SPACE) for p in self.ranks):
            raise ValueError("a piece of this vocabulary reaches across words")
        self.tails = {p[i:] for p in self.ranks for i in range(len(p))}
        self.beside: dict[tuple[str, str], bool] = {}

    def chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nothing, and the count of each chunk of a text; a text's first chunk has no space before it."""
        split = [WORD.findall(c if c[:1] == " " else " " + c) for c in chunks]
        counts = self.words([w for own in split for w in own])
        total = np.concatenate([[0], np.cumsum(counts)])
        ends = np.cumsum([len(own) for own in split]) if split else np.zeros(0, np.int64)
        return np.zeros(0, np.uint32), np.diff(total[np.concatenate([[0], ends])])

    def _merged(self, left: str, right: str) -> bool:
        """Whether merging the characters of two pieces, side by side, leaves those two pieces."""
        parts = list(left + right)
        while len(parts) > 1:
            ranked = [(self.ranks.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, at = min(ranked)
            if rank == np.inf:
                break
            parts[at : at + 2] = ["".join(parts[at : at + 2])]
        return parts == [left, right]

    def _fits(self, left: str, right: str) -> bool:
        """The same from the table of pairs, which grows with the pairs that are met."""
        known = self.beside.get((left, right))
        if known is None:
            if len(self.beside) > 250_000:
                self.beside.clear()
            known = self.beside[left, right] = self._merged(left, right)
        return known

    def _fill(self, word: str, counts: list[int], lasts: list[str]) -> None:
        """Go on from the prefixes filled in so far to the whole word."""
        ranks, beside, tails = self.ranks, self.beside, self.tails
        for end in range(len(counts), len(word) + 1):
            start, piece, found = end - 1, word[end - 1], []
            while piece in tails:
                if piece in ranks:
                    found.append((start, piece))
                if not start:
                    break
                start -= 1
                piece = word[start:end]
            for start, piece in reversed(found):
                if not start or beside.get((lasts[start], piece)) or self._fits(lasts[start], piece):
                    counts.append(counts[start] + 1)
                    lasts.append(piece)
                    break
            else:  # a character that is no piece is spelt in bytes
                counts.append(counts[end - 1] + len(word[end - 1].encode()))
                lasts.append(word[end - 1])

    def inside(self, word: str) -> list[int]:
        """Counts at the prefixes of a word: of its first character, its first two, and so on."""
        counts, lasts = [0], [""]
        self._fill(word.replace(" ", SPACE), counts, lasts)
        return counts[1:]

    def words(self, words: list[str]) -> np.ndarray:
        """Count of each word; a word starts with the spaces before it.

        Words are taken in order, and each goes on from the prefix that it shares with the one before.
        """
        own = [w.replace(" ", SPACE) for w in words]
        out, last, counts, lasts = np.zeros(len(own), np.int64), "", [0], [""]
        for i in sorted(range(len(own)), key=own.__getitem__):
            word, same = own[i], 0
            for x, y in zip(word, last):
                if x != y:
                    break
                same += 1
            del counts[same + 1 :], lasts[same + 1 :]
            self._fill(word, counts, lasts)
            out[i], last = counts[-1], word
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of ``text[:0]``, ``text[:1]``, up to the whole text."""
        out, before = [0], 0
        for n, word in enumerate(split_words(text)):
            own = self.inside(word)
            out += [before + c for c in own[n == 0 :]]
            before += own[-1]
        return np.asarray(out, np.int64)

    def longest_prefix(self, text: str, limit: int) -> int:
        """Characters of the longest prefix of at most ``limit`` tokens."""
        words = split_words(text)
        return max(self.cut(words, np.cumsum(self.words(words)), limit) - 1, 0)

    def cut(self, words: list[str], ends: np.ndarray, limit: int) -> int:
        """The same from words and the counts at their ends, with the space before the first word."""
        n = int(np.searchsorted(ends, limit, side="right"))
        chars = sum(map(len, words[:n]))
        if n < len(words):
            before = int(ends[n - 1]) if n else 0
            chars += max((i for i, c in enumerate(self.inside(words[n]), 1) if before + c <= limit), default=0)
        return chars


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text, and where a budget of ``limit`` tokens ends.

    Returns a row for each row of ``docs``: its id, ``n_bytes`` (UTF-8),
    ``n_tokens``, ``over_limit`` and ``kept_chars``, the characters of the longest
    prefix within the budget. A null text counts as an empty one, with no tokens.
    Whole texts are counted, however long. Repeated rows give repeated results,
    other columns are ignored, an empty table gives none.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("kept_chars", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = _counter(path)
        for batch in in_steps(batches):
            chunked = ChunkedBatch(_spaced(batch.column(1)))
            slots = cache.slots(chunked.keys)
            each = cache.lengths[slots][chunked.codes]
            totals = chunked.per_text(each)
            kept = np.asarray(batch.column(3).to_numpy(zero_copy_only=False), np.int64).copy()
            for i in np.flatnonzero(totals > limit).tolist():
                kept[i] = _cut(own, [chunked.keys[c] for c in chunked.codes[chunked.offsets[i] : chunked.offsets[i + 1]].tolist()], np.cumsum(each[chunked.offsets[i] : chunked.offsets[i + 1]]), limit)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(totals, pa.int64()), pa.array(totals > limit), pa.array(kept, pa.int64())], names=schema.names)

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), text.alias("t"), F.octet_length(text).cast("long").alias("b"), F.length(text).cast("long").alias("c")).mapInArrow(count, schema)


def prefix_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored programme: for each row its id, and the ``ends`` of its words (in characters) with the ``counts`` there.

    A null or empty text has no words. ``longest_within`` answers budgets from these arrays alone.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = _counter(path)
        known: dict[str, int] = {}
        for batch in in_steps(batches, 200):
            if len(known) > 500_000:
                known.clear()
            ends, counts = [], []
            for text in batch.column(1).to_pylist():
                words = split_words(text or "")
                new = [w for w in dict.fromkeys(words) if w not in known]
                known |= zip(new, own.words(new).tolist(), strict=True)
                ends.append(np.cumsum([len(w) for w in words], dtype=np.int64) - 1)
                counts.append(np.cumsum([known[w] for w in words], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e.astype(np.int32) for e in ends], pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(fill, schema)


def longest_within(counts: Column, ends: Column, limit: int) -> Column:
    """Characters of the longest prefix of whole words that has at most ``limit`` tokens, from ``prefix_counts``."""
    kept = F.size(F.filter(counts, lambda c: c <= limit))  # counts rise from word to word
    return F.when(kept == 0, 0).otherwise(F.element_at(ends, F.greatest(kept, F.lit(1))))


@lru_cache(maxsize=2)
def _counter(path: str | None) -> tuple[PrefixCounter, IdCache]:
    """The programme and the words it has met; kept by a Python worker from task to task."""
    own = counter(path)
    return own, IdCache(own.chunks, 250_000)


def _spaced(texts: pa.Array) -> pa.Array:
    """Texts with written space signs as spaces. One that starts with a space gets the library's own space
    already here, so that every chunk with a space in front holds all its spaces."""
    texts = pc.replace_substring(texts, SPACE, " ")
    return pc.if_else(pc.starts_with(texts, " "), pc.binary_join_element_wise(" ", texts, ""), texts)


def _cut(own: PrefixCounter, chunks: list[str], ends: np.ndarray, limit: int) -> int:
    """Characters of the budget: the chunk in which it ends, and within it the word and the character."""
    spaced = [c if c[:1] == " " else " " + c for c in chunks[:1]] + chunks[1:]
    n = int(np.searchsorted(ends, limit, side="right"))
    words = WORD.findall(spaced[n])
    inner = own.cut(words, np.cumsum(own.words(words)), limit - (int(ends[n - 1]) if n else 0))
    return max(sum(map(len, spaced[:n])) + inner - 1, 0)
