"""Space-delimited chunks of a batch of texts, each distinct chunk handled once.

Byte-level pre-tokenizers never join a non-space character to a following space,
so a text can be cut before every space that stands between two non-space
characters, and the parts can be encoded apart. Words repeat: a batch is cut and
dictionary-encoded in Arrow, and only distinct chunks reach an encoder.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A cut: a space between two characters that aren't white space.
CUT = re.compile(r"(?<=\S)(?= \S)")
#: The characters of white space as CUT knows them, and strings that are empty or start or end with one.
WHITE = "[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
ENDS_IN_SPACE = f"^$|^{WHITE}|{WHITE}$"


def give_back() -> None:
    """Return to the operating system what this process has freed: Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def in_steps(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Batches of no more than so many rows: what is made of each text's words stays small. What earlier tasks left is given back first."""
    give_back()
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


class ChunkedBatch:
    """Chunks of texts as positions in a list of distinct keys.

    ``keys`` holds the distinct chunks; ``codes[offsets[i]:offsets[i + 1]]`` are
    the chunks of text ``i`` in order. Joining a text's chunks gives the text.
    Null texts are empty texts.
    """

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.string()), "")
        parts = pc.split_pattern(texts, " ")
        bounds = parts.offsets.to_numpy()
        flat = parts.flatten().dictionary_encode()
        words = flat.dictionary.to_pylist()
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = (bounds - bounds[0]).astype(np.int64) if len(bounds) else np.zeros(1, np.int64)
        self.keys: list[str] = [" " + w for w in words]
        self.offsets = bounds
        if not len(texts):
            self.codes, self.offsets = np.zeros(0, np.int64), np.zeros(1, np.int64)
            return
        firsts = bounds[:-1]
        # the first chunk of a text has no space before it
        place: dict[str, int] = {}
        heads = [place.setdefault(words[c], len(place)) for c in codes[firsts].tolist()]
        codes[firsts] = np.asarray(heads, np.int64) + len(words)
        self.keys += list(place)
        odd = pc.match_substring_regex(flat.dictionary, ENDS_IN_SPACE).to_numpy(zero_copy_only=False)
        odd = np.concatenate([odd, np.fromiter((not w or w[0].isspace() or w[-1].isspace() for w in place), bool, len(place))])
        touched = np.flatnonzero(np.logical_or.reduceat(odd[codes], firsts)) if odd.any() else ()
        self.codes = codes
        if len(touched):
            self._recut(texts, touched, bounds)

    def _recut(self, texts: pa.Array, rows: np.ndarray, bounds: np.ndarray) -> None:
        """Cut again the texts in which white space meets a space."""
        place = {k: i for i, k in enumerate(self.keys)}
        pieces, at = [], 0
        lengths = np.diff(bounds)
        for i in rows.tolist():
            own = np.fromiter((place.setdefault(k, len(place)) for k in CUT.split(texts[i].as_py()) if k), np.int64)
            pieces += [self.codes[at : bounds[i]], own]
            at, lengths[i] = bounds[i + 1], len(own)
        pieces.append(self.codes[at:])
        self.codes = np.concatenate(pieces)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.keys = list(place)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sum over each text of ``values``, one value for each chunk of the batch."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


class IdCache:
    """Ids of chunks met so far; ``encode`` is asked for new chunks only.

    Holds at most ``limit`` chunks before it starts afresh, so its memory is bounded.
    Forgetting costs time only, never changes a result.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 600_000):
        self.encode, self.limit, self.age = encode, limit, 0
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.used = 0
        self.age += 1  # those who keep values by slot start afresh too

    def slots(self, keys: list[str]) -> np.ndarray:
        """Slot of each key; keys not met before are encoded first."""
        if len(self.place) > self.limit:
            self.clear()
        place = self.place
        new = [k for k in keys if k not in place]
        if new:
            flat, lengths = self.encode(new)
            first, count = len(place), len(new)
            place.update(zip(new, range(first, first + count), strict=True))
            self.ids = _grown(self.ids, self.used + len(flat))
            self.ids[self.used : self.used + len(flat)] = flat
            self.starts, self.lengths = _grown(self.starts, first + count), _grown(self.lengths, first + count)
            self.lengths[first : first + count] = lengths
            self.starts[first : first + count] = self.used + np.concatenate([[0], np.cumsum(lengths[:-1])]) if count else 0
            self.used += len(flat)
        return np.fromiter((place[k] for k in keys), np.int64, len(keys))

    def gather(self, slots: np.ndarray) -> np.ndarray:
        """Ids of the slots, joined in order."""
        lengths = self.lengths[slots]
        ends = np.cumsum(lengths)
        if not len(ends) or not ends[-1]:
            return np.zeros(0, np.uint32)
        index = np.repeat(self.starts[slots] - (ends - lengths), lengths)
        index += np.arange(ends[-1])
        return self.ids[index]


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    out = np.zeros(max(size, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


#: Bytes that aren't part of a word of digits, letters and characters beyond ASCII, as spaces; A-Z in lower case.
WORD_BYTES = bytes(b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Bytes with A-Z in lower case.
LOWER_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class WordedBatch:
    """Words of a batch of texts as positions in a list of distinct words.

    ``codes[offsets[i]:offsets[i + 1]]`` are the words of text ``i``. A table for
    ``bytes.translate`` prepares the texts; what is white space then parts words.
    """

    def __init__(self, texts: pa.Array, table: bytes = WORD_BYTES):
        texts = pc.fill_null(texts.cast(pa.string()), "")
        _, places, data = texts.buffers()
        if data is not None and len(texts):  # the bytes of these texts alone, not of the whole batch that they are a slice of
            at = np.frombuffer(places, np.int32, len(texts) + 1, 4 * texts.offset)
            own = data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes().translate(table)
            texts = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(own)])
        parts = pc.ascii_split_whitespace(texts)
        flat = parts.flatten().dictionary_encode()
        self.words: list[str] = flat.dictionary.to_pylist()
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
        if "" in self.words:  # before the first or after the last word of a text
            real = codes != self.words.index("")
            offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
            codes = codes[real]
        self.codes, self.offsets = codes, offsets


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` neighbours in an array of 64-bit hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(k) * np.uint64(0xD6E8FEB86659FD93))
        for j in range(k):
            out = (out ^ hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out
