"""Secret scans: fixed forms, and novelty against dictionary-primed zstandard.

Three fixed forms give the base spans. Beside them, strings in a sensitive context
are measured: zstandard is primed with the code around a candidate and with the
identifiers that the corpus repeats, and what the candidate adds in compressed bytes
is its novelty, against what a random string of its alphabet would add. Words and
identifiers compress away; keys don't, and are reported as ``novel``. A candidate's
own repetitions nearby don't prime it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The base forms.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
KINDS = ("assign", "access", "hex", "novel")
#: Characters that part a string and carry nothing.
SEPARATORS = str.maketrans("", "", "-_=. :")
#: Words that make a following string sensitive.
CONTEXT = re.compile(r"(?:auth|bearer|credential|private|signature|session|cookie|client|key|login|salt|hmac|pwd|webhook|conn)[A-Za-z_-]{0,20}[\"'\x20:=(]{1,4}([A-Za-z0-9+/_=-]{16,})", re.ASCII | re.IGNORECASE)
#: Texts that may hold a span; the others are passed over. Wider than the forms above.
MAYBE = r"(?i)passw|secret|token|api_?key|akia|[0-9a-f]{24}|(?:auth|bearer|credential|private|signature|session|cookie|client|key|login|salt|hmac|pwd|webhook|conn)[a-z_-]{0,20}[\"'\x20:=(]{1,4}[a-z0-9+/_=-]{16}"
#: Names of several parts, without digits, in snake, kebab or camel case: what the corpus's dictionary is made of.
NAME = "[A-Za-z]{2,20}(?:[_-][A-Za-z]{2,20})+|[a-z]{2,20}(?:[A-Z][a-z]{1,20})+"
#: Identifiers that code repeats everywhere; they prime the compressor before those of the corpus.
IDENTIFIERS = " ".join("access_token api_key application authorization configuration connection_string credentials client_id client_secret content-type database default environment function getElementById hostname import instance interface localhost parameters password private_key production public_key request response return self.session signature staging test_token token_type undefined username your_api_key_here changeme placeholder example abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789".split())


class Novelty:
    """Marginal compressed size of strings, as a share of what random strings of their alphabet would need."""

    def __init__(self, identifiers: str = IDENTIFIERS, reach: int = 2_000):
        self.identifiers, self.reach = identifiers.encode(), reach

    def __call__(self, text: str, start: int, end: int) -> float:
        own = text[start:end]
        around = (text[max(0, start - self.reach) : start].replace(own, " ") + "\n" + text[end : end + self.reach].replace(own, " ")).encode("utf-8", "replace")
        primed = zstandard.ZstdCompressionDict(self.identifiers + b"\n" + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        compressor = zstandard.ZstdCompressor(level=3, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
        return max(0, len(compressor.compress(own.encode())) - len(compressor.compress(b""))) / (len(own) * bits(own) / 6)


def bits(own: str) -> float:
    """Bits of a character of a random string over the kinds of characters that a string has."""
    plain = own.translate(SEPARATORS)
    if not set(plain.lower()) - set("0123456789abcdef") and (plain == plain.lower() or plain == plain.upper()):
        return 4.0
    kinds = 10 * any(c.isdigit() for c in plain) + 26 * any(c.islower() for c in plain) + 26 * any(c.isupper() for c in plain) + 2 * any(c in "+/" for c in plain)
    return max(1.0, math.log2(max(2, kinds)))


def corpus_identifiers(docs: DataFrame, text_col: str = "text", most: int = 2_000, least_rows: int = 3) -> list[str]:
    """The ``most`` most frequent names of several parts, of ``least_rows`` rows at least; the most frequent one comes last."""
    names = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(NAME), F.lit(0)))).alias("name")).filter(F.length("name").between(5, 60))
    rows = names.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") >= least_rows).orderBy(F.desc("n"), "name").limit(most).collect()
    return [r["name"] for r in reversed(rows)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end of every base span, in order; offsets count code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(m.start(), 2, m.end()) for m in re.finditer(rf"{HEX.pattern[:-1]}{{{HEX_LENGTH},}}", text)]
    return sorted(found)


def novel_spans(text: str, novelty: Novelty, least: float, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Strings in a sensitive context that hardly compress and that no base span covers."""
    found = []
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        own = text[start:end]
        if any(c.isdigit() for c in own) and any(c.isalpha() for c in own) and not any(s < end and start < e for s, _, e in taken) and novelty(text, start, end) >= least:
            found.append((start, 3, end))
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, least_novelty: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every text.

    Returns a row for each row of ``docs``: its id; ``n_assign``, ``n_access`` and
    ``n_hex``, the numbers of base spans; ``base_sha256``, of the base spans as
    kind:start:end by start and kind; ``spans``, all spans so written; and
    ``n_novel``. Offsets are code points, ends exclusive. A null text is an empty
    text and has no spans; whole texts are read, however long; repeated rows give
    repeated results; other columns are ignored; an empty table gives none.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_novel", T.LongType())])
    nothing = hashlib.sha256(b"").hexdigest()
    known = " ".join([IDENTIFIERS, *corpus_identifiers(docs, text_col)])  # of bounded size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(known)
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            maybe = pc.match_substring_regex(texts, MAYBE).to_pylist()
            rows = []
            for i, flagged in enumerate(maybe):
                if not flagged:
                    rows.append((0, 0, 0, nothing, "", 0))
                    continue
                text = texts[i].as_py()
                base = base_spans(text)
                novel = novel_spans(text, novelty, least_novelty, base)
                rows.append((*(sum(k == kind for _, k, _ in base) for kind in range(3)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + novel)), len(novel)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f) for c, f in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()], strict=True))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(scan, schema)
