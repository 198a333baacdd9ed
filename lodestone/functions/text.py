"""Text as columns: tokens, similarities, shapes and scores."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.scalars import bound

#: Tokens of letters, digits and underscores of any script.
TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column, longer_than: int = 1) -> Column:
    """Lower-case tokens of more than so many characters, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: F.length(t) > longer_than)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, 0 for texts with nothing in place; case doesn't count."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(F.lower(a), F.lower(b)) / longest)


def ngrams(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters of the lower-case text."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.length(low) - (n - 1))
    return F.when(F.length(low) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def bigram_cosine(a: Column, b: Column) -> Column:
    """Cosine of the character bigram counts of two texts."""

    def all_grams(text: Column) -> Column:
        return bound(F.lower(text), lambda low: F.when(F.length(low) >= 2, F.transform(F.sequence(F.lit(1), F.length(low) - 1), lambda i: F.substring(low, i, F.lit(2)))).otherwise(F.array().cast("array<string>")))

    def count(grams: Column, gram: Column) -> Column:
        return F.size(F.filter(grams, lambda g: g == gram)).cast("double")

    def similarity(x: Column, y: Column) -> Column:
        norm = lambda g: F.sqrt(F.aggregate(F.array_distinct(g), F.lit(0.0), lambda s, t: s + count(g, t) * count(g, t)))
        dot = F.aggregate(F.array_intersect(x, y), F.lit(0.0), lambda s, t: s + count(x, t) * count(y, t))
        return F.coalesce(F.try_divide(dot, norm(x) * norm(y)), F.lit(0.0))

    return bound(all_grams(a), lambda x: bound(all_grams(b), lambda y: similarity(x, y)))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of characters with which both texts start."""
    places = F.sequence(F.lit(1), F.least(F.length(a), F.length(b)))
    same = F.filter(places, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.when(F.least(F.length(a), F.length(b)) == 0, 0).otherwise(F.size(same))


def slug_similarity(a: Column, b: Column) -> Column:
    """Edit similarity with bonuses for containment and a common start, at most 1."""
    x, y = F.lower(a), F.lower(b)
    edit = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
    inside = F.when(x.contains(y) | y.contains(x), 0.2).otherwise(0.0)
    start = 0.1 * common_prefix(x, y) / F.greatest(F.least(F.length(x), F.length(y)), F.lit(1))
    return F.least(edit + inside + start, F.lit(1.0))


def shape(text: Column) -> Column:
    """Letters as A, digits as N, spaces as W and the rest as S, runs as one."""
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9\\s]+", "\u0001"), "[A-Za-z]+", "A"), "[0-9]+", "N"), "\\s+", "W")
    return F.regexp_replace(marked, "\u0001", "S")


def shape_regex(marks: Column) -> Column:
    """An anchored regular expression for a shape."""
    part = lambda c: F.when(c == "A", "[a-zA-Z]+").when(c == "N", "[0-9]+").when(c == "W", "\\s+").otherwise("[^a-zA-Z0-9\\s]+")
    return F.concat(F.lit("^"), F.array_join(F.transform(F.split(marks, ""), part), ""), F.lit("$"))


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, ours = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                ours.append(ch)
                break
    theirs = [ch for ch, u in zip(b, used, strict=True) if u]
    m = len(ours)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(ours, theirs, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity with scaling 0.1 over at most four leading characters; case doesn't count."""
    out = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        x, y = x.lower(), y.lower()
        base = _jaro(x, y)
        lead = next((i for i, (p, q) in enumerate(zip(x[:4], y[:4], strict=False)) if p != q), min(4, len(x), len(y)))
        out.append(base + lead * 0.1 * (1 - base))
    return pd.Series(out, dtype="float64")


def name_similarity(a: Column, b: Column) -> Column:
    """Of two names: 1 if equal, 0.9 if one holds the other, else a blend of three similarities."""
    x, y = F.lower(a), F.lower(b)
    blend = 0.5 * jaro_winkler(a, b) + 0.3 * levenshtein_similarity(a, b) + 0.2 * bigram_cosine(a, b)
    return F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.9).otherwise(blend)


def hits(words: Column, lexicon: Iterable[str]) -> Column:
    """How many of the words the lexicon has."""
    return F.size(F.filter(words, lambda w: w.isin(*lexicon)))


#: Repairs of extracted text, in order: what is replaced and by what.
REPAIRS = (
    ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("[‘’]", "'"), ("[“”]", '"'),
    ("[•●▪]", "-"), ("[–—]", "-"), ("\\[[0-9]+(?:,\\s*[0-9]+)*\\]", ""),
    ("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", ""), ("[ \\t]+", " "), ("(?<=[a-z,])\\n(?=[a-z])", " "), ("\\n{3,}", "\n\n"),
)


def clean(text: Column) -> Column:
    """Text with ligatures, quotes, bullets, dashes, citations, control characters, spaces and line ends repaired."""
    for old, new in REPAIRS:
        text = F.regexp_replace(text, old, new)
    return F.trim(text)
