"""Scores of texts by word lists, and of summaries by what they rest on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import clamp
from lodestone.functions.text import hits, tokens

POSITIVE = ("amazing", "beautiful", "best", "excellent", "good", "great", "happy", "helpful", "love", "nice", "perfect", "thanks", "wonderful")
NEGATIVE = ("angry", "awful", "bad", "broken", "error", "fail", "hate", "horrible", "poor", "problem", "sad", "terrible", "worst", "wrong")
FORMAL = ("accordingly", "consequently", "furthermore", "hence", "moreover", "nevertheless", "therefore", "thus", "whereas")
CASUAL = ("awesome", "cool", "gonna", "guy", "hey", "kinda", "lol", "ok", "stuff", "wanna", "yeah")
SUBJECTIVE = ("believe", "feel", "guess", "maybe", "opinion", "perhaps", "probably", "seems", "think")
OBJECTIVE = ("data", "evidence", "fact", "measured", "percent", "reported", "results", "study")
TONES = {"joy": ("glad", "happy", "joy", "love"), "anger": ("angry", "furious", "hate", "mad"), "fear": ("afraid", "fear", "scared", "worry"), "sadness": ("cry", "lonely", "sad", "sorry")}


def sentiment(text: Column, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    """Struct of score (-1 to 1), confidence and class."""
    own = tokens(text)
    up, down, n = hits(own, positive), hits(own, negative), F.size(own)
    score = clamp(F.coalesce(F.try_divide(2.0 * (up - down), n), F.lit(0.0)), -1.0, 1.0)
    sure = F.when(up + down == 0, 0.3).otherwise(F.least(F.lit(1.0), F.coalesce(F.try_divide(5.0 * (up + down), n), F.lit(0.0))))
    return F.struct(score.alias("score"), sure.alias("confidence"), F.when(score > 0.1, "Positive").when(score < -0.1, "Negative").otherwise("Neutral").alias("class"))


def tone(text: Column) -> Column:
    """The tone most of a text's words have; null without any."""
    own = tokens(text)
    counted = F.array(*(F.struct(hits(own, words).alias("n"), F.lit(name).alias("tone")) for name, words in sorted(TONES.items(), reverse=True)))
    best = F.array_max(counted)
    return F.when(best["n"] > 0, best["tone"])


def formality(text: Column) -> Column:
    """Share of formal marks among formal and casual ones; a half without any."""
    own = tokens(text)
    passive = F.regexp_count(F.lower(text), F.lit(r"\b(?:was|were|been|is|are) [a-z]+ed\b"))
    formal, casual = hits(own, FORMAL) + passive, hits(own, CASUAL) + F.regexp_count(F.lower(text), F.lit(r"[a-z]'(?:t|s|re|ve|ll|d|m)\b"))
    return F.coalesce(F.try_divide(formal, formal + casual), F.lit(0.5))


def subjectivity(text: Column) -> Column:
    """Share of subjective words among subjective and objective ones; a half without any."""
    own = tokens(text)
    a, b = hits(own, SUBJECTIVE), hits(own, OBJECTIVE)
    return F.coalesce(F.try_divide(a, a + b), F.lit(0.5))


def readability(text: Column) -> Column:
    """1 for short sentences of short words, 0 for long ones of long words."""
    own = tokens(text, 0)
    words, ends = F.size(own), F.greatest(F.regexp_count(text, F.lit("[.!?]+")), F.lit(1))
    letters = F.aggregate(own, F.lit(0), lambda s, w: s + F.length(w))
    return F.when(words == 0, 0.0).otherwise((clamp(1 - words / ends / 30) + clamp(1 - letters / words / 10)) / 2)


def evidence(claims: DataFrame, source: str, claim: str) -> DataFrame:
    """Share of each claim's longer terms that its source has, and whether that supports it."""
    own, there = F.array_distinct(tokens(F.col(claim), 3)), tokens(F.col(source), 3)
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(own, there)), F.size(own)), F.lit(0.0))
    return claims.withColumn("evidence", share).withColumn("supported", F.col("evidence") > 0.5)


def summary_quality(citation: Column, coherence: Column, entity: Column, factuality: Column) -> Column:
    """Overall quality of a summary from its four parts."""
    return 0.2 * citation + 0.15 * coherence + 0.2 * entity + 0.45 * factuality
