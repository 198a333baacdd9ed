"""Full-text search over a positional inverted index, ranked by how densely a text covers the query."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import tokens

#: A place is its position times this, plus the number of its field.
FIELDS = 16


@dataclass(frozen=True)
class Wanted:
    """A word or phrase of a query, and whether a text must not have it."""

    words: tuple[str, ...]
    excluded: bool = False


def parse_websearch(query: str) -> list[list[Wanted]]:
    """Alternatives of a query: words and "phrases" that must all be there, -excluded ones that must not, OR between alternatives.

    An alternative without a word that must be there is an error, as is a query without any.
    """
    alternatives: list[list[Wanted]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if word.lower() == "or" and not minus:
            alternatives.append([])
            continue
        words = tuple(re.findall(r"[^\W]+", (phrase or word).lower()))
        if words:
            alternatives[-1].append(Wanted(words, bool(minus)))
    alternatives = [a for a in alternatives if a]
    if not alternatives or any(all(w.excluded for w in a) for a in alternatives):
        raise ValueError("a query needs a word that is not excluded, in every alternative")
    return alternatives


def text_index(docs: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """The inverted index of a table: a row for each word of each text, with its ``places``.

    Places of later fields follow those of earlier ones; a phrase never goes from one
    field into the next. Null texts have no words; rows without an id are left out.
    """
    if len(fields) > FIELDS:
        raise ValueError(f"no more than {FIELDS} fields")
    own = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *(F.coalesce(tokens(F.col(f).cast("string"), 0), F.array().cast("array<string>")).alias(f"f{i}") for i, f in enumerate(fields)))

    def placed(field: int, start: Column) -> Column:
        return F.transform(f"f{field}", lambda w, at: F.struct(w.alias("term"), ((at + start).cast("long") * FIELDS + field).alias("place")))

    before, parts = F.lit(0), []
    for i in range(len(fields)):
        parts.append(placed(i, before))
        before = before + F.size(f"f{i}") + 1
    words = own.select("id", F.explode(F.concat(*parts)).alias("w")).select("id", "w.*")
    return words.groupBy("term", "id").agg(F.array_sort(F.collect_list("place")).alias("places"))


def _occurrences(held: Column, wanted: Wanted) -> Column:
    """Places at which a phrase starts: those of its first word that the others follow."""

    def ahead(word: str, k: int) -> Column:
        return F.transform(F.coalesce(held[word], F.array().cast("array<long>")), lambda p: p - k * FIELDS)

    found = ahead(wanted.words[0], 0)
    for k, word in enumerate(wanted.words[1:], 1):
        found = F.array_intersect(found, ahead(word, k))
    return found


def search_text(index: DataFrame, query: str, weights: list[float]) -> DataFrame:
    """``id`` and ``rank`` of every text that has all of an alternative of a query.

    A cover is a stretch of text with all of an alternative that no shorter stretch
    within it has; it counts the harmonic mean of the weights of the query's words and
    phrases in it, over one more than the number of its other words. The rank is the sum
    over all covers. ``weights`` has one for each field. Only postings of the query's
    words are read, and meet by text.
    """
    alternatives = parse_websearch(query)
    elements = list(dict.fromkeys(w.words for a in alternatives for w in a if not w.excluded))
    words = sorted({x for a in alternatives for w in a for x in w.words})
    held = index.filter(F.col("term").isin(words)).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("held"))
    whole = held.select("id", *(_occurrences(F.col("held"), Wanted(e)).alias(f"e{i}") for i, e in enumerate(elements)), *(F.lit(True) if all(not w.excluded for w in a) else F.size(F.concat(*(_occurrences(F.col("held"), w) for w in a if w.excluded))) == 0 for a in alternatives))
    whole = whole.toDF("id", *(f"e{i}" for i in range(len(elements))), *(f"ok{i}" for i in range(len(alternatives))))
    needs = [[elements.index(w.words) for w in a if not w.excluded] for a in alternatives]
    fits = None
    for i, own in enumerate(needs):
        one = F.col(f"ok{i}")
        for e in own:
            one = one & (F.size(f"e{e}") > 0)
        fits = one if fits is None else fits | one
    weight = F.array(*(F.lit(1.0 / w) for w in weights))

    def ended(i: int) -> Column:
        """Occurrences of an element by their ends: last and first word, whose, length, and 1 / weight."""
        size = len(elements[i])
        return F.transform(f"e{i}", lambda p: F.struct((F.floor(p / FIELDS) + size - 1).alias("q"), F.floor(p / FIELDS).alias("p"), F.lit(i).alias("own"), F.lit(size).alias("size"), F.element_at(weight, (p % FIELDS).cast("int") + 1).alias("inverse")))

    entries = F.array_sort(F.concat(*map(ended, range(len(elements)))))
    return whole.filter(fits).select("id", _cover_density(entries, needs, len(elements)).alias("rank"))


def _cover_density(entries: Column, needs: list[list[int]], elements: int) -> Column:
    """Sum over the covers, in one walk over occurrences that keeps of each element where it was last."""
    nowhere = F.struct(F.lit(-1).cast("long").alias("p"), F.lit(-1).cast("long").alias("at"), F.lit(0.0).alias("inverse"), F.lit(0).cast("long").alias("words"))
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("inverse"), F.lit(0).cast("long").alias("words"), F.lit(-1).cast("long").alias("from"), F.lit(0.0).alias("rank"), F.array(*[nowhere] * elements).alias("last"))

    def step(s: Column, x: Column) -> Column:
        here = F.struct(x["p"].alias("p"), s["n"].alias("at"), s["inverse"].alias("inverse"), s["words"].alias("words"))
        last = F.transform(s["last"], lambda l, i: F.when(i == x["own"], here).otherwise(l))
        starts = []
        for i, own in enumerate(needs):
            spots = F.array(*(F.get(last, F.lit(e)) for e in own))
            seen = F.forall(spots, lambda l: l["at"] >= 0) & F.col(f"ok{i}")
            starts.append(F.when(seen, F.array_min(spots)))
        start = F.array_max(F.array(*starts))
        fresh = F.coalesce(start["at"] > s["from"], F.lit(False))
        count, inverse = s["n"] - start["at"] + 1, s["inverse"] + x["inverse"] - start["inverse"]
        other = F.greatest(x["q"] - start["p"] + 1 - (s["words"] + x["size"] - start["words"]), F.lit(0))
        more = F.when(fresh, count / inverse / (1 + other)).otherwise(0.0)
        return F.struct((s["n"] + 1).alias("n"), (s["inverse"] + x["inverse"]).alias("inverse"), (s["words"] + x["size"]).alias("words"), F.when(fresh, start["at"]).otherwise(s["from"]).alias("from"), (s["rank"] + more).alias("rank"), last.alias("last"))

    return F.aggregate(entries, first, step, lambda s: s["rank"])
