"""Full-text search against a plain scorer."""

from __future__ import annotations

import random
import re

import pytest

from lodestone.operators import fulltext

WEIGHTS = [1.0, 0.4, 0.1]


def plain_rank(fields: list[str | None], query: str) -> float | None:
    """All covers by trying every stretch of occurrences; None for a text that the query doesn't find."""
    shift, places = 0, []
    for f, text in enumerate(fields):
        words = re.findall(r"[^\W]+", (text or "").lower())
        places += [(w, shift + i, f) for i, w in enumerate(words)]
        shift += len(words) + 1
    at = {(p, f): w for w, p, f in places}

    def occurrences(words):
        return [(p + len(words) - 1, p, len(words), 1 / WEIGHTS[f]) for w, p, f in places if w == words[0] and all(at.get((p + k, f)) == x for k, x in enumerate(words))]

    alternatives = fulltext.parse_websearch(query)
    fitting = [a for a in alternatives if all(bool(occurrences(w.words)) != w.excluded for w in a)]
    if not fitting:
        return None
    elements = list(dict.fromkeys(w.words for a in alternatives for w in a if not w.excluded))
    found = sorted((q, p, k, size, inverse) for k, e in enumerate(elements) for q, p, size, inverse in occurrences(e))
    rank, since = 0.0, -1
    for i in range(len(found)):
        starts = []
        for a in fitting:
            last = [max(((j, found[j][1]) for j in range(i + 1) if elements[found[j][2]] == w.words), default=None) for w in a if not w.excluded]
            if None not in last:
                starts.append(min((p, j) for j, p in last))
        if starts and max(starts)[1] > since:
            p, since = max(starts)
            own = found[since : i + 1]
            other = max(found[i][0] - p + 1 - sum(x[3] for x in own), 0)
            rank += len(own) / sum(x[4] for x in own) / (1 + other)
    return rank


QUERIES = ["alpha", "alpha beta", '"alpha beta"', "alpha OR gamma", '"alpha beta" gamma -delta OR "delta delta"', 'beta "gamma alpha beta" or -"beta beta" alpha', "Alpha alpha", "beta OR alpha beta"]


@pytest.mark.parametrize("query", QUERIES)
def test_search_against_a_plain_scorer(spark, query):
    rng = random.Random(9)
    text = lambda n: None if rng.random() < 0.1 else rng.choice([" ", "-", ", "]).join(rng.choice(["alpha", "Beta", "gamma", "delta", "epsilon", "zêta"]) for _ in range(rng.randrange(n)))
    rows = [(i, text(4), text(12), text(40), 1, "t") for i in range(80)] + [(None, "alpha beta", None, "gamma", 1, "t"), (200, None, None, None, 1, "t")]
    docs = spark.createDataFrame(rows, "id long, a string, b string, c string, place int, term string")
    index = fulltext.text_index(docs, "id", ["a", "b", "c"])
    got = {r["id"]: round(r["rank"], 9) for r in fulltext.search_text(index, query, WEIGHTS).collect()}
    want = {r[0]: round(rank, 9) for r in rows if r[0] is not None and (rank := plain_rank(list(r[1:4]), query)) is not None}
    assert got == want and want
    assert fulltext.search_text(fulltext.text_index(docs.limit(0), "id", ["a", "b", "c"]), query, WEIGHTS).count() == 0


@pytest.mark.parametrize("query", ["", "-alpha", "alpha OR -beta", ' "" - OR '])
def test_queries_without_a_word_that_must_be_there(query):
    with pytest.raises(ValueError, match="needs a word"):
        fulltext.parse_websearch(query)
