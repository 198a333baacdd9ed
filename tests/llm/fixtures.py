"""Documents with everything that an operator must bear."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kind int, pos long, n int, key string, part int, score double, predicted int, component string, node long, digest binary, own_id long, own_row string, own_cuts string, own_hash long, own_score double, own_prediction int, __row string, __id long"


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A table of ids and texts, with columns whose names operators might use."""
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), "x", 1, 2, 3, "k", 4, 0.5, 1, "c", 9, None, 1, "r", "c", 2, 0.1, 3, "q", 4) for i, t in rows], SCHEMA)


def odd_rows(seed: int = 3) -> list[tuple]:
    """Ids and texts: nulls, blanks, long texts, ties, repeated rows, and random ones with odd characters."""
    rng = random.Random(seed)
    alphabet = "aab the\n\t\r\x0b'sé🙂ßÉñ1 23.,-_/@+:=\"　 \x85▁İ"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.choice([1, 3, 10, 40, 300])))) for i in range(100, 160)]
    rows += [(None, "a text without an id"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "two words")]
    rows += [(6, " ".join(rng.choice(["alpha", "beta", "Gamma", "délta", "eps1"]) for _ in range(20_000))), (7, "x" * 60_000), (8, "the same text twice over"), (9, "the same text twice over"), (9, "the same text twice over"), (9, "another text under an id")]
    return rows
