"""License scans by diagonal voting.

Hashes of all runs of k words of the documents meet the positions of the same runs
in license templates in a join. Each meeting votes for a diagonal: the document's
position less the template's. A copy of a template puts its votes on one diagonal,
a copy with words put in or left out on neighbouring ones, so neighbours are
merged. What the votes cover of the template is its score. Meetings compare the
words themselves, so every vote is a verified span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.llm.chunks import WORD_BYTES, WordedBatch, in_steps, rolling
from lodestone.llm.common import row_key, stored

#: Phrases that count wherever their words stand together, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Sentences by which licenses are told, in words as ``words`` gives them.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "lgpl": "under the terms of the gnu lesser general public license as published by the free software foundation",
    "cc-by": "licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "licensed under the creative commons attribution sharealike license",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: Words of a run; a shorter template is one run.
RUN = 3
#: Runs of templates up to which their table is broadcast: some 10 MB.
BROADCAST_RUNS = 100_000


def words(text: str) -> list[str]:
    """Words of a text: A-Z lowered, runs of digits, letters and characters beyond ASCII."""
    return text.encode().translate(WORD_BYTES).decode().split(" ") if text else []


def _hashes(own: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in own), np.uint64, len(own))


def template_runs(templates: dict[str, str], phrases: dict[str, str], k: int) -> pd.DataFrame:
    """Every run of every template: its hash, words, place, and what it belongs to. A few hundred rows."""
    rows = []
    for base, texts in ((True, phrases), (False, {text: label for label, text in templates.items()})):
        for text, label in texts.items():
            own = [w for w in words(text) if w]
            size = len(own) if base else min(k, len(own))
            for at, h in enumerate(rolling(_hashes(own), size).tolist()):
                rows.append((int(np.uint64(h).astype(np.int64)), " ".join(own[at : at + size]), size, at, len(own), label, base, text))
    return pd.DataFrame(rows, columns=["run", "run_words", "size", "at", "template_words", "label", "base", "template"])


def find_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, least_cover: float = 0.8, near: int = 3, k: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License labels of every text.

    Returns a row for each row of ``docs``: its id, ``n_words``, ``n_base`` (all
    places of the phrases), ``first_word`` and ``last_word`` (smallest and largest
    start of a phrase, null if none), ``base_labels``, ``labels`` (with those of
    templates of which one merged diagonal covers ``least_cover``) and ``score``
    (the best cover of any template or phrase, 0 to 1). Diagonals no more than
    ``near`` apart are merged. A null text has no words; whole texts are read,
    however long. Repeated rows give repeated results; other columns of ``docs`` are
    ignored; an empty table gives none.

    Runs that no template has leave before the join, in the task that makes them (a
    semi-join on the sorted hashes of the templates); those left are joined by hash
    and words.
    """
    spark = docs.sparkSession
    runs = template_runs(templates, phrases, k)
    wanted = np.unique(runs["run"].to_numpy().astype(np.int64)).view(np.uint64)
    wanted.sort()
    sizes = sorted(set(runs["size"].tolist()))
    marks = np.zeros(1 << 16, bool)
    marks[(wanted & np.uint64(0xFFFF)).astype(np.int64)] = True
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("row", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.StructType([T.StructField("pos", T.LongType()), T.StructField("run", T.LongType()), T.StructField("run_words", T.StringType())])))])

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches):
            own = WordedBatch(batch.column(2))
            hashes = _hashes(own.words)[own.codes]
            ends = np.repeat(own.offsets[1:], np.diff(own.offsets))
            spots = []
            for size in sizes:
                h = rolling(hashes, size)
                at = np.flatnonzero(marks[(h & np.uint64(0xFFFF)).astype(np.int64)])
                at = at[wanted[np.minimum(np.searchsorted(wanted, h[at]), len(wanted) - 1)] == h[at]]
                at = at[at + size <= ends[at]]  # not from one text into the next
                spots += [(a, x, size) for a, x in zip(at.tolist(), h[at].view(np.int64).tolist(), strict=True)]
            spots.sort()
            places = np.fromiter((a for a, _, _ in spots), np.int64, len(spots))
            bounds = np.searchsorted(places, own.offsets)
            doc = np.searchsorted(own.offsets, places, side="right") - 1
            struct = pa.StructArray.from_arrays([pa.array(places - own.offsets[doc], pa.int64()), pa.array([x for _, x, _ in spots], pa.int64()), pa.array([" ".join(own.words[c] for c in own.codes[a : a + size].tolist()) for a, _, size in spots], pa.string())], names=["pos", "run", "run_words"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(own.offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), struct)], names=schema.names)

    rolled = stored(docs.select(id_col, row_key(id_col, text_col).alias("row"), text_col).mapInArrow(roll, schema), "license-runs")
    table = spark.createDataFrame(runs)
    table = F.broadcast(table) if len(runs) <= BROADCAST_RUNS else table
    hits = rolled.filter(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.*").distinct().join(table, ["run", "run_words"])
    votes = hits.groupBy("row", "base", "template", "label", "template_words", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set(F.struct("at", "size")).alias("runs"))
    order = Window.partitionBy("row", "base", "template").orderBy("diagonal")
    # the phrases' places stay apart; the diagonals of a template are merged with near ones
    group = F.sum(F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal", 1, -(1 << 40)).over(order) > near), 1).otherwise(0)).over(order)
    merged = votes.withColumn("merged", group).groupBy("row", "base", "template", "label", "template_words", "merged").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs"), F.min("diagonal").alias("start"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["at"], r["at"] + r["size"] - 1)))))
    spans = merged.withColumn("cover", covered / F.col("template_words"))
    is_base = F.col("base")
    found = spans.groupBy("row").agg(F.sum(is_base.cast("long")).alias("n_base"), F.min(F.when(is_base, F.col("start"))).alias("first_word"), F.max(F.when(is_base, F.col("start"))).alias("last_word"), F.collect_set(F.when(is_base, F.col("label"))).alias("base_set"), F.collect_set(F.when(is_base | (F.col("cover") >= least_cover), F.col("label"))).alias("set"), F.max("cover").alias("score"))
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return rolled.drop("hits").join(found, "row", "left").select(id_col, "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", joined("base_set").alias("base_labels"), joined("set").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
