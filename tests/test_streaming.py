"""Streams that are read to their end."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.plans import catalogue
from lodestone.streaming import sessions

DIRECTORY = "/root/testdata/sf0.001"


def test_streamed_counts_wait_for_the_end_of_the_input(spark, monkeypatch):
    """A wait with a limit is taken to run out at once; the counts must be whole none the less."""
    real = StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, timeout=None: real(self) if timeout is None else False)
    got = catalogue.QUERIES["streamed_counts"](spark, DIRECTORY).agg(F.sum("n")).first()[0]
    assert got == spark.read.parquet(f"{DIRECTORY}/events.parquet").count()


def test_complete_result_of_many_triggers_failure_and_no_input(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    rows.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = lambda folder: sessions.event_stream(spark, f"{tmp_path}/{folder}", rows.schema)
    got = sessions.complete_result(stream("in").groupBy("k").agg(F.count("*").alias("n")), "many")
    assert Counter({r["k"]: r["n"] for r in got.collect()}) == Counter(i % 7 for i in range(100))
    with pytest.raises(StreamingQueryException):
        sessions.complete_result(stream("in").groupBy(F.raise_error(F.lit("broken")).cast("int").alias("k")).count(), "failing")
    (tmp_path / "none").mkdir()
    assert sessions.complete_result(stream("none").groupBy("k").count(), "none").count() == 0
