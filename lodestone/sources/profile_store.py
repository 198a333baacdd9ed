"""A store of profiles: content-addressed, with history, baselines and pruning, safe for several writers."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.drift import schema_hash
from lodestone.operators.history import content_hash, padded_distance
from lodestone.operators.segment_profiles import segment_profiles, segment_vectors
from lodestone.sources.scratch import drop_path, list_done

RECORD = "id string, action string, source string, schema_hash string, content_hash string, rows long, columns int, at timestamp, vector array<double>, record string"


class ProfileStore:
    """Profiles of tables below a folder that driver and executors share.

    Every change is a record in a folder of its own that Spark marks as done, and the
    state is what all records say together: a profile is there from its ``store`` to
    its ``delete``, pinned and excluded as the last such record says. Writers append
    and never rewrite, so two at a time lose nothing, and a write that breaks off
    leaves a folder without the mark, which counts for nothing. An id is made of the
    hashes of schema and content: the same table stored again is the same profile.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _write(self, record: dict) -> None:
        name = uuid.uuid4().hex
        row = {f.split()[0]: None for f in RECORD.split(", ")} | record | {"record": name}
        self.spark.createDataFrame([Row(**row)], RECORD).coalesce(1).write.parquet(f"{self.path}/log/{name}")

    def _hashes(self, df: DataFrame) -> tuple[str, str, int]:
        one = content_hash(df).withColumn("schema", F.hex(schema_hash(df))).first()
        return one["schema"], str(one["content_hash"] or 0), one["rows"]

    def records(self) -> DataFrame:
        """All records of finished writes."""
        names = list_done(self.spark, f"{self.path}/log")
        return self.spark.read.schema(RECORD).parquet(*(f"{self.path}/log/{n}" for n in names)) if names else self.spark.createDataFrame([], RECORD)

    def entries(self) -> DataFrame:
        """The profiles that are there: what was stored first under an id, whether pinned as a baseline or excluded from being one."""
        own = self.records()
        last = lambda yes, no: F.coalesce(F.max(F.when(F.col("action").isin(yes, no), F.struct("at", "record", (F.col("action") == yes).alias("on"))))["on"], F.lit(False))
        fields = [f.split()[0] for f in RECORD.split(", ")][2:9]
        first = F.min(F.when(F.col("action") == "store", F.struct("at", "record", *(F.col(c).alias(f"s_{c}") for c in fields))))
        gone = F.max(F.when(F.col("action") == "delete", F.col("at")))
        stored = F.max(F.when(F.col("action") == "store", F.col("at")))
        state = own.groupBy("id").agg(first.alias("f"), gone.alias("gone"), stored.alias("stored"), last("pin", "unpin").alias("pinned"), last("exclude", "include").alias("excluded"))
        alive = state.filter(F.col("stored").isNotNull() & (F.col("gone").isNull() | (F.col("stored") > F.col("gone"))))
        return alive.select("id", *(F.col(f"f.s_{c}").alias(c) for c in fields), "pinned", "excluded")

    def store(self, df: DataFrame, source: str, at: datetime.datetime, numbers: Sequence[str], categories: Sequence[str] = ()) -> str:
        """Profile a table and keep it under its id, unless that content is there already; the id.

        The profile's files come first and its record last.
        """
        schema, content, rows = self._hashes(df)
        own = f"{schema}-{content}-{rows}"
        if self.entries().filter(F.col("id") == own).isEmpty():
            folder = f"{self.path}/profiles/{own}/{uuid.uuid4().hex}"
            segment_profiles(df.withColumn("all rows", F.lit("all")), "all rows", numbers, categories).write.parquet(folder)
            vector = segment_vectors(self.spark.read.parquet(folder)).first()
            self._write({"id": own, "action": "store", "source": source, "schema_hash": schema, "content_hash": content, "rows": rows, "columns": len(df.columns), "at": at, "vector": vector["vector"] if vector else []})
        return own

    def load(self, own: str) -> DataFrame | None:
        """The profile of an id, a row a column; None if it isn't there."""
        if self.entries().filter(F.col("id") == own).isEmpty():
            return None
        return self.spark.read.parquet(f"{self.path}/profiles/{own}/{list_done(self.spark, f'{self.path}/profiles/{own}')[0]}")

    def _mark(self, own: str, action: str, at: datetime.datetime) -> None:
        self._write({"id": own, "action": action, "at": at})

    def pin(self, own: str, at: datetime.datetime, on: bool = True) -> None:
        """Make a profile the baseline of its schema, or no longer; pruning never takes pinned ones."""
        self._mark(own, "pin" if on else "unpin", at)

    def exclude(self, own: str, at: datetime.datetime, on: bool = True) -> None:
        """Keep a profile from being a baseline, or no longer."""
        self._mark(own, "exclude" if on else "include", at)

    def delete(self, own: str, at: datetime.datetime) -> bool:
        """Take a profile out; whether it was there. Its files go after its record."""
        if self.entries().filter(F.col("id") == own).isEmpty():
            return False
        self._mark(own, "delete", at)
        drop_path(self.spark, f"{self.path}/profiles/{own}")
        return True

    def find_content(self, df: DataFrame) -> Row | None:
        """The entry of a table with the same content, whatever the order of its rows."""
        schema, content, rows = self._hashes(df)
        return self.entries().filter(F.col("id") == f"{schema}-{content}-{rows}").first()

    def history(self, df: DataFrame, limit: int | None = None) -> DataFrame:
        """Entries of tables with the same columns, the latest first."""
        same = self.entries().filter(F.col("schema_hash") == F.hex(schema_hash(df))).orderBy(F.desc("at"), "id")
        return same.limit(limit) if limit else same

    def baselines(self) -> DataFrame:
        """The baseline of each schema: the first pinned one, else the oldest that isn't excluded."""
        order = Window.partitionBy("schema_hash").orderBy(F.desc("pinned"), "at", "id")  # as many rows as a schema has profiles
        return self.entries().filter("not excluded").withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")

    def baseline(self, df: DataFrame) -> Row | None:
        """The baseline of a table's schema."""
        return self.baselines().filter(F.col("schema_hash") == F.hex(schema_hash(df))).first()

    def nearest(self, vector: Sequence[float], within: float | None = None) -> DataFrame:
        """Entries by the distance of their vectors from one, nearest first; those ``within`` alone if given."""
        wanted = F.array(*(F.lit(float(x)) for x in vector))
        near = self.entries().filter(F.size("vector") > 0).withColumn("distance", padded_distance(F.col("vector"), wanted))
        return (near.filter(F.col("distance") <= within) if within is not None else near).orderBy("distance", "id")

    def prune(self, at: datetime.datetime, keep: int = 5) -> list[str]:
        """Delete all but the last ``keep`` of each schema that aren't pinned; their ids."""
        order = Window.partitionBy("schema_hash").orderBy(F.desc("at"), "id")
        old = [r["id"] for r in self.entries().filter("not pinned").withColumn("place", F.row_number().over(order)).filter(F.col("place") > keep).select("id").collect()]  # one file operation each
        return [own for own in old if self.delete(own, at)]
