"""Sessions, windows and alarms of events; each works on a stream and on a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from lodestone.sources.scratch import scratch_path

#: What a signal of each kind weighs; others weigh ``OTHER``.
SIGNALS = {"purchase": 1.0, "add_to_cart": 0.35, "click": 0.1, "view": 0.05}
OTHER = 0.05


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Events of Parquet files as they arrive; a trigger takes so many files at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(events: DataFrame, ts: str = "ts", late: str | None = None) -> DataFrame:
    """Events with a time column that windows accept, and a watermark for streams."""
    own = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return own.withWatermark(ts, late) if late else own


def signal_weight(kind: str = "event_type") -> Column:
    """What an event weighs."""
    weight = F.lit(OTHER)
    for name, value in SIGNALS.items():
        weight = F.when(F.col(kind) == name, value).otherwise(weight)
    return weight


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", kind: str = "event_type", timeout: str = "30 minutes") -> DataFrame:
    """Sessions of users: start, end, events and their weight; a longer pause than ``timeout`` ends one."""
    own = events.groupBy(F.session_window(ts, timeout).alias("w"), user).agg(F.count("*").alias("events"), F.sum(signal_weight(kind)).alias("weight"))
    return own.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "weight")


def capped_sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", timeout_s: int = 1_800, most_s: int = 86_400) -> DataFrame:
    """Sessions of a batch that also end after ``most_s`` seconds, counted from their first event."""
    along = Window.partitionBy(user).orderBy("t")
    own = events.select(user, F.unix_timestamp(ts).alias("t")).withColumn("fresh", F.coalesce(F.col("t") - F.lag("t").over(along) > timeout_s, F.lit(True)).cast("int"))
    placed = own.withColumn("s", F.sum("fresh").over(along)).withColumn("first", F.min("t").over(Window.partitionBy(user, "s")))
    part = F.floor((F.col("t") - F.col("first")) / most_s)
    return placed.groupBy(user, "s", part.alias("part")).agg(F.min("t").alias("start"), F.max("t").alias("last"), F.count("*").alias("events")).drop("s", "part")


def tumbling_counts(events: DataFrame, kind: str = "event_type", ts: str = "ts", width: str = "1 hour") -> DataFrame:
    """Events of each kind in each window."""
    return events.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def sliding_alarms(events: DataFrame, user: str = "user_id", ts: str = "ts", width_s: int = 10, least: int = 5) -> DataFrame:
    """Events at which a user has had ``least`` or more in the last ``width_s`` seconds."""
    near = Window.partitionBy(user).orderBy("t").rangeBetween(-width_s, 0)
    return events.select(user, "event_id", F.unix_timestamp(ts).alias("t")).withColumn("recent", F.count("*").over(near)).filter(F.col("recent") >= least)


def breaker(events: DataFrame, key: str, ts: str = "ts", least: int = 5, width_s: int = 30) -> DataFrame:
    """Times at which the last ``least`` failures of a key fell within ``width_s`` seconds, and when each may close."""
    along = Window.partitionBy(key).orderBy("t")
    own = events.select(key, F.unix_timestamp(ts).alias("t")).withColumn("back", F.lag("t", least - 1).over(along))
    return own.filter(F.col("t") - F.col("back") <= width_s).select(key, F.col("t").alias("opened"), (F.col("back") + width_s).alias("closes"))


def unique_users(events: DataFrame, user: str = "user_id", ts: str = "ts", unit: str = "day") -> DataFrame:
    """Distinct users and events of each unit of time."""
    return events.groupBy(F.date_trunc(unit, ts).alias("period")).agg(F.countDistinct(user).alias("users"), F.count("*").alias("n"))


def top_metrics(events: DataFrame, metric: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values of a metric."""
    return events.groupBy(metric).agg(F.count("*").alias("n")).orderBy(F.desc("n"), metric).limit(k)


def to_memory(stream: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """Run a stream into a table in memory until its input is used up; for tests and previews."""
    running = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    running.awaitTermination()
    return running


def complete_result(stream: DataFrame, name: str) -> DataFrame:
    """The whole result of an aggregated stream once its input is used up, however long that takes.

    Each trigger replaces the files of the one before, below ``spark.checkpoint.dir``; a
    stream that fails raises its own error.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, name)

    def replace(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows")

    replace(spark.createDataFrame([], stream.schema), -1)  # a stream without any input has no trigger
    running = stream.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
