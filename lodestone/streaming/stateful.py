"""Keyed state with timers: sessions that expire, and a window of signals, as streams.

Events reach a stream in any order within the watermark's delay. Both processors
here hold an event back until the watermark has passed it, take what is due in the
order of time, and set a timer for what is to happen next; so their results don't
depend on how the input was cut into triggers. State is bounded by the events of
the delay and, a key, by one open session or one ring of signals.

Expired sessions are merged into persistent profiles once each: every trigger
writes what it adds under its own number, which a repeated trigger overwrites.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from lodestone.sources.scratch import drop_path, drop_stored, list_done, stored
from lodestone.streaming.sessions import signal_weight

#: What ends a session (a pause, and its greatest length), and the window of signals (how many, how old), in seconds.
TIMEOUT, LONGEST = 1_800, 86_400
CAPACITY, AGE = 1_000, 60


class InOrder(StatefulProcessor):
    """Takes a key's events in the order of their times, each once the watermark has passed it.

    A subclass says what an ``event`` (microseconds, then the row's other values)
    does to the state of its key, a dict, and what the state gives when the
    watermark has passed a time and nothing else is due (``settled``), with the next
    time at which to ask again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "content string")
        self.waiting = handle.getListState("waiting", "event string")

    def event(self, state: dict, event: list) -> Iterator[dict]:
        raise NotImplementedError

    def settled(self, state: dict, until: int) -> tuple[list[dict], int | None]:
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for batch in rows:
            events = batch.values.tolist()  # t in microseconds comes first
            self.waiting.appendList([(json.dumps(e),) for e in events])
            first = min([e[0] for e in events] + ([first] if first is not None else []))
        if first is not None:
            self.handle.registerTimer(-(-int(first) // 1_000))
        yield self.table([])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs() * 1_000
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        waiting = [json.loads(e[0]) for e in self.waiting.get()]
        due = sorted(e for e in waiting if e[0] <= until)
        later = [e for e in waiting if e[0] > until]
        found = [row for e in due for row in self.event(state, e)]
        more, ask = self.settled(state, until)
        if due:
            self.waiting.clear()
            if later:
                self.waiting.appendList([(json.dumps(e),) for e in later])
        self.state.update((json.dumps(state),)) if state else self.state.clear()
        for at in (min((e[0] for e in later), default=None), ask):
            if at is not None:
                self.handle.registerTimer(-(-int(at) // 1_000))
        yield self.table([{"key": key[0]} | row for row in found + more])

    def table(self, rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.columns)

    def close(self) -> None:
        pass


class Sessions(InOrder):
    """Sessions of a key: a pause ends one, and so does its greatest length, counted from its first event."""

    columns = ["key", "start", "last", "signals", "carts", "weight", "interests"]

    def __init__(self, timeout: int, longest: int):
        self.timeout, self.longest = timeout * 1_000_000, longest * 1_000_000

    def event(self, state: dict, event: list) -> Iterator[dict]:
        t, category, weight, cart = event
        if state and t - state["last"] > self.timeout:
            yield from self.ended(state)
            state.clear()
        if not state:
            state |= {"first": t, "part": 0, "signals": 0}
        part = (t - state["first"]) // self.longest
        if part != state["part"]:
            yield from self.ended(state)
            state["part"] = part
        if not state["signals"]:
            state |= {"start": t, "signals": 0, "carts": 0, "weight": 0.0, "interests": {}}
        state["last"] = t
        state["signals"] += 1
        state["carts"] += cart
        state["weight"] += weight
        state["interests"][category] = state["interests"].get(category, 0.0) + weight

    def ended(self, state: dict) -> Iterator[dict]:
        if state["signals"]:
            yield {n: state[n] for n in self.columns[1:-1]} | {"interests": json.dumps(state["interests"])}
            state["signals"] = 0

    def settled(self, state: dict, until: int) -> tuple[list[dict], int | None]:
        if not state:
            return [], None
        pause, end = state["last"] + self.timeout, state["first"] + (state["part"] + 1) * self.longest
        found = list(self.ended(state)) if min(pause, end) <= until else []
        if pause <= until:
            state.clear()
            return found, None
        return found, min(pause, end) if state["signals"] else pause


class Signals(InOrder):
    """The last signals of a key, so many and so old at most; an alarm whenever there are enough within a width."""

    columns = ["key", "event_id", "t", "recent"]

    def __init__(self, width: int, least: int, capacity: int, age: int):
        self.width, self.least, self.capacity, self.age = width * 1_000_000, least, capacity, age * 1_000_000

    def event(self, state: dict, event: list) -> Iterator[dict]:
        t, event_id = event
        ring = [x for x in state.get("ring", []) if x >= t - self.age]
        ring = [*ring, t][-self.capacity :]
        state["ring"] = ring
        recent = sum(x >= t - self.width for x in ring)
        if recent >= self.least:
            yield {"event_id": event_id, "t": t, "recent": recent}

    def settled(self, state: dict, until: int) -> tuple[list[dict], int | None]:
        if not state:
            return [], None
        gone = state["ring"][-1] + self.age + 1_000  # then every signal is too old for whatever may come
        if gone <= until:
            state.clear()
            return [], None
        return [], gone


@contextmanager
def rocks_db(spark: SparkSession) -> Iterator[None]:
    """State with timers needs this provider; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def expired_sessions(stream: DataFrame, key: str = "user_id", ts: str = "ts", kind: str = "event_type", carts: tuple[str, ...] = ("add_to_cart",), timeout: int = TIMEOUT, longest: int = LONGEST) -> DataFrame:
    """Sessions of a stream with a watermark, each once when the watermark says that it is over.

    A row a session: key, ``start`` and ``last`` event, ``signals``, ``carts`` among
    them, ``weight`` of all, and ``interests``, the weight of each kind. Events without
    a key or a time belong to none; those later than the watermark are lost, as in
    every stream. Ties go by the event's kind. Other columns are ignored.
    """
    own = stream.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("__key", F.col(key))
    events = own.select("__key", F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.coalesce(F.col(kind), F.lit("")).alias("category"), signal_weight(kind).alias("weight"), F.coalesce(F.col(kind).isin(*carts), F.lit(False)).cast("int").alias("cart"), ts)
    kept = ["t", "category", "weight", "cart"]

    class Own(Sessions):
        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            return super().handleInputRows(key, (b[kept] for b in rows), timerValues)

    kind_of = stream.schema[key].dataType.simpleString()
    closed = events.groupBy("__key").transformWithStateInPandas(Own(timeout, longest), f"key {kind_of}, start long, last long, signals long, carts long, weight double, interests string", "Append", "EventTime")
    return closed.select(F.col("key").alias(key), F.timestamp_micros("start").alias("start"), F.timestamp_micros("last").alias("last"), "signals", "carts", "weight", F.from_json("interests", "map<string, double>").alias("interests"))


def signal_alarms(stream: DataFrame, key: str = "user_id", ts: str = "ts", event_id: str = "event_id", width: int = 10, least: int = 5, capacity: int = CAPACITY, age: int = AGE) -> DataFrame:
    """Events of a stream with a watermark at which a key has had ``least`` signals or more within ``width`` seconds.

    A key's window holds its last ``capacity`` signals of the last ``age`` seconds. Ties
    of time go by id. Events without a key, id or time count nowhere.
    """
    own = stream.filter(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(event_id).isNotNull()).withColumn("__key", F.col(key))
    events = own.select("__key", F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(event_id).alias("id"), ts)

    class Own(Signals):
        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            return super().handleInputRows(key, (b[["t", "id"]] for b in rows), timerValues)

    kinds = [stream.schema[c].dataType.simpleString() for c in (key, event_id)]
    found = events.groupBy("__key").transformWithStateInPandas(Own(width, least, capacity, age), f"key {kinds[0]}, event_id {kinds[1]}, t long, recent long", "Append", "EventTime")
    return found.select(F.col("key").alias(key), F.col("event_id").alias(event_id), F.timestamp_micros("t").alias("at"), "recent")


def sessions_of_batch(events: DataFrame, until: object, key: str = "user_id", ts: str = "ts", kind: str = "event_type", carts: tuple[str, ...] = ("add_to_cart",), timeout: int = TIMEOUT, longest: int = LONGEST) -> DataFrame:
    """What ``expired_sessions`` gives of a whole table once its watermark (a column or value in microseconds) has come to ``until``."""
    own = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.coalesce(F.col(kind), F.lit("")).alias("category"), signal_weight(kind).alias("w"), F.coalesce(F.col(kind).isin(*carts), F.lit(False)).cast("long").alias("cart"))
    along = Window.partitionBy(key).orderBy("t")
    numbered = own.withColumn("fresh", F.coalesce(F.col("t") - F.lag("t").over(along) > timeout * 1_000_000, F.lit(True)).cast("int")).withColumn("s", F.sum("fresh").over(along))
    placed = numbered.withColumn("first", F.min("t").over(Window.partitionBy(key, "s"))).withColumn("final", F.max("t").over(Window.partitionBy(key, "s")))
    part = F.floor((F.col("t") - F.col("first")) / (longest * 1_000_000))
    kinds = placed.groupBy(key, "s", part.alias("part"), "category").agg(F.min("t").alias("start"), F.max("t").alias("last"), F.count("*").alias("n"), F.sum("cart").alias("carts"), F.sum("w").alias("w"), F.min("first").alias("first"))
    out = kinds.groupBy(key, "s", "part").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n").alias("signals"), F.sum("carts").alias("carts"), F.sum("w").alias("weight"), F.map_from_entries(F.collect_list(F.struct("category", "w"))).alias("interests"), F.min("first").alias("first"))
    over = F.least(F.col("last") + timeout * 1_000_000, F.col("first") + (F.col("part") + 1) * (longest * 1_000_000)) <= until
    return out.filter(over).select(key, F.timestamp_micros("start").alias("start"), F.timestamp_micros("last").alias("last"), "signals", "carts", "weight", "interests")


def merged_profiles(parts: DataFrame, key: str) -> DataFrame:
    """Profiles that several parts add to: counters add up, of an interest the highest counts, and of times the last."""
    counters = parts.groupBy(key).agg(*(F.sum(c).alias(c) for c in ("sessions", "signals", "carts")), F.max("last_seen").alias("last_seen"))
    interests = parts.select(key, F.explode("interests").alias("category", "score")).groupBy(key, "category").agg(F.max("score").alias("score"))
    maps = interests.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("category", "score"))).alias("interests"))
    return counters.join(maps, key, "left").select(key, "sessions", "signals", "carts", "last_seen", F.coalesce("interests", F.create_map().cast("map<string, double>")).alias("interests"))


class ProfileLog:
    """Persistent profiles as a log: what each trigger adds, in a folder of its own, and now and then all so far in one.

    Writing a trigger's folder again replaces it, so a trigger that is repeated after a
    failure adds nothing twice; folders without Spark's mark of success don't count.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, kind: str, every: int = 16):
        self.spark, self.path, self.key, self.every = spark, path, key, every
        self.schema = f"{key} {kind}, sessions long, signals long, carts long, last_seen timestamp, interests map<string, double>"

    def _parts(self, until: int | None = None) -> tuple[int, list[str]]:
        """The last folder with all so far, and the folders that hold the profiles together, up to a trigger."""
        done = [(name.partition("=")[0], int(name.partition("=")[2])) for name in list_done(self.spark, self.path) if "=" in name]
        inside = [(kind, n) for kind, n in done if until is None or n <= until]
        base = max((n for kind, n in inside if kind == "all"), default=-1)
        return base, [f"{self.path}/{kind}={n}" for kind, n in inside if (kind, n) == ("all", base) or (kind == "added" and n > base)]

    def read(self, until: int | None = None) -> DataFrame:
        """All profiles."""
        parts = self._parts(until)[1]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return merged_profiles(self.spark.read.schema(self.schema).parquet(*parts), self.key)

    def add(self, closed: DataFrame, batch: int) -> None:
        """Merge a trigger's expired sessions: columns as of ``expired_sessions``, with the profile's key."""
        own = closed.filter(F.col(self.key).isNotNull() & (F.col("signals") > 0)).select(self.key, F.lit(1).cast("long").alias("sessions"), "signals", "carts", F.col("last").alias("last_seen"), "interests")
        merged_profiles(own, self.key).write.mode("overwrite").parquet(f"{self.path}/added={batch}")
        if (batch + 1) % self.every == 0:
            before = self._parts(batch - 1)[0]
            parts = [f"{self.path}/all={before}"] * (before >= 0) + [f"{self.path}/added={n}" for n in range(before + 1, batch + 1)]
            merged_profiles(self.spark.read.schema(self.schema).parquet(*parts), self.key).write.mode("overwrite").parquet(f"{self.path}/all={batch}")
            for name in list_done(self.spark, self.path):  # what the folder before the last one had taken in
                if "=" in name and int(name.partition("=")[2]) < before + name.startswith("added"):
                    drop_path(self.spark, f"{self.path}/{name}")


def elevate(closed: DataFrame, links: DataFrame, path: str, key: str = "user_id", profile: str = "profile_id", every: int = 16, after: Callable[[int], None] = lambda batch: None) -> ProfileLog:
    """Merge the expired sessions of a stream into persistent profiles, until its input is used up.

    ``links`` has the profile of each key that has one; sessions of others are passed
    over. Progress and profiles lie below ``path``; called again, it goes on from
    there. ``after`` is called when a trigger's merge is written.
    """
    spark = closed.sparkSession
    log = ProfileLog(spark, f"{path}/profiles", profile, links.schema[profile].dataType.simpleString(), every)
    linked = links.select(F.col(key), F.col(profile)).filter(F.col(profile).isNotNull())

    def merge(rows: DataFrame, batch: int) -> None:
        # what the state gives is read from files: a second reading would run the state's step again
        own = stored(rows, "elevation-closed")
        # as many links as users: joined by their key, never sent to every task by way of the driver
        log.add(own.join(linked.hint("merge"), key), batch)
        drop_stored(own)
        after(batch)

    with rocks_db(spark):
        running = closed.writeStream.outputMode("append").foreachBatch(merge).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
        running.awaitTermination()
    return log


def appended(stream: DataFrame, path: str) -> DataFrame:
    """The rows of a stream with keyed state once its input is used up, from files below ``path``."""
    spark = stream.sparkSession
    with rocks_db(spark):
        running = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
        running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
