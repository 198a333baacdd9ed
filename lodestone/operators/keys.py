"""Which column of which table refers to which: foreign keys found from the values alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.sources.scratch import drop_stored, stored

#: Types whose values can be keys; they read alike as text in every engine.
KEY_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.DateType)
#: Values of a column's sketch.
SKETCH = 256


@dataclass(frozen=True)
class KeyColumn:
    """A column that may be a key, or refer to one, with its number of values."""

    table: str
    column: str
    place: int
    rows: int


def _eligible(tables: dict[str, DataFrame], longest: int) -> list[KeyColumn]:
    """Columns of key types that hold a value and none of more than ``longest`` characters; one pass over each table, a row of counts each."""
    found = []
    for table, df in sorted(tables.items()):
        names = [f.name for f in df.schema.fields if isinstance(f.dataType, KEY_TYPES)]
        if names:
            seen = df.agg(*(F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(names)), *(F.max(F.length(F.col(f"`{c}`").cast("string"))).alias(f"m{i}") for i, c in enumerate(names))).first()
            found += [(table, c, seen[f"n{i}"]) for i, c in enumerate(names) if seen[f"n{i}"] and seen[f"m{i}"] <= longest]
    return [KeyColumn(table, column, place, rows) for place, (table, column, rows) in enumerate(found)]


def _pairs(values: DataFrame, columns: list[KeyColumn], share: float, sketch: int, most_distinct: int | None) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Pairs of columns that remain, child and parent, and the distinct values of each column. The driver holds columns and pairs, never values.

    A parent's values are unique. A child has more than one value, and not so many that
    the parent couldn't hold ``share`` of them. Of the child's ``sketch`` values with the
    smallest hashes, which are a uniform sample of its values, the parent must hold all but 30 percentage points
    of ``share``: with 256 values a pair that deserves to stay misses that about once in 10^15 times or less.
    """
    distinct = {r["place"]: r["n"] for r in values.groupBy("place").agg(F.count("*").alias("n")).collect()}  # a row for each column
    unique = [c.place for c in columns if distinct[c.place] == c.rows]
    children = [c.place for c in columns if distinct[c.place] > 1 and (most_distinct is None or distinct[c.place] <= most_distinct)]
    if not unique or not children:
        return [], distinct
    low = F.row_number().over(Window.partitionBy("place").orderBy("h", "v"))
    sample = values.filter(F.col("place").isin(children)).withColumn("k", F.row_number().over(Window.partitionBy("place", F.pmod("h", F.lit(64))).orderBy("h", "v"))).filter(F.col("k") <= sketch)
    sample = sample.withColumn("k", low).filter(F.col("k") <= sketch).select(F.col("place").alias("child"), "h", "v")
    met = sample.join(values.filter(F.col("place").isin(unique)).select(F.col("place").alias("parent"), "h", "v"), ["h", "v"]).groupBy("child", "parent").agg(F.count("*").alias("met"))
    kept = []
    for r in met.collect():  # a row for each pair of columns at most
        a, b = r["child"], r["parent"]
        drawn = min(sketch, distinct[a])
        if a != b and distinct[b] > share * distinct[a] and r["met"] >= (share - 0.3) * drawn:
            kept.append((a, b))
    return sorted(kept), distinct


def discover_keys(tables: dict[str, DataFrame], share: float = 0.9, most_distinct: int | None = None, longest: int = 64, sketch: int = SKETCH) -> DataFrame:
    """Pairs of columns of which the first is likely to refer to the second.

    The second's values are unique, the first has more than one value (and no more
    than ``most_distinct``), and the second holds more than ``share`` of the first's
    distinct values, compared as text. Columns of other than whole numbers, text and
    dates, and those with a value of more than ``longest`` characters, are no keys; nulls are no values.

    Returns ``child_table``, ``child_column``, ``parent_table``, ``parent_column``,
    ``distinct_values``, ``found`` and ``overlap``; no rows if nothing refers to
    anything. The distinct values of all columns are one table. Sketches of them, of a
    fixed size a column, tell which pairs can be left; all that remain are counted
    exactly in one join on column and value.
    """
    spark = next(iter(tables.values())).sparkSession
    schema = "child_table string, child_column string, parent_table string, parent_column string, distinct_values long, found long, overlap double"
    columns = _eligible(tables, longest)
    values = None
    for table in sorted({c.table for c in columns}):
        own = [c for c in columns if c.table == table]
        each = F.explode(F.array(*(F.struct(F.lit(c.place).alias("place"), F.col(f"`{c.column}`").cast("string").alias("v")) for c in own))).alias("x")
        part = tables[table].select(each).select("x.*").filter("v is not null").distinct()
        values = part if values is None else values.unionByName(part)
    if values is None:
        return spark.createDataFrame([], schema)
    values = stored(values.withColumn("h", F.xxhash64("v")), "column-values")
    pairs, distinct = _pairs(values, columns, share, sketch, most_distinct)
    if not pairs:
        drop_stored(values)
        return spark.createDataFrame([], schema)
    wanted = F.broadcast(spark.createDataFrame(pairs, "child int, parent int"))  # pairs of columns
    asked = values.withColumnRenamed("place", "child").join(wanted, "child")
    counts = asked.join(values.withColumnRenamed("place", "parent"), ["parent", "h", "v"], "left_semi").groupBy("child", "parent").agg(F.count("*").alias("found")).collect()  # a row for each pair
    drop_stored(values)
    by_place = {c.place: c for c in columns}
    rows = [(by_place[r["child"]], by_place[r["parent"]], distinct[r["child"]], r["found"]) for r in counts]
    kept = [(a.table, a.column, b.table, b.column, n, found, found / n) for a, b, n, found in rows if found > share * n]
    return spark.createDataFrame(kept, schema)
