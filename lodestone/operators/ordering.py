"""Places of rows in one order over a whole table, without a task that holds the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.sources.scratch import stored


def numbered(df: DataFrame, order: Sequence[str], name: str = "rn") -> DataFrame:
    """``df`` with the place of each row, from 1, in the order of some columns (whose ties may go either way).

    Rows are dealt by ranges of the order and sorted there; the rows of the ranges before are added. Only a count for
    each range meets in one place.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = stored(dealt, "numbered")
    part = F.shiftright("__at", 33)
    counts = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("__part", before.alias("__before")))  # a row for each range
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.withColumn("__part", part).join(starts, "__part").withColumn(name, place).drop("__part", "__at", "__before")


#: Rows in a row that are handled together where neighbours matter.
BLOCK = 8_192


def in_blocks(placed: DataFrame, reach: int, rn: str = "rn", size: int = BLOCK) -> DataFrame:
    """Rows of ``numbered`` in blocks of ``size`` in a row, each with copies of the ``reach`` rows before it: ``__block`` and ``__copy``.

    So a row and those up to ``reach`` before it are always in one block, at the cost of one exchange, and no block grows with the table.
    """
    size = max(size, reach)
    block, place = F.floor((F.col(rn) - 1) / size), (F.col(rn) - 1) % size
    own, copy = F.struct(block.alias("b"), F.lit(False).alias("c")), F.struct((block + 1).alias("b"), F.lit(True).alias("c"))
    return placed.withColumn("__to", F.explode(F.when(place >= size - reach, F.array(own, copy)).otherwise(F.array(own)))).withColumn("__block", F.col("__to.b")).withColumn("__copy", F.col("__to.c")).drop("__to")


def before(placed: DataFrame, column: str, name: str, rn: str = "rn") -> DataFrame:
    """Rows of ``numbered`` with the value of a column in the row before; the first row goes."""
    along = Window.partitionBy("__block").orderBy(rn)
    near = in_blocks(placed, 1, rn).withColumn(name, F.lag(column).over(along))
    return near.filter(~F.col("__copy") & (F.col(rn) > 1)).drop("__block", "__copy")


def tile(place: Column, rows: Column, tiles: int) -> Column:
    """Number, from 1, of the tile of a place: tiles are of equal size, the first ones larger by one where rows are left over."""
    size, over = F.floor(rows / tiles), rows % tiles
    edge = over * (size + 1)
    return F.when(place <= edge, F.floor((place - 1) / (size + 1))).otherwise(over + F.floor(F.try_divide(place - 1 - edge, size))).cast("int") + 1


def middle(df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles of a column's values, by linear interpolation: a row for each group of ``by`` and share.

    Equal values are counted together first; then running counts over ranges of the values tell where each percentile
    lies. No task holds a group's values.
    """
    counts = df.select(*by, F.col(column).cast("double").alias("v")).filter("v is not null").groupBy(*by, "v").agg(F.count("*").alias("n"))
    dealt = stored(counts.repartitionByRange(*by, "v").sortWithinPartitions(*by, "v").withColumn("__part", F.spark_partition_id()), "value-counts")
    ranges = dealt.groupBy(*by, "__part").agg(F.sum("n").alias("rows"))
    along = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(ranges.select(*by, "__part", F.coalesce(F.sum("rows").over(along), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy(*by)).alias("total")))  # a row for each range and group
    within = F.coalesce(F.sum("n").over(Window.partitionBy("__part", *by).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("within", within).join(starts, [*by, "__part"]).withColumn("first", F.col("before") + F.col("within"))
    wanted = placed.withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares)))).withColumn("at", F.col("share") * (F.col("total") - 1))
    low, high = F.floor("at"), F.ceil("at")
    holds = lambda rank: (F.col("first") <= rank) & (rank < F.col("first") + F.col("n"))
    found = wanted.filter(holds(low) | holds(high)).groupBy(*by, "share").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("at").alias("at"))
    return found.select(*by, "share", (F.col("lo") + (F.col("at") - F.floor("at")) * (F.col("hi") - F.col("lo"))).alias("value"))


def percentiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], slack: float = 5e-4, accuracy: int = 10_000) -> DataFrame:
    """Exact percentiles of columns, by linear interpolation: ``column_name``, ``share``, ``value``; none for a column of nulls.

    A sketch brackets each percentile; then the values below the bracket are counted and
    those within it, a few in ten thousand, ordered. Whether a bracket holds what it should is
    checked by those counts; a column for which one doesn't goes through ``middle``.
    """
    spark = df.sparkSession
    own = df.select(*(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    asked = [F.lit(p) for s in shares for p in (max(s - slack, 0.0), min(s + slack, 1.0))]
    sketch = own.agg(*(F.percentile_approx(f"c{i}", F.array(*asked), F.lit(accuracy)).alias(f"b{i}") for i in range(len(columns))), *(F.count(f"c{i}").alias(f"n{i}") for i in range(len(columns)))).first()  # some numbers a column
    brackets = {}
    for i in range(len(columns)):
        for k, s in enumerate(shares):
            if sketch[f"n{i}"]:
                low, high = sketch[f"b{i}"][2 * k : 2 * k + 2]
                brackets[i, k] = (None if s <= slack else low, None if s >= 1 - slack else high)
    schema = "column_name string, share double, value double"
    if not brackets:
        return spark.createDataFrame([], schema)

    def side(i: int, k: int) -> tuple[Column, Column]:
        value, (low, high) = F.col(f"c{i}"), brackets[i, k]
        return F.lit(False) if low is None else value < low, (F.lit(True) if low is None else value >= low) & (F.lit(True) if high is None else value <= high)

    counted = own.agg(*(F.count_if(x & F.col(f"c{i}").isNotNull()).alias(f"{name}{i}_{k}") for i, k in brackets for name, x in zip(("below", "inside"), side(i, k), strict=True))).first()
    wanted, missed = [], set()
    for i, k in brackets:
        at = shares[k] * (sketch[f"n{i}"] - 1)
        below, inside = counted[f"below{i}_{k}"], counted[f"inside{i}_{k}"]
        if below <= int(at) and -int(-at // 1) < below + inside:
            wanted.append((i, k, columns[i], float(shares[k]), int(at) - below, -int(-at // 1) - below, at - int(at)))
        else:
            missed.add(i)
    wanted = F.broadcast(spark.createDataFrame([w for w in wanted if w[0] not in missed], "i int, k int, column_name string, share double, low long, high long, part double"))  # a row for each column and share
    near = own.select(F.explode(F.array_compact(F.array(*(F.when(side(i, k)[1] & F.col(f"c{i}").isNotNull(), F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.col(f"c{i}").alias("v"))) for i, k in brackets)))).alias("x")).select("x.*")
    values = near.groupBy("i", "k", "v").agg(F.count("*").alias("n"))
    along = Window.partitionBy("i", "k").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.col("upto") - F.col("n")
    holds = lambda rank: (first <= F.col(rank)) & (F.col(rank) < F.col("upto"))
    found = values.withColumn("upto", F.sum("n").over(along)).join(wanted, ["i", "k"]).filter(holds("low") | holds("high"))
    out = found.groupBy("column_name", "share").agg((F.min("v") + F.first("part") * (F.max("v") - F.min("v"))).alias("value"))
    if missed:
        names = [columns[i] for i in sorted(missed)]
        long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("value")) for c in names))).alias("p")).select("p.*")
        out = out.unionByName(middle(long, "value", shares, ["column_name"]))
    return out
