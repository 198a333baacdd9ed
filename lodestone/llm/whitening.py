"""Embedding whitening from an exact integer scatter.

Entries become integers. Every task subtracts a shift and adds up, in arbitrary
precision, its rows, its sums and its cross products; n XX' - SS' is then formed
exactly, and only its ratio to n squared becomes a float, rounded once, which eigh
decomposes. Nothing is lost to cancellation however far the data lie from zero,
and the result depends neither on the order of the rows nor on the shift.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of the parts in which integers are multiplied: products of two, added up over a batch, are exact in doubles.
PART = 18
#: Rows whose products are added up in doubles.
STEP = 1 << 16
#: Bits of the parts in which sums travel; longs add up the parts of millions of tasks.
SENT = 40


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, no entry null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * c) of each entry for a ``scale`` that is a power of two, as int64, or as Python's integers where those don't hold it."""
    with np.errstate(over="ignore"):
        floor = np.floor(values * float(scale))
    if not len(floor) or np.abs(floor).max() < 2.0**61:
        return floor.astype(np.int64)
    own = [int(c) * scale if abs(c) >= 2.0**53 else int(np.floor(c * scale)) for c in values.ravel().tolist()]
    return np.array(own, object).reshape(values.shape)


def widened(x: np.ndarray, *factors: int) -> np.ndarray:
    """``x`` as Python's integers if its product with the factors may not fit int64."""
    most = max((abs(int(v)) for v in (x.max(), x.min())), default=0) if x.size else 0
    for f in factors:
        most *= abs(f) + 1
    return x.astype(object) if most >= 1 << 62 else x


def parts_of(z: np.ndarray) -> list[np.ndarray]:
    """Doubles p0, p1, ... with z = p0 + 2^18 p1 + 2^36 p2 + ..., exactly; only the last may be negative, or all if one is enough."""
    out = []
    while max(abs(int(z.max())), abs(int(z.min()))) >> PART:
        out.append((z & ((1 << PART) - 1)).astype(np.float64))
        z = z >> PART
    return [*out, z.astype(np.float64)]


def gram(z: np.ndarray) -> np.ndarray:
    """Exact cross products of the columns of integers, as Python's integers."""
    total = np.zeros((z.shape[1], z.shape[1]), object)
    for at in range(0, len(z), STEP):
        parts = parts_of(z[at : at + STEP])
        for k, left in enumerate(parts):
            for l, right in enumerate(parts):
                total += (left.T @ right).astype(np.int64).astype(object) << (PART * (k + l))
    return total


@dataclass(frozen=True)
class Scatter:
    """Rows, their sums, and n XX' - SS', after a shift was subtracted."""

    n: int
    shift: np.ndarray
    sums: np.ndarray
    scatter: np.ndarray


@dataclass(frozen=True)
class Whitening:
    """Directions (dim x k) and eigenvalues of the covariance, largest first; ``shares`` of the trace; in units of 2^``unit``."""

    directions: np.ndarray
    values: np.ndarray
    shares: np.ndarray
    unit: int

    @property
    def solid(self) -> np.ndarray:
        """Which components have any variance at all."""
        return self.values > 0


def _sent(i: int, j: int, value: int) -> Iterator[tuple[int, int, int, int]]:
    """An integer as parts that fit longs and can be added up one by one."""
    part = 0
    while abs(value) >> SENT:
        yield i, j, part, value & ((1 << SENT) - 1)
        value, part = value >> SENT, part + 1
    yield i, j, part, value


def scatter(vectors: DataFrame, dim: int, scale: int) -> Scatter:
    """Exact scatter of column ``v``; the number of partial sums is that of the tasks times the square of the dimension."""
    first = vectors.select("v").first()
    shift = integers(np.array([first["v"]], float), scale)[0]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            z = widened(integers(batch.column(0).flatten().to_numpy().reshape(-1, dim), scale), 2)
            z = z - (shift if z.dtype != object else shift.astype(object))
            n += len(z)
            sums += widened(z, len(z)).sum(axis=0).astype(object)
            cross += gram(z)
        if n:
            rows = [*_sent(-1, -1, n)]
            for i in range(dim):
                rows += _sent(i, -1, int(sums[i]))
                for j in range(i, dim):
                    rows += _sent(i, j, int(cross[i, j]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["i", "j", "part", "value"])

    total = vectors.select("v").mapInArrow(add, "i int, j int, part int, value long").groupBy("i", "j", "part").agg(F.sum("value").alias("value")).toArrow()  # the square of the dimension
    n, sums, cross = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
    for i, j, part, value in zip(*(total[c].to_pylist() for c in ("i", "j", "part", "value")), strict=True):
        value <<= SENT * part
        if i < 0:
            n += value
        elif j < 0:
            sums[i] += value
        else:
            cross[i, j] += value
            if i != j:
                cross[j, i] += value
    return Scatter(n, shift, sums, n * cross - np.outer(sums, sums))


def decomposed(own: Scatter, components: int) -> Whitening:
    """Eigenvectors of the covariance by falling eigenvalue, the largest entry of each positive; eigenvalues lost in rounding are 0."""
    square = own.n * own.n
    unit = max(0, (max(int(v) for v in own.scatter.diagonal()).bit_length() - square.bit_length() - 900 + 1) // 2)
    covariance = np.array([[int(v) / (square << 2 * unit) for v in row] for row in own.scatter], float)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0)[0] < 0, -1.0, 1.0)
    values = np.where(values > values[0] * len(values) * np.finfo(float).eps, values, 0.0)
    trace = float(np.trace(covariance))
    return Whitening(vectors[:, :components], values[:components], values[:components] / trace if trace > 0 else np.zeros(components), unit)


def centred(values: np.ndarray, own: Scatter, scale: int) -> np.ndarray:
    """n x - S of each entry, exactly."""
    z = widened(integers(values, scale), 2)
    top = max((abs(int(v)) for v in [*own.shift, *own.sums]), default=0)
    z = widened(z, own.n)
    if z.dtype == object or top * (own.n + 1) >= 1 << 61:
        return (z.astype(object) - own.shift.astype(object)) * own.n - own.sums
    return (z - own.shift.astype(np.int64)) * own.n - own.sums.astype(np.int64)


def squares(d: np.ndarray) -> list[int]:
    """Exact sum of the squares of each row of integers."""
    if d.dtype == object or max(abs(int(d.max())), abs(int(d.min()))) >= 1 << 51 or d.shape[1] > 1 << 9:
        return [sum(int(x) * int(x) for x in row) for row in d]
    high, low = d >> 26, d & ((1 << 26) - 1)
    return [(a << 52) + (b << 27) + c for a, b, c in zip((high * high).sum(1).tolist(), (high * low).sum(1).tolist(), (low * low).sum(1).tolist(), strict=True)]


def projected(d: np.ndarray, own: Scatter, by: Whitening) -> np.ndarray:
    """Rows on the components, each over the root of its eigenvalue; NaN where that is 0."""
    if d.dtype == object:
        off = np.array([[int(x) / (own.n << by.unit) for x in row] for row in d], float)
    else:
        off = d / float(own.n) / 2.0**by.unit
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(by.solid, (off @ by.directions) / np.sqrt(by.values), np.nan)


def identity_error(vectors: DataFrame, dim: int, scale: int, own: Scatter, by: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened rows less the identity, over components with variance; None without one."""
    solid = np.flatnonzero(by.solid)
    if not len(solid):
        return None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(solid)
        sums, cross = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = projected(centred(batch.column(0).flatten().to_numpy().reshape(-1, dim), own, scale), own, by)[:, solid]
                sums, cross = sums + w.sum(axis=0), cross + w.T @ w
        i, j = np.meshgrid(np.arange(k), np.arange(-1, k), indexing="ij")
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(np.column_stack([sums, cross]).ravel())], names=["i", "j", "value"])

    rows = vectors.select("v").mapInArrow(add, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()  # the square of the components
    mean, cross = np.zeros(len(solid)), np.zeros((len(solid), len(solid)))
    for r in rows:
        if r["j"] < 0:
            mean[r["i"]] = r["value"] / own.n
        else:
            cross[r["i"], r["j"]] = r["value"] / own.n
    return float(np.abs(cross - np.outer(mean, mean) - np.eye(len(solid))).max())


def whiten(embeddings: DataFrame, components: int = 8, scale: int = 1_024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of every vector on the leading components of the covariance of all.

    Each entry c counts as the integer floor(``scale`` * c), ``scale`` being a power of
    two; adding a constant to all of them changes nothing below. Returns for each row
    and component from 1, by falling eigenvalue: the id, ``component``, ``n`` (vectors),
    ``deviation`` (sum over dimensions of (n x - S)^2, exact; null if no long holds it)
    and ``deviation_exact`` (the same as a decimal of 38 digits, null beyond),
    ``whitened``, ``explained`` (share of the trace) and ``identity_error`` (one value).

    Vectors that are null, empty, or hold null or non-finite entries are dropped, and so
    are those of another length than most (ties: the shorter). All others are fitted on
    and returned, zero vectors and repeated rows and ids among them; null ids stay null.
    A component without variance explains 0 and has no ``whitened`` (null); if none has
    any, ``identity_error`` is null. Vectors of fewer entries have fewer components.
    Other columns are ignored. Without vectors there are no rows.
    """
    spark = embeddings.sparkSession
    kind = embeddings.schema[id_col].dataType
    columns = {id_col: kind, "component": T.IntegerType(), "n": T.LongType(), "deviation": T.LongType(), "whitened": T.DoubleType(), "explained": T.DoubleType(), "identity_error": T.DoubleType(), "deviation_exact": T.DecimalType(38, 0)}
    schema = T.StructType([T.StructField(name, own_kind) for name, own_kind in columns.items()])
    vectors = embeddings.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("v")).filter(usable(F.col("v")))
    lengths = vectors.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths["dim"]
    vectors = vectors.filter(F.size("v") == dim)
    own = scatter(vectors, dim, scale)
    by = decomposed(own, min(components, dim))
    error = identity_error(vectors, dim, scale, own, by)
    k = len(by.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4_096):
                batch = whole.slice(at, 4_096)
                rows = batch.num_rows
                d = centred(batch.column(1).flatten().to_numpy().reshape(-1, dim), own, scale)
                each = pa.array(np.repeat(np.arange(rows), k))
                deviation = squares(d)
                made = [
                    batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, own.n), pa.int64()),
                    pa.array([x if x < 1 << 63 else None for x in deviation], pa.int64()).take(each), pa.array(projected(d, own, by).ravel(), from_pandas=True), pa.array(np.tile(by.shares, rows)),
                    pa.array([error] * (rows * k), pa.float64()), pa.array([Decimal(x) if x < 10**38 else None for x in deviation], pa.decimal128(38)).take(each),
                ]
                yield pa.RecordBatch.from_arrays(made, names=schema.names)

    return vectors.select(id_col, "v").mapInArrow(project, schema)
