"""Whitening of embeddings by a covariance in which each distinct vector counts as often as it occurs.

Entries are put on an integer grid first, so equal vectors are equal exactly and sums are exact. Identical vectors are
grouped, the groups' counts (or ones) weigh the centred products, each distinct vector is whitened once, and rows get
theirs back by a join. A third of all rows being one vector costs one row after the first partial count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.tokens import batched
from gleaner.session import stored

STEPS = 64  # of the grid, to one
SHIFT = 1_000_000
LIMIT = float(1 << 53)  # beyond it the grid has no place of its own for an entry
PARTS = 16  # tasks that add up partial sums, and what the driver receives of them


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: weight in all, sums by dimension, components in columns with their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return (self.values / self.trace).tolist() if len(self.values) else []


def grid(vector: str):
    """The integer vector of a row; null if the vector is null or has an entry that is null, no number or off the grid."""
    entry = lambda c: c.cast("double")
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(entry(c)) & (F.abs(entry(c)) < LIMIT / STEPS))
    return F.when(good, F.transform(vector, lambda c: F.floor(entry(c) * STEPS) + SHIFT))


def _key():
    """32 bytes that stand for a vector."""
    return F.unhex(F.sha2(F.array_join(F.transform("x", lambda c: c.cast("string")), ","), 256))


def _matrix(column: pa.ListArray, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def summed(df: DataFrame, add: Callable[[pa.RecordBatch], list[np.ndarray]]) -> list[np.ndarray] | None:
    """Arrays added up over all batches; none of no rows. Tasks add their own, some tasks add those, the driver the rest."""

    def total(parts: Iterable[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        got = None
        for p in parts:
            got = p if got is None else [a + b for a, b in zip(got, p)]
        rows = [] if got is None else [(k, a.tobytes(), a.dtype.str) for k, a in enumerate(got)]
        cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.string()))]
        # One row for a task, so that its arrays stay together.
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_pylist()], pa.list_(c.type)) for c in cols], ["at", "bytes", "kind"])

    def opened(row: dict) -> list[np.ndarray]:
        return [np.frombuffer(b, k) for b, k in zip(row["bytes"], row["kind"])]

    kind = T._parse_datatype_string("at array<int>, bytes array<binary>, kind array<string>")
    first = df.mapInArrow(lambda bs: total(add(b) for b in batched(bs) if b.num_rows), kind)
    second = first.repartition(PARTS).mapInArrow(lambda bs: total(opened(r) for b in bs for r in b.to_pylist()), kind)
    got = None
    for row in second.collect():
        part = opened(row.asDict())
        got = part if got is None else [a + b for a, b in zip(got, part)]
    return got


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: of 64-bit integers where these hold it, else of Python's."""
    if n * float(np.abs(x).max(initial=0)) < 2.0**62:
        return x * n - sums
    return x.astype(object) * n - sums.astype(object)


def _deviation(centred: np.ndarray) -> list[int]:
    if centred.dtype != object and centred.shape[1] * float(np.abs(centred).max(initial=0)) ** 2 < 2.0**62:
        return (centred * centred).sum(axis=1).tolist()
    return (centred.astype(object) ** 2).sum(axis=1).tolist()


def fit(distinct: DataFrame, weights: str = "counts", most: int = 32) -> Whitening:
    """Sums, covariance and components of distinct vectors `x` with their `copies`.

    `weights`: `counts`, each vector as often as it occurs, or `one`. Components without variance (to double
    precision) are left out, so a table of one vector has none.
    """
    if weights not in ("counts", "one"):
        raise ValueError(f"no such weights: {weights}")
    rows = distinct.select("x", (F.col("copies") if weights == "counts" else F.lit(1).cast("long")).alias("w"))

    def first(b: pa.RecordBatch) -> list[np.ndarray]:
        x, w = _matrix(b.column(0), np.int64), b.column(1).to_numpy()
        return [np.array([w.sum()], np.int64), (x * w[:, None]).sum(axis=0)]

    got = summed(rows, first)
    if got is None:
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0)
    n, sums = int(got[0][0]), got[1]

    def second(b: pa.RecordBatch) -> list[np.ndarray]:
        x, w = _matrix(b.column(0), np.int64), b.column(1).to_numpy()
        c = _centred(x, n, sums).astype(np.float64) / n
        return [((c * w[:, None]).T @ c).ravel()]

    d = len(sums)
    v = summed(rows, second)[0].reshape(d, d) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = values > max(values.max(initial=0), 0) * d * np.finfo(float).eps * 4
    some &= np.arange(d) < most
    return Whitening(n, tuple(sums.tolist()), np.ascontiguousarray(vectors[:, some]), values[some], float(np.trace(v)))


def identity_error(white: DataFrame, n: int, weights: str = "counts") -> float:
    """The largest entry of the whitened covariance less the identity, over the fit list."""
    rows = white.select("whitened", (F.col("copies") if weights == "counts" else F.lit(1).cast("long")).alias("w"))
    if not n:
        return 0.0

    def first(b: pa.RecordBatch) -> list[np.ndarray]:
        return [(_matrix(b.column(0), np.float64) * b.column(1).to_numpy()[:, None]).sum(axis=0)]

    mean = summed(rows, first)[0] / n

    def second(b: pa.RecordBatch) -> list[np.ndarray]:
        z = _matrix(b.column(0), np.float64) - mean
        return [((z * b.column(1).to_numpy()[:, None]).T @ z).ravel()]

    k = len(mean)
    return float(np.abs(summed(rows, second)[0].reshape(k, k) / n - np.eye(k)).max(initial=0.0))


def whitened(rows: DataFrame, key: str, vector: str, weights: str = "counts", most: int = 32) -> tuple[DataFrame, Whitening, float]:
    """key, deviation, whitened (an array, by component) for every row that is kept; what was fitted; identity error.

    Rows whose vector is null, or holds a null, a NaN, an infinity or an entry beyond 2^53 / 64, are dropped, as are
    vectors that have not the table's commonest length (of equally common ones the shortest). `deviation` is the
    exact sum of (n * x - S)^2. Repeated rows and null keys are kept. Other columns are not read. An empty table, or
    one without variance, gives rows without components.
    """
    x = rows.select(F.col(key).alias("key"), grid(vector).alias("x")).where(F.col("x").isNotNull())
    groups = stored(x.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).withColumn("size", F.size("x")), "distinct")
    common = groups.groupBy("size").agg(F.sum("copies").alias("rows")).orderBy(F.desc("rows"), "size").first()
    size = common["size"] if common else 0
    if not size:
        groups = groups.where(F.lit(False))
    distinct = groups.where(F.col("size") == size).select("x", "copies")
    model = fit(distinct, weights, most)
    n, sums, scale = model.n, np.array(model.sums, np.int64), np.sqrt(model.values)
    out = T._parse_datatype_string("key binary, copies bigint, deviation decimal(38,0), whitened array<double>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batched(batches):
            if not b.num_rows:
                continue
            c = _centred(_matrix(b.column(1), np.int64), n, sums)
            z = (c.astype(np.float64) / n) @ model.components / scale
            dev = pa.array(_deviation(c), pa.decimal128(38, 0))
            white = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel(), pa.float64()), z.shape[1]).cast(pa.list_(pa.float64())) if z.shape[1] else pa.array([[]] * len(z), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), dev, white], ["key", "copies", "deviation", "whitened"])

    white = stored(distinct.select(_key().alias("key"), "x", "copies").mapInArrow(run, out), "whitened")
    error = identity_error(white, n, weights) if len(model.values) else 0.0
    back = x.where(F.size("x") == size).select("key", _key().alias("_of"))
    table = white.select(F.col("key").alias("_vector"), "deviation", "whitened")
    return back.join(table, F.col("_of") == F.col("_vector")).select("key", "deviation", "whitened"), model, error
