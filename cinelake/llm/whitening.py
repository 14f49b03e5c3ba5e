"""Whitening of embeddings by a covariance of two passes.

Vectors become whole numbers, so the first pass adds them up exactly; with S = q n + r the mean is q + r / n,
and x - q is exact, so centring loses nothing.  The second pass sums the outer products of the centred vectors
with one matrix product a chunk of rows; a tree of tasks adds the tasks' matrices, and LAPACK's symmetric solver
gives the components.  The projection is broadcast: a vector's length times ``TOP`` numbers.  A third pass
measures the covariance of what was whitened.

The fit looks at each distinct vector once: they are made distinct by a shuffle on the packed numbers, after
each task has merged its own, so copies of one vector meet at most once a task.

Defined results: rows whose vector is null or holds a null, a NaN or an infinite entry are left out; all others
come back, with their own id, null and repeated ones included.  Vectors of different lengths are fitted apart,
each length with its own n, mean and components; an empty vector has no component and so no row.  A component
whose eigenvalue is zero to rounding has ``whitened`` null and is left out of the identity error; if no component
has variance the error is 0, and ``explained`` is null if the trace is 0.  Numbers beyond a long are taken as
the largest long; a deviation beyond a long is null.  Equal eigenvalues are numbered as the solver gives them.
An empty table gives no rows; other columns of any name are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import discard, finite, stored, table

#: Whole numbers of an entry c are floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components that are returned at most.
TOP = 16
#: Bytes of vectors that are worked on at a time.
CHUNK_BYTES = 4 << 20
#: What floor(SCALE * c) is held to, so that it is a long with the shift added.
LARGEST = float((1 << 63) - (1 << 21))


class Fit(NamedTuple):
    """What was learned of the vectors of one length."""

    n: int
    quotient: np.ndarray  # of the sums by n, as doubles
    remainder: np.ndarray  # of the sums by n, whole numbers
    projection: np.ndarray  # a column a component, over the root of its eigenvalue
    explained: list[float | None]
    identity_error: float


def whole_numbers(rows: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """(vec_id, dim, x): the packed longs of every vector that is whole and finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            length = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
            scaled = np.clip(np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False)), -LARGEST, LARGEST)
            x = scaled.astype("<i8") + SHIFT
            ends = np.concatenate(([0], np.cumsum(8 * length.astype(np.int64)))).astype(np.int64)
            packed = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length), packed.cast(pa.binary())], ["vec_id", "dim", "x"])

    source = rows.where(finite(F.col(vector))).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")
    )
    return source.mapInArrow(run, "vec_id long, dim int, x binary")


def chunks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    """The vectors of ``dim`` numbers, some at a time, as arrays of longs."""
    step = max(1, CHUNK_BYTES // (8 * dim))
    for batch in batches:
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step).column("x").to_pylist()
            yield np.frombuffer(b"".join(part), "<i8").reshape(-1, dim)


def sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length: number of vectors and exact sums of their numbers (one row a length, place and task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                for x in chunks(iter([own]), dim):
                    n, high, low = found.setdefault(dim, [0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)])
                    # Halves of 32 bits: a task's sums stay below 2**63.
                    found[dim] = [n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)]
        for dim, (n, high, low) in found.items():
            names = ["dim", "pos", "n", "high", "low"]
            columns = [np.full(dim, dim, np.int32), np.arange(dim, dtype=np.int32), np.full(dim, n), high, low]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    parts = fit.where("dim > 0").mapInArrow(run, "dim int, pos int, n long, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("dim", "pos").agg(wide("n"), wide("high"), wide("low")).orderBy("dim", "pos").collect():
        out.setdefault(r["dim"], (int(r["n"]), []))[1].append((int(r["high"]) << 32) + int(r["low"]))
    return out


def products(fit: DataFrame, dim: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the vectors of ``dim`` numbers of the outer products of ``of(chunk)``'s rows, with a column of ones put after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in chunks(batches, dim):
            y = of(x)
            y = np.hstack([y, np.ones((len(y), 1))])
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def added(total, row):
        m = np.frombuffer(row["m"])
        return m.copy() if total is None else total + m

    def merged(a, b):
        return b if a is None else a if b is None else a + b

    flat = fit.where(F.col("dim") == dim).mapInArrow(run, "m binary").rdd.treeAggregate(None, added, merged)
    side = int(round(len(flat) ** 0.5))
    return flat.reshape(side, side)


def fitted(fit: DataFrame, top: int = TOP) -> dict[int, Fit]:
    """The fit of each length of vectors among the distinct vectors ``fit`` (dim, x)."""
    out = {}
    for dim, (n, total) in sums(fit).items():
        quotient = np.array([float(s // n) for s in total])
        remainder = np.array([s % n for s in total], np.int64)

        def centred(x: np.ndarray, quotient=quotient, rest=remainder / n) -> np.ndarray:
            return (x - quotient) - rest

        covariance = products(fit, dim, centred)[:dim, :dim] / n
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        values, vectors = values[::-1][:top], vectors[:, ::-1][:, :top]
        real = values > max(values[0], 0.0) * dim * np.finfo(float).eps
        trace = float(np.trace(covariance))
        projection = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), np.nan)
        error = 0.0
        if real.any():
            used = projection[:, real]
            m = products(fit, dim, lambda x, used=used, centred=centred: centred(x) @ used) / n
            mean = m[-1, :-1]
            error = float(np.abs(m[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean))).max())
        explained = [float(e) / trace if trace > 0 else None for e in np.maximum(values, 0.0)]
        out[dim] = Fit(n, quotient, remainder, projection, explained, error)
    return out


def deviations(x: np.ndarray, fit: Fit) -> pa.Array:
    """Sum over the places of (n x - S)^2, exactly; null beyond a long."""
    off = x - fit.quotient
    if (fit.n * (float(np.abs(off).max(initial=0.0)) + 1.0)) ** 2 * x.shape[1] < 2.0**62:
        return pa.array(((fit.n * off.astype(np.int64) - fit.remainder) ** 2).sum(1))
    quotient, remainder = [int(q) for q in fit.quotient], fit.remainder.tolist()
    exact = [sum((fit.n * (v - q) - r) ** 2 for v, q, r in zip(row, quotient, remainder)) for row in x.tolist()]
    return pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())


def whitened(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", top: int = TOP) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row a vector and component."""
    spark = rows.sparkSession
    numbers = whole_numbers(rows, vector, vec_id)
    fit, path = stored(numbers.select("dim", "x").distinct())
    model = spark.sparkContext.broadcast(fitted(fit, top))
    discard(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims[dims > 0]).tolist():
                own, of = batch.filter(pa.array(dims == dim)), model.value[dim]
                step, k = max(1, CHUNK_BYTES // (8 * dim)), len(of.explained)
                for at in range(0, own.num_rows, step):
                    part = own.slice(at, step)
                    x = np.frombuffer(b"".join(part.column("x").to_pylist()), "<i8").reshape(-1, dim)
                    y = ((x - of.quotient) - of.remainder / of.n) @ of.projection
                    row = pa.array(np.repeat(np.arange(len(x)), k))
                    flat = y.reshape(-1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("vec_id").take(row),
                            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                            pa.array(np.full(len(flat), of.n)),
                            deviations(x, of).take(row),
                            pa.array(flat, mask=np.isnan(flat)),
                            pa.array(of.explained * len(x), pa.float64()),
                            pa.array(np.full(len(flat), of.identity_error)),
                        ],
                        ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return numbers.mapInArrow(
        run,
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
