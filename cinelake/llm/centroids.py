"""Centroid clustering by the exponion search.

Every vector carries its centroid, an upper bound u of its distance to it and a lower bound l of the distance to
all others.  After the centroids have moved, u grows by its own centroid's move and l falls by the largest.  A
vector keeps its centroid unseen while u stays below l or below half the way s to the centroid's nearest other
one.  The others scan only the ball of radius 2 u + s around their centroid: both the nearest and the second
nearest centroid lie in it.  The ball is a prefix of the centroid's list of the others, sorted by distance; its
radius is inclusive, and bounds count with a small slack, so no tie is lost, and of equal distances the smaller
number wins.  Distances are sums of whole squares.

State is a table of the shared folder, one a round; a round writes the next one, with each task's sums beside
it, and deletes the one before.  Sums are merged a row a task, centroid and place, so a centroid that holds most
vectors costs no more than another.  The centroids (``K`` vectors) are all that the driver holds.

Defined results: only vectors of exactly ``DIM`` entries count, none null, NaN or infinite; all others are left
out.  Entries are held to ±2**27 after scaling, so squares add up within a long.  Rows without an id get their
cluster but are no starting centroids; of equal hashes (repeated ids) the lesser vector comes first, and equal
vectors may start several centroids: the smaller number then gets all.  With fewer vectors than ``K`` there are
fewer centroids; with none that has an id there are none, and every ``cluster`` is null.  Repeated rows come back
each.  An empty table gives no rows; other columns of any name are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import discard, finite, stored, table

#: Entries of a vector, and what they are multiplied by before they become whole.
DIM, SCALE = 64, 256
#: Centroids, and rounds in which they move.
K, ROUNDS = 40, 5
#: Seed of the hash that picks the starting centroids.
SEED = 2
#: Largest whole entry.
LARGEST = 1 << 27
#: Vectors that are compared at a time.
CHUNK = 2048
#: Slack of the bounds, relative and absolute: far above the rounding of doubles, far below what costs time.
RELATIVE, ABSOLUTE = 1e-9, 1e-6


class Geometry(NamedTuple):
    """Centroids, and what a round needs to know of them."""

    centroids: np.ndarray  # longs, a row a centroid
    order: np.ndarray  # for each one, all of them by distance from it, itself first
    distance: np.ndarray  # their distances, in that order
    half: np.ndarray  # half the way to the nearest other
    moved: np.ndarray  # how far each one has moved since the state was made
    others: np.ndarray  # for each one, the largest move of the others


def geometry(centroids: np.ndarray, before: np.ndarray | None) -> Geometry:
    k = len(centroids)
    squares = np.stack([((centroids - c) ** 2).sum(1) for c in centroids])
    squares[np.arange(k), np.arange(k)] = -1  # itself comes first, before a centroid in the same place
    order = np.argsort(squares, axis=1, kind="stable")
    distance = np.sqrt(np.maximum(np.take_along_axis(squares, order, 1), 0).astype(float))
    half = distance[:, 1] / 2 if k > 1 else np.full(k, np.inf)
    moved = np.zeros(k) if before is None else np.sqrt(((centroids - before) ** 2).sum(1).astype(float))
    others = np.array([np.delete(moved, j).max(initial=0.0) for j in range(k)])
    return Geometry(centroids, order, distance, half, moved, others)


def exponion(x: np.ndarray, a: np.ndarray, u: np.ndarray, l: np.ndarray, at: Geometry) -> int:
    """Bring the state (a, u, l) of the vectors ``x`` up to date in place; the number of distances that were taken."""
    u += at.moved[a]
    l -= at.others[a]
    taken = 0

    def open_rows(rows: np.ndarray) -> np.ndarray:
        safe = np.maximum(l[rows], at.half[a[rows]])
        return rows[u[rows] * (1 + RELATIVE) + ABSOLUTE >= safe]

    rows = open_rows(np.arange(len(x)))
    known = rows[np.isfinite(u[rows])]
    u[known] = np.sqrt(((x[known] - at.centroids[a[known]]) ** 2).sum(1).astype(float))
    taken += len(known)
    rows = open_rows(rows)
    for c in np.unique(a[rows]).tolist():
        own = rows[a[rows] == c]
        reach = (2 * u[own] + 2 * at.half[c]) * (1 + RELATIVE) + ABSOLUTE
        count = np.searchsorted(at.distance[c], reach, side="right")
        # Rings that double: vectors are taken together whose balls end in the same ring.
        ring = np.minimum(1 << np.ceil(np.log2(np.maximum(count, 2))).astype(int), len(at.centroids))
        for m in np.unique(ring).tolist():
            some = own[ring == m]
            seen = np.sort(at.order[c, :m])
            for k in range(0, len(some), CHUNK):
                part = some[k : k + CHUNK]
                squares = np.stack([((x[part] - at.centroids[j]) ** 2).sum(1) for j in seen], 1)
                best = squares.argmin(1)  # of equal ones the first, which has the smaller number
                a[part] = seen[best]
                u[part] = np.sqrt(squares[np.arange(len(part)), best].astype(float))
                second = np.partition(squares, 1, 1)[:, 1] if m > 1 else np.full(len(part), np.inf)
                l[part] = np.sqrt(second.astype(float))
                taken += squares.size
    return taken


def packed(rows: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """(vec_id, x): the whole entries, as packed ints, of all vectors that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.clip(np.floor(SCALE * batch.column(1).flatten().to_numpy(zero_copy_only=False)), -LARGEST, LARGEST)
            flat = x.astype("<i4").tobytes()
            out = pa.array([flat[k : k + 4 * DIM] for k in range(0, len(flat), 4 * DIM)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["vec_id", "x"])

    column = F.col(vector)
    source = rows.where(finite(column) & (F.size(column) == DIM)).select(
        F.col(vec_id).cast("long").alias("vec_id"), column.cast("array<double>").alias("v")
    )
    return source.mapInArrow(run, "vec_id long, x binary")


def unpacked(x: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist()), "<i4").reshape(-1, DIM).astype(np.int64)


def picked_by(vec_id: Column, seed: int = SEED) -> Column:
    """What the starting centroids are the least of."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")), 256)


STATE = "vec_id long, x binary, a int, u double, l double, part binary, n long"


def assigned(rows: DataFrame, at: Geometry, known: bool, last: bool = False) -> DataFrame:
    """The next state of ``rows`` (vec_id, x and, if ``known``, a, u, l), and a row a task and centroid of sums.

    A row of sums has ``part`` (packed sums of the centroid ``a``) and ``n`` vectors.  In the ``last`` state ``n``
    is a vector's squared distance instead, and in a row of sums the distances' sum.
    """
    shared = rows.sparkSession.sparkContext.broadcast(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = shared.value
        k = len(where.centroids)
        total, number = np.zeros((k, DIM), np.int64), np.zeros(k, np.int64)
        names = ["vec_id", "x", "a", "u", "l", "part", "n"]
        for batch in batches:
            x = unpacked(batch.column("x"))
            if known:
                a, u, l = (batch.column(c).to_numpy().copy() for c in "aul")
            else:
                a, u, l = np.zeros(len(x), np.int32), np.full(len(x), np.inf), np.full(len(x), -np.inf)
            exponion(x, a, u, l, where)
            n = ((x - where.centroids[a]) ** 2).sum(1) if last else np.ones(len(x), np.int64)
            np.add.at(number, a, n)
            for c in np.unique(a).tolist():
                total[c] += x[a == c].sum(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), *map(pa.array, (a, u, l)), pa.nulls(len(x), pa.binary()), pa.array(n)], names
            )
        used = np.flatnonzero(number)
        none = lambda kind: pa.nulls(len(used), kind)
        sums = pa.array([total[c].astype("<i8").tobytes() for c in used], pa.binary())
        columns = [none(pa.int64()), none(pa.binary()), pa.array(used.astype(np.int32)), none(pa.float64()), none(pa.float64())]
        yield pa.RecordBatch.from_arrays([*columns, sums, pa.array(number[used])], names)

    return rows.mapInArrow(run, STATE)


def totals(state: DataFrame) -> list[tuple[int, int, int, int]]:
    """(centroid, place, sum, n) of a state's rows of sums; at most ``K * DIM`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.frombuffer(b"".join(batch.column("part").to_pylist()), "<i8")
            a, n = (np.repeat(batch.column(c).to_numpy(), DIM) for c in ("a", "n"))
            place = np.tile(np.arange(DIM, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a, place, sums, n)], ["a", "place", "part", "n"])

    parts = state.where(F.col("part").isNotNull()).select("a", "part", "n").mapInArrow(run, "a int, place int, part long, n long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = parts.groupBy("a", "place").agg(wide("part"), wide("n")).collect()
    return [(r["a"], r["place"], int(r["part"]), int(r["n"])) for r in found]


def starting(vectors: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors whose ids have the least hashes, in that order."""
    least = (
        vectors.where(F.col("vec_id").isNotNull())
        .withColumn("__hash", picked_by(F.col("vec_id"), seed))
        .orderBy("__hash", "x")
        .limit(k)
        .select("x")
        .collect()
    )
    return unpacked(pa.array([bytes(r["x"]) for r in least], pa.binary()))


def clustered(
    rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", k: int = K, rounds: int = ROUNDS, seed: int = SEED
) -> tuple[DataFrame, list[tuple[list[int], int]]]:
    """(vec_id, x, cluster, distance) of every vector, and each centroid with its sum of squared distances."""
    spark = rows.sparkSession
    vectors = packed(rows, vector, vec_id)
    centroids = starting(vectors, k, seed)
    if not len(centroids):
        none = vectors.withColumn("cluster", F.lit(None).cast("int")).withColumn("distance", F.lit(None).cast("long"))
        return none, []
    state, before, path = vectors, None, None
    for r in range(rounds + 1):
        last = r == rounds
        found, its_path = stored(assigned(state, geometry(centroids, before), r > 0, last))
        if path:
            discard(spark, path)
        state, path = found.where(F.col("part").isNull()), its_path
        sums = totals(found)
        if not last:
            before, centroids = centroids, centroids.copy()
            for a, place, total, n in sums:
                centroids[a, place] = total // n
    inertia = [0] * len(centroids)
    for a, _, _, n in sums:
        inertia[a] = n
    return (
        state.select("vec_id", "x", F.col("a").alias("cluster"), F.col("n").alias("distance")),
        list(zip(centroids.tolist(), inertia)),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustered(table(spark, sf_dir, "embeddings"))
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    of = [(k, inertia, digest(c)) for k, (c, inertia) in enumerate(centroids)]
    own = spark.createDataFrame(of, "cluster int, cluster_inertia long, centroid_sha256 string")
    return found.join(F.broadcast(own), "cluster", "left").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(x[1] for x in of)).cast("long").alias("inertia"), "centroid_sha256"
    )


def sql(k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """DuckDB's statement for the query's rows: every round compares all vectors with all centroids."""
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, [floor({SCALE} * c::DOUBLE)::BIGINT for c in embedding] AS x FROM embeddings
  WHERE len(embedding) = {DIM} AND len([c for c in embedding if c IS NOT NULL AND isfinite(c)]) = {DIM})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS k, x AS c FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) <= {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, x, min(d * 64 + k) % 64 AS k, min(d * 64 + k) // 64 AS d FROM (SELECT vec_id, x, k,
  list_sum([(x[i] - c[i]) * (x[i] - c[i]) for i in range(1, {DIM + 1})])::BIGINT AS d FROM v, c{r}) GROUP BY vec_id, x)"""
        )
        if r < rounds:
            parts.append(
                f"""m{r} AS (SELECT k, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {DIM + 1}) t(i) GROUP BY k, i),
n{r} AS (SELECT k, list((s - (s % n + n) % n) // n ORDER BY i) AS c FROM m{r} GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT k, coalesce(n{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN n{r} USING (k))"""
            )
    return f"""WITH {", ".join(parts)}
SELECT vec_id, k::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k)"""


SQL = sql()
