"""Chunk lengths from free space: the byte estimate (D07), batches of a length (D01), and the search over all lengths.

A layout of batches is a walk: from a bound p the next target is p + length, and the next bound the last key frame up to
the target if it lies beyond p, else the target.  All lengths of a source are walked at once over its key frames in
order, each by its own jumps (a binary search a jump in the key frames that have come so far), so a length costs its
batches, and a source is held in a few numbers a length, however many key frames it has.  Sources are the parallel
axis; within one the walk is a fold, as every bound depends on the one before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.functions.scalar import let

#: Bytes of a pixel of an intermediate frame.  Fixed value.
PIXEL_BYTES = 4
#: Lengths that the search tries, in seconds.  Fixed values.
SHORTEST, LONGEST = 5, 600
MIB = 1 << 20


def output_size(width: Column, height: Column, target_w: Column, target_h: Column, scale: Column) -> tuple[Column, Column]:
    """Width and height of an output frame: the target's, else the source's, scaled if no target is given."""
    factor = F.when(target_w.isNull() & target_h.isNull(), F.coalesce(scale, F.lit(1))).otherwise(F.lit(1))
    side = lambda t, s: F.coalesce(F.nullif(t, F.lit(0)), s, F.lit(0)).cast("long") * factor
    return side(target_w, width), side(target_h, height)


def frame_bytes(width: Column, height: Column, target_w: Column, target_h: Column, scale: Column) -> Column:
    """Bytes of one output frame; 0 where its size is unknown."""
    w, h = output_size(width, height, target_w, target_h, scale)
    return F.when((w > 0) & (h > 0), w * h * PIXEL_BYTES).otherwise(F.lit(0).cast("long"))


def total_bytes(frames: Column, fps: Column, duration: Column, multiplier: Column, each: Column) -> Column:
    """Bytes of all output frames: counted frames, else rate times duration, cut off; 0 is unknown."""
    n = F.coalesce(F.nullif(frames, F.lit(0)), F.when((fps > 0) & (duration > 0), (fps * duration).cast("long")), F.lit(0))
    many = F.greatest(F.coalesce(multiplier, F.lit(1)), F.lit(1))
    return F.when((n > 0) & (each > 0), n.cast("long") * many * each).otherwise(F.lit(0).cast("long"))


def rounded(x: np.ndarray) -> np.ndarray:
    """To six decimals, halves away from zero as SQL rounds them (numpy and Python round them to even)."""
    up = np.abs(x) * 1e6
    down = np.trunc(up)
    return np.copysign(down + (up - down >= 0.5), x) / 1e6


class Walk:
    """The walk of some lengths over one source's key frames."""

    def __init__(self, lengths: np.ndarray, duration: float, fps: float | None, keep: bool = False) -> None:
        self.lengths, self.duration, self.fps = lengths.astype(float), duration, fps or 0.0
        self.bound = np.zeros(len(lengths))  # the last one that was picked
        self.edge = np.zeros(len(lengths))  # and to six decimals
        self.target = self.lengths.copy()
        self.frames = np.zeros(len(lengths), np.int64)  # of the largest batch
        self.batches = np.zeros(len(lengths), np.int64)
        self.before: float | None = None  # the last key frame of the parts that have come
        self.kept: list[tuple[float, float]] | None = [] if keep else None

    def close(self, rows: np.ndarray, end: np.ndarray) -> None:
        """A batch up to ``end`` for each of ``rows``; one of no length is none."""
        wide = end > self.edge[rows]
        rows, end = rows[wide], end[wide]
        start = self.edge[rows]
        self.frames[rows] = np.maximum(self.frames[rows], np.rint((end - start) * self.fps).astype(np.int64))
        self.batches[rows] += 1
        self.edge[rows] = end
        if self.kept is not None:
            self.kept.extend(zip(start.tolist(), end.tolist()))

    def over(self, keys: np.ndarray, last: bool = False) -> None:
        """Go on over the next key frames, sorted; only targets up to the latest are settled unless these are the ``last``."""
        limit = np.inf if last else keys[-1]
        while len(rows := np.flatnonzero((self.target <= limit) & (self.target < self.duration))):
            target = self.target[rows]
            at = np.searchsorted(keys, target, side="right") - 1
            first = -np.inf if self.before is None else self.before
            best = np.where(at >= 0, keys[np.maximum(at, 0)] if len(keys) else first, first)
            picked = np.where(best > self.bound[rows], best, target)
            self.close(rows, rounded(picked))
            self.bound[rows] = picked
            self.target[rows] = picked + self.lengths[rows]
        if len(keys):
            self.before = float(keys[-1])

    def end(self) -> None:
        self.over(np.zeros(0), last=True)
        every = np.arange(len(self.lengths))
        self.close(every, rounded(np.full(len(every), self.duration)))
        # To six decimals the end may come before the duration: then a last short batch covers it.
        self.close(every, np.full(len(every), self.duration))


PARAMS = ["duration", "fps", "chunk_lo", "chunk_hi"]


def walked(requests: DataFrame, keyframes: DataFrame, layouts: bool) -> DataFrame:
    """Every source's walks.  ``requests``: (source_id long, duration, fps, chunk_lo, chunk_hi); ``keyframes``: (source_id, pts).

    With ``layouts``: (source_id, chunk, batches, frames), a row a length, with the frames of its largest batch; else
    (source_id, index, start_pts, end_pts, frames), the batches of length ``chunk_lo``.  Key frames after the duration (by
    more than a millisecond) do not count, nor those of sources without a request.
    """
    none = lambda t: F.lit(None).cast(t)
    head = requests.where(F.col("duration") > 0).select(
        F.col("source_id").cast("long").alias("source_id"), none("double").alias("pts"), *(F.col(c).cast("double").alias(c) for c in PARAMS)
    )
    keys = keyframes.where(F.col("pts").isNotNull()).select(
        F.col("source_id").cast("long").alias("source_id"), F.col("pts").cast("double").alias("pts"), *(none("double").alias(c) for c in PARAMS)
    )
    # A source's request comes before its key frames: nulls are first.  Dealing by source_id alone would be left out where both
    # sides stand by it already, and at run time either side's partitions are merged for themselves, so key frames would miss
    # their request; by a hash of it, both are dealt together.  The
    # number is given since walks are long over few bytes, which would be merged into a task or two.
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = head.unionByName(keys).repartition(tasks, F.xxhash64("source_id")).sortWithinPartitions("source_id", "pts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source: int | None = None
        walk: Walk | None = None

        def told() -> Iterator[pa.RecordBatch]:
            if walk is None:
                return
            walk.end()
            if layouts:
                n = len(walk.lengths)
                columns = [np.full(n, source), walk.lengths.astype(np.int64), walk.batches, walk.frames]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["source_id", "chunk", "batches", "frames"])
            else:
                start, end = (np.array(x) for x in zip(*walk.kept))
                frames = np.rint((end - start) * walk.fps).astype(np.int64)
                columns = [np.full(len(start), source), np.arange(len(start)), start, end, frames]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["source_id", "index", "start_pts", "end_pts", "frames"])

        for batch in batches:
            own = batch.column("source_id").to_numpy(zero_copy_only=False)
            edges = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1, [len(own)])) if len(own) else [0]
            for i, j in zip(edges[:-1], edges[1:]):
                part = batch.slice(i, j - i)
                if source is None or own[i] != source:
                    yield from told()
                    source, walk = int(own[i]), None
                at = 0
                if part.column("duration")[0].is_valid:
                    duration, fps, low, high = (part.column(c)[0].as_py() for c in PARAMS)
                    walk = Walk(np.arange(int(low), int(high) + 1 if layouts else int(low) + 1), duration, fps, not layouts)
                    at = 1
                keys = part.column("pts").slice(at).to_numpy(zero_copy_only=False)
                if walk is not None and len(keys):
                    keys = keys[keys <= walk.duration + 0.001]
                    if len(keys):
                        walk.over(keys)
        yield from told()

    schema = "source_id long, chunk long, batches long, frames long"
    if not layouts:
        schema = "source_id long, index long, start_pts double, end_pts double, frames long"
    return rows.mapInArrow(run, schema)


def bisected(fits: Column, low: Column, high: Column) -> Column:
    """The length that halving the range ends on: ``fits[length - low]`` says whether a length fits; null if none is found.

    Longer chunks need not have larger batches where key frames are sparse, so the halving itself is followed.
    """
    state = F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), F.lit(None).cast("int").alias("best"))

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        fit = F.get(fits, (middle - low).cast("int"))
        return (
            F.when(s["low"] > s["high"], s)
            .when(fit, F.struct((middle + 1).alias("low"), s["high"].alias("high"), middle.alias("best")))
            .otherwise(F.struct(s["low"].alias("low"), (middle - 1).alias("high"), s["best"].alias("best")))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit((LONGEST - SHORTEST + 1).bit_length() + 1)), state, step, lambda s: s["best"])


def auto_chunks(sources: DataFrame, keyframes: DataFrame) -> DataFrame:
    """How each source is cut: (source_id, chunk, reason, error, fps, each, total).

    ``sources``: (source_id, duration, fps, out_fps, frames, width, height, target_w, target_h, scale, multiplier, free_bytes,
    has_scratch, mode, enabled, chunk_seconds, policy).  A null ``chunk`` without an error is a single pass, whose reason is
    given; ``error`` is ``scratch_unset`` or ``scratch_too_small``.  ``each`` and ``total`` are bytes of a frame and of all.
    """
    c = F.col
    geometry = (c("width"), c("height"), c("target_w"), c("target_h"), c("scale"))
    positive = lambda x: F.when(x > 0, x)
    manual = c("mode") == "manual"

    def settled(each: Column, total: Column) -> Column:
        implied = F.when((c("duration") > 0) & (total > 0) & (each > 0), total / each.cast("double") / c("duration"))
        rate = F.coalesce(positive(c("out_fps")), positive(implied), positive(c("fps")))
        reason = (
            F.when(F.coalesce(c("duration") <= 0, F.lit(True)), "duration_unknown")
            .when(manual & ~c("enabled"), "manual_disabled")
            .when(manual, "manual")
            .when((total <= 0) & ~c("enabled"), "estimate_unknown_manual_disabled")
            .when(total <= 0, "fallback_manual_estimate_unknown")
            .when(total <= c("free_bytes"), "estimate_fits_free_space")
            .when(~c("has_scratch"), "scratch_unset")
            .otherwise("search")
        )
        return F.struct(each.alias("each"), total.alias("total"), rate.alias("rate"), reason.alias("reason"))

    counted = lambda each: total_bytes(c("frames"), c("fps"), c("duration"), c("multiplier"), each)
    sizes = let(frame_bytes(*geometry), lambda each: let(counted(each), lambda total: settled(each, total)))
    cap = F.least(c("chunk_seconds"), F.lit(LONGEST)).cast("int")
    sized = sources.select(
        "source_id", "duration", "policy", "free_bytes", c("chunk_seconds").cast("int").alias("chunk_seconds"), cap.alias("cap"), sizes.alias("is")
    ).select("*", "is.*").drop("is")
    wanted = sized.where("reason = 'search'").select(
        "source_id", "duration", c("rate").alias("fps"), F.lit(SHORTEST).alias("chunk_lo"), c("cap").alias("chunk_hi")
    )
    by_key = keyframes.join(sized.where("policy = 'keyframe'").select("source_id"), "source_id", "left_semi")
    largest = (
        walked(wanted, by_key, True)
        .groupBy("source_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "frames"))), lambda x: x["frames"]).alias("largest"))
    )
    room = F.transform("largest", lambda n: n * c("each") <= c("free_bytes"))
    best = let(room, lambda fits: F.when(c("reason") == "search", bisected(fits, F.lit(SHORTEST), c("cap"))))
    chunk = lambda best: F.coalesce(
        best, F.when(c("reason").isin("manual", "fallback_manual_estimate_unknown"), c("chunk_seconds"))
    )
    error = lambda best: F.when(c("reason") == "scratch_unset", "scratch_unset").when(
        (c("reason") == "search") & best.isNull(), "scratch_too_small"
    )
    told = F.when(~c("reason").isin("search", "manual", "scratch_unset"), c("reason"))
    end = let(best, lambda b: F.struct(chunk(b).alias("chunk"), error(b).alias("error")))
    return (
        sized.join(largest, "source_id", "left")
        .select("source_id", end.alias("end"), told.alias("reason"), c("rate").alias("fps"), "each", "total")
        .select("source_id", "end.chunk", "reason", "end.error", "fps", "each", "total")
    )


def auto_batches(sources: DataFrame, keyframes: DataFrame) -> DataFrame:
    """(source_id, chunk, index, start_pts, end_pts, frames, bytes): D01's batches of the length that ``auto_chunks`` settles on."""
    chosen = auto_chunks(sources, keyframes).where(F.col("chunk").isNotNull())
    chosen = chosen.join(sources.select("source_id", "duration", "policy"), "source_id")
    by_key = keyframes.join(chosen.where("policy = 'keyframe'").select("source_id"), "source_id", "left_semi")
    ask = chosen.select("source_id", "duration", "fps", F.col("chunk").alias("chunk_lo"), F.col("chunk").alias("chunk_hi"))
    cut = walked(ask, by_key, False)
    return cut.join(chosen.select("source_id", "chunk", "each"), "source_id").select(
        "source_id", "chunk", "index", "start_pts", "end_pts", "frames", (F.col("frames") * F.col("each")).alias("bytes")
    )
