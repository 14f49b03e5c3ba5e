"""Operators on frame and packet time series.  A series is told apart by ``source_id``, so every window and
join is partitioned by it; none needs a range join, since each is a look back or forward in order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelake.functions.scalar import half_even, total_frames


def of_source(*order: str) -> W:
    return W.partitionBy("source_id").orderBy(*order)


def extents(packets: DataFrame) -> DataFrame:
    """Last presentation time, last end and key-frame count of each source."""
    return packets.groupBy("source_id").agg(
        F.max("pts").alias("last_pts"),
        F.max(F.col("pts") + F.coalesce("dur", F.lit(0.0))).alias("last_end"),
        F.count_if("is_key").alias("n_keys"),
    )


def decodable_end(last_pts: Column, last_end: Column, period: Column) -> Column:
    """Where decoding ends: the last end, plus a frame if the last packet has no length."""
    end = F.when(last_end <= last_pts + 1e-6, last_end + F.coalesce(period, F.lit(0.0))).otherwise(last_end)
    return F.coalesce(end, last_pts + F.coalesce(period, F.lit(0.05)))


def planning_duration(decodable: Column, stream: Column, counted: Column, container: Column) -> Column:
    """What a plan takes as duration: measured, else the trusted bounds, else the container's."""
    p = lambda c: F.when(c > 0, c)
    trusted, longest = F.least(p(stream), p(counted)), F.greatest(p(stream), p(counted))
    return F.coalesce(
        p(decodable), F.when(p(container) < trusted - 0.05, longest).otherwise(trusted), p(container)
    )


def edges_to_batches(edges: DataFrame, fps: float = 24.0) -> DataFrame:
    """Half-open batches between neighbours of the array ``edges``, with frame estimates."""
    clean = F.array_sort(F.array_distinct(F.transform("edges", lambda x: F.round(x, 6))))
    cut = edges.select("source_id", clean.alias("e"))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("e") - 1), lambda i: F.struct(F.get("e", i - 1).alias("s"), F.get("e", i).alias("t"))
    )
    return (
        cut.where(F.size("e") > 1)
        .select("source_id", F.posexplode(pairs).alias("index", "b"))
        .select(
            "source_id",
            F.col("index").cast("long").alias("index"),
            F.col("b.s").alias("start_pts"),
            F.col("b.t").alias("end_pts"),
            half_even((F.col("b.t") - F.col("b.s")) * fps).alias("frames"),
        )
    )


def batch_edges(requests: DataFrame, chunk: int, policy: str = "exact") -> DataFrame:
    """``requests`` (source_id, duration, keyframes) with ``edges``: the bounds of batches of about ``chunk`` s.

    exact: multiples of the chunk.  keyframe: each bound is the last key frame up to the target, if it lies
    beyond the bound before, else the target; the next target is a chunk later.  That is a fold along one
    source; sources are the parallel axis (D01).
    """
    duration = F.col("duration")
    steps = F.greatest(F.ceil(duration / chunk).cast("int") - 1, F.lit(0))
    exact = F.transform(
        F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        lambda k: (k * chunk).cast("double"),
    )
    if policy == "exact":
        inner = exact
    else:
        # A snapped bound lies less than a chunk before its target, so bounds may be twice as many.
        bound = F.ceil(2 * duration / chunk).cast("int") + 2
        state = F.struct(
            F.lit(float(chunk)).alias("target"), F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out")
        )

        def step(s: Column, _: Column) -> Column:
            best = F.array_max(F.filter("keyframes", lambda k: k <= s["target"]))
            picked = F.when(best > s["last"], best).otherwise(s["target"])
            return F.when(
                s["target"] < duration,
                F.struct(
                    (picked + chunk).alias("target"), picked.alias("last"), F.array_append(s["out"], picked).alias("out")
                ),
            ).otherwise(s)

        snapped = F.aggregate(F.sequence(F.lit(1), bound), state, step, lambda s: s["out"])
        inner = F.when(F.size(F.coalesce("keyframes", F.array().cast("array<double>"))) > 0, snapped).otherwise(exact)
    edges = F.concat(F.array(F.lit(0.0)), inner, F.array(duration))
    return requests.where(duration > 0).select("source_id", edges.alias("edges"))


def plan_batches(requests: DataFrame, chunk: int, policy: str = "exact", fps: float = 24.0) -> DataFrame:
    return edges_to_batches(batch_edges(requests, chunk, policy), fps)


def frame_accounting(batches: DataFrame, num: Column, den: Column, total: Column, multiplier: int = 1) -> DataFrame:
    """Source and output frames of each batch, from differences of cumulative indices."""
    offset = total_frames(num, den, F.col("start_pts"))
    content = F.least(total_frames(num, den, F.col("end_pts")), total) - offset
    overlap = F.when(F.col("index") > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    return batches.select(
        "source_id",
        "index",
        offset.alias("offset"),
        content.alias("content"),
        overlap.alias("overlap"),
        (offset - overlap).alias("input_base"),
        (overlap + content).alias("input_count"),
        (overlap * multiplier).alias("output_skip"),
        (content * multiplier).alias("output_count"),
    )


def reconciled(plan: DataFrame, actual: DataFrame, multiplier: int = 1) -> DataFrame:
    """Plans corrected by what was decoded: a surplus is trimmed, a shortage shrinks the plan."""
    got = F.col("actual")
    content = F.when(got < F.col("input_count"), F.greatest(got - F.col("overlap"), F.lit(0))).otherwise(F.col("content"))
    return plan.join(actual, ["source_id", "index"]).select(
        "source_id",
        "index",
        F.greatest(got - F.col("input_count"), F.lit(0)).alias("trimmed"),
        content.alias("content"),
        (content * multiplier).alias("output_count"),
    )


def as_of_back(series: DataFrame, is_mark: Column, value: str, name: str) -> DataFrame:
    """Each row with ``value`` of the last marked row up to it (J01): one shuffle, no range join."""
    w = of_source("pts", "n").rowsBetween(W.unboundedPreceding, 0)
    return series.withColumn(name, F.last(F.when(is_mark, F.col(value)), ignorenulls=True).over(w))


def as_of_next(series: DataFrame, is_mark: Column, value: str, name: str) -> DataFrame:
    """Each row with ``value`` of the first marked row from it on."""
    w = of_source("n").rowsBetween(0, W.unboundedFollowing)
    return series.withColumn(name, F.first(F.when(is_mark, F.col(value)), ignorenulls=True).over(w))


def islands(frames: DataFrame, is_cut: Column) -> DataFrame:
    """Runs of frames that a cut begins, as closed intervals."""
    run = F.sum(F.when(is_cut, 1).otherwise(0)).over(of_source("n").rowsBetween(W.unboundedPreceding, 0))
    return (
        frames.withColumn("run", run)
        .groupBy("source_id", "run")
        .agg(F.min("n").alias("first_n"), F.max("n").alias("last_n"))
    )


def near_cuts(frames: DataFrame, cuts: DataFrame) -> DataFrame:
    """Frames next to a cut, or on it."""
    band = cuts.select("source_id", F.explode(F.array(F.col("n") - 1, F.col("n"), F.col("n") + 1)).alias("n"))
    return frames.join(band, ["source_id", "n"], "left_semi")


def duplicates(scores: DataFrame, threshold: float, protected: DataFrame | None = None) -> DataFrame:
    """Frames k (from 2) that repeat the one before: its score against frame k - 1 is below the threshold.

    ``scores``: (source_id, n from 0, score).  A frame without a score is kept, and so are protected frames;
    if all but one of a source would go, none goes (P05, P06).
    """
    total = W.partitionBy("source_id")
    k = scores.select("source_id", (F.col("n") + 1).alias("k"), "score", F.count("*").over(total).alias("full"))
    low = k.where((F.col("k") >= 2) & (F.col("score") < max(threshold, 1e-12)))
    if protected is not None:
        low = low.join(protected.select("source_id", F.col("n").alias("k")), ["source_id", "k"], "left_anti")
    skipped = F.count("*").over(total)
    return (
        low.withColumn("skipped", skipped)
        .where(~((F.col("full") > 2) & (F.col("skipped") >= F.col("full") - 1)))
        .select("source_id", "k")
    )


def compacted(frames: DataFrame, skipped: DataFrame) -> DataFrame:
    """Every frame k with ``kept`` and, for kept ones, its new number from 1."""
    marked = frames.join(skipped.withColumn("__skip", F.lit(True)), ["source_id", "k"], "left")
    kept = F.col("__skip").isNull()
    number = F.sum(F.when(kept, 1).otherwise(0)).over(of_source("k").rowsBetween(W.unboundedPreceding, 0))
    return marked.select(
        "source_id", "k", kept.alias("kept"), F.when(kept, number.cast("long")).alias("new_k"), number.cast("long").alias("shown_k")
    )


def expanded(compact: DataFrame, multiplier: int) -> DataFrame:
    """For each output frame the one of the compact series that it shows."""
    m = F.explode(F.sequence(F.lit(0), F.lit(multiplier - 1))).alias("m")
    return compact.select("source_id", "k", F.greatest("shown_k", F.lit(1)).alias("p"), m).select(
        "source_id",
        ((F.col("k") - 1) * multiplier + 1 + F.col("m")).alias("out_n"),
        ((F.col("p") - 1) * multiplier + 1 + F.col("m")).alias("from_n"),
    )


def cuts_in_batches(cuts: DataFrame, batches: DataFrame, width: int = 1024) -> DataFrame:
    """Local numbers of the cuts that fall into a batch's input (J02): 2 up to the input's length.

    Frames are dealt into bins, of ``width`` at level 0 and twice as wide at each further one.  A batch stands at the first
    level whose bins are as long as it, so in two of them at most however long it is; a cut looks into its bin of each
    level that its source has, and meets few batches and not all of its source's.
    """
    local = F.col("n") - F.col("input_base") + 1
    bin_of = lambda n, level: F.call_function("shiftright", F.floor(n / width).cast("long"), level)
    more = F.floor((F.col("input_count") - 2) / width).cast("long")  # bins of width that a batch fills, less one
    level = F.when(more > 0, F.length(F.bin(more))).otherwise(0)
    first, last = F.col("input_base") + 1, F.col("input_base") + F.col("input_count") - 1
    levelled = batches.where(F.col("input_count") >= 2).withColumn("level", level)
    spread = levelled.withColumn("bin", F.explode(F.sequence(bin_of(first, F.col("level")), bin_of(last, F.col("level")))))
    return (
        cuts.join(levelled.select("source_id", "level").distinct(), "source_id")
        .withColumn("bin", bin_of(F.col("n"), F.col("level")))
        .join(spread, ["source_id", "level", "bin"])
        .where((local >= 2) & (local <= F.col("input_count")))
        .select("source_id", "index", local.alias("local_n"))
    )


def held_over_cuts(cuts: DataFrame, multiplier: int) -> DataFrame:
    """Output frames between a cut and the frame before it, and the frame that each repeats instead."""
    c = F.col("local_n")
    return cuts.where(c >= 2).select(
        "source_id",
        "index",
        F.explode(
            F.when(F.lit(multiplier > 1), F.sequence((c - 2) * multiplier + 2, (c - 1) * multiplier)).otherwise(
                F.array().cast("array<bigint>")
            )
        ).alias("out_n"),
        ((c - 2) * multiplier + 1).alias("from_n"),
    )


def chunks(frames: DataFrame, size: int) -> DataFrame:
    """Frames in groups of ``size``."""
    return frames.withColumn("chunk", F.floor((F.row_number().over(of_source("n")) - 1) / size).cast("long"))


def packed(items: DataFrame, limit: int) -> DataFrame:
    """Greedy packing: ``items`` (source_id, item, size) with the number of the pack of each.

    A pack takes items in order while their sizes fit the limit, one at least; a null size counts as 0.  A source's items
    stream by in order, and only its open pack and that pack's size are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, pack, used = None, 0, 0
        for batch in batches:
            own, sizes, out = batch.column("source_id").to_pylist(), batch.column("size").to_pylist(), []
            for s, size in zip(own, sizes):
                if s != source:
                    source, pack, used = s, 0, 0
                if used > 0 and used + (size or 0) > limit:
                    pack, used = pack + 1, 0
                used += size or 0
                out.append(pack)
            yield pa.RecordBatch.from_arrays([batch.column("source_id"), batch.column("item"), pa.array(out, pa.int64())], ["source_id", "item", "pack"])

    rows = items.select("source_id", F.col("item").cast("long").alias("item"), F.col("size").cast("long").alias("size"))
    kind = rows.schema["source_id"].dataType.simpleString()
    ordered = rows.where(F.col("source_id").isNotNull()).repartition("source_id").sortWithinPartitions("source_id", "item")
    return ordered.mapInArrow(run, f"source_id {kind}, item long, pack long")


def trimmed(frames: DataFrame, skip: int, keep: int | None = None) -> DataFrame:
    """Frames (source_id, n) without the first ``skip`` of each source, ``keep`` of the rest at most, renumbered as ``k`` from 1."""
    k = F.row_number().over(W.partitionBy("source_id").orderBy("n")) - skip
    out = frames.withColumn("k", k).where(F.col("k") > 0)
    return out if keep is None else out.where(F.col("k") <= keep)


def stored_plans(batches: DataFrame, stored: DataFrame) -> DataFrame:
    """Batches with the stored plan of their source whose start and end are theirs, to six decimals.

    Of several plans of one span the newest is taken: the largest ``plan_id``.
    """
    at = lambda c: F.round(F.col(c).cast("double"), 6)
    keys = ["source_id", "__start", "__end"]
    left = batches.withColumn("__start", at("start")).withColumn("__end", at("end"))
    right = stored.groupBy("source_id", at("start").alias("__start"), at("end").alias("__end")).agg(F.max("plan_id").alias("plan_id"))
    return left.join(right, keys, "left").drop("__start", "__end")
