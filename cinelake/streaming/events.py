"""Structured Streaming over events and progress lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of Parquet files as they arrive, with a zoned time."""
    return spark.readStream.schema(EVENTS).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of each window and type."""
    value = F.sum(F.col("value").cast("decimal(18,4)")).alias("total")
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", length), "event_type")
        .agg(F.count("*").alias("n"), value)
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def sliding(events: DataFrame, length: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts of overlapping windows."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", length, step))
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), "n")
    )


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    return (
        events.withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap).alias("s"))
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
    )


def samples(lines: DataFrame) -> DataFrame:
    """Samples of a stream of key=value lines (job_id, line_no, value); a ``progress`` line ends one.

    The state of a job is the sample that is not ended yet; lines come in order within a job.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, frame, fps, speed = state.get if state.exists else (0, None, None, None)
        open_sample = {"frame": frame, "fps": fps, "speed": speed}
        out = []
        for lines_ in batches:
            for value in lines_.sort_values("line_no")["value"]:
                k, _, v = value.partition("=")
                k, v = k.strip(), v.strip()
                if k in open_sample:
                    open_sample[k] = v
                elif k == "progress":
                    out.append((key[0], done, *open_sample.values(), v))
                    done, open_sample = done + 1, dict.fromkeys(open_sample)
        state.update((done, *open_sample.values()))
        yield pd.DataFrame(out, columns=["job_id", "sample", "frame", "fps", "speed", "progress"])

    return lines.groupBy("job_id").applyInPandasWithState(
        fold,
        "job_id long, sample long, frame string, fps string, speed string, progress string",
        "done long, frame string, fps string, speed string",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def fan_out(stream: DataFrame, sinks: list, checkpoint: str):
    """Every batch to each sink in turn; a sink that fails is passed over, the others get the batch."""

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        for sink in sinks:
            try:
                sink(rows, number)
            except Exception as error:  # noqa: BLE001
                print(f"sink {sink!r} failed on batch {number}: {error}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)
