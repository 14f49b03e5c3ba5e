"""Joins of streams, sinks that write each batch once, and late rows kept aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from cinelake.operators import timeline
from cinelake.sinks.published import read_text, write_text


def interval_join(events: DataFrame, spans: DataFrame, late: str = "10 minutes", length: str = "1 hour", how: str = "inner") -> DataFrame:
    """Events (key, ts, ...) with the spans (key, begin, end, ...) of their key that hold them.

    Both are streams.  A span lasts ``length`` at most, so Spark can drop an event when the watermark of the spans has passed
    it, and a span when that of the events has; with ``leftOuter`` an event without a span comes out then.
    """
    e = events.withWatermark("ts", late).alias("e")
    s = spans.withWatermark("begin", late).alias("s")
    inside = (F.col("e.ts") >= F.col("s.begin")) & (F.col("e.ts") < F.col("s.end"))
    bounded = F.col("e.ts") <= F.col("s.begin") + F.expr(f"INTERVAL {length}")
    own = [F.col(f"s.{c}") for c in spans.columns if c not in events.columns]
    return e.join(s, (F.col("e.key") == F.col("s.key")) & inside & bounded, how).select(*(F.col(f"e.{c}") for c in events.columns), *own)


def _ledger(spark: SparkSession, path: str) -> dict[str, str]:
    """What the last committed batch left: its number and the latest event time so far."""
    text = read_text(spark, f"{path}/ledger")
    return dict(x.split("=", 1) for x in text.splitlines()) if text else {}


def exactly_once(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts", late_ms: int | None = None) -> DataStreamWriter:
    """Write each batch of a stream once to the table ``path/rows``, and rows that come too late to ``path/late``.

    A batch overwrites the folder of its own number and is then put into the ledger, a file that is replaced as a whole.  A
    batch that comes again after it was committed is passed over; one that was cut off is written anew.  A row is late if
    its time lies more than ``late_ms`` before the latest of the batches before its own.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ledger = _ledger(spark, path)
        if int(ledger.get("batch", -1)) >= number:
            return
        high = int(ledger["high"]) if ledger.get("high") else None
        ms = F.unix_millis(ts)
        rows = batch.persist()
        too_late = F.lit(False) if high is None or late_ms is None else F.coalesce(ms < high - late_ms, F.lit(False))
        rows.where(~too_late).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        rows.where(too_late).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        latest = rows.agg(F.max(ms)).first()[0]
        rows.unpersist()
        now = max((x for x in (high, latest) if x is not None), default="")
        write_text(spark, f"{path}/ledger", f"batch={number}\nhigh={now}\n")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def committed(spark: SparkSession, path: str, name: str = "rows") -> DataFrame | None:
    """The rows of all committed batches; none before the first."""
    last = _ledger(spark, path).get("batch")
    return None if last is None else spark.read.parquet(f"{path}/{name}").where(F.col("batch") <= int(last))


def reconciled_with_late(plan: DataFrame, rows: DataFrame, late: DataFrame, keys: tuple[Column, Column], multiplier: int = 1) -> DataFrame:
    """Plans corrected by what came, late rows included (T11, D05): ``keys`` are a row's source_id and index."""
    source, index = keys
    both = rows.unionByName(late)
    actual = both.groupBy(source.alias("source_id"), index.alias("index")).agg(F.count("*").alias("actual"))
    none = plan.select("source_id", "index").join(actual, ["source_id", "index"], "left").select("source_id", "index", F.coalesce("actual", F.lit(0)).alias("actual"))
    return timeline.reconciled(plan, none, multiplier)
