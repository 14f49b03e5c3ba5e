"""The last lines of each job, as keyed state that evicts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Lines of a view.  Fixed value.
LINES = 20_000
OUTPUT = "job_id string, seq long, line string, oldest long"


class LastLines(StatefulProcessor):
    """A ring of ``limit`` lines a job: line k stands in slot k modulo the limit, so a new line costs one write.

    A job whose lines stop for ``idle_ms`` loses its view.
    """

    def __init__(self, limit: int = LINES, idle_ms: int | None = None) -> None:
        self.limit, self.idle_ms = limit, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")
        self.slots = handle.getMapState("slots", "slot long", "seq long, line string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        found = pd.concat(list(rows)).sort_values(["file", "at"], kind="stable")["line"].tolist()
        total = n + len(found)
        kept = found[-self.limit :]
        first = total - len(kept)
        for seq, line in enumerate(kept, first):
            self.slots.updateValue((seq % self.limit,), (seq, line))
        self.count.update((total,))
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        oldest = max(0, total - self.limit)
        yield pd.DataFrame({"job_id": key[0], "seq": range(first, total), "line": kept, "oldest": oldest})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.count.clear()
        self.slots.clear()
        yield pd.DataFrame({"job_id": [key[0]], "seq": [-1], "line": [None], "oldest": [-1]})

    def close(self) -> None:
        pass


def last_lines(lines: DataFrame, limit: int = LINES, idle_ms: int | None = None) -> DataFrame:
    """New lines of each job's view (job_id, seq, line, oldest): ``oldest`` is the first number that the view still has.

    ``lines``: a stream (job_id, file, at, line).  A job that timed out gives a row of number -1.  The state store must be
    RocksDB's (``spark.sql.streaming.stateStore.providerClass``).
    """
    return (
        lines.select(F.col("job_id").cast("string").alias("job_id"), "file", "at", "line")
        .groupBy("job_id")
        .transformWithStateInPandas(LastLines(limit, idle_ms), OUTPUT, "append", "none" if idle_ms is None else "processingTime")
    )


def view(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(job_id, seq, line): the views as the stream's last batch left them, read from its checkpoint."""
    state = spark.read.format("statestore").option("stateVarName", "slots").load(checkpoint)
    return state.select(F.col("key.job_id").alias("job_id"), F.col("user_map_value.seq").alias("seq"), F.col("user_map_value.line").alias("line"))
