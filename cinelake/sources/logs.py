"""Readers of tool logs and sidecar text.  Each takes lines (source_id, line_no, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelake.functions.scalar import clock_seconds


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files in order; a file is read as one record, so line numbers are sure."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_id"), "value")
    return whole.select("source_id", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def packets(lines: DataFrame) -> DataFrame:
    """Packets of key=value fields parted by | (S02): the first time that there is, lengths above zero only."""
    fields = F.str_to_map("value", F.lit("[|]"), F.lit("="))
    number = lambda k: F.try_element_at(fields, F.lit(k)).try_cast("double")
    dur = F.coalesce(number("pkt_duration_time"), number("duration_time"))
    return lines.select(
        "source_id",
        F.coalesce(number("pkt_pts_time"), number("pts_time"), number("best_effort_timestamp_time")).alias("pts"),
        F.when(dur > 0, dur).alias("dur"),
        F.coalesce(F.contains(F.try_element_at(fields, F.lit("flags")), F.lit("K")), F.lit(False)).alias("is_key"),
    ).where(F.col("pts").isNotNull())


def scores(lines: DataFrame, header: str = r"frame:\s*(\d+)", value: str = r"scene_score=([0-9.eE+-]+)") -> DataFrame:
    """Scene scores (S03): a header line names the frame of the lines that follow; the last of a frame wins."""
    w = W.partitionBy("source_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    frame = F.nullif(F.regexp_extract("value", header, 1), F.lit("")).cast("int")
    score = F.nullif(F.regexp_extract("value", value, 1), F.lit("")).try_cast("double")
    return (
        lines.withColumn("n", F.last(frame, ignorenulls=True).over(w))
        .withColumn("score", score)
        .where(F.col("n").isNotNull() & F.col("score").isNotNull())
        .groupBy("source_id", "n")
        .agg(F.max_by("score", "line_no").alias("score"))
    )


def showinfo_scores(lines: DataFrame) -> DataFrame:
    """Scene scores of showinfo lines (S04), each of which names its frame; the last of a frame wins."""
    n = F.nullif(F.regexp_extract("value", r"\bn:\s*(\d+)", 1), F.lit("")).cast("int")
    score = F.nullif(F.regexp_extract("value", r"scene_score[:=]\s*([0-9.eE+-]+)", 1), F.lit("")).try_cast("double")
    return (
        lines.where(F.col("value").contains("showinfo"))
        .select("source_id", "line_no", n.alias("n"), score.alias("score"))
        .where("n is not null and score is not null")
        .groupBy("source_id", "n")
        .agg(F.max_by("score", "line_no").alias("score"))
    )


def preferred_scores(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first``, and ``second`` for the sources that ``first`` knows nothing of."""
    return first.unionByName(second.join(first.select("source_id").distinct(), "source_id", "left_anti"))


def scene_cuts(lines: DataFrame) -> DataFrame:
    """Cuts of a scene detector's log (S06): (source_id, score, seconds)."""
    score = F.regexp_extract("value", r"score:\s*([0-9.]+)", 1).try_cast("double")
    time = clock_seconds(F.regexp_extract("value", r"time:\s*([0-9:.]+)", 1))
    return lines.select("source_id", score.alias("score"), time.alias("pts_time_s")).where("score is not null and pts_time_s is not null")


def encoder_list(lines: DataFrame) -> DataFrame:
    """Video encoders of an encoder listing (S22): what follows the ruler and has type V."""
    w = W.partitionBy("source_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    after = F.max(F.trim("value").rlike("^-{4,}$")).over(w)
    parts = F.split(F.trim("value"), r"\s+", 3)
    return (
        lines.withColumn("after", after)
        .where(F.col("after") & F.trim("value").rlike(r"^V\S*\s"))
        .select("source_id", F.get(parts, 1).alias("name"), F.get(parts, 2).alias("description"))
    )
