"""Encoder choice: a graph of fallbacks, resolved against what a host can run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values: (encoder, rank of the fallback, fallback).
FALLBACKS = (
    ("av1_nvenc", 1, "hevc_nvenc"), ("hevc_nvenc", 1, "h264_nvenc"), ("h264_nvenc", 1, "h264_d3d12"), ("h264_nvenc", 2, "libx264"),
    ("hevc_nvenc", 2, "libx265"), ("av1_nvenc", 2, "libsvtav1"), ("hevc_qsv", 1, "h264_qsv"), ("hevc_qsv", 2, "libx265"),
    ("h264_qsv", 1, "libx264"), ("hevc_amf", 1, "h264_amf"), ("hevc_amf", 2, "libx265"), ("h264_amf", 1, "libx264"),
    ("av1_d3d12", 1, "av1_vulkan"), ("av1_d3d12", 2, "libsvtav1"), ("libsvtav1", 1, "libx265"), ("libx265", 1, "libx264"),
)


def longest_chain(edges: DataFrame) -> int:
    """Steps of the longest chain of fallbacks that comes to no encoder twice: one small job a step."""
    level = edges.select(F.col("fallback").alias("encoder"), F.array("encoder", "fallback").alias("path"))
    steps = 0
    while not level.isEmpty():
        steps += 1
        level = (
            level.join(edges, "encoder")
            .where(~F.array_contains("path", F.col("fallback")))
            .select(F.col("fallback").alias("encoder"), F.array_append("path", F.col("fallback")).alias("path"))
            .distinct()
        )
    return steps


def resolved(requests: DataFrame, capable: DataFrame, edges: DataFrame) -> DataFrame:
    """The nearest capable encoder along the fallbacks: fewest steps, then the ranks in order.

    ``requests``: (host, wanted); ``capable``: (host, encoder); ``edges``: (encoder, rank, fallback).  The graph
    is small, so it is joined once a step of its longest chain; hosts are the parallel axis.
    """
    start = requests.select("host", "wanted", F.col("wanted").alias("encoder"), F.array("wanted").alias("path"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("ranks"))
    level, every = start, start
    for k in range(1, longest_chain(edges) + 1):
        level = (
            level.join(edges, "encoder")
            .where(~F.array_contains("path", F.col("fallback")))
            .select(
                "host", "wanted", F.col("fallback").alias("encoder"), F.array_append("path", F.col("fallback")).alias("path"),
                F.lit(k).alias("depth"), F.array_append("ranks", F.col("rank")).alias("ranks"),
            )
        )
        every = every.unionByName(level)
    best = (
        every.join(capable, ["host", "encoder"])
        .groupBy("host", "wanted")
        .agg(F.min(F.struct("depth", "ranks", "encoder", "path")).alias("b"))
    )
    return requests.join(best, ["host", "wanted"], "left").select(
        "host", "wanted", F.col("b.encoder").alias("encoder"), F.col("b.depth").alias("depth"), F.array_join("b.path", ">").alias("path")
    )
