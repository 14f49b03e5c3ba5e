"""Readers of container metadata, quality scores and folders of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STREAM = (
    "struct<index:int,codec_type:string,codec_name:string,width:int,height:int,pix_fmt:string,avg_frame_rate:string,"
    "nb_frames:string,duration:string,disposition:map<string,int>,tags:map<string,string>>"
)
PROBE = (
    f"streams array<{STREAM}>, chapters array<struct<start_time:string,end_time:string,tags:map<string,string>>>, "
    "format struct<filename:string,format_name:string,duration:string,size:string,bit_rate:string>"
)


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """One row a probe document (S01), with the text numbers read or null, and attachments apart."""
    raw = spark.read.schema(PROBE).json(path, multiLine=True)
    return raw.select(
        F.col("format.filename").alias("filename"),
        F.col("format.duration").try_cast("double").alias("duration_s"),
        F.contains("format.format_name", F.lit("matroska")).alias("is_matroska"),
        F.filter("streams", lambda s: s["codec_type"] != "attachment").alias("streams"),
        F.filter("streams", lambda s: s["codec_type"] == "attachment").alias("attachments"),
        F.transform(
            "chapters",
            lambda c: F.struct(c["start_time"].try_cast("double").alias("start_s"), c["end_time"].try_cast("double").alias("end_s")),
        ).alias("chapters"),
    )


def primary_video(probes: DataFrame) -> DataFrame:
    """The first video stream that is no cover picture."""
    cover = lambda s: F.coalesce(F.try_element_at(s["disposition"], F.lit("attached_pic")), F.lit(0))
    videos = F.filter("streams", lambda s: (s["codec_type"] == "video") & (cover(s) == 0))
    return probes.select("filename", F.get(videos, 0).alias("video"))


def read_quality(spark: SparkSession, path: str) -> DataFrame:
    """Mean and harmonic mean of quality scores (S08, A06): the pooled ones, else the mean over frames."""
    schema = "pooled_metrics struct<vmaf:struct<mean:double,harmonic_mean:double>>, frames array<struct<metrics:struct<vmaf:double>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    scored = F.filter(F.transform("frames", lambda f: f["metrics"]["vmaf"]), lambda x: x.isNotNull())
    average = F.aggregate(scored, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(scored), F.lit(0))
    return raw.select(
        F.coalesce("pooled_metrics.vmaf.mean", average).alias("mean"),
        F.col("pooled_metrics.vmaf.harmonic_mean").alias("harmonic_mean"),
    )


def frame_folders(spark: SparkSession, path: str, suffix: str = "png") -> DataFrame:
    """Numbered frames and their bytes in each folder (S18, A08); contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", True).load(path)
    return (
        files.select("path", "length")
        .where(F.col("path").rlike(rf"/\d+\.{suffix}$"))
        .groupBy(F.regexp_replace("path", "/[^/]+$", "").alias("folder"))
        .agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    )


def videos(spark: SparkSession, path: str) -> DataFrame:
    """Video files below a folder by suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length").where(F.lower("path").rlike(r"\.(mkv|mp4|avi|mov|m4v|webm|ts|wmv)$")).orderBy("path")
