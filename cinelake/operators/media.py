"""Operators on containers and their streams: mapping into an output, and validation of what came out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stream_counts(streams: DataFrame) -> DataFrame:
    """Streams, and default streams, of each kind in a file."""
    kinds = ("video", "audio", "subtitle")
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds]
    defaults = [F.count_if((F.col("kind") == k) & F.col("is_default")).alias(f"default_{k}") for k in kinds]
    return streams.groupBy("file_id").agg(*counts, *defaults)


def mapped_streams(streams: DataFrame, container: str) -> DataFrame:
    """Streams with their number among the kept ones of their kind, or why they are left out.

    Matroska takes every subtitle, MP4 those in ``mov_text`` only.
    """
    kept = F.lit(True) if container == "mkv" else (F.col("kind") != "subtitle") | (F.col("codec_name") == "mov_text")
    marked = streams.withColumn("kept", kept)
    order = W.partitionBy("file_id", "kind", "kept").orderBy("index")
    return marked.select(
        "file_id",
        "index",
        "kind",
        F.when(F.col("kept"), (F.row_number().over(order) - 1).cast("long")).alias("out_idx"),
        F.when(~F.col("kept"), F.concat(F.lit("no "), F.col("codec_name"), F.lit(" in mp4"))).alias("reason"),
    )


def muxer(container: Column, attachments: Column, chapters: Column) -> Column:
    """Which tool writes the file; the first rule that holds counts."""
    return (
        F.when(container == "mp4", "ffmpeg")
        .when(attachments > 0, "mkvmerge")
        .when(chapters > 1, "mkvmerge")
        .otherwise("ffmpeg+propedit")
    )


def attachment_sizes(attachments: DataFrame, sizes: DataFrame) -> DataFrame:
    """Attachments with the sizes that another tool reports, 0 where it has none."""
    return attachments.join(sizes, ["file_id", "filename"], "left").withColumn("size", F.coalesce("size", F.lit(0)))


#: Transfers that count as converted to BT.709.
BT709_TRANSFERS = "", "unknown", "bt709", "smpte170m", "bt470bg", "iec61966-2-1"


#: Seconds and pixels that an output may differ by.
DURATION_TOLERANCE, PIXEL_TOLERANCE = 0.20, 2


def validation_report(pairs: DataFrame) -> DataFrame:
    """(file_id, code, severity, expected, got): what an output lost against its source and plan.

    ``pairs`` holds expected and got values side by side (``e_`` and ``g_``): duration, video (pictures attached do not
    count), width, height, audio, subtitle, chapters, attachments, transfer, audio_default and subtitle_default; and
    container, copy_chapters, copy_attachments, target_w and target_h (what the plan asked for; null or 0 keeps the source's
    size), hdr (the source was HDR or 10-bit) and roundtripped (the plan made it 8-bit).  Columns that are left out say
    nothing of their rules.  Losing every default flag of a kind is a failure, losing some a note; a duration that is not
    known is a note.  An output passes if it has no failure.
    """
    c = lambda k: F.col(k) if k in pairs.columns else F.lit(None)
    yes = lambda k: F.coalesce(c(k), F.lit(False))
    e_transfer, g_transfer = (F.lower(F.coalesce(c(k), F.lit(""))) for k in ("e_transfer", "g_transfer"))
    seconds = lambda k: F.format_string("%.3fs", c(k).cast("double"))

    def rule(code: str, broken: Column, expected: Column, got: Column, severity: Column | str = "failure") -> Column:
        level = F.lit(severity) if isinstance(severity, str) else severity
        values = (F.lit(code), level, expected.cast("string"), got.cast("string"))
        return F.when(broken, F.struct(*(v.alias(k) for v, k in zip(values, ("code", "severity", "expected", "got")))))

    def count_differs(what: str) -> Column:
        return rule(f"{what}_stream_count", c(f"e_{what}") != c(f"g_{what}"), c(f"e_{what}"), c(f"g_{what}"))

    def count_lost(what: str, wanted: Column) -> Column:
        e, g = c(f"e_{what}"), c(f"g_{what}")
        return rule(f"{what}_lost", wanted & (e > 0) & (g != e), e, g)

    def default_lost(kind: str) -> Column:
        e, g = c(f"e_{kind}_default"), c(f"g_{kind}_default")
        severity = F.when(g == 0, "failure").otherwise("note")
        return rule(f"{kind}_streams_default_lost", (e > 0) & (g < e), e, g, severity)

    far = lambda want, got: got.isNull() | (F.abs(got - want) > PIXEL_TOLERANCE)
    size = lambda w, h: F.concat(F.coalesce(w.cast("string"), F.lit("?")), F.lit("x"), F.coalesce(h.cast("string"), F.lit("?")))
    planned = F.coalesce((c("target_w") > 0) & (c("target_h") > 0), F.lit(False))
    rules = [
        rule("duration_mismatch", F.abs(c("e_duration") - c("g_duration")) > DURATION_TOLERANCE, seconds("e_duration"), seconds("g_duration")),
        rule("duration_unknown", c("e_duration").isNull() | c("g_duration").isNull(), c("e_duration"), c("g_duration"), "note"),
        rule("video_stream_count", c("g_video") != 1, F.lit(1), c("g_video")),
        rule("video_resolution", planned & (far(c("target_w"), c("g_width")) | far(c("target_h"), c("g_height"))), size(c("target_w"), c("target_h")), size(c("g_width"), c("g_height"))),
        rule("video_resolution_drift", ~planned & (F.abs(c("e_width") - c("g_width")) > PIXEL_TOLERANCE), c("e_width"), c("g_width")),
        count_differs("audio"),
        count_differs("subtitle"),
        count_lost("chapters", F.coalesce(c("copy_chapters"), F.lit(False))),
        count_lost("attachments", F.coalesce(c("copy_attachments"), F.lit(True)) & (c("container") == "mkv")),
        rule("hdr_transfer_residual", yes("hdr") & yes("roundtripped") & ~g_transfer.isin(*BT709_TRANSFERS), F.lit("bt709 (or unspecified)"), g_transfer),
        rule("hdr_roundtripped", yes("hdr") & yes("roundtripped") & g_transfer.isin(*BT709_TRANSFERS), e_transfer, g_transfer, "note"),
        rule("hdr_transfer_lost", yes("hdr") & ~yes("roundtripped") & (e_transfer != "") & (g_transfer != "") & (e_transfer != g_transfer), e_transfer, g_transfer),
        default_lost("audio"),
        default_lost("subtitle"),
    ]
    if not {"e_duration", "g_duration"} <= set(pairs.columns):
        rules = rules[2:]
    return pairs.select("file_id", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("r")).select("file_id", "r.*")


def missing_pins(pins: DataFrame, installed: DataFrame) -> DataFrame:
    """Pinned tools to fetch: missing, or of another version."""
    found = pins.join(installed, "tool_id", "left")
    status = F.when(F.col("version").isNull(), "missing").when(
        ~F.startswith(F.ltrim("version"), F.col("expected")), "mismatch"
    )
    return found.withColumn("status", status).where(F.col("status").isNotNull()).select("tool_id", "expected", "version", "status")


#: Tools that come with another's pin.
SUPPLIED_BY = {"ffprobe": "ffmpeg", "mkvpropedit": "mkvmerge", "mkvinfo": "mkvmerge"}


def supplying_pins(tools: DataFrame, pins: DataFrame) -> DataFrame:
    """(tool_id, pin, expected) of tools (tool_id): the pin of each one, or of the tool that it comes with.

    ``pins``: (tool_id, expected), a row a tool.  A tool without a pin has nulls.
    """
    own = F.coalesce(*(F.when(F.col("tool_id") == a, b) for a, b in SUPPLIED_BY.items()), F.col("tool_id"))
    return tools.select("tool_id", own.alias("__pin")).join(
        pins.select(F.col("tool_id").alias("__pin"), F.col("tool_id").alias("pin"), "expected"), "__pin", "left"
    ).drop("__pin")
