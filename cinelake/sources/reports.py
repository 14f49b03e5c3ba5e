"""Readers of what other programs report: containers and their tracks, graphics cards and adapters, logs as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cinelake.functions import scalar as fn

# The fields of a container report, containers of the Matroska family, the fields of a card's line, parts of the
# names of adapters that only draw in software, the fields of a log line that every record has, and the order of levels.
PROPERTIES = "struct<codec_id:string,language:string,track_name:string,default_track:boolean,forced_track:boolean,enabled_track:boolean,uid:string>"
CONTAINER = (
    "file_name string, container struct<type:string,properties:struct<duration:string,title:string>>, "
    f"tracks array<struct<id:string,type:string,codec:string,properties:{PROPERTIES}>>, "
    "attachments array<struct<id:string,file_name:string,content_type:string,description:string,size:string,properties:struct<uid:string>>>, "
    "chapters array<struct<num_entries:string>>"
)
MATROSKA = "matroska", "webm"
TRACKS = "array<struct<id:bigint,type:string,codec:string,codec_id:string,language:string,track_name:string,is_default:boolean,forced:boolean,enabled:boolean,uid:bigint>>"
ATTACHMENTS = "array<struct<id:bigint,filename:string,content_type:string,description:string,size:bigint,uid:bigint>>"
CARD = "name", "vram_total_mib", "vram_free_mib", "driver_version", "compute_capability", "pci_bus_id"
SOFTWARE = "microsoft basic|remote display"
RECORD = "ts", "level", "logger", "msg", "exc"
LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}


def whole(text: Column, otherwise: int | None = None) -> Column:
    """A whole number from text, or what stands for none."""
    return F.coalesce(text.try_cast("long"), F.lit(otherwise).cast("long"))


def containers(reports: DataFrame) -> DataFrame:
    """Containers of reports (S07, A10): tracks and attachments as arrays, and the entries of all chapters summed.

    ``reports``: (source_id, value), a JSON text each.  A text that is no JSON object gives a row with ``readable`` false and
    nothing else; fields that a report lacks are as if off, empty or 0, a track is enabled unless
    the report says otherwise, and a container without a name has its source's.
    """
    d = F.from_json("value", CONTAINER, {"mode": "PERMISSIVE"})
    # A JSON text is an object if a brace opens it; a schema of all that it holds, to tell the same, costs more than the parse.
    opened = F.ltrim("value", F.lit(" \t\r\n")).startswith("{")
    readable = F.coalesce(F.try_parse_json("value").isNotNull() & opened, F.lit(False))
    off, empty = F.lit(False), F.lit("")
    c = lambda path: F.col(f"d.{path}")
    tracks = F.transform(
        c("tracks"),
        lambda t: F.struct(
            whole(t["id"], -1).alias("id"), F.coalesce(t["type"], empty).alias("type"), F.coalesce(t["codec"], empty).alias("codec"),
            F.coalesce(t["properties"]["codec_id"], empty).alias("codec_id"), t["properties"]["language"].alias("language"),
            t["properties"]["track_name"].alias("track_name"), F.coalesce(t["properties"]["default_track"], off).alias("is_default"),
            F.coalesce(t["properties"]["forced_track"], off).alias("forced"), F.coalesce(t["properties"]["enabled_track"], ~off).alias("enabled"),
            whole(t["properties"]["uid"]).alias("uid"),
        ),
    )
    attachments = F.transform(
        c("attachments"),
        lambda a: F.struct(
            whole(a["id"], -1).alias("id"), F.coalesce(a["file_name"], empty).alias("filename"), a["content_type"].alias("content_type"),
            a["description"].alias("description"), whole(a["size"], 0).alias("size"), whole(a["properties"]["uid"]).alias("uid"),
        ),
    )
    chapters = F.aggregate(F.coalesce(c("chapters"), F.array().cast("array<struct<num_entries:string>>")), F.lit(0).cast("long"), lambda n, x: n + whole(x["num_entries"], 0))
    kind = F.coalesce(c("container.type"), empty)
    only = lambda x: F.when(F.col("readable"), x)
    return reports.select("source_id", d.alias("d"), readable.alias("readable")).select(
        "source_id",
        "readable",
        only(F.coalesce(F.nullif(c("file_name"), empty), F.col("source_id").cast("string"))).alias("file_name"),
        only(kind).alias("container"),
        only(F.lower(kind).isin(*MATROSKA)).alias("is_matroska"),
        only(c("container.properties.title")).alias("title"),
        only(whole(c("container.properties.duration"))).alias("duration_ns"),
        F.coalesce(only(tracks), F.array().cast(TRACKS)).alias("tracks"),
        F.coalesce(only(attachments), F.array().cast(ATTACHMENTS)).alias("attachments"),
        only(chapters).alias("chapter_entries"),
    )


def exploded(found: DataFrame, column: str) -> DataFrame:
    """(source_id, position, x): the entries of an array column of ``containers``.

    The outer form, whose rows without an entry are dropped, since for the inner one Spark infers a filter over the array: moved
    below, it would write and parse each report again for every row of the join beneath.
    """
    return found.select("source_id", F.posexplode_outer(column).alias("position", "x")).where("position is not null")


def container_tracks(found: DataFrame) -> DataFrame:
    """A row a track of ``containers``."""
    return exploded(found, "tracks").select("source_id", "position", "x.*")


def container_attachments(found: DataFrame) -> DataFrame:
    """A row an attachment of ``containers``: what J06 joins sizes from."""
    return exploded(found, "attachments").select("source_id", "x.*")


def cards(lines: DataFrame) -> DataFrame:
    """Graphics cards of comma-separated lines (S23): those of six fields or more whose two sizes are whole numbers."""
    parts = F.transform(F.split("value", ","), lambda x: F.trim(x))
    field = dict(zip(CARD, (F.get("parts", k) for k in range(len(CARD)))))
    sizes = {c: F.when(field[c].rlike("^[+-]?[0-9]+$"), field[c].try_cast("long")) for c in CARD[1:3]}
    blank = {c: F.nullif(field[c], F.lit("")) for c in CARD[4:]}
    rows = lines.select("source_id", parts.alias("parts")).where(F.size("parts") >= len(CARD))
    return rows.select("source_id", *((sizes | blank).get(c, field[c]).alias(c) for c in CARD)).where("vram_total_mib is not null and vram_free_mib is not null")


def adapters(reports: DataFrame) -> DataFrame:
    """Display adapters of JSON reports, an object or an array of objects each (S23): named ones that do not draw in software.

    ``reports``: (source_id, value).  What is no JSON has none; memory that is no number is unknown.
    """
    v = F.try_parse_json("value")
    several = F.try_variant_get("v", "$", "array<variant>")
    rows = reports.select("source_id", v.alias("v")).select("source_id", F.explode(F.coalesce(several, F.array("v"))).alias("x"))
    name = F.trim(F.try_variant_get("x", "$.Name", "string"))
    found = rows.select("source_id", name.alias("name"), F.try_variant_get("x", "$.AdapterRAM", "bigint").alias("ram_bytes"))
    return found.where((F.col("name") != "") & ~F.lower("name").rlike(SOFTWARE))


def preferred_vendors(adapters: DataFrame) -> DataFrame:
    """(source_id, vendor): the maker to use where no card of the first choice was found.

    Where both makers appear, that of the larger memory, AMD at equal or unknown memory; adapters of other makers do not count.
    """
    most = lambda v: F.max(F.when(F.col("vendor") == v, F.coalesce("ram_bytes", F.lit(0).cast("long"))))
    sizes = adapters.withColumn("vendor", fn.vendor(F.col("name"))).groupBy("source_id").agg(most("amd").alias("amd"), most("intel").alias("intel"))
    first = F.when(F.col("intel").isNull() | (F.col("amd") >= F.col("intel")), "amd")
    vendor = F.when(F.col("amd").isNotNull(), F.coalesce(first, F.lit("intel"))).when(F.col("intel").isNotNull(), "intel").otherwise("unknown")
    return sizes.select("source_id", vendor.alias("vendor"))


def log_records(lines: DataFrame) -> DataFrame:
    """Records of JSON lines (S21): the common fields, the job, and what else a line says as a map; batch or stream.

    ``lines``: at least (value).  A line that is no JSON object is kept as a message without level, so nothing is lost.
    """
    said = F.from_json("value", "map<string,string>")
    rows = lines.withColumn("said", F.when(F.trim("value").startswith("{"), said))
    get = lambda name: F.try_element_at("said", F.lit(name))
    more = F.map_filter("said", lambda k, _: ~k.isin(*RECORD, "job_id"))
    return rows.select(
        *lines.columns,
        F.try_to_timestamp(get("ts"), F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("ts"),
        F.upper(get("level")).alias("level"),
        get("logger").alias("logger"),
        F.when(F.col("said").isNull(), F.col("value")).otherwise(get("msg")).alias("msg"),
        get("exc").alias("exc"),
        get("job_id").alias("job_id"),
        more.alias("more"),
    ).drop("value")


def at_least(records: DataFrame, level: str) -> DataFrame:
    """Records at or above a level; those without a known level stay."""
    rank = F.coalesce(*(F.when(F.col("level") == name, F.lit(k)) for name, k in LEVELS.items()))
    return records.where(F.coalesce(rank, F.lit(LEVELS["CRITICAL"])) >= LEVELS[level.upper()])


def job_logs(records: DataFrame, path: str, checkpoint: str, level: str = "DEBUG") -> StreamingQuery:
    """Writes a stream of records as a folder of JSON lines a job, so one job's log is read without the others' (S21)."""
    kept = at_least(records, level).where("job_id is not null")
    return (
        kept.writeStream.format("json").partitionBy("job_id").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )
