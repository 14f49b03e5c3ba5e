"""Queries of what other programs report: the reports are written as text from the tables' rows, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.functions import canonical
from cinelake.queries import query, table
from cinelake.sources import reports

TRACK = {"type": "CASE l_linenumber WHEN 1 THEN 'video' WHEN 4 THEN 'subtitles' ELSE 'audio' END", "default_track": "CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 3 = 1 END", "uid": "CASE WHEN l_suppkey % 4 > 0 THEN l_partkey END"}
KIND = "CASE o_custkey % 3 WHEN 0 THEN 'Matroska' WHEN 1 THEN 'WebM' ELSE 'QuickTime/MP4' END"


def container_reports(spark: SparkSession, d: str) -> DataFrame:
    """A JSON report of each order, whose lines are its tracks, of each line's chapters and, if it is finished, an attachment."""
    c = F.col
    t = {name: F.expr(e) for name, e in TRACK.items()}
    properties = F.struct(c("l_returnflag").alias("language"), t["default_track"].alias("default_track"), (c("l_linenumber") == 3).alias("forced_track"), t["uid"].alias("uid"))
    track = F.struct(c("l_linenumber").alias("id"), t["type"].alias("type"), c("l_linestatus").alias("codec"), properties.alias("properties"))
    font = F.struct(c("l_linenumber").alias("id"), F.concat(c("l_linestatus"), F.lit('"é.ttf')).alias("file_name"), c("l_partkey").alias("size"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(track)).alias("tracks"),
        F.collect_list(F.when(c("l_linestatus") == "F", font)).alias("attachments"),
        F.collect_list(F.struct((c("l_suppkey") % 5).alias("num_entries"))).alias("chapters"),
    )
    orders = table(spark, d, "orders")
    about = F.struct(F.expr(KIND).alias("type"), F.struct((c("o_orderkey") * 1_000_000_007).alias("duration"), c("o_orderstatus").alias("title")).alias("properties"))
    report = F.to_json(F.struct(c("o_orderpriority").alias("file_name"), about.alias("container"), "tracks", "attachments", "chapters"))
    text = F.when(c("o_orderkey") % 9 == 0, F.expr("left(report, 40)")).otherwise(c("report"))
    return orders.join(lines, c("o_orderkey") == c("l_orderkey")).select("o_orderkey", report.alias("report")).select(c("o_orderkey").alias("source_id"), text.alias("value"))


@query(f"""WITH l AS (SELECT l_orderkey, count(*) AS tracks, count(*) FILTER ({TRACK['default_track']}) AS defaults, count(*) FILTER (l_linestatus = 'F') AS attachments,
  coalesce(sum(l_partkey) FILTER (l_linestatus = 'F'), 0)::BIGINT AS attachment_bytes, sum(l_suppkey % 5)::BIGINT AS chapter_entries FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS source_id, o_orderkey % 9 > 0 AS readable, CASE WHEN readable THEN {KIND} END AS container, CASE WHEN readable THEN o_custkey % 3 < 2 END AS is_matroska, CASE WHEN readable THEN o_orderpriority END AS file_name,
  CASE WHEN readable THEN o_orderkey * 1000000007 END AS duration_ns, CASE WHEN readable THEN tracks ELSE 0 END AS tracks, CASE WHEN readable THEN defaults ELSE 0 END AS defaults,
  CASE WHEN readable THEN attachments ELSE 0 END AS attachments, CASE WHEN readable THEN attachment_bytes ELSE 0 END AS attachment_bytes, CASE WHEN readable THEN chapter_entries END AS chapter_entries
FROM orders JOIN l ON l_orderkey = o_orderkey""")
def s07_containers(spark: SparkSession, d: str) -> DataFrame:
    """Containers as another tool reports them."""
    found = reports.containers(container_reports(spark, d))
    total = F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["size"])
    return found.select(
        "source_id", "readable", "container", "is_matroska", "file_name", "duration_ns", F.size("tracks").cast("long").alias("tracks"),
        F.size(F.filter("tracks", lambda t: t["is_default"])).cast("long").alias("defaults"), F.size("attachments").cast("long").alias("attachments"),
        total.alias("attachment_bytes"), "chapter_entries",
    )


@query(f"""SELECT l_orderkey AS source_id, l_linenumber AS id, {TRACK['type']} AS type, l_linestatus AS codec, l_returnflag AS language, coalesce({TRACK['default_track']}, false) AS is_default,
  l_linenumber = 3 AS forced, true AS enabled, {TRACK['uid']} AS uid FROM lineitem WHERE l_orderkey % 9 > 0 AND l_orderkey IN (SELECT o_orderkey FROM orders)""")
def s07_tracks(spark: SparkSession, d: str) -> DataFrame:
    """The tracks of those reports."""
    rows = reports.container_tracks(reports.containers(container_reports(spark, d)))
    return rows.select("source_id", F.col("id").cast("int").alias("id"), "type", "codec", "language", "is_default", "forced", "enabled", "uid")


CARD_LINE = "concat(p_name, ' , ', cast(p_size * 256 AS string), ', ', CASE WHEN p_partkey % 5 = 0 THEN '[N/A]' ELSE cast(p_size * 100 AS string) END, ',', p_brand, ', ', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '8.6' END, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE ', 00:01' END)"


@query("""SELECT p_partkey AS source_id, trim(p_name) AS name, (p_size * 256)::BIGINT AS vram_total_mib, (p_size * 100)::BIGINT AS vram_free_mib, p_brand AS driver_version,
  CASE WHEN p_partkey % 3 > 0 THEN '8.6' END AS compute_capability, '00:01' AS pci_bus_id FROM part WHERE p_partkey % 5 > 0 AND p_partkey % 7 > 0""")
def s23_cards(spark: SparkSession, d: str) -> DataFrame:
    """Graphics cards read from lines."""
    lines = table(spark, d, "part").select(F.col("p_partkey").alias("source_id"), F.expr(CARD_LINE).alias("value"))
    return reports.cards(lines)


ADAPTER = {"name": "CASE c_custkey % 5 WHEN 0 THEN 'Intel UHD' WHEN 1 THEN ' AMD Radeon ' WHEN 2 THEN 'Microsoft Basic Display' WHEN 3 THEN 'Radeon Pro' ELSE 'Virtual' END", "ram": "CASE WHEN c_custkey % 4 > 0 THEN floor(c_acctbal) END"}


@query(f"""WITH a AS (SELECT c_nationkey AS source_id, {ADAPTER['name']} AS name, coalesce({ADAPTER['ram']}, 0)::BIGINT AS ram FROM customer),
m AS (SELECT source_id, max(ram) FILTER (name ILIKE '%amd%' OR name ILIKE '%radeon%') AS amd, max(ram) FILTER (name ILIKE '%intel%') AS intel FROM a WHERE name NOT LIKE 'Microsoft Basic%' GROUP BY source_id)
SELECT source_id, CASE WHEN amd IS NULL AND intel IS NULL THEN 'unknown' WHEN amd IS NULL THEN 'intel' WHEN intel IS NULL OR amd >= intel THEN 'amd' ELSE 'intel' END AS vendor FROM m""")
def s23_vendors(spark: SparkSession, d: str) -> DataFrame:
    """The maker of each host's adapters that counts, from reports of an adapter or of several."""
    one = F.struct(F.expr(ADAPTER["name"]).alias("Name"), F.expr(ADAPTER["ram"]).cast("long").alias("AdapterRAM"))
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("source_id"), "c_custkey", F.to_json(one).alias("value"))
    several = rows.where("c_custkey % 2 = 0").groupBy("source_id", F.floor(F.col("c_custkey") / 20)).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit(",3]")).alias("value"))
    return reports.preferred_vendors(reports.adapters(rows.where("c_custkey % 2 = 1").select("source_id", "value").unionByName(several.select("source_id", "value"))))


@query("""WITH r AS (SELECT user_id, event_id, ts, event_type, value, CASE event_id % 4 WHEN 0 THEN 'DEBUG' WHEN 1 THEN 'INFO' WHEN 2 THEN 'WARNING' ELSE 'ERROR' END AS level FROM events)
SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id::VARCHAR END AS job_id, CASE WHEN event_id % 10 > 0 THEN level END AS level, count(*) AS n, count(DISTINCT CASE WHEN event_id % 10 > 0 THEN event_type ELSE 'no json ' || event_id END) AS messages,
  max(CASE WHEN event_id % 10 > 0 THEN epoch(date_trunc('second', ts))::BIGINT END) AS last, sum(CASE WHEN event_id % 10 > 0 THEN event_id % 97 END)::BIGINT AS frames
FROM r WHERE event_id % 10 = 0 OR level <> 'DEBUG' GROUP BY ALL""")
def s21_job_logs(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines of all jobs by job and level, debug lines left out and unreadable lines kept."""
    k = F.col("event_id")
    level = F.element_at(F.array(*map(F.lit, ("debug", "INFO", "WARNING", "ERROR"))), (k % 4 + 1).cast("int"))
    line = F.struct(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), level.alias("level"), F.lit("stage").alias("logger"), F.col("event_type").alias("msg"),
        F.col("user_id").cast("string").alias("job_id"), (k % 97).alias("frame"),
    )
    text = F.when(k % 10 == 0, F.concat(F.lit("no json "), k.cast("string"))).otherwise(F.to_json(line))
    records = reports.at_least(reports.log_records(table(spark, d, "events").select(text.alias("value"))), "info")
    return records.groupBy("job_id", "level").agg(
        F.count("*").alias("n"), F.countDistinct("msg").alias("messages"), F.max(F.unix_timestamp("ts")).alias("last"),
        F.sum(F.try_element_at("more", F.lit("frame")).cast("long")).alias("frames"),
    )


@query("""WITH e AS (SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS names FROM orders GROUP BY o_custkey)
SELECT c_custkey AS host, c_nationkey || '|' || CASE WHEN c_custkey % 3 > 0 THEN c_custkey ELSE 0 END || '|' || CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment ELSE 'none' END || '|' || c_custkey % 9 * 1024 || '|none|7.1|'
  || CASE WHEN c_custkey % 2 = 0 THEN 'nvidia' ELSE 'none' END || '|' || CASE WHEN c_custkey % 2 = 0 THEN '10' ELSE '00' END || CASE WHEN c_custkey % 5 = 0 THEN '1' ELSE '0' END
  || '|000|0' || CASE WHEN c_custkey % 7 = 0 THEN '1' ELSE '0' END || '|010|' || coalesce(names, '') || '|' AS text, true AS same_key, 24 AS digits FROM customer LEFT JOIN e ON o_custkey = c_custkey""")
def f12_hosts(spark: SparkSession, d: str) -> DataFrame:
    """what tells hosts apart, and its key, whatever order the encoders come in."""
    k = F.col("c_custkey")
    names = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("names"))
    hosts = table(spark, d, "customer").join(names, F.col("o_custkey") == k, "left").select(
        k.alias("host"), F.col("c_nationkey").alias("cores"), F.when(k % 3 > 0, k).alias("ram_mib"), F.when(k % 4 > 0, F.col("c_mktsegment")).alias("arch"),
        (k % 9 * 1024).alias("vram_mib"), F.lit("").alias("driver"), F.lit("7.1").alias("ffmpeg"), F.when(k % 2 == 0, "nvidia").alias("vendor"), "names",
        F.create_map(F.lit("qsv_h264"), k % 2 == 0, F.lit("qsv_av1"), k % 5 == 0, F.lit("d3d12_av1"), k % 7 == 0, F.lit("vulkan_hevc"), F.lit(True)).alias("flags"),
    )
    text = canonical.host_text(F.col("flags"), F.col("names"))
    turned = canonical.host_text(F.col("flags"), F.reverse("names"))
    keyed = hosts.select("host", text.alias("text"), canonical.host_key(text).alias("a"), canonical.host_key(turned).alias("b"))
    return keyed.select("host", "text", (F.col("a") == F.col("b")).alias("same_key"), F.length("a").alias("digits"))
