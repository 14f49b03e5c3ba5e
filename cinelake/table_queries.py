"""Queries of tables and settings over time: published tables, older versions, SQL functions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.functions import scalar as fn
from cinelake.functions import sql as sql_functions
from cinelake.operators import jobs, media
from cinelake.queries import STREAM, query, stream, table
from cinelake.sinks import migrate, published


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a local session without one gets a temporary folder."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="published-")


@query("""WITH j AS (SELECT o_orderstatus AS state, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY o_orderstatus)
SELECT state, n, total, 'plan' AS kind, (SELECT count(*) FROM orders) AS jobs FROM j""")
def s16_published(spark: SparkSession, d: str) -> DataFrame:
    """A table published with a manifest, read back after a second publication was cut off."""
    orders = table(spark, d, "orders")
    path = f"{shared_folder(spark)}/published-{uuid.uuid4()}"
    rows = orders.groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    published.publish(rows.limit(0), path, {"kind": "empty"})
    published.publish(rows, path, {"kind": "plan", "jobs": orders.count()})
    rows.limit(1).write.parquet(f"{path}/data-cut-off")
    about = published.read_manifest(spark, path)["about"]
    return published.published(spark, path).withColumns({"kind": F.lit(about["kind"]), "jobs": F.lit(about["jobs"]).cast("long")})


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN '{"a":' || o_custkey || '}' END AS overrides, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS current_stage,
  CASE WHEN o_orderkey % 3 = 2 THEN o_orderstatus END AS last_failed_stage, CASE WHEN o_orderkey % 3 = 2 AND o_custkey % 2 = 0 THEN o_custkey % 4 ELSE 0 END::INT AS retry_count FROM orders""")
def s15_migrated(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of three versions read as the latest."""
    o = table(spark, d, "orders")
    first = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"))
    named = F.concat(F.lit('{"a":'), F.col("o_custkey").cast("string"), F.lit("}"))
    second = o.where("o_orderkey % 3 = 1").select(F.col("o_orderkey").alias("id"), named.alias("preset_overrides_json"), F.col("o_orderpriority").alias("current_stage"))
    third = o.where("o_orderkey % 3 = 2").select(
        F.col("o_orderkey").alias("id"), named.alias("overrides"), F.col("o_orderpriority").alias("current_stage"), F.col("o_orderstatus").alias("last_failed_stage"),
        F.when(F.col("o_custkey") % 2 == 0, (F.col("o_custkey") % 4).cast("int")).alias("retry_count"),
    )
    steps = (*migrate.JOBS, migrate.Migration(4, renamed=(("preset_overrides_json", "overrides"),)))
    third_steps = tuple(m._replace(added=tuple(a for a in m.added if a[0] != "preset_overrides_json")) for m in steps)
    old = migrate.union_of_versions([(first, 0), (second, 1)], steps)
    return old.unionByName(migrate.migrated(third, third_steps, 0)).select("id", "overrides", "current_stage", "last_failed_stage", "retry_count")


SETTINGS = """CASE c_custkey % 6 WHEN 0 THEN '{"hardware":{"prefer_nvenc":true,"x":1}}' WHEN 1 THEN '{"hardware":{"prefer_nvenc":0}}'
  WHEN 2 THEN '{"hardware":{"prefer_nvenc":true,"prefer_hardware_encoder":false}}' WHEN 3 THEN '{"hardware":{"x":' || c_custkey || '}}' WHEN 4 THEN '{"hardware":[' || c_custkey || ']}' ELSE 'no json' END"""


@query("SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS prefer_hardware FROM customer")
def s20_legacy_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings under keys of older versions."""
    found = migrate.legacy_values(F.expr(SETTINGS))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), found["hardware.prefer_hardware_encoder"].alias("prefer_hardware"))


@query(f"""WITH RECURSIVE {STREAM}, i AS (SELECT source_id, n AS item, 1 + n * 7 % 11 AS x, pts FROM s),
r AS (SELECT source_id, item, 0::BIGINT AS pack, x AS used FROM i WHERE item = 0 UNION ALL
  SELECT i.source_id, i.item, pack + (used > 0 AND used + x > 30)::BIGINT, CASE WHEN used > 0 AND used + x > 30 THEN x ELSE used + x END FROM r JOIN i ON i.source_id = r.source_id AND i.item = r.item + 1)
SELECT source_id::VARCHAR AS source_id, item, pack, floor(24000.0::DOUBLE / 1001 * pts + 0.5)::BIGINT AS frame, lpad(item::VARCHAR, 8, '0') || '.png' AS name, round_even(pts, 0)::BIGINT AS even, true AS same_key
FROM r JOIN s ON s.source_id = r.source_id AND s.n = r.item""".replace("SELECT source_id::VARCHAR AS source_id, item", "SELECT r.source_id::VARCHAR AS source_id, item"))
def x06_sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The library's functions called from SQL, a table function over partitions among them."""
    sql_functions.register(spark)
    s = stream(spark, d)
    items = s.select(F.col("source_id").cast("string").alias("source_id"), F.col("n").alias("item"), (1 + F.col("n") * 7 % 11).alias("size"))
    keyed = s.select(F.col("source_id").cast("string").alias("source_id"), F.col("n").alias("item"), "pts")
    return spark.sql(
        """WITH packed AS (SELECT * FROM pack_items(30, TABLE({items}) PARTITION BY source_id ORDER BY item))
        SELECT p.source_id, p.item, p.pack, media_frames(24000, 1001, k.pts) AS frame, media_frame_name(p.item) AS name, media_half_even(k.pts) AS even,
          media_hash_json(concat('{{"b":', p.item, ',"a":[]}}')) = media_hash_text(concat('{{"a":[],"b":', p.item, '}}')) AS same_key
        FROM packed p JOIN {keyed} k ON k.source_id = p.source_id AND k.item = p.item""",
        items=items,
        keyed=keyed,
    )


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders")
def s12_listed(spark: SparkSession, d: str) -> DataFrame:
    """Jobs in the order of their creation."""
    jobs_ = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return jobs.listed(jobs_).select("id", "position")


@query("""WITH f AS (SELECT l_orderkey AS job_id, CASE WHEN l_linenumber % 5 = 0 THEN 'part_' ELSE 'segment_' END || l_linenumber || CASE WHEN l_partkey % 7 = 0 THEN '.tmp' ELSE '.mkv' END AS name, (l_quantity::INT - 10) AS length FROM lineitem),
k AS (SELECT o_orderkey AS job_id, '/w/segment_0.mkv' AS path FROM orders WHERE o_orderstatus = 'F')
SELECT job_id, path FROM k UNION SELECT job_id, '/w/' || name FROM f WHERE length > 0 AND name LIKE 'segment!_%.mkv' ESCAPE '!' AND job_id NOT IN (SELECT job_id FROM k)""")
def p08_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments that resumed jobs go on with."""
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    name = F.concat(F.lit("/w/"), F.when(n % 5 == 0, "part_").otherwise("segment_"), n.cast("string"), F.when(p % 7 == 0, ".tmp").otherwise(".mkv"))
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), name.alias("path"), (F.col("l_quantity").cast("int") - 10).alias("length"))
    known = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("job_id"), F.lit("/w/segment_0.mkv").alias("path"))
    return jobs.usable_segments(found, known)


@query("""WITH e AS (SELECT event_id, strftime(ts, '%Y%m%d') AS day, ts FROM events), b AS (SELECT event_id, day, CASE event_id % 4 WHEN 0 THEN 'v20170101 x' || day WHEN 1 THEN 'built 20241399, ' || day || '-1' WHEN 2 THEN '20240230' ELSE NULL END AS a,
  CASE event_id % 3 WHEN 0 THEN 'from ' || strftime(ts + INTERVAL 400 DAY, '%Y%m%d') || '.' ELSE 'none' END AS c FROM e)
SELECT event_id, CASE WHEN event_id % 5 = 0 AND coalesce(contains(a, day), false) THEN day WHEN event_id % 4 = 1 THEN day WHEN event_id % 3 = 0 THEN substr(c, 6, 8) END AS tag FROM b""")
def o09_date_tags(spark: SparkSession, d: str) -> DataFrame:
    """The first plausible date among texts, a preferred one first."""
    k, day = F.col("event_id"), F.date_format("ts", "yyyyMMdd")
    a = F.when(k % 4 == 0, F.concat(F.lit("v20170101 x"), day)).when(k % 4 == 1, F.concat(F.lit("built 20241399, "), day, F.lit("-1"))).when(k % 4 == 2, "20240230")
    c = F.when(k % 3 == 0, F.concat(F.lit("from "), F.date_format(F.col("ts") + F.expr("INTERVAL 400 DAYS"), "yyyyMMdd"), F.lit("."))).otherwise("none")
    return table(spark, d, "events").select("event_id", fn.first_date_tag(F.array(a, c), F.when(k % 5 == 0, day)).alias("tag"))


RC = {"wanted": "CASE o_custkey % 5 WHEN 0 THEN 'cqp' WHEN 1 THEN 'VBR' WHEN 2 THEN 'cbr' WHEN 3 THEN 'vbr_peak' END", "family": "CASE o_orderkey % 3 WHEN 0 THEN 'amf' WHEN 1 THEN 'nvenc' ELSE 'qsv' END", "rc": "CASE o_orderkey % 7 WHEN 0 THEN 'CQP' WHEN 1 THEN 'constqp' WHEN 2 THEN 'vbr_peak' WHEN 3 THEN 'vbr_latency' WHEN 4 THEN 'cbr' WHEN 5 THEN 'vbr' ELSE 'qp' END"}


@query(f"""WITH r AS (SELECT o_orderkey AS id, lower({RC['wanted']}) AS w, {RC['family']} AS f, lower({RC['rc']}) AS rc FROM orders)
SELECT id, coalesce(CASE WHEN f = 'amf' THEN (w, rc) IN (('cqp', 'cqp'), ('cqp', 'constqp'), ('cqp', 'qp'), ('vbr', 'vbr_peak'), ('vbr', 'vbr_latency'), ('cbr', 'cbr'), ('vbr_peak', 'vbr_peak'))
  WHEN f = 'nvenc' THEN (w, rc) IN (('cqp', 'constqp'), ('vbr', 'vbr'), ('cbr', 'cbr'), ('vbr_peak', 'vbr_peak')) ELSE false END, false) AS matches FROM r""")
def f23_rate_controls(spark: SparkSession, d: str) -> DataFrame:
    """rate controls against an editor's names."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), fn.rate_control_matches(*(F.expr(RC[k]) for k in ("wanted", "family", "rc"))).alias("matches"))


@query("""WITH t AS (SELECT CASE s_suppkey % 5 WHEN 0 THEN 'ffprobe' WHEN 1 THEN 'mkvinfo' WHEN 2 THEN 'ffmpeg' ELSE 'tool' || s_suppkey END AS tool_id FROM supplier),
p AS (SELECT 'tool' || s_suppkey AS tool_id, s_name AS expected FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT * FROM (VALUES ('ffmpeg', '7.1'), ('mkvmerge', '90')))
SELECT t.tool_id, p.tool_id AS pin, expected FROM t LEFT JOIN p ON p.tool_id = CASE t.tool_id WHEN 'ffprobe' THEN 'ffmpeg' WHEN 'mkvinfo' THEN 'mkvmerge' ELSE t.tool_id END""")
def j07_pins(spark: SparkSession, d: str) -> DataFrame:
    """The pin that supplies each tool."""
    k = F.col("s_suppkey")
    named = F.concat(F.lit("tool"), k.cast("string"))
    s = table(spark, d, "supplier")
    tools = s.select(F.when(k % 5 == 0, "ffprobe").when(k % 5 == 1, "mkvinfo").when(k % 5 == 2, "ffmpeg").otherwise(named).alias("tool_id"))
    more = spark.createDataFrame([("ffmpeg", "7.1"), ("mkvmerge", "90")], "tool_id string, expected string")
    return media.supplying_pins(tools, s.where(k % 2 == 0).select(named.alias("tool_id"), F.col("s_name").alias("expected")).union(more))
