"""Further queries: predicates, ordering, unions and scalar rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelake.functions import scalar as fn
from cinelake.operators import jobs, media, timeline
from cinelake.queries import STREAM, query, stream, table


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def p10_log_filter(spark: SparkSession, d: str) -> DataFrame:
    """P10: lines that hold a word, in any case."""
    return table(spark, d, "documents").where(F.lower("text").contains("license")).select("doc_id")


#: What a tool's messages say when memory ran out or the device failed.
OUT_OF_MEMORY = r"(?i)out of memory|alloc(ation)? failed|vkAllocateMemory"
DEVICE_FAULT = r"(?i)device lost|vkQueueSubmit|gpu hang"


def fault(message: Column) -> Column:
    """Class of an error message."""
    return F.when(message.rlike(OUT_OF_MEMORY), "memory").when(message.rlike(DEVICE_FAULT), "device").otherwise("other")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'memory' WHEN 1 THEN 'device' WHEN 2 THEN 'memory' ELSE 'other' END AS fault FROM events")
def p14_faults(spark: SparkSession, d: str) -> DataFrame:
    """Classes of error messages."""
    texts = F.array(*map(F.lit, ("Out of memory at 5", "ERROR: Device Lost", "vkAllocateMemory failed", "end of file", "")))
    return table(spark, d, "events").select("event_id", fault(F.element_at(texts, (F.col("event_id") % 5 + 1).cast("int"))).alias("fault"))


@query("SELECT l_orderkey, l_linenumber, l_partkey % 4 IN (1, 2) AS ten_bit, l_suppkey % 3 <> 0 AS hdr FROM lineitem")
def p07_hdr(spark: SparkSession, d: str) -> DataFrame:
    """Ten-bit and HDR streams by pixel format and transfer."""
    pick = lambda n, k, *v: F.element_at(F.array(*map(F.lit, v)), (F.col(k) % n + 1).cast("int"))
    ten = pick(4, "l_partkey", "yuv420p", "yuv420p10le", "p010le", "nv12").rlike("10")
    hdr = pick(3, "l_suppkey", "bt709", "smpte2084", "arib-std-b67").isin("smpte2084", "arib-std-b67")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ten.alias("ten_bit"), hdr.alias("hdr"))


@query("SELECT model, scale, count(*) AS n FROM (SELECT 'm' || (l_suppkey % 4)::VARCHAR AS model, l_linenumber AS scale FROM lineitem) WHERE NOT (model = 'm0' AND scale IN (2, 4)) AND NOT (model = 'm1' AND scale IN (2, 3, 4)) GROUP BY ALL")
def p12_unsupported(spark: SparkSession, d: str) -> DataFrame:
    """Combinations that no model supports."""
    wanted = table(spark, d, "lineitem").select(F.concat(F.lit("m"), (F.col("l_suppkey") % 4).cast("string")).alias("model"), F.col("l_linenumber").alias("scale"))
    known = spark.createDataFrame([("m0", 2), ("m0", 4), ("m1", 2), ("m1", 3), ("m1", 4)], "model string, scale int")
    return wanted.join(F.broadcast(known), ["model", "scale"], "left_anti").groupBy("model", "scale").agg(F.count("*").alias("n"))


@query(f"WITH {STREAM}, c AS (SELECT DISTINCT source_id, round_even(pts / 3600, 0)::BIGINT AS idx FROM s WHERE is_key) SELECT source_id, idx FROM c WHERE idx > 0 AND idx < 500")
def p04_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Cuts inside the series, each once."""
    idx = fn.half_even(F.col("pts") / 3600)
    return stream(spark, d).where("is_key").select("source_id", idx.alias("idx")).where("idx > 0 and idx < 500").distinct()


@query(f"WITH {STREAM} SELECT source_id, n, score - lag(score) OVER (PARTITION BY source_id ORDER BY n) AS change FROM s")
def w11_change(spark: SparkSession, d: str) -> DataFrame:
    """Change against the frame before."""
    return stream(spark, d).select("source_id", "n", (F.col("score") - F.lag("score").over(timeline.of_source("n"))).alias("change"))


@query("SELECT n_regionkey, arg_max(n_name, (k, n_nationkey)) AS name, max(k) AS ram FROM (SELECT *, n_nationkey % 4 AS k FROM nation) GROUP BY n_regionkey")
def a11_largest(spark: SparkSession, d: str) -> DataFrame:
    """The adapter of the most memory of each vendor, ties by number."""
    n = table(spark, d, "nation").withColumn("k", F.col("n_nationkey") % 4)
    return n.groupBy("n_regionkey").agg(F.max_by("n_name", F.struct("k", "n_nationkey")).alias("name"), F.max("k").alias("ram"))


def version_key(tag: Column) -> Column:
    """A version as a sortable struct; null if unreadable.  A pre-release comes before its release."""
    text = F.lower(F.regexp_replace(F.trim(tag), "^[vV]", ""))
    part = lambda k: F.regexp_extract(text, r"^(\d+)\.(\d+)(?:\.(\d+))?[-.]?(?:(a|alpha|b|beta|rc)\.?(\d+)?)?$", k)
    number = lambda k: F.coalesce(part(k).try_cast("int"), F.lit(0))
    stage = F.when(part(4).isin("a", "alpha"), 0).when(part(4).isin("b", "beta"), 1).when(part(4) == "rc", 2).otherwise(3)
    return F.when(part(1) != "", F.struct(number(1).alias("a"), number(2).alias("b"), number(3).alias("c"), stage.alias("stage"), number(5).alias("n")))


@query("SELECT c_nationkey, 'v1.' || max(c_custkey)::VARCHAR || '.0' AS tag FROM customer WHERE c_custkey % 3 = 0 GROUP BY c_nationkey")
def o06_newest(spark: SparkSession, d: str) -> DataFrame:
    """The newest readable release that is no draft."""
    k = F.col("c_custkey")
    tag = F.when(k % 3 == 1, "garbage").otherwise(F.concat(F.lit("v1."), k.cast("string"), F.lit(".0")))
    c = table(spark, d, "customer").select("c_nationkey", tag.alias("tag"), (k % 3 == 2).alias("draft"))
    sure = c.withColumn("key", version_key(F.col("tag"))).where(F.col("key").isNotNull() & ~F.col("draft"))
    return sure.groupBy("c_nationkey").agg(F.max_by("tag", "key").alias("tag"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'upscaled' WHEN o_custkey % 3 = 0 THEN 'interpolated' WHEN o_custkey % 2 = 0 THEN 'decoded' END AS folder FROM orders")
def o10_first_folder(spark: SparkSession, d: str) -> DataFrame:
    """The first of several sources that exists."""
    c = F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.when(c % 4 == 0, "upscaled"), F.when(c % 3 == 0, "interpolated"), F.when(c % 2 == 0, "decoded")).alias("folder"))


@query("SELECT c_custkey AS id, greatest(least(c_acctbal, 120), 0) AS start_s, greatest(least(greatest(c_acctbal, 0) + greatest(c_custkey % 50 - 5, 0.1)::DOUBLE, 120), greatest(least(c_acctbal, 120), 0)) AS end_s FROM customer")
def d18_segment(spark: SparkSession, d: str) -> DataFrame:
    """A benchmark's segment within the source."""
    x, length = F.col("c_acctbal"), F.greatest((F.col("c_custkey") % 50 - 5).cast("double"), F.lit(0.1))
    start = fn.clamp(x, 0.0, 120.0)
    end = F.greatest(F.least(F.greatest(x, F.lit(0.0)) + length, F.lit(120.0)), start)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), start.alias("start_s"), end.alias("end_s"))


@query("SELECT l_orderkey AS job_id, l_linenumber AS stage, 10 + l_suppkey % 3 AS expected, 10 + l_partkey % 3 AS produced FROM lineitem WHERE l_suppkey % 3 <> l_partkey % 3")
def d05b_frame_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Stages whose output has not the frames expected."""
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("stage"), (10 + F.col("l_suppkey") % 3).alias("expected"), (10 + F.col("l_partkey") % 3).alias("produced"))
    return r.where(F.col("expected") != F.col("produced"))


@query("SELECT c_custkey AS id, (c_custkey % 3 > 0)::BOOLEAN AS upscale, (c_custkey % 2 = 0) AS interpolate, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 > 0 THEN 'interpolate,upscale' WHEN c_custkey % 2 = 0 THEN 'interpolate' WHEN c_custkey % 3 > 0 THEN 'upscale' ELSE '' END AS stages FROM customer")
def d14_active_stages(spark: SparkSession, d: str) -> DataFrame:
    """Stages that a plan runs, in order."""
    c = F.col("c_custkey")
    up, inter = c % 3 > 0, c % 2 == 0
    stages = F.array_join(F.filter(F.array(F.when(inter, "interpolate"), F.when(up, "upscale")), lambda x: x.isNotNull()), ",")
    return table(spark, d, "customer").select(c.alias("id"), up.alias("upscale"), inter.alias("interpolate"), stages.alias("stages"))


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_id % 3 AS done FROM events),
l AS (SELECT *, lag(done) OVER (PARTITION BY user_id ORDER BY k) AS before FROM e) SELECT user_id, k, done FROM l WHERE before IS DISTINCT FROM done""")
def t05_changes(spark: SparkSession, d: str) -> DataFrame:
    """Progress rows that differ from the one before."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", F.row_number().over(w).cast("long").alias("k"), (F.col("event_id") % 3).alias("done"))
    before = F.lag("done").over(W.partitionBy("user_id").orderBy("k"))
    return e.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("done"))).select("user_id", "k", "done")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Show' || (c_custkey % 100)::VARCHAR || '.1080p.60fps.mkv' ELSE 'Show' || (c_custkey % 100)::VARCHAR || '.out.mkv' END AS name FROM customer")
def f19_output_names(spark: SparkSession, d: str) -> DataFrame:
    """output names from a template; a template with an unknown part falls back."""
    k = F.col("c_custkey")
    path = F.concat(F.lit("/media/a/Show"), (k % 100).cast("string"), F.lit(".avi"))
    stem = F.regexp_extract(path, r"([^/\\]+)\.[^.]+$", 1)
    template = F.when(k % 2 == 0, "{source_stem}.{height}p.{fps}fps").otherwise("{source_stem}.{what}")
    filled = F.replace(F.replace(F.replace(template, F.lit("{source_stem}"), stem), F.lit("{height}"), F.lit("1080")), F.lit("{fps}"), F.lit("60"))
    name = F.when(filled.rlike("[{}]"), F.concat(stem, F.lit(".out"))).otherwise(filled)
    return table(spark, d, "customer").select(k.alias("id"), F.concat(name, F.lit(".mkv")).alias("name"))


@query("SELECT o_orderkey AS id, sha256(o_orderkey::VARCHAR || '|' || o_orderstatus || '|' || o_orderpriority || '|') AS key FROM orders")
def f12_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of pieces, each followed by a bar (SHA-256 in place of BLAKE2b)."""
    text = F.concat(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"), F.lit("|"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.sha2(text, 256).alias("key"))


@query("SELECT user_id, floor(value / 50)::BIGINT AS slot, count(*) AS n FROM events WHERE value > 0 GROUP BY ALL UNION ALL SELECT user_id, -1, count(*) FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def s28_concatenated(spark: SparkSession, d: str) -> DataFrame:
    """Segments put together in one result."""
    e = table(spark, d, "events")
    one = e.where("value > 0").groupBy("user_id", F.floor(F.col("value") / 50).cast("long").alias("slot")).agg(F.count("*").alias("n"))
    two = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.lit(-1).cast("long").alias("slot"), "n")
    return one.unionByName(two)


@query("SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL")
def f35_json_paths(spark: SparkSession, d: str) -> DataFrame:
    """Values read from JSON text."""
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT s_nationkey, count(*) AS n, count(*) FILTER (s_acctbal < 0) AS warnings, bool_or(s_acctbal < 0) AS any_issue FROM supplier GROUP BY s_nationkey")
def p13_issues(spark: SparkSession, d: str) -> DataFrame:
    """Tools with issues."""
    low = F.col("s_acctbal") < 0
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.count_if(low).alias("warnings"), F.bool_or(low).alias("any_issue"))


@query("SELECT p_type, p_brand, count(DISTINCT p_partkey) AS n, percent FROM (SELECT *, round(100.0 * count(*) OVER (PARTITION BY p_type, p_brand) / count(*) OVER (), 6)::DOUBLE AS percent FROM part) GROUP BY p_type, p_brand, percent")
def rel_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a total (Spark's own); the total is one row, joined by the driver's side of the plan."""
    p = table(spark, d, "part")
    counted = p.groupBy("p_type", "p_brand").agg(F.countDistinct("p_partkey").alias("n"), F.count("*").alias("c"))
    total = p.agg(F.count("*").alias("t")).scalar()
    return counted.select("p_type", "p_brand", "n", F.round(100.0 * F.col("c") / total, 6).alias("percent"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE '{\"a\":1}' END ELSE 'old' END AS overrides FROM orders")
def p15_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Settings may be changed while a job waits; the empty change counts as none."""
    wanted = F.when(F.col("o_custkey") % 2 == 0, "{}").otherwise('{"a":1}')
    value = F.when(F.col("o_orderstatus") == "O", F.nullif(wanted, F.lit("{}"))).otherwise("old")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), value.alias("overrides"))




@query("""SELECT c_custkey AS id, c_custkey % 2 = 0 AS drops, CASE WHEN c_custkey % 2 = 0 THEN 24 ELSE 25 END::BIGINT AS nominal,
  greatest(1, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE round_even((c_custkey % 120) / CASE WHEN c_custkey % 2 = 0 THEN 24000.0::DOUBLE / 1001 ELSE 25.0::DOUBLE END, 0) END)::BIGINT AS multiplier FROM customer""")
def f04_target_rates(spark: SparkSession, d: str) -> DataFrame:
    """nominal rates, and how often a frame is shown to reach a rate."""
    k = F.col("c_custkey")
    num, den = F.when(k % 2 == 0, 24000).otherwise(25), F.when(k % 2 == 0, 1001).otherwise(1)
    return table(spark, d, "customer").select(
        k.alias("id"), fn.drops_frames(num, den).alias("drops"), fn.half_even(num.cast("double") / den).alias("nominal"),
        fn.target_multiplier(num, den, (k % 120).cast("double"), F.when(k % 3 == 0, 2)).alias("multiplier"),
    )


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 12.5 WHEN 3 THEN 0 END::DOUBLE AS number, s_suppkey % 4 = 0 AS flag,
  CASE s_suppkey % 3 WHEN 0 THEN 'turing' WHEN 1 THEN 'ada' ELSE 'unknown' END AS generation,
  CASE s_suppkey % 3 WHEN 0 THEN 30000 WHEN 1 THEN 59940 ELSE 24000 END::BIGINT AS num, CASE s_suppkey % 3 WHEN 1 THEN 1000 ELSE 1001 END::BIGINT AS den,
  CASE WHEN s_suppkey % 2 = 0 THEN 1704067200 + s_suppkey % 60 END::BIGINT AS epoch,
  CASE s_suppkey % 2 WHEN 0 THEN (s_suppkey % 1000)::VARCHAR || ' B' ELSE '1.5 MiB' END AS size FROM supplier""")
def f08_loose_values(spark: SparkSession, d: str) -> DataFrame:
    """text read into values, null or a default where it cannot be."""
    k = F.col("s_suppkey")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (k % n + 1).cast("int"))
    text = pick(4, "12.5", "N/A", "", "0")
    iso = F.when(k % 2 == 0, F.concat(F.lit("2024-01-01T00:00:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("Z"))).otherwise("soon")
    rate = fn.output_rate(pick(3, "30000/1001", "59.94", " "))
    return table(spark, d, "supplier").select(
        k.alias("id"), fn.loose_number(text).alias("number"), fn.loose_flag(text).alias("flag"), fn.generation(pick(3, "7.5", "8.9", "1.0")).alias("generation"),
        rate["num"].alias("num"), rate["den"].alias("den"), fn.epoch_seconds(iso).alias("epoch"),
        fn.bytes_text(F.when(k % 2 == 0, k % 1000).otherwise(3 << 19)).alias("size"),
    )


@query(f"WITH {STREAM}, x AS (SELECT source_id, max(pts) AS p, max(pts + CASE WHEN source_id % 2 = 0 THEN 0.04 ELSE 0 END::DOUBLE) AS e FROM s GROUP BY source_id) SELECT source_id, CASE WHEN e <= p + 1e-6::DOUBLE THEN e + 0.0417::DOUBLE ELSE e END AS decodable_end FROM x")
def d03_decodable_end(spark: SparkSession, d: str) -> DataFrame:
    """Where decoding ends."""
    s = stream(spark, d).withColumn("dur", F.when(F.col("source_id") % 2 == 0, 0.04).otherwise(0.0))
    x = timeline.extents(s)
    return x.select("source_id", timeline.decodable_end(F.col("last_pts"), F.col("last_end"), F.lit(0.0417)).alias("decodable_end"))


@query("SELECT l_orderkey AS job_id, l_linenumber AS segment, l_quantity * 10 / 24 AS expected_s, l_quantity * 10 / 24 + (l_partkey % 10) / 10.0::DOUBLE AS got_s FROM lineitem WHERE abs(l_quantity * 10 / 24 + (l_partkey % 10) / 10.0::DOUBLE - l_quantity * 10 / 24) > 0.25")
def d06_segment_durations(spark: SparkSession, d: str) -> DataFrame:
    """Segments whose length is off by more than a quarter second."""
    expected = F.col("l_quantity") * 10 / 24
    got = expected + (F.col("l_partkey") % 10) / 10.0
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("segment"), expected.alias("expected_s"), got.alias("got_s"))
    return r.where(F.abs(F.col("got_s") - F.col("expected_s")) > 0.25)


@query("SELECT event_type, user_id, count(*) AS n, approx FROM (SELECT event_type, user_id, true AS approx FROM events) GROUP BY ALL")
def a15_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups, with a sketch's distinct count within a twentieth of the exact one."""
    e = table(spark, d, "events")
    near = e.groupBy("event_type").agg((F.abs(F.approx_count_distinct("event_id", 0.02) - F.countDistinct("event_id")) <= 0.1 * F.countDistinct("event_id") + 1).alias("approx"))
    return e.groupBy("event_type", "user_id").agg(F.count("*").alias("n")).join(near, "event_type").select("event_type", "user_id", "n", "approx")


@query("""SELECT o_orderkey AS id, cents // gcd(cents, 100) AS num, 100 // gcd(cents, 100) AS den
FROM (SELECT o_orderkey, (1000 + o_orderkey * 37 % 9000)::BIGINT AS cents FROM orders)""")
def f01_decimal_rates(spark: SparkSession, d: str) -> DataFrame:
    """rates given as decimals, as fractions."""
    cents = (1000 + F.col("o_orderkey") * 37 % 9000).cast("long")
    rate = fn.rational((cents / F.lit(100)).cast("decimal(10,2)").cast("string"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), rate.num.alias("num"), rate.den.alias("den"))


BASE_SETTINGS = """'{"encoder":{"codec":"hevc","rc":{"mode":"crf","value":' || (k % 30) || '}},"audio":{"copy":true},"name":"n' || k || '"}'"""
OVER_SETTINGS = """CASE k % 3 WHEN 0 THEN '{"encoder":{"rc":{"value":' || (k % 7) || '}}}' WHEN 1 THEN '{"encoder":{"rc":"off","args":[1,2]},"name":"new"}' ELSE '{"audio":{"copy":false,"lang":{"first":"en"}}}' END"""


@query(f"""SELECT k AS id, m->>'$.encoder.codec' AS codec, m->>'$.encoder.rc.mode' AS mode, m->>'$.encoder.rc.value' AS value,
  m->>'$.encoder.args[1]' AS arg, m->>'$.audio.copy' AS copy, m->>'$.audio.lang.first' AS lang, m->>'$.name' AS name
FROM (SELECT k, json_merge_patch({BASE_SETTINGS}, {OVER_SETTINGS}) AS m FROM (SELECT c_custkey AS k FROM customer))""")
def u07_deep_settings(spark: SparkSession, d: str) -> DataFrame:
    """Overrides merged at every depth, lists replaced whole."""
    keyed = table(spark, d, "customer").select(F.col("c_custkey").alias("k")).select("k", F.expr(BASE_SETTINGS).alias("a"), F.expr(OVER_SETTINGS).alias("b"))
    paths = {"codec": "encoder.codec", "mode": "encoder.rc.mode", "value": "encoder.rc.value", "arg": "encoder.args[1]", "copy": "audio.copy", "lang": "audio.lang.first", "name": "name"}
    merged = keyed.select(F.col("k").alias("id"), jobs.deep_merged("a", "b").alias("m"))
    return merged.select("id", *(F.get_json_object("m", f"$.{path}").alias(name) for name, path in paths.items()))


@query("""WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS file_id, l_orderkey % 3 AS ea, l_partkey % 3 AS ga, l_orderkey % 4 AS ec, l_suppkey % 4 AS gc,
  1920 AS ew, 1920 - l_partkey % 5 AS gw, CASE l_orderkey % 4 WHEN 0 THEN 'smpte2084' WHEN 1 THEN 'arib-std-b67' WHEN 2 THEN '' ELSE 'bt709' END AS et,
  CASE l_suppkey % 4 WHEN 0 THEN 'SMPTE2084' WHEN 1 THEN 'arib-std-b67' WHEN 2 THEN '' ELSE 'bt709' END AS gt, l_orderkey % 3 AS ead, l_suppkey % 3 AS gad,
  l_partkey % 2 AS esd, l_linenumber % 2 AS gsd, l_linenumber % 2 = 0 AS mkv, l_orderkey % 5 <> 0 AS cc, l_orderkey % 7 <> 0 AS ca, l_partkey % 2 = 0 AS pres,
  l_suppkey % 3 <> 0 AS hdr, l_orderkey % 2 = 0 AS rt FROM lineitem)
SELECT file_id, 'attachments_lost' AS code, 'failure' AS severity, ea::VARCHAR AS expected, ga::VARCHAR AS got FROM p WHERE ca AND mkv AND ea > 0 AND ga <> ea
UNION ALL SELECT file_id, 'chapters_lost', 'failure', ec::VARCHAR, gc::VARCHAR FROM p WHERE cc AND ec > 0 AND gc <> ec
UNION ALL SELECT file_id, 'video_resolution_drift', 'failure', ew::VARCHAR, gw::VARCHAR FROM p WHERE pres AND abs(ew - gw) > 2
UNION ALL SELECT file_id, 'hdr_roundtripped', 'note', et, lower(gt) FROM p WHERE hdr AND rt AND lower(gt) NOT IN ('smpte2084', 'arib-std-b67')
UNION ALL SELECT file_id, 'hdr_transfer_residual', 'failure', 'bt709 (or unspecified)', lower(gt) FROM p WHERE hdr AND rt AND lower(gt) IN ('smpte2084', 'arib-std-b67')
UNION ALL SELECT file_id, 'hdr_transfer_lost', 'failure', et, lower(gt) FROM p WHERE hdr AND NOT rt AND et <> '' AND gt <> '' AND et <> lower(gt)
UNION ALL SELECT file_id, 'audio_streams_default_lost', CASE WHEN gad = 0 THEN 'failure' ELSE 'note' END, ead::VARCHAR, gad::VARCHAR FROM p WHERE gad < ead
UNION ALL SELECT file_id, 'subtitle_streams_default_lost', 'failure', esd::VARCHAR, gsd::VARCHAR FROM p WHERE gsd < esd""")
def d12_report(spark: SparkSession, d: str) -> DataFrame:
    """Losses of attachments, chapters, size, transfer and default flags, with their severity."""
    o, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    transfer = lambda k, first: F.element_at(F.array(*map(F.lit, (first, "arib-std-b67", "", "bt709"))), (k % 4 + 1).cast("int"))
    pairs = table(spark, d, "lineitem").select(
        (o * 10 + n).alias("file_id"), (o % 3).alias("e_attachments"), (p % 3).alias("g_attachments"), (o % 4).alias("e_chapters"), (s % 4).alias("g_chapters"),
        F.lit(1920).alias("e_width"), (1920 - p % 5).alias("g_width"), transfer(o, "smpte2084").alias("e_transfer"), transfer(s, "SMPTE2084").alias("g_transfer"),
        (o % 3).alias("e_audio_default"), (s % 3).alias("g_audio_default"), (p % 2).alias("e_subtitle_default"), (n % 2).alias("g_subtitle_default"),
        F.when(n % 2 == 0, "mkv").otherwise("mp4").alias("container"), (o % 5 != 0).alias("copy_chapters"), (o % 7 != 0).alias("copy_attachments"),
        F.when(p % 2 != 0, 0 * o + 1920 - p % 5).alias("target_w"), F.lit(1080).alias("target_h"), F.lit(1080).alias("g_height"), (s % 3 != 0).alias("hdr"), (o % 2 == 0).alias("roundtripped"),
    )
    return media.validation_report(pairs)


@query("SELECT l_orderkey AS job_id, l_linenumber AS stage FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def s13_deleted_cache(spark: SparkSession, d: str) -> DataFrame:
    """Cached stages that stay when jobs are deleted."""
    every = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    cache = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("stage"))
    return jobs.deleted(every, cache, every.where("o_orderstatus = 'F'"))[1]


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def j10_running(spark: SparkSession, d: str) -> DataFrame:
    """Those of some jobs that run."""
    every = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("state"))
    return jobs.running_of(every, table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))).select("id")


@query("""SELECT event_id, coalesce(nullif(trim(m, ' '), ''), nullif(trim(x->>'$.ffmpeg_line', ' '), '')) AS text
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN ' ' || event_type || ' ' WHEN 1 THEN '  ' END AS m,
  CASE WHEN event_id % 2 = 0 THEN '{"ffmpeg_line": " frame ' || event_id || '"}' ELSE '{"other": 1}' END AS x FROM events)""")
def f34_event_text(spark: SparkSession, d: str) -> DataFrame:
    """what an event says: its message, else the tool's line."""
    n = F.col("event_id")
    message = F.when(n % 3 == 0, F.concat(F.lit(" "), "event_type", F.lit(" "))).when(n % 3 == 1, "  ")
    extra = F.when(n % 2 == 0, F.concat(F.lit('{"ffmpeg_line": " frame '), n.cast("string"), F.lit('"}'))).otherwise('{"other": 1}')
    return table(spark, d, "events").select("event_id", jobs.event_text(message, extra).alias("text"))


@query(f"WITH {STREAM} SELECT source_id, n, n - 1 AS k FROM s WHERE n >= 2 AND n < 7")
def w05_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """The first two frames of each source dropped, five kept and renumbered."""
    return timeline.trimmed(stream(spark, d).select("source_id", "n"), 2, 5).select("source_id", "n", F.col("k").cast("long").alias("k"))


@query("""SELECT o_custkey AS source_id, o_orderkey AS batch, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 3 END AS plan_id FROM orders""")
def j13_stored_plans(spark: SparkSession, d: str) -> DataFrame:
    """Stored plans whose start and end agree to six decimals."""
    at = F.col("o_orderkey") / 7.0
    batches = table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("batch"), at.alias("start"), (at + 1).alias("end"))
    off = F.when(F.col("batch") % 2 == 0, 2e-8).otherwise(1e-3)
    stored = batches.select("source_id", (F.col("batch") * 3).alias("plan_id"), (F.round("start", 6) + off).alias("start"), (F.round("end", 6) + off).alias("end"))
    return timeline.stored_plans(batches, stored).select("source_id", "batch", "plan_id")


@query("""SELECT s_suppkey, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd, nth_value(s_suppkey, 2) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second,
  count(*) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS near FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)""")
def rel_distribution(spark: SparkSession, d: str) -> DataFrame:
    """percent_rank, cume_dist, nth_value and a RANGE frame (Spark's own)."""
    w = W.partitionBy("s_nationkey").orderBy("s_suppkey")
    whole, near = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), w.rangeBetween(-10, 10)
    return table(spark, d, "supplier").select(
        "s_suppkey", F.percent_rank().over(w).alias("pr"), F.cume_dist().over(w).alias("cd"),
        F.nth_value("s_suppkey", 2).over(whole).alias("second"), F.count("*").over(near).alias("near"),
    )
