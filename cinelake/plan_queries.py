"""Queries of the planning part: encoder choice, chunk lengths, stages, keys.

Jobs are ``orders``, hosts are ``customer``; what a host can do is read off the digits of a hash of its key, so that
all combinations occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.functions import canonical
from cinelake.plans import batching, models, paths, recommend
from cinelake.queries import STREAM, query, stream, table


def sql_text(value: object) -> str:
    """A value as SQL."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (tuple, list)):
        return f"[{', '.join(map(sql_text, value))}]::VARCHAR[]"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


NAMES = [n for names in recommend.ENCODERS.values() for n in names]
#: (digit of the hash, what it is about, limit): a digit below the limit says yes.
LISTED = [(k + 1, n, "c") for k, n in enumerate(NAMES)] + [(29, "libx264", "d"), (30, "libx265", "9")]
CAPABLE = [(k + 15, n, "8") for k, n in enumerate(NAMES)]
WANTED = [*NAMES, "libx264", "libx265"]


def hosts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(host, has_nvidia, arch, vram) and (host, encoder, listed, capable)."""
    c = table(spark, d, "customer").withColumn("h", F.md5(F.col("c_custkey").cast("string")))
    host = c.select(
        F.col("c_custkey").alias("host"),
        F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE", "MACHINERY").alias("has_nvidia"),
        F.when(F.col("c_acctbal") > 0, F.when(F.col("c_nationkey") < 12, "ampere").otherwise("turing")).alias("arch"),
        (F.floor(F.abs("c_acctbal") / 1000) * 1024).cast("int").alias("vram"),
    )
    rows = [(n, k, at, next((j for j, m, _ in CAPABLE if m == n), None)) for k, n, at in LISTED]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(k).alias("k"), F.lit(at).alias("at"), F.lit(j).alias("j")) for n, k, at, j in rows))).alias("e")
    digit = lambda k: F.substr("h", F.col(k), F.lit(1))
    capabilities = c.select(F.col("c_custkey").alias("host"), "h", each).select(
        "host",
        F.col("e.n").alias("encoder"),
        (digit("e.k") < F.col("e.at")).alias("listed"),
        F.coalesce(digit("e.j") < "8", F.lit(False)).alias("capable"),
    )
    return host, capabilities


RULES_SQL = ", ".join(
    f"({k}, {sql_text(r.encoder)}, {sql_text(r.needs)}, {sql_text(r.bars)}, {sql_text(r.target)}, {sql_text(r.done)}, {sql_text(r.warnings)}, {sql_text(r.rationale)})"
    for k, r in enumerate(recommend.RULES)
)
CHAIN = """{name} AS (SELECT job, host, prefer, {start} AS encoder, false AS done, []::VARCHAR[] AS warnings, []::VARCHAR[] AS rationale, 0 AS depth FROM {of}
  UNION ALL SELECT c.job, c.host, c.prefer, s.target, s.done, c.warnings || s.warnings, c.rationale || s.rationale, depth + 1
  FROM {name} c JOIN s ON s.host = c.host AND s.encoder = c.encoder || CASE WHEN NOT c.prefer AND c.encoder IN ('libx264', 'libx265') THEN ' alone' ELSE '' END WHERE NOT c.done)"""
MADE = {"nvenc_cq": "o_orderkey % 51 + 1", "qsv_global_quality": "o_orderkey % 51 + 1", "amf_qp_i": "o_orderkey % 40", "x_crf": "o_custkey % 52", "d3d12_qp": "o_custkey % 53 - 1", "vulkan_qp": "o_custkey % 257 - 1", "vulkan_async_depth": "o_custkey % 64 + 1", "nvenc_rc_lookahead": "o_custkey % 33", "qsv_look_ahead_depth": "o_custkey % 101", "nvenc_bframes": "o_custkey % 9", "qsv_bf": "o_custkey % 17"}
AMF_RC = "CASE o_custkey % 4 WHEN 0 THEN 'CQP' WHEN 1 THEN 'cbr' WHEN 2 THEN 'constqp' ELSE 'vbr_peak' END"
FLAGS = {"amf_vbaq": "o_custkey % 3 = 0", "amf_preencode": "o_custkey % 5 = 0"}
GOAL_OF = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'speed' WHEN '2' THEN 'quality' WHEN '3' THEN 'auto' WHEN '4' THEN 'archival' ELSE 'compat' END"
PRESET_GOAL = "CASE WHEN o_totalprice < 100000 THEN 'auto' WHEN o_totalprice < 200000 THEN 'quality' WHEN o_totalprice < 300000 THEN 'compat' ELSE 'speed' END"
CODEC = "CASE WHEN o_totalprice < 150000 THEN 'HEVC' WHEN o_totalprice < 250000 THEN 'h264' END"
PIX_FMT = "CASE WHEN o_totalprice > 220000 THEN 'yuv420p10le' WHEN o_totalprice > 50000 THEN 'yuv420p' END"

D13_SQL = f"""WITH RECURSIVE h AS (SELECT c_custkey AS host, md5(c_custkey::VARCHAR) AS h, c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') AS card,
  coalesce(CASE WHEN c_acctbal > 0 THEN CASE WHEN c_nationkey < 12 THEN 'ampere' ELSE 'turing' END END, 'None') AS arch, (floor(abs(c_acctbal) / 1000) * 1024)::INT::VARCHAR AS vram FROM customer),
f AS (SELECT host, list(fact) AS facts FROM (SELECT host, 'nvidia' AS fact FROM h WHERE card
  UNION ALL SELECT host, 'lists ' || n FROM h, (VALUES {", ".join(map(str, LISTED))}) v(k, n, m) WHERE substr(h.h, k, 1) < m
  UNION ALL SELECT host, 'runs ' || n FROM h, (VALUES {", ".join(map(str, CAPABLE))}) v(k, n, m) WHERE substr(h.h, k, 1) < m) GROUP BY host),
s AS MATERIALIZED (SELECT h.host, r.encoder, target, done, [replace(replace(w, '{{arch}}', arch), '{{vram}}', vram) for w in warnings] AS warnings,
  [replace(replace(w, '{{arch}}', arch), '{{vram}}', vram) for w in rationale] AS rationale
  FROM h LEFT JOIN f ON f.host = h.host, (VALUES {RULES_SQL}) r(ord, encoder, needs, bars, target, done, warnings, rationale)
  WHERE len(list_intersect(needs, coalesce(facts, []))) = len(needs) AND len(list_intersect(bars, coalesce(facts, []))) = 0
  QUALIFY row_number() OVER (PARTITION BY h.host, r.encoder ORDER BY ord) = 1),
j AS (SELECT o_orderkey AS job, o_custkey AS host, o_orderpriority AS preset, ({sql_text(WANTED)})[o_orderkey % {len(WANTED)} + 1] AS wanted, o_orderstatus <> 'F' AS prefer,
  CASE WHEN {GOAL_OF} = 'auto' THEN {PRESET_GOAL} ELSE {GOAL_OF} END AS g, {CODEC} AS source_codec, {PIX_FMT} AS pix_fmt, {AMF_RC} AS amf_rc,
  {", ".join(f"{MADE.get(f, FLAGS.get(f, sql_text(v)))} AS {f}" for f, v in recommend.DEFAULTS.items() if f != "amf_rc")} FROM orders),
{CHAIN.format(name="a", start="wanted", of="j")},
b AS (SELECT j.*, a.encoder AS name, a.warnings, a.rationale, CASE WHEN name LIKE '%!_%' ESCAPE '!' THEN split_part(name, '_', 2) ELSE 'software' END AS kind,
  CASE {" ".join(f"WHEN name = '{a}' THEN '{b}'" for a, b in recommend.COMPAT.items())} END AS compat
  FROM j JOIN a ON a.job = j.job WHERE a.done),
{CHAIN.format(name="e", start="coalesce(compat, name)", of="b WHERE g = 'compat'")},
z AS (SELECT b.*, coalesce(e.encoder, name) AS final, coalesce(e.warnings, []) AS more, {", ".join(f"{recommend.rewritten(f, 'g', 'kind')} AS new_{f}" for f in recommend.DEFAULTS)}
  FROM b LEFT JOIN e ON e.job = b.job AND e.done),
y AS (SELECT *, final LIKE '%!_amf' ESCAPE '!' AND lower(new_amf_rc) IN ('cqp', 'constqp', 'qp') AS fixed FROM z)
SELECT job, final AS encoder, array_to_string(warnings || more
  || CASE WHEN pix_fmt LIKE '%10%' AND final LIKE 'h264!_%' ESCAPE '!' THEN [{sql_text(recommend.TEN_BIT)}] ELSE [] END
  || CASE WHEN lower(source_codec) IN ('hevc', 'h265') AND (final LIKE 'h264!_%' ESCAPE '!' OR final = 'libx264') THEN [{sql_text(recommend.LARGER)}] ELSE [] END, '|') AS warnings,
  array_to_string(['Preset ''' || preset || ''' requests encoder: ' || wanted] || rationale
  || CASE {" ".join(f"WHEN g = '{g}' AND kind = '{k}' THEN [{sql_text(t)}]" for (g, k), (_, t) in recommend.GOALS.items())}
     WHEN g = 'compat' AND compat IS NOT NULL THEN [replace({sql_text(recommend.COMPATIBLE)}, '{{target}}', compat)] ELSE [] END
  || CASE WHEN fixed AND new_amf_vbaq THEN [{sql_text(recommend.NO_VBAQ)}] ELSE [] END
  || CASE WHEN fixed AND new_amf_preencode THEN [{sql_text(recommend.NO_PREENCODE)}] ELSE [] END || ['Final encoder: ' || final], '|') AS rationale,
  {", ".join(f"new_{f} AND NOT fixed AS {f}" if f in FLAGS else f"new_{f} AS {f}" for f in recommend.DEFAULTS)} FROM y"""


@query(D13_SQL)
def d13_recommended(spark: SparkSession, d: str) -> DataFrame:
    """Encoder, settings, warnings and rationale of every job on its host."""
    of = {f: F.expr(f"cast({e} as int)") for f, e in MADE.items()} | {f: F.expr(e) for f, e in FLAGS.items()} | {"amf_rc": F.expr(AMF_RC)}
    jobs = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("job"),
        F.col("o_custkey").alias("host"),
        F.col("o_orderpriority").alias("preset"),
        F.element_at(F.array(*map(F.lit, WANTED)), (F.col("o_orderkey") % len(WANTED) + 1).cast("int")).alias("encoder"),
        F.expr(GOAL_OF).alias("goal"),
        F.expr(PRESET_GOAL).alias("preset_goal"),
        (F.col("o_orderstatus") != "F").alias("prefer_hardware"),
        F.expr(CODEC).alias("source_codec"),
        F.expr(PIX_FMT).alias("source_pix_fmt"),
        *(c.alias(f) for f, c in of.items()),
    )
    return recommend.recommended(jobs, *hosts(spark, d)).select(
        "job", "encoder", F.array_join("warnings", "|").alias("warnings"), F.array_join("rationale", "|").alias("rationale"), "settings.*"
    )


# Sources are users; an hour counts as a second, so that a source is some minutes long.
SOURCE_COLUMNS = {
    "fps": "CASE source_id % 3 WHEN 0 THEN 24.0D WHEN 1 THEN 24000.0D / 1001.0D ELSE 30.0D END",
    "out_fps": "CASE WHEN source_id % 4 > 0 THEN 48.0D END",
    "frames": "CASE WHEN source_id % 5 > 0 THEN n * 170 END",
    "width": "CASE WHEN source_id % 29 = 0 THEN 0 ELSE 1920 END",
    "height": "1080",
    "target_w": "CASE WHEN source_id % 6 = 0 THEN 1280 END",
    "target_h": "CASE WHEN source_id % 6 = 0 THEN 720 END",
    "scale": "CASE WHEN source_id % 5 = 1 THEN 2 WHEN source_id % 5 = 2 THEN 1 END",
    "multiplier": "CASE WHEN source_id % 4 > 0 THEN 2 ELSE 0 END",
    "free_bytes": "total * 2000000",
    "has_scratch": "source_id % 11 <> 0",
    "mode": "CASE WHEN source_id % 7 = 0 THEN 'manual' ELSE 'auto' END",
    "enabled": "source_id % 2 = 0",
    "chunk_seconds": "60 + source_id * 7 % 600",
    "policy": "CASE WHEN source_id % 8 = 0 THEN 'exact' ELSE 'keyframe' END",
}
AUTO_SQL = f"""WITH RECURSIVE {STREAM},
u AS (SELECT source_id, CASE WHEN source_id % 23 > 0 THEN max(pts) / 3600.0 END AS duration, count(*) AS n, floor(sum(score::DECIMAL(18,4)))::BIGINT AS total,
  coalesce(list(pts / 3600.0) FILTER (is_key), []) AS keys FROM s GROUP BY source_id),
w AS (SELECT source_id, duration, keys, {", ".join(f"{e.replace('.0D', '.0::DOUBLE')} AS {c}" for c, e in SOURCE_COLUMNS.items())} FROM u),
v AS (SELECT *, CASE WHEN target_w IS NULL AND target_h IS NULL THEN coalesce(scale, 1) ELSE 1 END AS factor FROM w),
x AS (SELECT *, coalesce(target_w, width) * factor * coalesce(target_h, height) * factor * 4::BIGINT AS each FROM v),
y AS (SELECT *, coalesce(nullif(frames, 0), trunc(fps * duration)::BIGINT, 0) * greatest(multiplier, 1) * each AS total FROM x),
z AS MATERIALIZED (SELECT *, coalesce(out_fps, CASE WHEN duration > 0 AND total > 0 THEN total / each::DOUBLE / duration END, fps) AS rate, least(chunk_seconds, 600) AS cap,
  CASE WHEN coalesce(duration <= 0, true) THEN 'duration_unknown' WHEN mode = 'manual' AND NOT enabled THEN 'manual_disabled' WHEN mode = 'manual' THEN 'manual'
    WHEN total <= 0 AND NOT enabled THEN 'estimate_unknown_manual_disabled' WHEN total <= 0 THEN 'fallback_manual_estimate_unknown'
    WHEN total <= free_bytes THEN 'estimate_fits_free_space' WHEN NOT has_scratch THEN 'scratch_unset' ELSE 'search' END AS why FROM y),
r AS (SELECT source_id, c::DOUBLE AS c, duration, CASE WHEN policy = 'keyframe' THEN keys ELSE [] END AS keys, 0.0::DOUBLE AS p, c::DOUBLE AS t
  FROM z, range(5, 661) l(c) WHERE duration > 0 AND (why = 'search' AND c <= cap OR c = chunk_seconds AND why IN ('manual', 'fallback_manual_estimate_unknown'))
  UNION ALL SELECT source_id, c, duration, keys, q, q + c FROM (SELECT *, CASE WHEN list_max([k for k in keys if k <= t]) > p THEN list_max([k for k in keys if k <= t]) ELSE t END AS q FROM r WHERE t < duration)),
e AS (SELECT DISTINCT source_id, c, round(p, 6) AS e FROM r UNION SELECT DISTINCT source_id, c, round(duration, 6) FROM r UNION SELECT DISTINCT source_id, c, duration FROM r WHERE duration > round(duration, 6)),
b AS MATERIALIZED (SELECT source_id, c::BIGINT AS chunk, row_number() OVER o - 1 AS index, e AS start_pts, lead(e) OVER o AS end_pts,
  round_even((lead(e) OVER o - e) * rate, 0)::BIGINT AS frames, each, free_bytes, cap, why FROM e JOIN z USING (source_id) WINDOW o AS (PARTITION BY source_id, c ORDER BY e) QUALIFY end_pts IS NOT NULL),
f AS MATERIALIZED (SELECT source_id, chunk, max(frames) * each <= free_bytes AS fits FROM b GROUP BY source_id, chunk, each, free_bytes),
h AS (SELECT source_id, 5 AS low, cap AS high, NULL::INT AS best, 0 AS step FROM z WHERE why = 'search'
  UNION ALL SELECT source_id, CASE WHEN fits THEN chunk + 1 ELSE low END, CASE WHEN fits THEN high ELSE chunk - 1 END, CASE WHEN fits THEN chunk ELSE best END, step + 1
  FROM h JOIN f USING (source_id) WHERE low <= high AND chunk = (low + high) // 2),
g AS (SELECT source_id, arg_max(coalesce(best, 0), step) AS best FROM h GROUP BY source_id),
a AS (SELECT z.source_id, CASE why WHEN 'search' THEN nullif(best, 0) WHEN 'manual' THEN chunk_seconds WHEN 'fallback_manual_estimate_unknown' THEN chunk_seconds END::INT AS chunk,
  CASE WHEN why NOT IN ('search', 'manual', 'scratch_unset') THEN why END AS reason,
  CASE WHEN why = 'scratch_unset' THEN why WHEN why = 'search' AND best = 0 THEN 'scratch_too_small' END AS error, rate AS fps, each, total FROM z LEFT JOIN g USING (source_id))
"""


def scratch_sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(sources, key frames) as ``batching.auto_chunks`` takes them."""
    s = stream(spark, d)
    u = s.groupBy("source_id").agg(
        (F.max("pts") / 3600.0).alias("duration"), F.count("*").alias("n"), F.floor(F.sum(F.col("score").cast("decimal(18,4)"))).cast("long").alias("total")
    )
    u = u.withColumn("duration", F.when(F.col("source_id") % 23 > 0, F.col("duration")))
    made = u.select("source_id", "duration", *(F.expr(e).alias(c) for c, e in SOURCE_COLUMNS.items()))
    return made, s.where("is_key").select("source_id", (F.col("pts") / 3600.0).alias("pts"))


@query(AUTO_SQL + "SELECT * FROM a")
def d08_auto_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The length that each source is cut by, or why it is not."""
    return batching.auto_chunks(*scratch_sources(spark, d))


@query(AUTO_SQL + "SELECT source_id, chunk, count(*) AS batches, max(frames) AS frames FROM b WHERE why = 'search' GROUP BY source_id, chunk")
def d08_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Batches and largest batch of every source under every length that is searched."""
    sources, keys = scratch_sources(spark, d)
    cut = batching.auto_chunks(sources, keys).where("reason IS NULL AND coalesce(error, '') <> 'scratch_unset'")
    ask = cut.join(sources.where("mode = 'auto'").select("source_id", "duration", F.least("chunk_seconds", F.lit(600)).alias("chunk_hi"), "policy"), "source_id")
    exact = ask.where("policy = 'exact'").select("source_id")
    return batching.walked(
        ask.select("source_id", "duration", "fps", F.lit(batching.SHORTEST).alias("chunk_lo"), "chunk_hi"), keys.join(exact, "source_id", "left_anti"), True
    )


@query(AUTO_SQL + "SELECT b.source_id, b.chunk::INT AS chunk, index, start_pts, end_pts, frames, frames * b.each AS bytes FROM b JOIN a ON a.source_id = b.source_id AND a.chunk = b.chunk")
def d08_auto_batches(spark: SparkSession, d: str) -> DataFrame:
    """The batches of each source's length, with their bytes."""
    return batching.auto_batches(*scratch_sources(spark, d))


PLAN_COLUMNS = {
    "pipeline_order": "CASE WHEN o_orderkey % 2 = 0 THEN 'interpolate_first' ELSE 'upscale_first' END",
    "num": "CASE o_custkey % 5 WHEN 0 THEN 24000 WHEN 1 THEN 30000 WHEN 2 THEN 25 WHEN 3 THEN 24 END",
    "den": "CASE WHEN o_custkey % 5 < 2 THEN 1001 ELSE 1 END",
    "pix_fmt": "CASE o_custkey % 7 WHEN 0 THEN 'yuv420p10le' WHEN 1 THEN 'YUV422P12BE' WHEN 2 THEN 'p010le' WHEN 3 THEN NULL ELSE 'yuv420p' END",
    "transfer": "CASE o_custkey % 11 WHEN 0 THEN 'smpte2084' WHEN 1 THEN 'ARIB-STD-B67' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'bt709' END",
    "width": "CASE WHEN o_custkey % 2 = 0 THEN 1920 ELSE 1280 END",
    "height": "CASE WHEN o_custkey % 2 = 0 THEN 1080 ELSE 720 END",
    "upscale_enabled": "o_totalprice < 150000",
    "engine": "CASE o_orderkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'anime4kcpp-vs' ELSE 'realesrgan-ncnn-vulkan' END",
    "hdr_policy": "CASE WHEN o_orderstatus = 'F' THEN 'skip' ELSE 'allow_8bit_roundtrip' END",
    "interpolate_enabled": "o_orderkey % 3 > 0",
    "interpolator": "CASE WHEN o_orderkey % 10 > 0 THEN 'rife-ncnn-vulkan' END",
    "target_fps": "CASE o_orderkey % 6 WHEN 0 THEN 60.0D WHEN 1 THEN 47.5D WHEN 2 THEN 24.0D WHEN 3 THEN 0.0D END",
    "multiplier": "CASE o_orderkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 1 END",
    "post_enabled": "o_orderpriority < '3'",
    "deband": "o_custkey % 2 = 0",
    "deblock": "o_custkey % 3 = 0",
    "grain": "o_custkey % 4",
    "target_mode": "CASE o_orderkey % 8 WHEN 0 THEN 'explicit' WHEN 1 THEN 'scale_only' ELSE 'named' END",
    "target_w": "640",
    "target_h": "360",
    "target_named": "CASE o_orderkey % 9 WHEN 0 THEN '720p' WHEN 1 THEN '1080p' WHEN 2 THEN '9p' WHEN 3 THEN '2160p' END",
    "batches": "CASE WHEN o_totalprice > 280000 THEN 3 ELSE 0 END",
    "manual": "o_totalprice > 300000",
    "dedupe_enabled": "o_custkey % 2 = 1",
    "model": "CASE o_custkey % 6 WHEN 0 THEN 'realesr-animevideov3' WHEN 1 THEN 'realesrgan-x4plus' WHEN 2 THEN 'acnet' WHEN 3 THEN 'models-pro' WHEN 4 THEN 'models-cunet' ELSE 'models-upconv_7_photo' END",
    "scale": "o_orderkey % 6",
    "denoise": "o_custkey % 7 - 2",
    "version": "CASE o_custkey % 3 WHEN 0 THEN 'v4.25-lite' WHEN 1 THEN 'v4.24' ELSE 'v9' END",
}


def notes_sql(when: str) -> str:
    """P12's notes as entries of a list in SQL, null where there is none."""
    catalogue = ", ".join(sql_text(m) for m in models.ANIME_MODELS)
    is_ = lambda e: f"{when} AND engine = '{e}'"
    anime = "engine || ': Anime4K"
    rows = [
        f"""{is_(models.CUGAN)} AND NOT CASE WHEN model = 'models-pro' THEN scale IN (2, 3) AND denoise IN (-1, 0, 3) ELSE scale = 2 AND denoise BETWEEN -1 AND 3 OR scale IN (3, 4) AND denoise IN (-1, 0, 3) END
        THEN 'realcugan: Real-CUGAN ' || model || ' does not ship a (scale=' || scale || ', denoise=' || denoise || ') checkpoint; the binary will silently fall back. Consider scale=2/3 with denoise=3 for cel anime.'""",
        f"{is_(models.CUGAN)} AND scale = 4 AND model = 'models-pro' THEN 'realcugan: Real-CUGAN pro lacks a native 4x checkpoint; the binary cascades 2x→2x. Real-ESRGAN x4 is usually preferable for 4x.'",
        f"{is_(models.ESRGAN)} AND NOT starts_with(model, 'realesr') THEN 'realesrgan: Real-ESRGAN model ''' || model || ''' is not in our catalog; assuming x4 native scale.'",
        f"{is_(models.ESRGAN)} AND starts_with(model, 'realesr') AND scale > 4 THEN 'realesrgan: Real-ESRGAN model ''' || model || ''' has native scale x4; requested x' || scale || ' would extrapolate.'",
        f"""{is_(models.ESRGAN)} AND starts_with(model, 'realesr') AND scale < 4 THEN 'realesrgan: Real-ESRGAN model ''' || model || ''' runs at x4 natively; the binary will downscale the result to x' || scale || ', which wastes ~' || (16 - scale * scale)
        || ' GPU-frames worth of compute. Consider Real-CUGAN at native x' || scale || '.'""",
        f"{is_(models.ESRGAN)} AND model = 'realesrgan-x4plus' THEN 'realesrgan: Real-ESRGAN model ''realesrgan-x4plus'' is a stills model and will flicker in motion. For anime episodes prefer realesr-animevideov3.'",
        f"""{is_(models.WAIFU)} AND model NOT IN ('models-cunet', 'models-upconv_7_photo') THEN 'waifu2x: waifu2x model ''' || model
        || ''' is not in our catalog; known models: [''models-cunet'', ''models-upconv_7_anime_style_art_rgb'', ''models-upconv_7_photo'']'""",
        f"""{is_(models.WAIFU)} AND (model = 'models-cunet' AND scale NOT IN (1, 2) OR model = 'models-upconv_7_photo' AND scale <> 2) THEN 'waifu2x: waifu2x ' || model || ' does not ship a scale=' || scale || ' checkpoint (supported: '
        || CASE WHEN model = 'models-cunet' THEN '[1, 2]' ELSE '[2]' END || '). Pick scale=2 for cel anime, or scale=1 with models-cunet for denoise-only passes.'""",
        f"""{is_(models.WAIFU)} AND model IN ('models-cunet', 'models-upconv_7_photo') AND denoise NOT BETWEEN -1 AND 3
        THEN 'waifu2x: waifu2x ' || model || ' does not ship a denoise=' || denoise || ' checkpoint (supported: [-1, 0, 1, 2, 3]). Use -1 for no denoise; 3 is strongest.'""",
        f"""{is_(models.WAIFU)} AND model = 'models-upconv_7_photo'
        THEN 'waifu2x: waifu2x model ''models-upconv_7_photo'' is a photo model and will produce smoother, less line-faithful output on cel anime. For anime episodes prefer models-cunet.'""",
        f"{when} AND starts_with(engine, 'anime4kcpp') AND model NOT IN ({catalogue}) THEN {anime} model ''' || model || ''' is not in our catalog; see Anime4KCPP wiki Model list (default: acnet-f8b8-hdn)'",
        f"{when} AND starts_with(engine, 'anime4kcpp') AND scale NOT BETWEEN 1 AND 4 THEN {anime} scale should be within 1..4 for predictable output quality.'",
        f"{is_(models.ANIME_VS)} AND denoise NOT BETWEEN -1 AND 3 THEN {anime} denoise should stay in -1..3 to match preset compatibility.'",
    ]
    return ",\n    ".join(f"CASE WHEN {r} END" for r in rows)


def version_sql(when: str) -> str:
    """The interpolator's notes in SQL, for the versions that occur."""
    return f"""CASE WHEN {when} AND version = 'v9' THEN 'rife: RIFE version ''v9'' not in our catalog; behavior may differ.' WHEN {when} AND version LIKE '%-lite'
    THEN 'rife: RIFE ' || version || ' is a lite variant — faster but lower quality. Prefer v4.22/v4.24-class non-lite models unless throughput is a hard constraint.' END"""


P12_COLUMNS = {
    "engine": "CASE l_partkey % 6 WHEN 0 THEN 'realcugan-ncnn-vulkan' WHEN 1 THEN 'realesrgan-ncnn-vulkan' WHEN 2 THEN 'waifu2x-ncnn-vulkan' WHEN 3 THEN 'anime4kcpp' WHEN 4 THEN 'anime4kcpp-vs' ELSE 'none' END",
    "model": "CASE l_suppkey % 7 WHEN 0 THEN 'realesr-animevideov3' WHEN 1 THEN 'realesrgan-x4plus' WHEN 2 THEN 'arnet-f8b16-box' WHEN 3 THEN 'models-pro' WHEN 4 THEN 'models-cunet' WHEN 5 THEN l_linestatus ELSE 'models-upconv_7_photo' END",
    "scale": "l_linenumber - 1",
    "denoise": "l_orderkey % 7 - 2",
}
F29_COLUMNS = {"enabled": "l_linenumber > 1", "deband": "l_partkey % 2 = 0", "deblock": "CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 3 = 1 END", "grain": "l_quantity::INT - 12"}


@query(f"""WITH r AS (SELECT l_orderkey AS id, l_linenumber AS line, {", ".join(f"{e} AS {c}" for c, e in P12_COLUMNS.items())} FROM lineitem)
SELECT id, line, array_to_string([x for x in [{notes_sql("true")}] if x IS NOT NULL], '|') AS notes FROM r""")
def p12_model_notes(spark: SparkSession, d: str) -> DataFrame:
    """What users should know of combinations of engine, model, scale and strength."""
    notes = models.model_notes(*(F.expr(P12_COLUMNS[c]) for c in ("engine", "model", "scale", "denoise")))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.array_join(notes, "|").alias("notes"))


@query(f"""WITH r AS (SELECT l_orderkey AS id, l_linenumber AS line, {", ".join(f"{e} AS {c}" for c, e in F29_COLUMNS.items())} FROM lineitem),
s AS (SELECT *, [x for x in [CASE WHEN enabled AND deband THEN 'gradfun=1.5:8' END, CASE WHEN enabled AND deblock THEN 'deblock=filter=weak:block=4:alpha=0.05:beta=0.05' END,
  CASE WHEN enabled AND grain > 0 THEN 'noise=c0s=' || least(grain, 32) || ':c0f=t+u' END] if x IS NOT NULL] AS parts FROM r)
SELECT id, line, CASE WHEN len(parts) > 0 THEN array_to_string(parts, ',') END AS vf,
  CASE WHEN NOT enabled THEN 'postprocess disabled' WHEN len(parts) = 0 THEN 'postprocess enabled but all sub-filters off'
    ELSE array_to_string([x for x in [CASE WHEN deband THEN 'deband: gradfun=1.5:8 (smooths gradient banding)' END, CASE WHEN deblock THEN 'deblock: weak filter, block=4 (cleans source compression artifacts)' END,
      CASE WHEN grain > 0 THEN 'grain: noise c0s=' || least(grain, 32) || ' luma temporal+uniform (prevents over-smooth NVENC look)' END] if x IS NOT NULL], '|') END AS rationale,
  CASE WHEN enabled AND grain > 32 THEN 'grain_addback ' || grain || ' clamped to 32 (valid range 0..32)' ELSE '' END AS warnings FROM s""")
def f29_filter_chains(spark: SparkSession, d: str) -> DataFrame:
    """the chain of filters after upscaling, with reasons and warnings."""
    chain = models.filter_chain(*(F.expr(F29_COLUMNS[c]) for c in ("enabled", "deband", "deblock", "grain")))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), chain.alias("c"))
    return rows.select("id", "line", "c.vf", F.array_join("c.rationale", "|").alias("rationale"), F.array_join("c.warnings", "|").alias("warnings"))
D14_SQL = f"""WITH p AS (SELECT o_orderkey AS plan, {", ".join(f"{e.replace('0D', '0::DOUBLE').replace('5D', '5::DOUBLE')} AS {c}" for c, e in PLAN_COLUMNS.items())} FROM orders),
f AS (SELECT *, coalesce(regexp_matches(lower(pix_fmt), 'p10|p012|p12'), false) AS deep, coalesce(lower(transfer) IN ('smpte2084', 'arib-std-b67'), false) AS hdr,
  upscale_enabled AND engine <> 'none' AS wants, interpolate_enabled AND coalesce(interpolator = 'rife-ncnn-vulkan', false) AS asks,
  post_enabled AND (deband OR deblock OR grain > 0) AS post, num::DOUBLE / den AS fps FROM p),
g AS (SELECT *, CASE WHEN asks THEN target_fps END AS goal, CASE WHEN asks THEN multiplier END AS m, wants AND (deep OR hdr) AND hdr_policy = 'skip' AS skipped,
  wants AND (deep OR hdr) AND hdr_policy <> 'skip' AS trip FROM f),
h AS (SELECT *, wants AND NOT skipped AS up, CASE WHEN num IS NULL THEN coalesce(m, 1) WHEN m < 1 THEN 1 WHEN m IS NOT NULL THEN m WHEN goal > 0 THEN greatest(1, round_even(goal / fps, 0)) ELSE 1 END::BIGINT AS times FROM g),
i AS (SELECT *, asks AND times > 1 AS inter, abs(fps * times - goal) / goal AS drift FROM h),
j AS MATERIALIZED (SELECT *, up OR inter OR post OR batches > 0 OR manual AS framed,
  CASE target_mode WHEN 'explicit' THEN target_w WHEN 'scale_only' THEN NULL ELSE CASE target_named WHEN '720p' THEN 1280 WHEN '1080p' THEN 1920 WHEN '2160p' THEN 3840 END END AS tw,
  CASE target_mode WHEN 'explicit' THEN target_h WHEN 'scale_only' THEN NULL ELSE CASE target_named WHEN '720p' THEN 720 WHEN '1080p' THEN 1080 WHEN '2160p' THEN 2160 END END AS th,
  CASE WHEN inter THEN times ELSE 1 END AS k FROM i)
"""


def plans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("plan"), *(F.expr(e).alias(c) for c, e in PLAN_COLUMNS.items()))


@query(f"""{D14_SQL} SELECT plan, up AS upscale, inter AS interpolate, post AS postprocess, CASE WHEN framed THEN 'frames' ELSE 'source' END AS encode_input_mode, times AS multiplier,
  CASE WHEN num > 0 THEN (num * k // gcd(num * k, den))::BIGINT || '/' || (den // gcd(num * k, den))::BIGINT ELSE '' END AS output_fps,
  CASE WHEN framed AND NOT up AND (tw IS DISTINCT FROM width OR th IS DISTINCT FROM height) THEN tw END AS decode_w,
  CASE WHEN framed AND NOT up AND (tw IS DISTINCT FROM width OR th IS DISTINCT FROM height) THEN th END AS decode_h,
  dedupe_enabled AND framed AND (up OR inter) AND engine <> 'anime4kcpp-vs' AS dedupe, CASE WHEN deep OR hdr THEN hdr_policy ELSE 'n/a' END AS hdr_policy,
  CASE WHEN trip THEN 'yuv420p' END AS target_pix_fmt, CASE WHEN trip THEN 'bt709' ELSE nullif(transfer, '') END AS target_transfer, trip AS roundtripped,
  array_to_string([x for x in [CASE WHEN skipped THEN {sql_text(paths.SKIPPED)} END, CASE WHEN trip THEN {sql_text(paths.ROUNDTRIP)} END,
    {notes_sql("up")}, {version_sql("asks")},
    CASE WHEN num IS NULL AND m IS NOT NULL THEN {sql_text(paths.UNKNOWN_RATE)} WHEN num IS NULL THEN {sql_text(paths.ASSUMED)} WHEN m < 1 THEN 'fps: multiplier ' || m || ' < 1 is invalid; using 1'
      WHEN m IS NULL AND goal > 0 AND drift > 0.005 THEN 'fps: target ' || goal || 'fps from source ' || printf('%.3f', fps) || 'fps requires non-integer multiplier ' || printf('%.3f', goal / fps)
        || '; rounded to ' || times || '× → ' || printf('%.3f', fps * times) || 'fps (drift ' || printf('%.2f', drift * 100) || '%)' END] if x IS NOT NULL], '|') AS warnings FROM j""")
def d14_plans(spark: SparkSession, d: str) -> DataFrame:
    """What each plan does, its rate, HDR policy, decode size and warnings."""
    return paths.planned(plans(spark, d)).drop("stages").withColumn("warnings", F.array_join("warnings", "|"))


@query(f"""{D14_SQL}, o AS (SELECT plan, framed, CASE WHEN pipeline_order = 'interpolate_first' THEN ['decode', 'interpolate', 'upscale', 'postprocess', 'encode'] ELSE ['decode', 'upscale', 'interpolate', 'postprocess', 'encode'] END AS names,
  inter, up, post FROM j),
r AS (SELECT plan, framed, i - 1 AS position, names[i] AS stage, CASE names[i] WHEN 'interpolate' THEN inter WHEN 'upscale' THEN up WHEN 'postprocess' THEN post ELSE true END AS active FROM o, range(1, 6) t(i))
SELECT plan, position::INT AS position, stage, CASE WHEN stage = 'decode' THEN framed ELSE active END AS active, CASE WHEN stage = 'encode' AND NOT framed THEN 'source'
  ELSE coalesce(last_value(CASE WHEN active THEN stage END IGNORE NULLS) OVER (PARTITION BY plan ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'source') END AS reads FROM r""")
def d14_stages(spark: SparkSession, d: str) -> DataFrame:
    """The stages of each plan, and what each reads."""
    return paths.stages(paths.planned(plans(spark, d)))


LADDER_COLUMNS = {
    "encoder": "CASE o_orderkey % 6 WHEN 0 THEN 'h264_nvenc' WHEN 1 THEN 'hevc_nvenc' WHEN 2 THEN 'av1_nvenc' WHEN 3 THEN 'hevc_amf' WHEN 4 THEN 'h264_amf' ELSE 'libx265' END",
    "multipass": "CASE o_custkey % 4 WHEN 0 THEN 'fullres' WHEN 1 THEN 'qres' WHEN 2 THEN 'disabled' END",
    "temporal_aq": "o_totalprice < 150000",
    "spatial_aq": "o_orderstatus = 'F'",
    "b_ref_mode": "CASE WHEN o_custkey % 3 = 0 THEN 'middle' ELSE 'each' END",
    "bframes": "o_custkey % 4",
    "bit_depth": "CASE o_custkey % 5 WHEN 0 THEN '8' WHEN 1 THEN '10' ELSE 'auto' END",
    "ten_bit": "o_orderpriority < '3'",
}


@query(f"""WITH j AS (SELECT o_orderkey AS job, {", ".join(f"{e} AS {c}" for c, e in LADDER_COLUMNS.items())} FROM orders),
n AS (SELECT * FROM j WHERE encoder LIKE '%nvenc'), w AS (SELECT * FROM n WHERE encoder <> 'h264_nvenc' AND ten_bit),
a AS (SELECT job, 0 AS k, encoder, multipass, temporal_aq, spatial_aq, b_ref_mode, bframes, bit_depth, NULL AS pix_fmt FROM j
  UNION ALL SELECT job, 1, encoder, 'qres', temporal_aq, spatial_aq, b_ref_mode, bframes, bit_depth, NULL FROM n WHERE multipass = 'fullres'
  UNION ALL SELECT job, 2, encoder, 'disabled', temporal_aq, spatial_aq, b_ref_mode, bframes, bit_depth, NULL FROM n WHERE multipass IN ('fullres', 'qres')
  UNION ALL SELECT job, 3, encoder, 'disabled', false, spatial_aq, b_ref_mode, bframes, bit_depth, NULL FROM n WHERE temporal_aq
  UNION ALL SELECT job, 4, encoder, 'disabled', false, spatial_aq, b_ref_mode, bframes, bit_depth, 'yuv420p' FROM w
  UNION ALL SELECT job, 5, encoder, multipass, temporal_aq, spatial_aq, b_ref_mode, bframes, '8', NULL FROM j WHERE encoder = 'hevc_amf' AND (bit_depth = '10' OR bit_depth = 'auto' AND ten_bit)),
u AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY job, multipass, temporal_aq, spatial_aq, b_ref_mode, bframes, bit_depth, pix_fmt ORDER BY k) = 1)
SELECT job, (row_number() OVER (PARTITION BY job ORDER BY k) - 1)::INT AS attempt, encoder, multipass, temporal_aq, spatial_aq, b_ref_mode, bframes, bit_depth, pix_fmt FROM u""")
def u06_relaxed(spark: SparkSession, d: str) -> DataFrame:
    """The attempts of each job's encoder, from the preset's to the most careful, equal ones once."""
    return paths.relaxed(table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), *(F.expr(e).alias(c) for c, e in LADDER_COLUMNS.items())))


@query("""SELECT l_orderkey AS job_id, l_linenumber AS stage, '{"params":{"a":[' || l_linenumber || ',{"x":null,"y":"\\u00e9"}],"scale":' || l_suppkey % 4 || ',"tta":' || CASE WHEN l_partkey % 2 = 0 THEN 'true' ELSE 'false' END
  || '},"source":"' || l_orderkey || '","stage":"' || l_linenumber || '","tools":{"ffmpeg":"' || l_suppkey % 2 || '","rife":"4"}}' AS canonical, true AS same_key, l_partkey % 2 = 0 AS hit FROM lineitem""")
def d16_built_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are built from source, stage, tools and settings, against those of stored results."""
    c, text = F.col, lambda x: x.cast("string")
    scale, tta = text(c("l_suppkey") % 4), F.when(c("l_partkey") % 2 == 0, "true").otherwise("false")
    own = F.concat(F.lit('{"tta": '), tta, F.lit(', "scale": '), scale, F.lit(', "a": ['), text(c("l_linenumber")), F.lit(', {"y": "é", "x": null}]}'))
    other = F.concat(F.lit('{"a":['), text(c("l_linenumber")), F.lit(',{"x":null,"y":"\\u00e9"}],"scale":'), scale, F.lit(',\n"tta":'), tta, F.lit("}"))
    stored = F.regexp_replace(other, "false", "true")
    tools = F.create_map(F.lit("rife"), F.lit("4"), F.lit("ffmpeg"), text(c("l_suppkey") % 2))
    turned = F.create_map(F.lit("ffmpeg"), text(c("l_suppkey") % 2), F.lit("rife"), F.lit("4"))
    key = lambda tools, params: canonical.cache_key(text(c("l_orderkey")), text(c("l_linenumber")), tools, params)
    payload = F.concat(F.lit('{"stage":"'), text(c("l_linenumber")), F.lit('","tools":'), F.to_json(tools), F.lit(',"source":"'), text(c("l_orderkey")), F.lit('","params":'), own, F.lit("}"))
    keyed = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", canonical.canonical_and_key(payload).alias("built"),
        key(tools, own).alias("a"), key(turned, other).alias("b"), key(turned, stored).alias("stored"),
    )
    return keyed.select(
        c("l_orderkey").alias("job_id"), c("l_linenumber").alias("stage"), "built.canonical", ((c("a") == c("b")) & (c("a") == c("built.key"))).alias("same_key"), (c("a") == c("stored")).alias("hit")
    )
