"""Path planning: which stages a plan runs and what each reads (D14), what becomes of HDR, and the ladder of relaxed attempts.

A plan is a small graph: its stages in the order of the pipeline, each of which reads the last active one before it.
Everything is found in the row of a plan, so nothing is shuffled; ``stages`` turns the graphs into rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.functions import scalar as fn
from cinelake.functions.scalar import let
from cinelake.plans import models

# Transfers of HDR, parts of names of pixel formats of more than eight bits, the engine that interpolates,
# named targets, and messages.
HDR_TRANSFERS = ("smpte2084", "arib-std-b67")
DEEP = "p10|p012|p12"
INTERPOLATOR = "rife-ncnn-vulkan"
NAMED = {"720p": (1280, 720), "1080p": (1920, 1080), "1440p": (2560, 1440), "2160p": (3840, 2160)}
SKIPPED = "upscaler disabled: source is high-bit-depth/HDR and hdr_policy=skip"
ROUNDTRIP = "upscaler will round-trip through 8-bit BT.709; HDR/wide-gamut info lost"
UNKNOWN_RATE, ASSUMED = "fps: source fps unknown; cannot compute output rate", "fps: source fps unknown; assuming no interpolation"
#: Stages in either order; the first is always there, and what it reads is the source.
ORDERS = {
    "interpolate_first": ("decode", "interpolate", "upscale", "postprocess", "encode"),
    "upscale_first": ("decode", "upscale", "interpolate", "postprocess", "encode"),
}


def has_more_bits(pix_fmt: Column) -> Column:
    return F.coalesce(F.lower(pix_fmt).rlike(DEEP), F.lit(False))


def is_hdr(transfer: Column) -> Column:
    return F.coalesce(F.lower(transfer).isin(*HDR_TRANSFERS), F.lit(False))


def target(mode: Column, width: Column, height: Column, named: Column) -> tuple[Column, Column]:
    """The size that a target asks for; null keeps the source's."""
    of = lambda k: F.coalesce(*(F.when(named == n, F.lit(size[k])) for n, size in NAMED.items()))
    side = lambda k, own: F.when(mode == "explicit", own).when(mode == "scale_only", F.lit(None)).otherwise(of(k))
    return side(0, width), side(1, height)


def realized(num: Column, den: Column, goal: Column, multiplier: Column) -> Column:
    """(multiplier, note) by which a rate is raised; a given multiplier wins over a goal."""
    source = num.cast("double") / den
    known = num.isNotNull() & (num > 0)
    text = lambda x, d: F.format_string(f"%.{d}f", x)

    def by_goal(times: Column) -> Column:
        drift = F.abs(source * times - goal) / goal
        note = F.concat(
            F.lit("fps: target "), goal.cast("string"), F.lit("fps from source "), text(source, 3), F.lit("fps requires non-integer multiplier "),
            text(goal / source, 3), F.lit("; rounded to "), times.cast("string"), F.lit("× → "), text(source * times, 3),
            F.lit("fps (drift "), text(drift * 100, 2), F.lit("%)"),
        )
        return F.struct(times.alias("times"), F.when(drift > 0.005, note).alias("note"))

    def plain(times: Column, note: Column | None = None) -> Column:
        return F.struct(times.cast("long").alias("times"), (F.lit(None) if note is None else note).cast("string").alias("note"))

    low = F.concat(F.lit("fps: multiplier "), multiplier.cast("string"), F.lit(" < 1 is invalid; using 1"))
    times = F.greatest(F.lit(1).cast("long"), fn.half_even(goal / source))
    return (
        F.when(~F.coalesce(known, F.lit(False)) & multiplier.isNotNull(), plain(multiplier, F.lit(UNKNOWN_RATE)))
        .when(~F.coalesce(known, F.lit(False)), plain(F.lit(1), F.lit(ASSUMED)))
        .when(multiplier < 1, plain(F.lit(1), low))
        .when(multiplier.isNotNull(), plain(multiplier))
        .when(goal > 0, let(times, by_goal))
        .otherwise(plain(F.lit(1)))
    )


def planned(plans: DataFrame) -> DataFrame:
    """Plans with what they do: flags, rate, graph, HDR, decode size, warnings.

    ``plans``: (plan, pipeline_order, num, den, pix_fmt, transfer, width, height, upscale_enabled, engine, hdr_policy,
    interpolate_enabled, interpolator, target_fps, multiplier, post_enabled, deband, deblock, grain, target_mode, target_w,
    target_h, target_named, batches, manual, dedupe_enabled), and model, scale, denoise, version where combinations are to be
    checked (P12).  ``num / den`` is the source's rate in lowest terms, null if
    unknown; ``batches`` counts the batches that were planned, and ``manual`` says that batching is on by hand: either makes
    the encoder read frames.
    """
    c = F.col
    off = F.lit(False)
    flag = lambda name: F.coalesce(c(name), off)
    deep, hdr = has_more_bits(c("pix_fmt")), is_hdr(c("transfer"))
    wanted = flag("upscale_enabled") & (F.coalesce("engine", F.lit("none")) != "none")
    special = deep | hdr
    skip = wanted & special & (c("hdr_policy") == "skip")
    trip = wanted & special & (c("hdr_policy") != "skip")
    asks = flag("interpolate_enabled") & F.coalesce(c("interpolator") == INTERPOLATOR, off)
    raised = realized(c("num"), c("den"), F.when(asks, c("target_fps")), F.when(asks, c("multiplier")))
    post = flag("post_enabled") & (flag("deband") | flag("deblock") | (F.coalesce("grain", F.lit(0)) > 0))
    first = plans.select(
        "*",
        F.struct(deep.alias("deep"), hdr.alias("hdr"), (wanted & ~skip).alias("upscale"), skip.alias("skip"), trip.alias("trip"), asks.alias("asks"), raised.alias("raised"), post.alias("post")).alias("is"),
    )
    interpolates = c("is.asks") & (c("is.raised.times") > 1)
    frames = c("is.upscale") | interpolates | c("is.post") | (F.coalesce("batches", F.lit(0)) > 0) | flag("manual")
    on = {"decode": F.lit(True), "interpolate": interpolates, "upscale": c("is.upscale"), "postprocess": c("is.post"), "encode": F.lit(True)}

    def graph(order: tuple[str, ...]) -> Column:
        rows = []
        for k, stage in enumerate(order):
            before = F.lit("source")
            for s in order[:k]:
                before = F.when(on[s], F.lit(s)).otherwise(before)
            rows.append(F.struct(F.lit(stage).alias("stage"), on[stage].alias("active"), before.alias("reads")))
        return F.array(*rows)

    stages = F.when(c("pipeline_order") == "interpolate_first", graph(ORDERS["interpolate_first"])).otherwise(graph(ORDERS["upscale_first"]))
    tw, th = target(c("target_mode"), c("target_w"), c("target_h"), c("target_named"))
    resized = frames & ~c("is.upscale") & ~(tw.eqNullSafe(c("width")) & th.eqNullSafe(c("height")))
    times = F.when(interpolates, c("is.raised.times")).otherwise(F.lit(1).cast("long"))
    common = fn.gcd(c("num") * times, c("den").cast("long"))
    rate = F.when(c("num") > 0, F.concat((c("num") * times / common).cast("long").cast("string"), F.lit("/"), (c("den") / common).cast("long").cast("string"))).otherwise("")
    special = c("is.deep") | c("is.hdr")
    none, notes = F.array().cast("array<string>"), []
    if "model" in plans.columns:
        notes.append(F.when(c("is.upscale"), models.model_notes(c("engine"), c("model"), c("scale"), c("denoise"))).otherwise(none))
    if "version" in plans.columns:
        notes.append(F.when(c("is.asks"), models.interpolator_notes(c("version"))).otherwise(none))
    dedupe = flag("dedupe_enabled") & frames & (c("is.upscale") | interpolates) & ~(F.coalesce("engine", F.lit("")) == "anime4kcpp-vs")
    return first.select(
        "plan",
        c("is.upscale").alias("upscale"),
        interpolates.alias("interpolate"),
        c("is.post").alias("postprocess"),
        F.when(frames, "frames").otherwise("source").alias("encode_input_mode"),
        F.coalesce("is.raised.times", F.lit(1).cast("long")).alias("multiplier"),
        rate.alias("output_fps"),
        F.when(resized, tw).alias("decode_w"),
        F.when(resized, th).alias("decode_h"),
        dedupe.alias("dedupe"),
        F.when(special, c("hdr_policy")).otherwise("n/a").alias("hdr_policy"),
        F.when(c("is.trip"), "yuv420p").alias("target_pix_fmt"),
        F.when(c("is.trip"), "bt709").otherwise(F.nullif("transfer", F.lit(""))).alias("target_transfer"),
        c("is.trip").alias("roundtripped"),
        stages.alias("stages"),
        F.concat(F.array_compact(F.array(F.when(c("is.skip"), SKIPPED), F.when(c("is.trip"), ROUNDTRIP))), *notes, F.array_compact(F.array(c("is.raised.note")))).alias("warnings"),
    )


def stages(planned: DataFrame) -> DataFrame:
    """(plan, position, stage, active, reads): the graphs of ``planned`` as rows; a plan from the source itself decodes nothing."""
    framed = F.col("encode_input_mode") == "frames"
    return planned.select("plan", "encode_input_mode", F.posexplode("stages").alias("position", "s")).select(
        "plan",
        "position",
        "s.stage",
        F.when(F.col("s.stage") == "decode", framed).otherwise(F.col("s.active")).alias("active"),
        F.when((F.col("s.stage") == "encode") & ~framed, "source").otherwise(F.col("s.reads")).alias("reads"),
    )


#: What tells two attempts apart.
MARKS = ("multipass", "temporal_aq", "spatial_aq", "b_ref_mode", "bframes", "bit_depth", "pix_fmt")


def first_of_equals(attempts: Column) -> Column:
    """An array without nulls and without what came before in it, in its order."""
    return F.filter(attempts, lambda x, k: x.isNotNull() & ((k == 0) | ~F.exists(F.slice(attempts, 1, F.greatest(k, F.lit(1))), lambda y: y.eqNullSafe(x))))


def relaxed(jobs: DataFrame) -> DataFrame:
    """(job, attempt, encoder, multipass, temporal_aq, spatial_aq, b_ref_mode, bframes, bit_depth, pix_fmt): what to try, in order.

    ``jobs``: (job, encoder, multipass, temporal_aq, spatial_aq, b_ref_mode, bframes, bit_depth, ten_bit).  A card's encoder is
    tried with less and less: two passes at a quarter, none, no temporal quantization, at last eight bits; an AMF encoder of ten
    bits with eight; others once.  Of attempts that are equal the first stays.
    """
    c = F.col
    nvenc, ten = c("encoder").endswith("_nvenc"), F.coalesce("ten_bit", F.lit(False))
    wide = lambda kind: c("encoder").isin(f"hevc_{kind}", f"av1_{kind}")

    def attempt(**change: object) -> Column:
        new = {"pix_fmt": F.lit(None).cast("string")} | {k: F.lit(v) for k, v in change.items()}
        return F.struct(*(new.get(m, c(m) if m != "pix_fmt" else None).alias(m) for m in MARKS))

    passes = F.coalesce("multipass", F.lit(""))
    bare = {"multipass": "disabled", "temporal_aq": False}
    ladder = F.array(
        attempt(),
        F.when(nvenc & (passes == "fullres"), attempt(multipass="qres")),
        F.when(nvenc & passes.isin("fullres", "qres"), attempt(multipass="disabled")),
        F.when(nvenc & F.coalesce("temporal_aq", F.lit(False)), attempt(**bare)),
        F.when(nvenc & ten & wide("nvenc"), attempt(**bare, pix_fmt="yuv420p")),
        F.when(wide("amf") & ((c("bit_depth") == "10") | (c("bit_depth") == "auto") & ten), attempt(bit_depth="8")),
    )
    return jobs.select("job", "encoder", F.posexplode(let(ladder, first_of_equals)).alias("attempt", "x")).select("job", "attempt", "encoder", "x.*")
