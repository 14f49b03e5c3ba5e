"""Encoder recommendation: an ordered rule engine over hosts and jobs.

Rules are data.  Each says for which encoder it stands, which facts of the host it needs and which it bars, what
comes next, and what is told.  A fact (what a host lists, what runs, whether a card is there) is a bit, so the facts
of a host are one number: the capabilities joined with the facts' bits.  A job carries its host's number and follows
the rules from the encoder that its preset wants: a fold over (encoder, warnings, rationale), which takes the first
rule of the encoder that holds.  Goals are rewrite rules of the settings.  Nothing is shuffled but the capabilities
by host and the join of jobs with hosts; the rules are one constant of the plan.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Encoders by kind of device, the software encoder of each codec, the devices of any vendor by codec in
# their order, and what takes the place of a software encoder, in order.
ENCODERS = {
    "nvenc": ("h264_nvenc", "hevc_nvenc", "av1_nvenc"),
    "qsv": ("h264_qsv", "hevc_qsv", "av1_qsv"),
    "amf": ("h264_amf", "hevc_amf", "av1_amf"),
    "d3d12": ("h264_d3d12", "av1_d3d12"),
    "vulkan": ("h264_vulkan", "hevc_vulkan", "av1_vulkan"),
}
SOFTWARE = {"h264": "libx264", "hevc": "libx265", "av1": "libx265"}
ANY_VENDOR = {"h264": ("h264_d3d12", "h264_vulkan"), "hevc": ("hevc_vulkan",), "av1": ("av1_d3d12", "av1_vulkan")}
IN_PLACE_OF = {
    "libx264": ("h264_nvenc", "h264_qsv", "h264_amf", "h264_d3d12", "h264_vulkan"),
    "libx265": ("hevc_nvenc", "hevc_qsv", "hevc_amf", "hevc_vulkan", "av1_vulkan", "av1_d3d12"),
}
# Messages.
CONFIRMED = {
    "nvenc": "{name} confirmed available (arch={arch}, vram={vram} MiB).",
    "qsv": "{name} confirmed available (Intel QSV path).",
    "amf": "{name} confirmed available (AMD AMF path).",
    "d3d12": "{name} confirmed available (DirectX D3D12 path).",
    "vulkan": "{name} confirmed available (Vulkan path).",
}
MISSING = {
    "nvenc": "{name} requires an NVIDIA GPU; none detected.",
    "qsv": "{name} is not available (driver/ffmpeg or no Intel adapter).",
    "amf": "{name} is not available (driver/ffmpeg or no AMD adapter).",
    "d3d12": "{name} is not available in this ffmpeg/driver D3D12 path.",
    "vulkan": "{name} is not available in this ffmpeg/driver Vulkan path.",
}
FALLING = "Falling back to {target}."
NEEDS_ADA = "av1_nvenc requires Ada (RTX 40xx) or newer; your arch is {arch}. Falling back to hevc_nvenc."
HEVC_GONE, H264_GONE = "hevc_nvenc unavailable; falling back to h264_nvenc.", "h264_nvenc unavailable."
NOT_BUILT, NOT_WANTED = "{name} not present in this ffmpeg build.", "Hardware encoder fallback disabled by settings."
TEN_BIT = (
    "Source is 10-bit but H.264 output will downconvert to 8-bit for compatibility. Use HEVC or libx265 to retain bit depth."
)
LARGER = "Source is HEVC but you selected H.264 output; this typically increases filesize for the same quality."
NO_VBAQ = "AMF VBAQ disabled: incompatible with CQP rate control."
NO_PREENCODE = "AMF preencode disabled: incompatible with CQP rate control."
#: Said of a software encoder when hardware may not take its place.
ALONE = " alone"


class Rule(NamedTuple):
    """The first rule of ``encoder`` whose ``needs`` a host meets and whose ``bars`` it does not; ``done`` ends the search."""

    encoder: str
    needs: tuple[str, ...]
    bars: tuple[str, ...]
    target: str
    done: bool
    warnings: tuple[str, ...] = ()
    rationale: tuple[str, ...] = ()


def lists(encoder: str) -> str:
    return f"lists {encoder}"


def runs(encoder: str) -> str:
    return f"runs {encoder}"


CARD = "nvidia"


def made_rules() -> list[Rule]:
    out: list[Rule] = []

    def falls(name: str, target: str, told: str, bars: tuple[str, ...] = ()) -> None:
        """``name`` gives way to ``target`` if that is listed and runs."""
        said = (told.format(name=name), FALLING.format(target=target))
        out.append(Rule(name, (lists(target), runs(target)), bars, target, False, said))

    for kind, names in ENCODERS.items():
        for name in names:
            codec = name.split("_")[0]
            software, told = SOFTWARE[codec], MISSING[kind]
            stays = Rule(name, (runs(name),), (), name, True, (), (CONFIRMED[kind].replace("{name}", name),))
            if kind == "nvenc":
                for other in ANY_VENDOR[codec]:
                    falls(name, other, told, (CARD,))
                out.append(Rule(name, (), (CARD,), software, True, (told.format(name=name), FALLING.format(target=software))))
                out.append(stays)
                if codec == "av1":
                    out.append(Rule(name, (), (), "hevc_nvenc", False, (NEEDS_ADA,)))
                elif codec == "hevc":
                    out.append(Rule(name, (), (), "h264_nvenc", False, (HEVC_GONE,)))
                else:
                    for other in ANY_VENDOR[codec]:
                        falls(name, other, H264_GONE)
                    out.append(Rule(name, (), (), software, True, (H264_GONE, FALLING.format(target=software))))
                continue
            out.append(stays)
            # A lesser codec of the same kind comes before the same codec of another kind.
            lesser = {"av1": ("hevc", "h264"), "hevc": ("h264",), "h264": ()}[codec]
            for other in (f"{c}_{kind}" for c in lesser):
                if other in names:
                    falls(name, other, told)
            for other in ANY_VENDOR[codec]:
                if other != name:
                    falls(name, other, told)
            out.append(Rule(name, (), (), software, True, (told.format(name=name), FALLING.format(target=software))))
    for name, others in IN_PLACE_OF.items():
        told = NOT_BUILT.format(name=name)
        out.append(Rule(name, (lists(name),), (), name, True))
        for other in others:
            falls(name, other, NOT_BUILT)
        out.append(Rule(name, (), (), name, True, (told,)))
        out.append(Rule(name + ALONE, (lists(name),), (), name, True))
        out.append(Rule(name + ALONE, (), (), name, True, (told, NOT_WANTED)))
    return out


RULES = made_rules()
#: Steps of the longest chain: three cards' encoders, a device of any vendor, and the one that confirms it.
STEPS = 6

# The settings that goals rewrite, and their defaults.
DEFAULTS: dict[str, str | int | bool] = {
    "nvenc_preset": "p6", "nvenc_cq": 20, "nvenc_multipass": "qres", "nvenc_rc_lookahead": 32, "nvenc_spatial_aq": True,
    "nvenc_temporal_aq": True, "nvenc_bframes": 3, "qsv_preset": "medium", "qsv_global_quality": 22, "qsv_extbrc": True,
    "qsv_look_ahead_depth": 40, "qsv_bf": 3, "qsv_low_power": False, "amf_quality": "quality", "amf_rc": "cqp",
    "amf_qp_i": 19, "amf_qp_p": 21, "amf_qp_b": 23, "amf_preanalysis": True, "amf_vbaq": False, "amf_preencode": False,
    "d3d12_qp": 21, "d3d12_quality": -1, "vulkan_qp": 21, "vulkan_quality": -1, "vulkan_async_depth": 2, "x_crf": 18,
    "x_preset": "slow",
}
# By goal and kind, what becomes of a setting.  "=" puts a value, "<" takes it at most, ">" at least, "+"
# adds; steps are taken in order.
GOALS: dict[tuple[str, str], tuple[dict[str, tuple[tuple[str, str | int | bool], ...]], str]] = {
    ("quality", "nvenc"): (
        {"nvenc_preset": (("=", "p6"),), "nvenc_cq": (("<", 19),), "nvenc_multipass": (("=", "qres"),), "nvenc_spatial_aq": (("=", True),), "nvenc_temporal_aq": (("=", False),), "nvenc_rc_lookahead": ((">", 24),)},
        "Goal=quality: NVENC bumped to p6, CQ ≤ 19, qres multipass.",
    ),
    ("quality", "qsv"): (
        {"qsv_preset": (("=", "veryslow"),), "qsv_global_quality": (("<", 22), (">", 1)), "qsv_extbrc": (("=", True),), "qsv_look_ahead_depth": ((">", 40),), "qsv_low_power": (("=", False),)},
        "Goal=quality: QSV preset veryslow, global_quality tightened.",
    ),
    ("quality", "amf"): (
        {"amf_quality": (("=", "quality"),), "amf_qp_i": (("<", 20), (">", 0)), "amf_qp_p": (("<", 22), (">", 0)), "amf_qp_b": (("<", 24), (">", 0)), "amf_preanalysis": (("=", True),), "amf_vbaq": (("=", False),)},
        "Goal=quality: AMF quality=quality, QP tightened.",
    ),
    ("quality", "d3d12"): ({"d3d12_qp": (("<", 20), (">", 0)), "d3d12_quality": ((">", 0),)}, "Goal=quality: D3D12 QP tightened."),
    ("quality", "vulkan"): (
        {"vulkan_qp": (("<", 20), (">", 0)), "vulkan_quality": ((">", 0),), "vulkan_async_depth": ((">", 2),)},
        "Goal=quality: Vulkan QP tightened.",
    ),
    ("quality", "software"): (
        {"x_preset": (("=", "slow"),), "x_crf": (("<", 21),)},
        "Goal=quality: software encoder set to slow preset, CRF ≤ 21.",
    ),
    ("speed", "nvenc"): (
        {"nvenc_preset": (("=", "p4"),), "nvenc_multipass": (("=", "qres"),), "nvenc_temporal_aq": (("=", False),)},
        "Goal=speed: NVENC set to p4, qres multipass, temporal_aq off.",
    ),
    ("speed", "qsv"): (
        {"qsv_preset": (("=", "veryfast"),), "qsv_global_quality": (("+", 4), ("<", 51)), "qsv_look_ahead_depth": (("<", 12),), "qsv_low_power": (("=", True),)},
        "Goal=speed: QSV preset veryfast, global_quality relaxed.",
    ),
    ("speed", "amf"): (
        {"amf_quality": (("=", "speed"),), "amf_preanalysis": (("=", False),), "amf_vbaq": (("=", False),)},
        "Goal=speed: AMF quality=speed.",
    ),
    ("speed", "d3d12"): ({"d3d12_qp": ((">", 0), ("+", 4), ("<", 51))}, "Goal=speed: D3D12 QP relaxed."),
    ("speed", "vulkan"): (
        {"vulkan_qp": ((">", 0), ("+", 4), ("<", 255)), "vulkan_async_depth": ((">", 4), ("<", 64))},
        "Goal=speed: Vulkan QP relaxed and async depth increased.",
    ),
    ("speed", "software"): ({"x_preset": (("=", "medium"),)}, "Goal=speed: software preset relaxed to medium."),
    ("archival", "nvenc"): (
        {"nvenc_preset": (("=", "p7"),), "nvenc_cq": (("<", 18),), "nvenc_multipass": (("=", "fullres"),), "nvenc_bframes": ((">", 4),)},
        "Goal=archival: NVENC at p7/CQ18, 4 B-frames.",
    ),
    ("archival", "qsv"): (
        {"qsv_preset": (("=", "veryslow"),), "qsv_global_quality": (("<", 20), (">", 1)), "qsv_extbrc": (("=", True),), "qsv_look_ahead_depth": ((">", 50),), "qsv_bf": ((">", 4),), "qsv_low_power": (("=", False),)},
        "Goal=archival: QSV veryslow / tight global_quality.",
    ),
    ("archival", "amf"): (
        {"amf_quality": (("=", "high_quality"),), "amf_qp_i": (("<", 18), (">", 0)), "amf_qp_p": (("<", 18), (">", 0)), "amf_qp_b": (("<", 19), (">", 0)), "amf_preanalysis": (("=", True),), "amf_vbaq": (("=", False),)},
        "Goal=archival: AMF high_quality / lower QP.",
    ),
    ("archival", "d3d12"): ({"d3d12_qp": (("<", 18), (">", 0)), "d3d12_quality": ((">", 0),)}, "Goal=archival: D3D12 QP lowered."),
    ("archival", "vulkan"): (
        {"vulkan_qp": (("<", 18), (">", 0)), "vulkan_quality": ((">", 0),), "vulkan_async_depth": ((">", 4), ("<", 64))},
        "Goal=archival: Vulkan QP lowered.",
    ),
    ("archival", "software"): (
        {"x_preset": (("=", "slower"),), "x_crf": (("<", 16),)},
        "Goal=archival: software encoder set to slower / CRF ≤ 16.",
    ),
}
COMPATIBLE = "Goal=compat: forcing {target} for streaming/device compatibility."
#: The encoder that goal ``compat`` puts in the place of a newer codec's.
COMPAT = {name: f"h264_{kind}" for kind, names in ENCODERS.items() for name in names if not name.startswith("h264")} | {"libx265": "libx264"}
# Rate controls of a fixed quantizer; source codecs that an H.264 output makes larger.
FIXED_QP, HEVC = ("cqp", "constqp", "qp"), ("hevc", "h265")


#: The bit of each fact.
BITS = {fact: k for k, fact in enumerate(sorted({f for r in RULES for f in (*r.needs, *r.bars)}))}


def mask_of(facts: tuple[str, ...]) -> int:
    return sum(1 << BITS[f] for f in facts)


def rules_of_encoders() -> Column:
    """The rules of each encoder, in order, as one constant map."""
    of: dict[str, list[dict]] = {}
    for r in RULES:
        of.setdefault(r.encoder, []).append(
            {"need": mask_of(r.needs), "bar": mask_of(r.bars), "encoder": r.target, "done": r.done, "warnings": r.warnings, "rationale": r.rationale}
        )
    kind = "struct<need:bigint,bar:bigint,encoder:string,done:boolean,warnings:array<string>,rationale:array<string>>"
    return F.from_json(F.lit(json.dumps(of)), f"map<string,array<{kind}>>")


def host_facts(hosts: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(host, arch, vram, facts) of ``hosts`` (host, has_nvidia, arch, vram); ``facts`` is the number of their bits.

    ``capabilities``: (host, encoder, listed, capable), a row an encoder that the host knows of; facts that no rule
    asks for do not count.
    """
    spark = hosts.sparkSession
    bits = F.broadcast(spark.createDataFrame([(f, 1 << k) for f, k in BITS.items()], "fact string, bit long"))
    told = F.array_compact(
        F.array(
            F.when(F.col("listed"), F.concat(F.lit("lists "), "encoder")),
            F.when(F.col("capable"), F.concat(F.lit("runs "), "encoder")),
        )
    )
    known = capabilities.select("host", F.explode(told).alias("fact")).join(bits, "fact").groupBy("host").agg(F.bit_or("bit").alias("bits"))
    card = F.when(F.coalesce("has_nvidia", F.lit(False)), F.lit(1 << BITS[CARD])).otherwise(F.lit(0))
    return hosts.join(known, "host", "left").select("host", "arch", "vram", F.coalesce("bits", F.lit(0)).bitwiseOR(card).cast("long").alias("facts"))


def available(wanted: Column, prefer: Column, facts: Column, rules: Column) -> Column:
    """(encoder, done, warnings, rationale) at the end of the chain of rules from ``wanted``."""
    none = F.array().cast("array<string>")
    start = F.struct(wanted.alias("encoder"), F.lit(False).alias("done"), none.alias("warnings"), none.alias("rationale"))

    def step(state: Column, _: Column) -> Column:
        name = F.when(~prefer & state["encoder"].isin(*IN_PLACE_OF), F.concat(state["encoder"], F.lit(ALONE))).otherwise(state["encoder"])
        holds = lambda r: (facts.bitwiseAND(r["need"]) == r["need"]) & (facts.bitwiseAND(r["bar"]) == 0)
        first = F.filter(F.when(~state["done"], F.try_element_at(rules, name)), holds)
        return F.when(state["done"] | first.isNull(), state).otherwise(
            F.struct(
                F.get(first, F.lit(0))["encoder"].alias("encoder"),
                F.get(first, F.lit(0))["done"].alias("done"),
                F.concat(state["warnings"], F.get(first, F.lit(0))["warnings"]).alias("warnings"),
                F.concat(state["rationale"], F.get(first, F.lit(0))["rationale"]).alias("rationale"),
            )
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)


def kind_of(encoder: Column) -> Column:
    """Kind of device, or software."""
    last = F.element_at(F.split(encoder, "_"), -1)
    return F.when(encoder.contains("_") & last.isin(*ENCODERS), last).otherwise("software")


def rewritten(field: str, goal: str = "__goal", kind: str = "__kind") -> str:
    """A setting after the goal, as an SQL expression over the columns of the goal and the kind."""
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower()
    how = {"=": "{b}", "<": "least({v}, {b})", ">": "greatest({v}, {b})", "+": "({v} + {b})"}
    cases = []
    for (of_goal, of_kind), (fields, _) in GOALS.items():
        if field in fields:
            value = field
            for op, by in fields[field]:
                value = how[op].format(v=value, b=text(by))
            cases.append(f"WHEN {goal} = '{of_goal}' AND {kind} = '{of_kind}' THEN {value}")
    return f"CASE {' '.join(cases)} ELSE {field} END" if cases else field


def recommended(jobs: DataFrame, hosts: DataFrame, capabilities: DataFrame) -> DataFrame:
    """The encoder, settings, warnings and rationale of each job.

    ``jobs``: (job, host, preset, encoder, preset_goal, goal, prefer_hardware, source_codec, source_pix_fmt) and any of
    the settings of ``DEFAULTS``, which else have their defaults.  A null goal is ``auto``, which leaves it to the preset's;
    a null preference is true.  An encoder that no rule knows stays.  A job whose host is unknown counts as on a host
    without any encoder or card.
    """
    missing = {f: F.lit(v) for f, v in DEFAULTS.items() if f not in jobs.columns}
    every = hosts.join(jobs.select("host").distinct(), "host", "right")
    known = host_facts(every, capabilities)
    prefer = F.coalesce("prefer_hardware", F.lit(True))
    goal = F.coalesce(F.nullif("goal", F.lit("auto")), "preset_goal", F.lit("auto"))
    rules = rules_of_encoders()
    found = (
        jobs.withColumns(missing)
        .join(known, "host")
        .withColumn("__goal", goal)
        .withColumn("__first", available(F.col("encoder"), prefer, F.col("facts"), rules))
    )
    name = F.col("__first.encoder")
    compat = F.try_element_at(F.create_map(*(F.lit(x) for pair in COMPAT.items() for x in pair)), name)
    found = found.withColumns({"__kind": kind_of(name), "__compat": compat})
    again = F.when(F.col("__goal") == "compat", available(F.coalesce("__compat", name), prefer, F.col("facts"), rules))
    found = found.withColumn("__again", again)
    final = F.coalesce(F.col("__again.encoder"), name)
    settings = {f: F.expr(rewritten(f)) for f in DEFAULTS}
    fixed = final.endswith("_amf") & F.lower(settings["amf_rc"]).isin(*FIXED_QP)
    no_vbaq, no_preencode = fixed & settings["amf_vbaq"], fixed & settings["amf_preencode"]
    settings["amf_vbaq"] = settings["amf_vbaq"] & ~no_vbaq
    settings["amf_preencode"] = settings["amf_preencode"] & ~no_preencode

    texts = F.coalesce(*(F.when((F.col("__goal") == g) & (F.col("__kind") == k), F.lit(t)) for (g, k), (_, t) in GOALS.items()))
    forced = F.when((F.col("__goal") == "compat") & F.col("__compat").isNotNull(), F.replace(F.lit(COMPATIBLE), F.lit("{target}"), F.col("__compat")))
    h264 = final.startswith("h264_")
    told = lambda texts: F.transform(
        texts,
        lambda t: F.replace(
            F.replace(t, F.lit("{arch}"), F.coalesce("arch", F.lit("None"))), F.lit("{vram}"), F.coalesce("vram", F.lit(0)).cast("string")
        ),
    )
    warnings = F.concat(
        told(F.col("__first.warnings")),
        told(F.coalesce(F.col("__again.warnings"), F.array().cast("array<string>"))),
        F.array_compact(
            F.array(
                F.when(F.coalesce(F.col("source_pix_fmt").contains("10"), F.lit(False)) & h264, TEN_BIT),
                F.when(F.coalesce(F.lower("source_codec").isin(*HEVC), F.lit(False)) & (h264 | (final == "libx264")), LARGER),
            )
        ),
    )
    rationale = F.concat(
        F.array(F.concat(F.lit("Preset '"), "preset", F.lit("' requests encoder: "), "encoder")),
        told(F.col("__first.rationale")),
        F.array_compact(F.array(F.coalesce(texts, forced), F.when(no_vbaq, NO_VBAQ), F.when(no_preencode, NO_PREENCODE))),
        F.array(F.concat(F.lit("Final encoder: "), final)),
    )
    return found.select(
        "job",
        final.alias("encoder"),
        F.struct(*(c.alias(field) for field, c in settings.items())).alias("settings"),
        warnings.alias("warnings"),
        rationale.alias("rationale"),
    )
