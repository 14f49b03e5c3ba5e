"""Vectors of the planning part: encoder choice, chunk lengths."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelake.plans import batching, recommend

RUNS = ("h264_nvenc", "hevc_nvenc")


def host(has_nvidia=True, arch="ampere", listed=("h264_nvenc", "hevc_nvenc", "libx264", "libx265"), runs=RUNS):
    return {"has_nvidia": has_nvidia, "arch": arch, "listed": listed, "runs": runs if has_nvidia else tuple(r for r in runs if "nvenc" not in r)}


BARE = {"has_nvidia": False, "arch": None}
#: (encoder, host, other fields of the job, expected encoder, expected settings, a part of a warning, no warnings)
VECTORS = [
    ("hevc_nvenc", host(), {}, "hevc_nvenc", {}, None),
    ("av1_nvenc", host(), {}, "hevc_nvenc", {}, "av1_nvenc"),
    ("hevc_nvenc", host(**BARE), {}, "libx265", {}, "NVIDIA"),
    ("h264_nvenc", host(), {"source_pix_fmt": "yuv420p10le"}, "h264_nvenc", {}, "10-bit"),
    ("h264_nvenc", host(), {"source_codec": "hevc"}, "h264_nvenc", {}, "HEVC"),
    ("hevc_nvenc", host(), {"goal": "quality"}, "hevc_nvenc", {"nvenc_preset": "p6", "nvenc_cq": 19, "nvenc_rc_lookahead": 32}, None),
    ("hevc_nvenc", host(), {"goal": "speed"}, "hevc_nvenc", {"nvenc_preset": "p4", "nvenc_temporal_aq": False}, None),
    ("hevc_nvenc", host(), {"goal": "compat"}, "h264_nvenc", {}, None),
    ("libx265", host(listed=("h264_nvenc", "hevc_nvenc", "libx264")), {}, "hevc_nvenc", {}, "not present"),
    ("libx265", host(listed=("h264_nvenc", "hevc_nvenc", "libx264")), {"prefer_hardware": False}, "libx265", {}, "disabled by settings"),
    ("hevc_qsv", host(**BARE, listed=("hevc_qsv", "libx264"), runs=("hevc_qsv",)), {"goal": "quality"}, "hevc_qsv", {"qsv_extbrc": True, "qsv_look_ahead_depth": 40, "qsv_low_power": False}, None),
    ("hevc_amf", host(**BARE, listed=("hevc_amf",), runs=("hevc_amf",)), {"goal": "quality", "amf_rc": "cqp", "amf_vbaq": True}, "hevc_amf", {"amf_vbaq": False}, None),
    ("hevc_amf", host(**BARE, listed=("hevc_amf",), runs=("hevc_amf",)), {"amf_rc": "cqp", "amf_vbaq": True}, "hevc_amf", {"amf_vbaq": False}, None),
    ("hevc_amf", host(**BARE, listed=("hevc_amf",), runs=("hevc_amf",)), {"amf_rc": "cbr", "amf_vbaq": True}, "hevc_amf", {"amf_vbaq": True}, None),
    ("hevc_amf", host(**BARE, listed=("hevc_amf",), runs=("hevc_amf",)), {"goal": "speed"}, "hevc_amf", {"amf_quality": "speed", "amf_preanalysis": False, "amf_vbaq": False}, None),
    ("hevc_nvenc", host(), {"goal": "auto", "preset_goal": "speed"}, "hevc_nvenc", {"nvenc_preset": "p4"}, None),
    ("hevc_qsv", host(**BARE, listed=("hevc_qsv", "libx265"), runs=()), {}, "libx265", {}, "Intel"),
    ("h264_nvenc", host(**BARE, listed=("h264_d3d12", "libx264"), runs=("h264_d3d12",)), {}, "h264_d3d12", {}, "Falling back to h264_d3d12."),
    ("av1_d3d12", host(**BARE, listed=("av1_vulkan", "h264_vulkan"), runs=("av1_vulkan", "h264_vulkan")), {}, "av1_vulkan", {}, "D3D12"),
    ("hevc_qsv", host(**BARE, listed=("hevc_qsv", "h264_qsv"), runs=("hevc_qsv", "h264_qsv")), {"goal": "compat"}, "h264_qsv", {}, None),
    ("ffv1", host(), {}, "ffv1", {}, None),
]
JOB = "job long, host long, preset string, encoder string, preset_goal string, goal string, prefer_hardware boolean, source_codec string, source_pix_fmt string, amf_rc string, amf_vbaq boolean"


def test_recommendations(spark):
    jobs, hosts, can = [], [], []
    for k, (encoder, h, extra, *_) in enumerate(VECTORS):
        row = {"amf_rc": "cqp", "amf_vbaq": False} | extra
        jobs.append((k, k, "t", encoder, row.get("preset_goal"), row.get("goal"), row.get("prefer_hardware"), row.get("source_codec"), row.get("source_pix_fmt"), row["amf_rc"], row["amf_vbaq"]))
        hosts.append((k, h["has_nvidia"], h["arch"], 10240))
        can += [(k, e, e in h["listed"], e in h["runs"]) for e in {*h["listed"], *h["runs"]}]
    jobs.append((99, 99, "t", "hevc_nvenc", None, None, None, None, None, "cqp", False))  # a host that nothing is known of
    got = recommend.recommended(
        spark.createDataFrame(jobs, JOB),
        spark.createDataFrame(hosts, "host long, has_nvidia boolean, arch string, vram int"),
        spark.createDataFrame(can, "host long, encoder string, listed boolean, capable boolean"),
    )
    rows = {r["job"]: r for r in got.collect()}
    assert len(rows) == len(jobs) and rows[99]["encoder"] == "libx265"
    for k, (_, _, _, encoder, settings, warning) in enumerate(VECTORS):
        r = rows[k]
        assert r["encoder"] == encoder, k
        assert {f: r["settings"][f] for f in settings} == settings, k
        assert (not r["warnings"]) if warning is None else any(warning in w for w in r["warnings"]), k
        assert r["rationale"][-1] == f"Final encoder: {encoder}"
    assert "hevc_nvenc confirmed available (arch=ampere, vram=10240 MiB)." in rows[0]["rationale"]


def test_chains_end_within_the_steps():
    of = {}
    for r in recommend.RULES:
        of.setdefault(r.encoder, []).append(r)
    rng = random.Random(3)
    for _ in range(4000):
        facts = {f for f in recommend.BITS if rng.random() < 0.4}
        for name in of:
            for step in range(recommend.STEPS):
                rule = next(r for r in of[name] if facts.issuperset(r.needs) and not facts.intersection(r.bars))
                name = rule.target
                if rule.done:
                    break
            assert rule.done


SOURCE = "source_id long, duration double, fps double, out_fps double, frames long, width int, height int, target_w int, target_h int, scale int, multiplier int, free_bytes long, has_scratch boolean, mode string, enabled boolean, chunk_seconds int, policy string"


def source(k, **over):
    row = {"source_id": k, "duration": 300.0, "fps": 24.0, "out_fps": 24.0, "frames": 7200, "width": 320, "height": 240, "target_w": None, "target_h": None, "scale": None, "multiplier": 1, "free_bytes": 80 * batching.MIB, "has_scratch": True, "mode": "auto", "enabled": True, "chunk_seconds": 600, "policy": "exact"}
    return tuple((row | over).values())


def test_auto_chunks(spark):
    full = 1440 * 320 * 240 * 4
    sources = [
        source(0, duration=60.0, frames=1440, chunk_seconds=30, free_bytes=full + 100 * batching.MIB),
        source(1),
        source(2, out_fps=None, fps=None),
        source(3, width=1920, height=1080, free_bytes=50 * batching.MIB, has_scratch=False),
        source(4, mode="manual", enabled=False),
        source(5, mode="manual", chunk_seconds=600, duration=1420.0),
        source(6, duration=None),
        source(7, width=0, height=None),
        source(8, width=None, enabled=False),
        source(9, width=1920, height=1080, free_bytes=batching.MIB),
        source(10, width=960, height=540, scale=2, multiplier=2),
        source(11, width=960, height=540, scale=2, target_w=1920, target_h=1080),
        source(12, frames=None, fps=24000 / 1001, duration=60.0),
    ]
    frame = spark.createDataFrame(sources, SOURCE)
    none = spark.createDataFrame([], "source_id long, pts double")
    got = {r["source_id"]: r for r in batching.auto_chunks(frame, none).collect()}
    assert (got[0]["chunk"], got[0]["reason"], got[0]["total"]) == (None, "estimate_fits_free_space", full)
    limit = 80 * batching.MIB // (320 * 240 * 4)
    assert got[1]["chunk"] == limit // 24 == got[2]["chunk"]
    assert got[3]["error"] == "scratch_unset" and got[9]["error"] == "scratch_too_small"
    assert got[4]["reason"] == "manual_disabled" and got[6]["reason"] == "duration_unknown"
    assert got[5]["chunk"] == 600 and got[5]["reason"] is None
    assert (got[7]["chunk"], got[7]["reason"]) == (600, "fallback_manual_estimate_unknown")
    assert got[8]["reason"] == "estimate_unknown_manual_disabled"
    assert got[10]["each"] == got[11]["each"] == 1920 * 1080 * 4
    assert (got[10]["total"], got[11]["total"]) == (2 * 7200 * 1920 * 1080 * 4, 7200 * 1920 * 1080 * 4)
    assert got[12]["total"] == int(24000 / 1001 * 60) * 320 * 240 * 4
    cut = [r for r in batching.auto_batches(frame, none).collect() if r["source_id"] == 5]
    assert [(r["start_pts"], r["end_pts"]) for r in sorted(cut)] == [(0, 600), (600, 1200), (1200, 1420)]


def plain(duration, chunk, keys, fps):
    """Batches as (start, end, frames), by a scan of all key frames for each bound."""
    bounds, target, last = [], float(chunk), 0.0
    while target < duration:
        best = max((k for k in keys if k <= target), default=None)
        last = target if best is None or best <= last else best
        bounds.append(last)
        target = last + chunk
    edges = sorted({0.0, *(round(b, 6) for b in bounds), round(duration, 6)})
    if edges[-1] < duration:
        edges.append(duration)
    return [(a, b, round((b - a) * fps)) for a, b in zip(edges, edges[1:])]


def test_known_layouts(spark):
    keys = {1: [0, 12, 24, 28, 36, 60, 84, 100], 2: [], 3: [0]}
    duration = {1: 120.0, 2: 90.0, 3: 90.0}
    ask = spark.createDataFrame([(k, duration[k], 24.0, 30, 30) for k in keys], "source_id long, duration double, fps double, chunk_lo int, chunk_hi int")
    frames = spark.createDataFrame([(k, float(x)) for k, v in keys.items() for x in v], "source_id long, pts double")
    got = {}
    for r in sorted(batching.walked(ask, frames, False).collect()):
        got.setdefault(r["source_id"], []).append((r["start_pts"], r["end_pts"]))
    assert got[1] == [(0, 28), (28, 36), (36, 60), (60, 84), (84, 100), (100, 120)]
    assert got[2] == got[3] == [(0, 30), (30, 60), (60, 90)]


@pytest.mark.parametrize("seed", range(3))
def test_all_lengths_against_a_scan(spark, seed):
    rng = random.Random(seed)
    sources, keys = [], []
    for k in range(12):
        duration = rng.choice([0.3, 4.0, 61.25, 733.123457, 900.0000004])
        sources.append((k, duration, rng.choice([24.0, 23.976]), 5, rng.choice([5, 60, 600])))
        at = 0.0
        while at < duration + 3 and k % 4:
            keys.append((k, at))
            at = round(at + rng.choice([0.5, 2.0, 10.01, 45.5, 130.25]), 6)
    ask = spark.createDataFrame(sources, "source_id long, duration double, fps double, chunk_lo int, chunk_hi int")
    frames = spark.createDataFrame(keys, "source_id long, pts double")
    got = {(r["source_id"], r["chunk"]): (r["batches"], r["frames"]) for r in batching.walked(ask, frames, True).collect()}
    assert len(got) == sum(high - low + 1 for *_, low, high in sources)
    for k, duration, fps, low, high in sources:
        own = [x for i, x in keys if i == k and x <= duration + 0.001]
        for chunk in range(low, high + 1, 7):
            want = plain(duration, chunk, own, fps)
            assert got[k, chunk] == (len(want), max(n for *_, n in want)), (k, chunk)


PLAN = "plan long, pipeline_order string, num int, den int, pix_fmt string, transfer string, width int, height int, upscale_enabled boolean, engine string, hdr_policy string, interpolate_enabled boolean, interpolator string, target_fps double, multiplier int, post_enabled boolean, deband boolean, deblock boolean, grain int, target_mode string, target_w int, target_h int, target_named string, batches int, manual boolean, dedupe_enabled boolean"
QUIET = {"pipeline_order": "interpolate_first", "num": 24, "den": 1, "pix_fmt": "yuv420p", "transfer": None, "width": 1280, "height": 720, "upscale_enabled": False, "engine": "realesrgan-ncnn-vulkan", "hdr_policy": "skip", "interpolate_enabled": False, "interpolator": "rife-ncnn-vulkan", "target_fps": None, "multiplier": None, "post_enabled": False, "deband": False, "deblock": False, "grain": 0, "target_mode": "scale_only", "target_w": None, "target_h": None, "target_named": None, "batches": 0, "manual": False, "dedupe_enabled": False}
HDR10 = {"pix_fmt": "yuv420p10le", "transfer": "smpte2084", "upscale_enabled": True}
PLANS = [
    {},
    {"manual": True},
    {"upscale_enabled": True},
    {"post_enabled": True, "deband": True},
    {"post_enabled": True},
    HDR10,
    HDR10 | {"hdr_policy": "allow_8bit_roundtrip"},
    HDR10 | {"transfer": None},
    {"num": 24000, "den": 1001, "interpolate_enabled": True, "multiplier": 2},
    {"interpolate_enabled": True, "multiplier": 1},
    {"interpolate_enabled": True, "target_fps": 60.0},
    {"upscale_enabled": True, "interpolate_enabled": True, "multiplier": 2, "post_enabled": True, "grain": 1},
    {"upscale_enabled": True, "interpolate_enabled": True, "multiplier": 2, "pipeline_order": "upscale_first", "dedupe_enabled": True},
    {"num": None, "interpolate_enabled": True, "multiplier": 2},
    {"batches": 4, "target_mode": "named", "target_named": "1080p"},
]


def test_path_plans(spark):
    from cinelake.plans import paths

    frame = spark.createDataFrame([(k, *(QUIET | p).values()) for k, p in enumerate(PLANS)], PLAN)
    planned = paths.planned(frame)
    got = {r["plan"]: r for r in planned.collect()}
    assert [got[k]["encode_input_mode"] for k in range(len(PLANS))] == ["source", "frames", "frames", "frames", "source", "source", "frames", "source", "frames", "source", "frames", "frames", "frames", "frames", "frames"]
    assert [got[k]["upscale"] for k in (2, 5, 6, 7)] == [True, False, True, False]
    assert got[5]["warnings"] == [paths.SKIPPED] == got[7]["warnings"] and got[6]["warnings"] == [paths.ROUNDTRIP]
    assert (got[6]["target_pix_fmt"], got[6]["target_transfer"], got[6]["roundtripped"]) == ("yuv420p", "bt709", True)
    assert (got[5]["target_transfer"], got[5]["hdr_policy"], got[0]["hdr_policy"]) == ("smpte2084", "skip", "n/a")
    assert (got[8]["output_fps"], got[8]["multiplier"], got[0]["output_fps"]) == ("48000/1001", 2, "24/1")
    assert not got[9]["interpolate"] and got[9]["output_fps"] == "24/1"
    assert got[10]["multiplier"] == 2 and "rounded to 2× → 48.000fps (drift 20.00%)" in got[10]["warnings"][0]
    assert got[12]["dedupe"] and not got[11]["dedupe"]
    assert got[13]["output_fps"] == "" and got[13]["interpolate"] and got[13]["warnings"] == [paths.UNKNOWN_RATE]
    assert (got[14]["decode_w"], got[14]["decode_h"]) == (1920, 1080)
    reads = {(r["plan"], r["stage"]): (r["active"], r["reads"]) for r in paths.stages(planned).collect()}
    assert reads[0, "decode"] == (False, "source") and reads[0, "encode"] == (True, "source")
    assert [reads[11, s][1] for s in ("interpolate", "upscale", "postprocess", "encode")] == ["decode", "interpolate", "upscale", "postprocess"]
    assert [reads[12, s] for s in ("upscale", "interpolate", "encode")] == [(True, "decode"), (True, "upscale"), (True, "interpolate")]
    assert reads[2, "interpolate"] == (False, "decode") and reads[2, "encode"] == (True, "upscale") and reads[3, "encode"] == (True, "postprocess")


def test_relaxed_attempts(spark):
    from cinelake.plans import paths

    jobs = [
        (0, "hevc_nvenc", "fullres", True, True, "middle", 3, "auto", True),
        (1, "h264_nvenc", "disabled", True, True, "middle", 3, "auto", True),
        (2, "hevc_nvenc", "disabled", False, True, "middle", 3, "auto", False),
        (3, "hevc_amf", None, None, None, None, None, "auto", True),
        (4, "h264_amf", None, None, None, None, None, "10", True),
        (5, "libx265", "fullres", True, True, None, 0, "auto", True),
    ]
    frame = spark.createDataFrame(jobs, "job long, encoder string, multipass string, temporal_aq boolean, spatial_aq boolean, b_ref_mode string, bframes int, bit_depth string, ten_bit boolean")
    got = {}
    for r in sorted(paths.relaxed(frame).collect(), key=lambda r: (r["job"], r["attempt"])):
        got.setdefault(r["job"], []).append((r["multipass"], r["temporal_aq"], r["bit_depth"], r["pix_fmt"]))
    assert got[0] == [("fullres", True, "auto", None), ("qres", True, "auto", None), ("disabled", True, "auto", None), ("disabled", False, "auto", None), ("disabled", False, "auto", "yuv420p")]
    assert got[1] == [("disabled", True, "auto", None), ("disabled", False, "auto", None)]
    assert len(got[2]) == len(got[4]) == len(got[5]) == 1
    assert [x[2] for x in got[3]] == ["auto", "8"]


def test_canonical_keys(spark):
    import hashlib
    import json

    from pyspark.sql import functions as F

    from cinelake.functions import canonical

    texts = ['{"b": 1, "a": {"d": [3, {"z": null, "y": "é"}], "c": 1.0}}', "[]", "null", "{", None, '"\\ud83d\\ude42"', "1e3"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r for r in frame.select("t", canonical.canonical_json("t").alias("c"), canonical.hash_json("t").alias("k"), canonical.hash_text("t").alias("h")).collect()}
    assert got[texts[0]]["c"] == '{"a":{"c":1.0,"d":[3,{"y":"\\u00e9","z":null}]},"b":1}'
    for t in texts:
        fine = t not in ("{", None)
        want = json.dumps(json.loads(t), sort_keys=True, separators=(",", ":")) if fine else None
        assert got[t]["c"] == want
        assert got[t]["k"] == (hashlib.blake2b(want.encode(), digest_size=16).hexdigest() if fine else None)
        assert got[t]["h"] == (None if t is None else hashlib.blake2b(t.encode(), digest_size=16).hexdigest())
    payload = {"source": "s\"1", "stage": "04", "tools": {"a": "1", "b": "2"}, "params": {"x": [1, {"k": False}]}}
    want = hashlib.blake2b(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode(), digest_size=16).hexdigest()
    key = canonical.cache_key(F.lit('s"1'), F.lit("04"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")), F.lit('{"x": [1, {"k": false}]}'))
    assert spark.range(1).select(key.alias("k")).first()["k"] == want


def test_walks_meet_their_key_frames_however_the_sides_are_dealt(spark):
    """Both sides stand by source already, and run in different numbers of merged partitions."""
    least = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 32)
    spark.conf.set(least, "32k")
    try:
        ids = spark.range(300 * 800)
        source, k = F.col("id") % 300, F.floor(F.col("id") / 300)
        of = W.partitionBy("source_id").orderBy("k")
        frames = ids.select(source.alias("source_id"), k.alias("k")).select("source_id", (F.row_number().over(of) * 10.0).alias("pts"))
        ask = ids.groupBy(source.alias("source_id")).agg((F.count("*") * 0 + 8000.0).alias("duration"))
        ask = ask.select("source_id", "duration", F.lit(24.0).alias("fps"), F.lit(15).alias("chunk_lo"), F.lit(15).alias("chunk_hi"))
        ends = batching.walked(ask, frames, False).groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("end_pts") % 10 > 0).alias("off"))
        assert ends.where("n <> 800 or off > 0").count() == 0 and ends.count() == 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset(least)


def test_halves_are_rounded_as_in_sql():
    """Halves of the sixth decimal move away from zero, at bounds and at the end, so no empty last batch is left."""
    assert batching.rounded(np.array([0.0000005, 0.0000025, 295.3585925, 1.25, -0.0000005])).tolist() == [0.000001, 0.000003, 295.358593, 1.25, -0.000001]
    walk = batching.Walk(np.array([5]), 295.3585925, 24.0, True)
    walk.end()
    assert len(walk.kept) == 60 and walk.kept[-1] == (295.0, 295.358593)
