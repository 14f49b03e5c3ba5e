"""Reports of other programs, notes on models, filter chains, keys of hosts."""

import hashlib
import json
import os

import pandas as pd
from pyspark.sql import functions as F

from cinelake.functions import canonical
from cinelake.plans import models, paths
from cinelake.sources import reports


def test_containers(spark):
    full = {
        "file_name": "a.mkv", "container": {"type": "Matroska", "properties": {"duration": 123, "title": "T"}},
        "tracks": [{"id": 0, "type": "video", "codec": "HEVC", "properties": {"codec_id": "V", "default_track": True, "uid": 18, "enabled_track": False, "more": [1]}}, {"id": 1}],
        "attachments": [{"id": 1, "file_name": "f.ttf", "size": 10, "properties": {"uid": 7}}, {"file_name": "é"}],
        "chapters": [{"num_entries": 3}, {"num_entries": "4"}, {}],
    }
    texts = [json.dumps(full), "no", "{}", "[1]", None, '{"container": null, "tracks": null}', '{"file_name": ""}']
    found = reports.containers(spark.createDataFrame(list(enumerate(texts)), "source_id int, value string"))
    got = {r["source_id"]: r for r in found.collect()}
    a = got[0]
    assert (a["file_name"], a["is_matroska"], a["title"], a["duration_ns"], a["chapter_entries"]) == ("a.mkv", True, "T", 123, 7)
    assert [(t["id"], t["type"], t["codec_id"], t["is_default"], t["enabled"], t["uid"]) for t in a["tracks"]] == [(0, "video", "V", True, False, 18), (1, "", "", False, True, None)]
    assert [(x["id"], x["filename"], x["size"], x["uid"]) for x in a["attachments"]] == [(1, "f.ttf", 10, 7), (-1, "é", 0, None)]
    assert [got[k]["readable"] for k in range(7)] == [True, False, True, False, False, True, True]
    assert (got[1]["tracks"], got[1]["chapter_entries"], got[1]["container"]) == ([], None, None)
    assert (got[2]["container"], got[2]["is_matroska"], got[2]["chapter_entries"], got[6]["file_name"]) == ("", False, 0, "6")
    assert reports.container_tracks(found).count() == 2 and reports.container_attachments(found).count() == 2


def test_cards_and_adapters(spark):
    lines = ["RTX 3080, 10240, 9000, 550.1, 8.6, 00:01, more", "bad, [N/A], 1, x, y, z", "a,1,2,d,,", "a,1,2,d,", "a,1.5,2,d,e,f", "", None]
    got = reports.cards(spark.createDataFrame(list(enumerate(lines)), "source_id int, value string")).orderBy("source_id").collect()
    assert [tuple(r) for r in got] == [(0, "RTX 3080", 10240, 9000, "550.1", "8.6", "00:01"), (2, "a", 1, 2, "d", None, None)]
    texts = [
        '[{"Name": " AMD Radeon ", "AdapterRAM": 8}, {"Name": "Intel UHD", "AdapterRAM": "12"}, 5, {"Name": "Microsoft Basic Display", "AdapterRAM": 99}, {"Name": ""}, {}]',
        '{"Name": "Intel", "AdapterRAM": null}', "x", '{"Name": "Quadro NVIDIA"}', '[{"Name": "Radeon", "AdapterRAM": "x"}, {"Name": "Intel"}]', "[]", None,
    ]
    found = reports.adapters(spark.createDataFrame(list(enumerate(texts)), "source_id int, value string"))
    assert sorted((r["source_id"], r["name"], r["ram_bytes"]) for r in found.where("source_id < 4").collect()) == [(0, "AMD Radeon", 8), (0, "Intel UHD", 12), (1, "Intel", None), (3, "Quadro NVIDIA", None)]
    assert {r["source_id"]: r["vendor"] for r in reports.preferred_vendors(found).collect()} == {0: "intel", 1: "intel", 3: "unknown", 4: "amd"}


def test_logs_by_job(spark, tmp_path):
    lines = [
        {"ts": "2024-01-02T03:04:05", "level": "INFO", "logger": "x", "msg": "a", "job_id": "1", "frame": 7, "deep": {"k": [1]}},
        {"ts": "no time", "level": "debug", "msg": "b", "job_id": "2"},
        {"level": "ERROR", "msg": "c", "job_id": "2", "exc": "E"},
        {"level": "odd", "msg": "d"},
    ]
    texts = [json.dumps(x) for x in lines] + ["plain line", "{broken", "[1]", ""]
    found = reports.log_records(spark.createDataFrame(list(enumerate(texts)), "k int, value string"))
    got = [r.asDict() for r in found.orderBy("k").collect()]
    assert str(got[0]["ts"]) == "2024-01-02 03:04:05" and got[0]["more"] == {"frame": "7", "deep": '{"k":[1]}'} and got[1]["ts"] is None
    assert [r["msg"] for r in got] == ["a", "b", "c", "d", "plain line", "{broken", "[1]", ""] and got[2]["exc"] == "E"
    assert [r["k"] for r in reports.at_least(found, "info").orderBy("k").collect()] == [0, 2, 3, 4, 5, 6, 7]
    os.mkdir(tmp_path / "in")
    (tmp_path / "in" / "one.jsonl").write_text("\n".join(texts))
    for _ in range(2):  # the second run goes on where the first ended
        stream = reports.log_records(spark.readStream.text(str(tmp_path / "in")))
        reports.job_logs(stream, str(tmp_path / "out"), str(tmp_path / "state"), "INFO").awaitTermination(60)
    back = spark.read.json(str(tmp_path / "out"))
    assert sorted((str(r["job_id"]), r["msg"]) for r in back.collect()) == [("1", "a"), ("2", "c")]


def test_model_notes(spark):
    c = F.col
    rows = [
        (models.CUGAN, "models-pro", 2, 3, []), (models.CUGAN, "models-pro", 4, 3, ["(scale=4, denoise=3)", "cascades 2x→2x"]), (models.CUGAN, "models-se", 4, 3, []), (models.CUGAN, "other", 3, 1, ["Real-CUGAN other does not"]),
        (models.ESRGAN, "realesr-animevideov3", 4, 0, []), (models.ESRGAN, "realesr-animevideov3", 8, 0, ["would extrapolate"]), (models.ESRGAN, "realesrgan-x4plus", 2, 0, ["wastes ~12 GPU", "will flicker"]), (models.ESRGAN, "it's", 2, 0, ['"it\'s" is not']),
        (models.WAIFU, "models-cunet", 1, -1, []), (models.WAIFU, "models-upconv_7_photo", 1, 7, ["scale=1 checkpoint (supported: [2])", "(supported: [-1, 0, 1, 2, 3])", "photo model"]), (models.WAIFU, "x", 9, 9, ["known models: ['models-cunet', "]),
        (models.ANIME, "acnet", 4, 9, []), (models.ANIME, "nope", 5, 0, ["(default: acnet-f8b8-hdn)", "within 1..4"]), (models.ANIME_VS, "acnet", 2, 9, ["stay in -1..3"]),
        ("none", "x", 9, 9, []), (None, None, None, None, []),
    ]
    frame = spark.createDataFrame([(k, *r[:4]) for k, r in enumerate(rows)], "k int, e string, m string, s int, d int")
    got = {r["k"]: r["n"] for r in frame.select("k", models.model_notes(c("e"), c("m"), c("s"), c("d")).alias("n")).collect()}
    for k, (engine, *_, want) in enumerate(rows):
        assert len(got[k]) == len(want) and all(w in n and n.startswith(models.PREFIXES[engine]) for n, w in zip(got[k], want)), (k, got[k])
    versions = spark.createDataFrame([("v4.22",), ("v4.16",), ("v4.16-lite",), ("v4.26-large",), ("rife",)], "v string")
    assert [len(r["n"]) for r in versions.select(models.interpolator_notes(c("v")).alias("n")).collect()] == [0, 1, 1, 0, 0]


def test_notes_in_plans(spark):
    from tests.test_plans import HDR10, PLAN, QUIET

    plans = [{"upscale_enabled": True}, HDR10, {"interpolate_enabled": True, "target_fps": 60.0}, {}]
    frame = spark.createDataFrame([(k, *(QUIET | p).values(), "realesrgan-x4plus", 4, 0, "v4.25-lite") for k, p in enumerate(plans)], PLAN + ", model string, scale int, denoise int, version string")
    got = {r["plan"]: r["warnings"] for r in paths.planned(frame).collect()}
    assert len(got[0]) == 1 and "stills model" in got[0][0]
    assert got[1] == [paths.SKIPPED] and got[3] == []  # no upscaling, no notes
    assert got[2][0].startswith("rife: RIFE v4.25-lite is a lite") and got[2][1].startswith("fps: target")


def test_filter_chain(spark):
    rows = [
        (False, True, True, 10, None, "disabled", 0), (True, False, False, 0, None, "all sub-filters off", 0), (True, False, False, -3, None, "all sub-filters off", 0),
        (True, True, True, 8, f"{models.DEBAND},{models.DEBLOCK},noise=c0s=8:c0f=t+u", "gradient banding", 0), (True, False, False, 99, "noise=c0s=32:c0f=t+u", "c0s=32 luma", 1),
        (True, True, None, None, models.DEBAND, "gradient banding", 0), (None, True, True, 40, None, "disabled", 0),
    ]
    c = F.col
    frame = spark.createDataFrame([(k, *r[:4]) for k, r in enumerate(rows)], "k int, e boolean, a boolean, b boolean, g int")
    got = {r["k"]: r["c"] for r in frame.select("k", models.filter_chain(c("e"), c("a"), c("b"), c("g")).alias("c")).collect()}
    for k, (*_, vf, reason, warnings) in enumerate(rows):
        assert got[k]["vf"] == vf and reason in got[k]["rationale"][0] and len(got[k]["warnings"]) == warnings, k


def test_keys_of_hosts(spark):
    names = "cores int, ram_mib long, arch string, vram_mib int, driver string, ffmpeg string, vendor string, flags map<string,boolean>, encoders array<string>"
    rows = [(8, 32000, "ada", 16000, "550", "7.1", "nvidia", {"qsv_hevc": True, "vulkan_av1": True, "odd": True}, ["libx265", "av1_nvenc"]), (4, None, None, 0, "", None, None, None, None)]
    text = canonical.host_text(F.col("flags"), F.col("encoders"))
    got = spark.createDataFrame(rows, names).select(text.alias("t"), canonical.host_key(text).alias("k")).collect()
    want = ["8|32000|ada|16000|550|7.1|nvidia|010|000|00|001|av1_nvenc,libx265|", "4|0|none|0|none|none|none|000|000|00|000||"]
    assert [r["t"] for r in got] == want
    assert [r["k"] for r in got] == [hashlib.blake2b(t.encode(), digest_size=12).hexdigest() for t in want]


def test_reports_are_parsed_once_for_tracks(spark):
    """No filter that Spark infers may parse the reports a second time, in a join's condition say."""
    made = spark.range(20).withColumn("kind", F.lit("audio")).join(spark.range(5).withColumnRenamed("id", "k").hint("merge"), F.col("id") == F.col("k"))
    text = F.to_json(F.struct(F.array(F.struct(F.col("id"), F.col("kind").alias("type"))).alias("tracks"), F.array(F.struct(F.col("k").alias("size"))).alias("attachments")))
    found = reports.containers(made.select(F.col("id").alias("source_id"), F.when(F.col("id") == 3, "[]").otherwise(text).alias("value")))
    for rows, name in ((reports.container_tracks(found), "tracks"), (reports.container_attachments(found), "attachments")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert len([x for x in plan.splitlines() if "parseJson" in x]) == 1, name
        assert sorted(r["source_id"] for r in rows.collect()) == [0, 1, 2, 4]


def test_keys_parse_what_differs_only(spark, monkeypatch):
    """Keys of stages are those of the whole text, and rows of equal settings and tools cost no parse each."""
    rows = [("a", "04", {"b": "2", "a": "1"}, '{"y": 1.50, "x": ["é", null]}'), ("é\\\"\n", "0", None, None), (None, None, {}, "{}"), ("/s{}", "", {"t": None}, "no"), ("s", "t", {}, '{}, "source": "u"')]
    frame = spark.createDataFrame(rows, "source string, stage string, tools map<string,string>, params string")
    own = canonical.cache_key(*(F.col(c) for c in frame.columns))
    number = canonical.cache_key(F.lit(7), F.col("stage"), F.col("tools"), F.col("params"))
    for r in frame.select("*", own.alias("k"), number.alias("n")).collect():
        try:
            whole = {"tools": r["tools"] or {}, "params": json.loads(r["params"] or "{}")} | ({} if r["stage"] is None else {"stage": r["stage"]})
            want = [whole | ({} if r["source"] is None else {"source": r["source"]}), whole | {"source": 7}]
        except ValueError:
            assert r["k"] is None and r["n"] is None
            continue
        text = [json.dumps(w, sort_keys=True, separators=(",", ":")) for w in want]
        assert [r["k"], r["n"]] == [hashlib.blake2b(t.encode(), digest_size=16).hexdigest() for t in text], r
    parsed, plain = [], canonical.canonical_text
    monkeypatch.setattr(canonical, "canonical_text", lambda t: parsed.append(t) or plain(t))
    n = 500
    of = [pd.Series([f'{{"source":"{k}"}}' for k in range(n)]), pd.Series(['{"stage":"1"}'] * n), pd.Series(['{"a":"1"}'] * n), pd.Series(['{"x": 1}', "{}"] * (n // 2))]
    assert canonical.hash_parts.func(*of).nunique() == n and len(parsed) == 3
    parsed.clear()
    assert canonical.canonical_and_key.func(of[3]).drop_duplicates().shape == (2, 2) and len(parsed) == 2
