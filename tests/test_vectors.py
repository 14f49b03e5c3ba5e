"""Operators of media timelines on small vectors with known results."""

import json

import pytest
from pyspark.sql import functions as F

from cinelake.functions import scalar as fn
from cinelake.operators import jobs, media, timeline
from cinelake.plans import encoders
from cinelake.sources import logs
from cinelake.sources import media as sources


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def batches(spark, duration, chunk, policy="exact", keys=(), fps=24.0):
    r = frame(spark, [("a", duration, list(map(float, keys)))], "source_id string, duration double, keyframes array<double>")
    got = timeline.plan_batches(r, chunk, policy, fps).orderBy("index").collect()
    return [(x["start_pts"], x["end_pts"]) for x in got], [x["frames"] for x in got]


@pytest.mark.parametrize(
    "duration,chunk,want",
    [(90.0, 30, [(0, 30), (30, 60), (60, 90)]), (95.0, 30, [(0, 30), (30, 60), (60, 90), (90, 95)]), (12.5, 30, [(0, 12.5)])],
)
def test_exact_batches(spark, duration, chunk, want):
    assert batches(spark, duration, chunk)[0] == want


def test_keyframe_batches(spark):
    keys = [0.0, 12, 24, 28, 36, 60, 84, 100]
    want = [(0, 28), (28, 36), (36, 60), (60, 84), (84, 100), (100, 120)]
    assert batches(spark, 120.0, 30, "keyframe", keys)[0] == want
    for keys in ([], [0.0]):
        assert batches(spark, 90.0, 30, "keyframe", keys)[0] == [(0, 30), (30, 60), (60, 90)]
    got = batches(spark, 120.0, 30, "keyframe", [0.0, 1, 2, 5, 10, 50, 80, 110])[0]
    assert got[0] == (0, 10) and got[-1][1] == 120 and all(a < b for a, b in got)
    assert [a for a, _ in got[1:]] == [b for _, b in got[:-1]]


def test_batch_counts(spark):
    assert batches(spark, 60.0, 30, fps=60.0)[1] == [1800, 1800]
    assert batches(spark, 0.0, 30)[0] == []


@pytest.mark.parametrize(
    "text,want",
    [("24000/1001", (24000, 1001)), ("24/1", (24, 1)), ("48/2", (24, 1)), ("", None), (None, None), ("0/0", None), ("N/A", None), ("garbage", None), ("1/0", None), ("23.976", (2997, 125)), ("29.97", (2997, 100)), ("0.333333333", (1, 3)), ("3.141592653", (103993, 33102)), ("59.94005994", (60000, 1001)), ("25.0", (25, 1)), ("0.0", None)],
)
def test_rational(spark, text, want):
    got = one(spark, fn.rational(F.lit(text).cast("string")))
    assert (got and tuple(got)) == want


def test_frame_counts(spark):
    assert one(spark, fn.total_frames(F.lit(24), F.lit(1), F.lit(60.0))) == 1440
    assert one(spark, fn.total_frames(F.lit(24000), F.lit(1001), F.lit(60.0))) == 1439
    assert one(spark, fn.half_even(F.lit(2.5))) == 2 and one(spark, fn.half_up(F.lit(2.5))) == 3
    assert one(spark, fn.target_multiplier(F.lit(24000), F.lit(1001), F.lit(48.0), F.lit(None))) == 2
    assert one(spark, fn.target_multiplier(F.lit(24), F.lit(1), F.lit(48.0), F.lit(0))) == 1


def test_accounting_uses_cumulative_indices(spark):
    b = frame(spark, [("a", 1, 715.784609916052, 872.9688029041514)], "source_id string, index long, start_pts double, end_pts double")
    row = timeline.frame_accounting(b, F.lit(24000), F.lit(1001), F.lit(10**9).cast("long"), 2).first()
    by_length = int(24000 / 1001 * (872.9688029041514 - 715.784609916052) + 0.5)
    assert abs(by_length - row["content"]) == 1
    capped = timeline.frame_accounting(frame(spark, [("a", 1, 1400.0, 1500.0)], "source_id string, index long, start_pts double, end_pts double"), F.lit(24), F.lit(1), F.lit(33610).cast("long")).first()
    assert capped["content"] == 10


def test_reconciled(spark):
    plan = frame(spark, [("a", 1, 2877, 1, 2878), ("a", 0, 24, 0, 24)], "source_id string, index long, content long, overlap long, input_count long")
    actual = frame(spark, [("a", 1, 225), ("a", 0, 20)], "source_id string, index long, actual long")
    got = {r["index"]: (r["content"], r["output_count"]) for r in timeline.reconciled(plan, actual, 2).collect()}
    assert got == {1: (224, 448), 0: (20, 40)}


def test_planning_duration(spark):
    d = lambda *v: one(spark, timeline.planning_duration(*(F.lit(x).cast("double") for x in v)))
    assert d(1420, 1500, None, 1500) == 1420
    assert d(None, 1420, 1420, 1400) == 1420
    assert d(None, None, None, 1500) == 1500


def lines(spark, text):
    return frame(spark, [("s", i, v) for i, v in enumerate(text.split("\n"))], "source_id string, line_no int, value string")


def test_packets(spark):
    text = "pts_time=0|duration_time=0.5|flags=K_\npts_time=2|flags=K__\nbest_effort_timestamp_time=4|flags=K\npkt_pts_time=6|pts_time=5|flags=K\nflags=K\npts_time=8|duration_time=0.5|flags=__\npts_time=N/A"
    got = logs.packets(lines(spark, text))
    r = timeline.extents(got).first()
    assert (r["last_pts"], r["last_end"], r["n_keys"]) == (8.0, 8.5, 4)
    assert sorted(x["pts"] for x in got.where("is_key").collect()) == [0, 2, 4, 6]
    assert abs(one(spark, timeline.decodable_end(F.lit(1420.0), F.lit(1420.042), F.lit(0.04))) - 1420.042) < 1e-9


def test_scores(spark):
    text = "frame:0 pts:0\nlavfi.scene_score=0.0\nframe:1 pts:1\nlavfi.scene_score=0.5\nlavfi.scene_score=0.00015\nnoise"
    first = logs.scores(lines(spark, text))
    assert {r["n"]: r["score"] for r in first.collect()} == {0: 0.0, 1: 0.00015}
    second = logs.showinfo_scores(lines(spark, "[showinfo] n: 1 scene_score=0.0\n[showinfo] n: 1 scene_score=0.2\nother n: 9 scene_score=1"))
    assert {r["n"]: r["score"] for r in second.collect()} == {1: 0.2}
    assert logs.preferred_scores(first, second).count() == 2
    assert logs.preferred_scores(first.where("false"), second).count() == 1


def test_scene_cuts(spark):
    got = logs.scene_cuts(lines(spark, "lavfi.scd.score: 10.0, lavfi.scd.time: 0:00:01\nx score: 11.0, time: 3.5\nnothing"))
    assert sorted((r["score"], r["pts_time_s"]) for r in got.collect()) == [(10.0, 1.0), (11.0, 3.5)]
    assert [one(spark, fn.clock_seconds(F.lit(t))) for t in ("1.5", "0:01:30.5", "1:30.25")] == [1.5, 90.5, 90.25]
    assert [one(spark, fn.scene_threshold(F.lit(x))) for x in (0.4, 30.0)] == [27.0, 30.0]


def test_encoder_list(spark):
    got = logs.encoder_list(lines(spark, "Encoders:\n V..... = Video\n ------\n V....D libx264 H.264 / AVC\n A....D aac AAC\n V..... hevc_nvenc NVENC hevc"))
    assert sorted(r["name"] for r in got.collect()) == ["hevc_nvenc", "libx264"]


def test_islands(spark):
    for n, cuts, want in ((10, [0, 5], [(0, 4), (5, 9)]), (10, [3, 7], [(0, 2), (3, 6), (7, 9)])):
        f = frame(spark, [("a", k, k in cuts) for k in range(n)], "source_id string, n int, cut boolean")
        assert sorted((r["first_n"], r["last_n"]) for r in timeline.islands(f, F.col("cut")).collect()) == want


def test_cuts_in_batches(spark):
    for cuts, base, count, want in (([5, 250, 260], 240, 240, [11, 21]), ([240, 480, 481], 240, 240, []), ([480], 479, 481, [2])):
        c = frame(spark, [("a", k) for k in cuts], "source_id string, n long")
        b = frame(spark, [("a", 0, base, count)], "source_id string, index long, input_base long, input_count long")
        assert sorted(r["local_n"] for r in timeline.cuts_in_batches(c, b).collect()) == want


@pytest.mark.parametrize("cut,m,want", [(10, 3, (26, 2)), (4, 2, (6, 1)), (2, 3, (2, 2)), (5, 1, (0, 0)), (1, 3, (0, 0))])
def test_held_over_cuts(spark, cut, m, want):
    c = frame(spark, [("a", 0, cut)], "source_id string, index long, local_n long")
    got = sorted(r["out_n"] for r in timeline.held_over_cuts(c, m).collect())
    assert (got[0] if got else 0, len(got)) == want


def test_duplicates_and_expansion(spark):
    s = frame(spark, [("a", n, x) for n, x in enumerate([0.0, 0.001, 0.9, 0.0001, 0.5])], "source_id string, n long, score double")
    skip = timeline.duplicates(s, 0.01, frame(spark, [("a", 3)], "source_id string, n long"))
    assert sorted(r["k"] for r in skip.collect()) == [2, 4]
    frames = frame(spark, [("a", k) for k in range(1, 6)], "source_id string, k long")
    compact = timeline.compacted(frames, skip)
    assert [(r["k"], r["new_k"]) for r in compact.where("kept").orderBy("k").collect()] == [(1, 1), (3, 2), (5, 3)]
    shown = [r["from_n"] for r in timeline.expanded(compact, 1).orderBy("out_n").collect()]
    assert shown == [1, 1, 2, 2, 3]
    all_low = frame(spark, [("a", n, 0.0) for n in range(5)], "source_id string, n long, score double")
    assert timeline.duplicates(all_low, 0.01).count() == 0


def test_band(spark):
    f = frame(spark, [("a", n) for n in range(1, 13)], "source_id string, n int")
    cuts = frame(spark, [("a", 6), ("a", 11)], "source_id string, n int")
    assert sorted(r["n"] for r in timeline.near_cuts(f, cuts).collect()) == [5, 6, 7, 10, 11, 12]


def test_packing(spark):
    sizes = {"a": [3, 4, 5, 20, 1], "b": [None, 9, 0, 0]}
    items = frame(spark, [(s, k, x) for s, v in sizes.items() for k, x in enumerate(v)], "source_id string, item int, size int")
    got = timeline.packed(items.repartition(3), 8).orderBy("source_id", "item").collect()
    assert [(r["source_id"], r["pack"]) for r in got] == [("a", 0), ("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 0), ("b", 1), ("b", 1)]


def test_queue(spark):
    j = frame(spark, [("b", "/x/Beta.mkv", "queued", "2"), ("a", "C:\\y\\beta.mkv", "queued", "2"), ("c", "/x/alpha.mkv", "queued", "3"), ("d", "/x/a.mkv", "done", "1")], "id string, source_path string, state string, created_at string")
    assert [jobs.next_queued(j, p).first()["id"] for p in ("fifo", "name_asc", "name_desc")] == ["a", "c", "b"]


def test_active_time(spark):
    j = frame(spark, [("q", 100.0, 170.0), ("j", 1000.0, 1020.0), ("n", None, 1.0)], "id string, started double, ended double")
    p = frame(spark, [("q", 110.0, 130.0), ("q", 150.0, None), ("j", 1003.0, 1010.0), ("j", 1018.0, None)], "id string, paused double, resumed double")
    got = {r["id"]: r["active_s"] for r in jobs.active_seconds(j, p).collect()}
    assert got["q"] == 30 and got["j"] == 11


def test_performance_counts_nothing_twice(spark):
    r = frame(spark, [("j", "05_up__batch_01", 2.0, 1, 5), ("j", "05_up__batch_02", 3.0, 1, 9), ("j", "05_up", 5.0, 2, 9), ("j", "09_mux", 1.0, 1, 9)], "job_id string, result_name string, duration_s double, calls long, scans_total long")
    got = {x["stage"]: (x["runs"], x["duration_s"], x["scans_total"]) for x in jobs.performance(r).collect()}
    assert got == {"05_up": (2, 5.0, 9), "09_mux": (1, 1.0, 9), None: (3, 6.0, 9)}


def test_job_progress_may_fall(spark):
    e = frame(spark, [("j", 1, "started", 5, None), ("j", 2, "progress", 5, 0.5), ("j", 3, "completed", 5, None), ("j", 4, "progress", 4, 0.1)], "job_id string, seq int, kind string, stage_index int, progress double")
    r = jobs.job_progress(e).first()
    assert r["stage"] == 5 and abs(r["progress"] - 4.1 / 11) < 1e-12


def test_samples(spark):
    text = ["frame=1", "fps=24", "frame=2", "progress=continue", "frame=9", "progress=end", "frame=10"]
    f = frame(spark, [("j", k, v) for k, v in enumerate(text)], "job_id string, line_no int, value string")
    got = [(r["frame"], r["fps"], r["progress"]) for r in jobs.progress_samples(f).orderBy("sample").collect()]
    assert got == [("2", "24", "continue"), ("9", None, "end")]


def test_mapping_and_muxer(spark):
    s = frame(spark, [(1, 0, "video", "hevc"), (1, 1, "subtitle", "ass"), (1, 2, "subtitle", "mov_text")], "file_id int, index int, kind string, codec_name string")
    got = {r["index"]: (r["out_idx"], r["reason"]) for r in media.mapped_streams(s, "mp4").collect()}
    assert got[2] == (0, None) and got[1][0] is None and got[1][1]
    assert media.mapped_streams(s, "mkv").where("out_idx is null").count() == 0
    tool = lambda *v: one(spark, media.muxer(*map(F.lit, v)))
    assert [tool("mp4", 1, 5), tool("mkv", 1, 0), tool("mkv", 0, 2), tool("mkv", 0, 1)] == ["ffmpeg", "mkvmerge", "mkvmerge", "ffmpeg+propedit"]
    assert one(spark, fn.flags_text(default=F.lit(False))) == "0"


def resolve(spark, wanted, capable):
    r = frame(spark, [(1, wanted)], "host int, wanted string")
    c = frame(spark, [(1, x) for x in capable], "host int, encoder string")
    e = frame(spark, encoders.FALLBACKS, "encoder string, rank int, fallback string")
    return encoders.resolved(r, c, e).first()["encoder"]


def test_encoders(spark):
    assert resolve(spark, "hevc_nvenc", ["hevc_nvenc"]) == "hevc_nvenc"
    assert resolve(spark, "av1_nvenc", ["hevc_nvenc", "libx265"]) == "hevc_nvenc"
    assert resolve(spark, "hevc_nvenc", ["libx265", "libx264"]) == "libx265"
    assert resolve(spark, "h264_nvenc", ["h264_d3d12", "libx264"]) == "h264_d3d12"
    assert resolve(spark, "av1_d3d12", ["av1_vulkan"]) == "av1_vulkan"
    assert resolve(spark, "hevc_nvenc", ["h264_qsv"]) is None


def test_long_chains_of_encoders(spark):
    """Chains of any length are followed to their end, circles are left, and ranks are numbers."""
    chain = [(f"e{k}", 1, f"e{k + 1}") for k in range(9)] + [("e9", 1, "e0"), ("a", 10, "b"), ("a", 9, "c"), ("a", 1, "a")]
    edges = frame(spark, chain, "encoder string, rank int, fallback string")
    wanted = frame(spark, [(1, "e0"), (2, "e3"), (3, "a"), (4, "e1")], "host int, wanted string")
    can = frame(spark, [(1, "e9"), (2, "e2"), (3, "b"), (3, "c"), (4, "x")], "host int, encoder string")
    got = {r["host"]: (r["encoder"], r["depth"]) for r in encoders.resolved(wanted, can, edges).collect()}
    assert got == {1: ("e9", 9), 2: ("e2", 9), 3: ("c", 1), 4: (None, None)}


def test_pins(spark):
    pins = frame(spark, [("ffmpeg", "7.1"), ("rife", "4"), ("mkv", "90")], "tool_id string, expected string")
    have = frame(spark, [("ffmpeg", " 7.1.2"), ("rife", "3.9")], "tool_id string, version string")
    assert {r["tool_id"]: r["status"] for r in media.missing_pins(pins, have).collect()} == {"rife": "mismatch", "mkv": "missing"}


def test_probe_files(spark, tmp_path):
    probe = {"streams": [{"index": 0, "codec_type": "video", "disposition": {"attached_pic": 1}}, {"index": 1, "codec_type": "video", "width": 1920}, {"index": 2, "codec_type": "attachment"}], "chapters": [{"start_time": "0.0", "end_time": "N/A"}], "format": {"filename": "a.mkv", "format_name": "matroska,webm", "duration": "12.5"}}
    (tmp_path / "p.json").write_text(json.dumps(probe, indent=1))
    p = sources.read_probes(spark, f"file://{tmp_path}/p.json")
    r = p.first()
    assert (r["duration_s"], r["is_matroska"], len(r["streams"]), len(r["attachments"])) == (12.5, True, 2, 1)
    assert r["chapters"][0]["end_s"] is None
    assert sources.primary_video(p).first()["video"]["index"] == 1
    for doc, want in (({"pooled_metrics": {"vmaf": {"mean": 93.25, "harmonic_mean": 92.81}}, "frames": []}, (93.25, 92.81)), ({"frames": [{"metrics": {"vmaf": 90.0}}, {"metrics": {"vmaf": 95.0}}]}, (92.5, None))):
        (tmp_path / "v.json").write_text(json.dumps(doc))
        assert tuple(sources.read_quality(spark, f"file://{tmp_path}/v.json").first()) == want


def test_folders(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for name in ("00000001.png", "00000002.png", "cover.png", "x.mkv"):
        (tmp_path / "f" / name).write_bytes(b"123")
    r = sources.frame_folders(spark, f"file://{tmp_path}").first()
    assert (r["n"], r["bytes"]) == (2, 6)
    assert sources.videos(spark, f"file://{tmp_path}").count() == 1
    (tmp_path / "log.txt").write_text("a\nb\r\nc")
    assert [r["value"] for r in logs.read_lines(spark, f"file://{tmp_path}/log.txt").orderBy("line_no").collect()] == ["a", "b", "c"]


def test_deep_settings(spark):
    from cinelake.operators import jobs

    cases = [
        ('{"a":{"b":1,"c":[1,2]},"d":1}', '{"a":{"c":[3]},"e":{"f":2}}', '{"a": {"b": 1, "c": [3]}, "d": 1, "e": {"f": 2}}'),
        ('{"a":1}', '{"a":{"b":null}}', '{"a": {"b": null}}'),
        (None, '{"a":1}', '{"a": 1}'),
        ("no json", None, "{}"),
    ]
    got = spark.createDataFrame([c[:2] for c in cases], "a string, b string").select(jobs.deep_merged("a", "b").alias("m")).collect()
    assert [r["m"] for r in got] == [c[2] for c in cases]


def test_decimal_rates_agree_with_exact_fractions(spark):
    from fractions import Fraction

    texts = [f"{k * 7919 % 240}.{k * 104729 % 10**9:09d}" for k in range(1, 200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fn.rational(F.col("t")).alias("r")).collect()
    for t, r in rows:
        want = Fraction(t).limit_denominator(fn.MAX_DENOMINATOR)
        assert (r and (r["num"], r["den"])) == (want and (want.numerator, want.denominator) or None), t
