"""Older versions, validation reports and SQL functions."""

import random

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cinelake.functions import sql
from cinelake.operators import media, timeline
from cinelake.sinks import migrate


def test_versions_of_a_table(spark):
    old = spark.createDataFrame([(1, "x")], "id long, state string")
    middle = spark.createDataFrame([(2, "y", None, "04", None)], "id long, state string, preset_overrides_json string, current_stage string, retry_count int")
    new = migrate.migrated(old)
    assert new.columns == ["id", "state", "preset_overrides_json", "current_stage", "last_failed_stage", "resume_from_stage", "retry_count"]
    assert migrate.migrated(new).collect() == new.collect()  # again
    both = {r["id"]: r for r in migrate.union_of_versions([(old, 0), (middle, 0)]).collect()}
    assert (both[1]["retry_count"], both[2]["retry_count"], both[2]["current_stage"]) == (0, 0, "04")
    wanted = StructType.fromDDL("id long, state int, extra string")
    assert migrate.difference(middle.schema, wanted)[:2] == [("extra", "missing", "string"), ("state", "type", "string for int")]
    assert {c for c, what, _ in migrate.difference(middle.schema, wanted) if what == "unknown"} == {"preset_overrides_json", "current_stage", "retry_count"}
    renamed = migrate.Migration(4, renamed=(("state", "status"),))
    assert migrate.migrated(old, (renamed,)).columns == ["id", "status"]
    clash = spark.createDataFrame([("old", None), ("old", "new")], "state string, status string")
    assert [r["status"] for r in migrate.migrated(clash, (renamed,)).collect()] == ["old", "new"]


def test_legacy_settings(spark):
    texts = {
        '{"hardware":{"prefer_nvenc":true}}': True, '{"hardware":{"prefer_nvenc":null}}': False, '{"hardware":{"prefer_nvenc":""}}': False,
        '{"hardware":{"prefer_nvenc":"no"}}': True, '{"hardware":{"prefer_nvenc":[]}}': False, '{"hardware":{"prefer_nvenc":true,"prefer_hardware_encoder":false}}': False,
        '{"hardware":{}}': None, '{"hardware":3}': None, "[]": None, "{": None,
    }
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = frame.select("t", migrate.legacy_values(F.col("t"))["hardware.prefer_hardware_encoder"].alias("v")).collect()
    assert {r["t"]: r["v"] for r in got} == texts


def test_validation_report(spark):
    good = {"e_duration": 100.0, "g_duration": 100.15, "g_video": 1, "target_w": 1920, "target_h": 1080, "e_width": 960, "g_width": 1921, "g_height": 1079, "e_audio": 2, "g_audio": 2, "e_subtitle": 1, "g_subtitle": 1, "e_chapters": 4, "g_chapters": 4, "copy_chapters": True, "e_attachments": 2, "g_attachments": 2, "copy_attachments": True, "container": "mkv", "hdr": False, "roundtripped": False, "e_transfer": None, "g_transfer": None, "e_audio_default": 2, "g_audio_default": 2, "e_subtitle_default": 0, "g_subtitle_default": 0}
    cases = [
        ({}, []),
        ({"g_duration": 100.3}, [("duration_mismatch", "failure")]),
        ({"g_duration": None}, [("duration_unknown", "note")]),
        ({"g_video": 0}, [("video_stream_count", "failure")]),
        ({"g_width": 1900}, [("video_resolution", "failure")]),
        ({"g_height": None}, [("video_resolution", "failure")]),
        ({"target_w": None, "g_width": 960}, []),
        ({"target_w": 0, "g_width": 970}, [("video_resolution_drift", "failure")]),
        ({"g_audio": 1, "g_subtitle": 2}, [("audio_stream_count", "failure"), ("subtitle_stream_count", "failure")]),
        ({"g_chapters": 3}, [("chapters_lost", "failure")]),
        ({"g_chapters": 5}, [("chapters_lost", "failure")]),
        ({"g_chapters": 0, "copy_chapters": False}, []),
        ({"g_attachments": 1}, [("attachments_lost", "failure")]),
        ({"g_attachments": 1, "container": "mp4"}, []),
        ({"hdr": True, "e_transfer": "smpte2084", "g_transfer": "SMPTE2084"}, []),
        ({"hdr": True, "e_transfer": "smpte2084", "g_transfer": "bt709"}, [("hdr_transfer_lost", "failure")]),
        ({"hdr": True, "roundtripped": True, "e_transfer": "smpte2084", "g_transfer": "bt709"}, [("hdr_roundtripped", "note")]),
        ({"hdr": True, "roundtripped": True, "e_transfer": "smpte2084", "g_transfer": "smpte2084"}, [("hdr_transfer_residual", "failure")]),
        ({"g_audio_default": 1}, [("audio_streams_default_lost", "note")]),
        ({"g_audio_default": 0}, [("audio_streams_default_lost", "failure")]),
    ]
    names = {"container": "string", "e_transfer": "string", "g_transfer": "string", "e_duration": "double", "g_duration": "double", "copy_chapters": "boolean", "copy_attachments": "boolean", "hdr": "boolean", "roundtripped": "boolean"}
    schema = "file_id int, " + ", ".join(f"{c} {names.get(c, 'int')}" for c in good)
    frame = spark.createDataFrame([(k, *(good | over).values()) for k, (over, _) in enumerate(cases)], schema)
    got = {}
    for r in media.validation_report(frame).collect():
        got.setdefault(r["file_id"], []).append((r["code"], r["severity"]))
    for k, (_, want) in enumerate(cases):
        assert sorted(got.get(k, [])) == sorted(want), k


def test_newest_stored_plan(spark):
    batches = spark.createDataFrame([("a", 0, 0.0, 10.0), ("a", 1, 10.0, 20.0)], "source_id string, batch int, start double, end double")
    stored = spark.createDataFrame([("a", 1, 0.0, 10.0), ("a", 3, 0.0000001, 10.0), ("a", 2, 0.0, 10.0)], "source_id string, plan_id int, start double, end double")
    assert {r["batch"]: r["plan_id"] for r in timeline.stored_plans(batches, stored).collect()} == {0: 3, 1: None}


def test_bins_of_cuts(spark):
    cuts = spark.createDataFrame([("a", n) for n in (0, 1, 999, 1000, 1001, 5000, 10_000)], "source_id string, n long")
    batches = spark.createDataFrame([("a", 0, 0, 1000), ("a", 1, 999, 5000), ("a", 2, 5998, 1), ("a", 3, 5999, 4002)], "source_id string, index int, input_base long, input_count long")
    want = {(i, n - base + 1) for n in (0, 1, 999, 1000, 1001, 5000, 10_000) for i, base, count in ((0, 0, 1000), (1, 999, 5000), (2, 5998, 1), (3, 5999, 4002)) if 2 <= n - base + 1 <= count}
    for width in (1, 7, 1024):
        got = [(r["index"], r["local_n"]) for r in timeline.cuts_in_batches(cuts, batches, width).collect()]
        assert sorted(got) == sorted(want)


def test_long_batches_stand_in_few_bins(spark):
    """Rows that the join of cuts and batches is made of do not grow with the batches' length; batches may overlap."""
    rng = random.Random(5)
    spans = [(k, rng.randrange(10**9), 2 + rng.randrange(10 ** rng.randrange(1, 10))) for k in range(60)]
    cuts = [rng.randrange(2 * 10**9) for _ in range(300)] + [base + x for _, base, count in spans for x in (0, 1, count - 1, count)]
    want = sorted((k, n - base + 1) for n in cuts for k, base, count in spans if 2 <= n - base + 1 <= count)
    batches = spark.createDataFrame([("a", *s) for s in spans], "source_id string, index int, input_base long, input_count long")
    found = timeline.cuts_in_batches(spark.createDataFrame([("a", n) for n in cuts], "source_id string, n long"), batches, 4)
    assert sorted((r["index"], r["local_n"]) for r in found.collect()) == want


def test_functions_in_sql(spark):
    sql.register(spark)
    sql.register(spark)
    row = spark.sql("SELECT media_half_up(2.5D) a, media_half_even(2.5D) b, media_ntsc_drop(24000, 1001) c, media_hash_json('{\"b\":1, \"a\":2}') = media_hash_text('{\"a\":2,\"b\":1}') d").first()
    assert tuple(row) == (3, 2, True, True)
    spark.createDataFrame([("a", k, x) for k, x in enumerate([3, 4, 5, 20, 1])] + [("b", 0, None)], "source_id string, item long, size long").createOrReplaceTempView("items")
    got = spark.sql("SELECT * FROM pack_items(8, TABLE(items) PARTITION BY source_id ORDER BY item)").collect()
    assert sorted(map(tuple, got)) == [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("a", 4, 3), ("b", 0, 0)]


def test_small_rules(spark):
    from cinelake.functions import scalar as fn
    from cinelake.operators import jobs

    cases = {
        (("v20240115", "20240115 and 20230101"), None): "20240115", (("built 20230101", None), None): "20230101", (("20171231", "20241301"), None): None,
        (("20230101 20240115",), "20240115"): "20240115", (("20230101", "x20240115y"), "20240115"): "20240115", (("20230101",), "20170101"): "20230101",
        (("é20240115 20240230 20240229",), None): "20240229", ((), None): None,
    }
    frame = spark.createDataFrame([(k, list(blobs), prefer) for k, (blobs, prefer) in enumerate(cases)], "k int, blobs array<string>, prefer string")
    got = {r["k"]: r["tag"] for r in frame.select("k", fn.first_date_tag(F.col("blobs"), F.col("prefer")).alias("tag")).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())
    rows = [("cqp", "amf", "QP", True), ("vbr", "amf", "vbr_latency", True), ("vbr", "nvenc", "vbr_latency", False), ("cqp", "nvenc", "constqp", True), ("cqp", "qsv", "cqp", False), ("Custom", "amf", "custom", True), (None, "amf", "cqp", False)]
    frame = spark.createDataFrame(rows, "w string, f string, r string, want boolean")
    assert all(r["got"] == r["want"] for r in frame.select("want", fn.rate_control_matches(F.col("w"), F.col("f"), F.col("r")).alias("got")).collect())
    made = spark.createDataFrame([("c", "2024-01-02 00:00:00"), ("b", "2024-01-02 00:00:00"), ("a", "2024-01-03 00:00:00"), ("z", "2023-01-01 00:00:00"), ("n", None)], "id string, t string")
    listed = jobs.listed(made.withColumn("created_at", F.col("t").cast("timestamp")))
    assert [r["id"] for r in listed.orderBy("position").collect()] == ["n", "z", "b", "c", "a"] and listed.agg(F.max("position")).first()[0] == 4
    found = spark.createDataFrame([(1, "/w/segment_1.mkv", 5), (1, "/w/segment_2.mkv", 0), (1, "/w/x.mkv", 3), (2, "/w/segment_1.mkv", 5), (1, "/w/segment_1.mkv", 5)], "job_id int, path string, length long")
    known = spark.createDataFrame([(2, "/w/segment_9.mkv")], "job_id int, path string")
    assert sorted(map(tuple, jobs.usable_segments(found, known).collect())) == [(1, "/w/segment_1.mkv"), (2, "/w/segment_9.mkv")]
