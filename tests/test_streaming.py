"""Drained streams against batch answers."""

from pyspark.sql import functions as F

from cinelake.streaming import events

EVENTS = "/root/testdata/sf0.001/events.parquet"


def drained(stream, tmp_path, mode):
    rows = []
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True)
    q = q.foreachBatch(lambda b, _: rows.append(b.collect())).start()
    q.awaitTermination(120)
    return rows


def test_windows(spark, tmp_path):
    source = spark.read.parquet(EVENTS)
    source.repartition(3).write.parquet(f"file://{tmp_path}/in")
    read = events.read_events(spark, f"file://{tmp_path}/in")
    got = drained(events.tumbling(read), tmp_path / "t", "complete")[-1]
    want = source.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").count().collect()
    assert sorted((r["start"], r["event_type"], r["n"]) for r in got) == sorted((r["window"]["start"], r["event_type"], r["count"]) for r in want)
    got = drained(events.sliding(read), tmp_path / "s", "complete")[-1]
    assert sum(r["n"] for r in got) == 2 * source.count()
    got = drained(events.sessions(read), tmp_path / "x", "complete")[-1]
    assert sum(r["n"] for r in got) == source.count()


def test_samples(spark, tmp_path):
    text = ["frame=1", "fps=24", "progress=continue", "frame=9", "progress=end", "frame=10"]
    rows = [(j, k, v) for j in (1, 2) for k, v in enumerate(text)]
    spark.createDataFrame(rows, "job_id long, line_no long, value string").write.parquet(f"file://{tmp_path}/in")
    read = spark.readStream.schema("job_id long, line_no long, value string").parquet(f"file://{tmp_path}/in")
    got = [r for b in drained(events.samples(read), tmp_path, "append") for r in b]
    assert sorted((r["job_id"], r["sample"], r["frame"], r["fps"], r["progress"]) for r in got) == [
        (j, *x) for j in (1, 2) for x in ((0, "1", "24", "continue"), (1, "9", None, "end"))
    ]


def test_fan_out_passes_over_a_failing_sink(spark, tmp_path):
    spark.range(5).write.parquet(f"file://{tmp_path}/in")
    read = spark.readStream.schema("id long").parquet(f"file://{tmp_path}/in")
    seen = []

    def broken(batch, number):
        raise ValueError("no")

    q = events.fan_out(read, [broken, lambda b, n: seen.append(b.count())], f"file://{tmp_path}/c").start()
    q.awaitTermination(60)
    assert seen == [5]
