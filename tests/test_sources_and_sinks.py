"""Log tails, bounded views, streams written once, published tables and fingerprints."""

import hashlib
import os
import random

from pyspark.sql import functions as F

from cinelake.sinks import published
from cinelake.sources import fingerprints, tail
from cinelake.streaming import exact, views


def append(path, lines, end="\n"):
    with open(path, "ab") as f:
        f.write("".join(f"{x}\n" for x in lines)[: None if end else -1].encode())


def test_tail_over_rolls_and_restarts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "RANGE", 700)  # many pieces a file
    tail.register(spark)
    logs, rng = tmp_path / "logs", random.Random(2)
    logs.mkdir()
    log = logs / "app.log"
    wrote, number, generation = [], 0, 0

    def more(n):
        nonlocal number
        rows = [f"{generation} {number + k} {'x' * rng.randint(0, 90)} é" for k in range(n)]
        number += n
        append(log, rows)
        wrote.extend(rows)

    def drain():
        stream = spark.readStream.format("log_tail").load(f"{logs}/app.log*")
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        assert q.exception() is None
        got = [r["line"] for r in spark.read.schema("file string, at long, line string").parquet(f"{tmp_path}/out").collect()]
        assert sorted(got) == sorted(wrote)

    more(50)
    with open(log, "ab") as f:
        f.write(b"not ended")
    drain()  # a line without an end waits
    with open(log, "ab") as f:
        f.write(b" yet\n")
    wrote.append("not ended yet")
    more(7)
    drain()
    more(5)  # not read before the roll
    os.rename(log, logs / "app.log.1")
    generation += 1
    more(30)
    drain()
    os.rename(logs / "app.log.1", logs / "app.log.2")
    os.rename(log, logs / "app.log.1")
    generation += 1
    more(200)
    drain()
    drain()  # nothing new
    log.write_bytes(b"")  # truncated, and filled anew
    generation += 1
    more(3)
    drain()


def test_last_lines_of_each_job(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        wrote = {"a": [], "b": []}
        for part, sizes in enumerate([{"a": 9_000, "b": 3}, {"a": 9_000}, {"a": 7_500, "b": 20}]):
            rows = [(job, "f", len(wrote[job]) + k, f"{job} {len(wrote[job]) + k}") for job, n in sizes.items() for k in range(n)]
            for job, _, _, line in rows:
                wrote[job].append(line)
            spark.createDataFrame(rows, "job_id string, file string, at long, line string").coalesce(1).write.mode("append").parquet(str(source))
            stream = spark.readStream.schema("job_id string, file string, at long, line string").parquet(str(source))
            seen = []
            q = views.last_lines(stream).writeStream.foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
            assert q.awaitTermination(300) and q.exception() is None
            assert sorted(r["line"] for r in seen) == sorted(line for _, _, _, line in rows), part
        got = {}
        for r in views.view(spark, f"{tmp_path}/c").orderBy("seq").collect():
            got.setdefault(r["job_id"], []).append(r["line"])
        assert got == {"a": wrote["a"][-views.LINES :], "b": wrote["b"]}
        assert max(r["oldest"] for r in seen) == 25_500 - views.LINES
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_batches_are_written_once_and_late_rows_reconciled(spark, tmp_path):
    source, out = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()
    at = lambda s: f"2024-01-01 00:{s // 60:02}:{s % 60:02}"
    batches = [[(1, 0, at(k)) for k in range(10)], [(1, 1, at(600 + k)) for k in range(8)], [(1, 0, at(11)), (1, 1, at(620))]]
    schema = "source_id long, index long, ts string"
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source)).withColumn("ts", F.col("ts").cast("timestamp"))
        q = exact.exactly_once(stream, out, f"{tmp_path}/c", late_ms=60_000).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        if number == 1:  # the driver dies before Spark notes the batch as done: it comes again
            for top in (f"{tmp_path}/c/commits",):
                for name in os.listdir(top):
                    if name.strip(".").split(".")[0] == "1":
                        os.remove(f"{top}/{name}")
            q = exact.exactly_once(stream, out, f"{tmp_path}/c", late_ms=60_000).trigger(availableNow=True).start()
            assert q.awaitTermination(120) and q.exception() is None
            assert exact.committed(spark, out).count() == 18
    rows, late = exact.committed(spark, out), exact.committed(spark, out, "late")
    assert (rows.count(), late.count()) == (19, 1)
    plan = spark.createDataFrame([(1, 0, 11, 0, 11), (1, 1, 9, 0, 9), (1, 2, 5, 0, 5)], "source_id long, index long, input_count long, overlap long, content long")
    got = {r["index"]: (r["content"], r["trimmed"]) for r in exact.reconciled_with_late(plan, rows, late, (F.col("source_id"), F.col("index"))).collect()}
    assert got == {0: (11, 0), 1: (9, 0), 2: (0, 0)}


def test_half_written_batches_are_not_read(spark, tmp_path):
    out = f"{tmp_path}/out"
    assert exact.committed(spark, out) is None
    spark.range(3).write.parquet(f"{out}/rows/batch=0")
    assert exact.committed(spark, out) is None
    published.write_text(spark, f"{out}/ledger", "batch=0\nhigh=\n")
    spark.range(5).write.parquet(f"{out}/rows/batch=1")
    assert exact.committed(spark, out).count() == 3


def test_interval_join_of_streams(spark, tmp_path):
    spans = [(1, "2024-01-01 00:00:00", "2024-01-01 00:10:00", "a"), (1, "2024-01-01 00:10:00", "2024-01-01 00:30:00", "b"), (2, "2024-01-01 00:00:00", "2024-01-01 00:05:00", "c")]
    events = [(1, "2024-01-01 00:09:59", 1), (1, "2024-01-01 00:10:00", 2), (2, "2024-01-01 00:05:00", 3), (2, "2024-01-01 00:00:00", 4), (3, "2024-01-01 00:00:00", 5)]
    spark.createDataFrame(spans, "key long, begin string, end string, name string").write.parquet(f"{tmp_path}/s")
    spark.createDataFrame(events, "key long, ts string, id long").write.parquet(f"{tmp_path}/e")
    time = lambda df, *c: df.withColumns({x: F.col(x).cast("timestamp") for x in c})
    s = time(spark.readStream.schema("key long, begin string, end string, name string").parquet(f"{tmp_path}/s"), "begin", "end")
    e = time(spark.readStream.schema("key long, ts string, id long").parquet(f"{tmp_path}/e"), "ts")
    got = []
    q = exact.interval_join(e, s).writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    assert sorted((r["id"], r["name"]) for r in got) == [(1, "a"), (2, "b"), (4, "c")]


def test_published_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert published.published(spark, path) is None and published.read_manifest(spark, path) is None
    first = published.publish(spark.range(4), path, {"stage": "01_plan", "when": 1.5})
    assert published.published(spark, path).count() == 4 and published.read_manifest(spark, path)["about"] == {"stage": "01_plan", "when": 1.5}
    spark.range(9).write.parquet(f"{path}/data-cut-off")  # a publication that never came to its manifest
    assert published.published(spark, path).count() == 4
    second = published.publish(spark.range(2), path)
    assert published.published(spark, path).count() == 2 and not os.path.exists(f"{tmp_path}/t/{first['data']}")
    os.remove(f"{tmp_path}/t/{second['data']}/_SUCCESS")
    assert published.published(spark, path) is None
    for broken in ("{", "[]", "�", '{"data": 3}'):
        published.write_text(spark, f"{path}/manifest.json", broken)
        assert published.published(spark, path) is None
    (tmp_path / "t/manifest.json").write_bytes(b"\xff\xfe{}")
    assert published.read_manifest(spark, path) is None


def test_fingerprints(spark, tmp_path):
    sizes = [0, 5, 1 << 20, (2 << 20) - 1, 2 << 20, (2 << 20) + 1, 5 << 20]
    paths, want = [], {}
    for k, size in enumerate(sizes):
        p = tmp_path / f"{k} x.bin"
        p.write_bytes(random.Random(k).randbytes(size))
        stat, data = p.stat(), p.read_bytes()
        h = hashlib.blake2b(digest_size=16)
        h.update(stat.st_size.to_bytes(8, "little"))
        h.update(stat.st_mtime_ns.to_bytes(8, "little"))
        h.update(data[: 1 << 20])
        if size > 2 << 20:
            h.update(data[-(1 << 20) :])
        paths.append(str(p))
        want[str(p)] = (h.hexdigest(), size)
    frame = spark.createDataFrame([(p,) for p in [*paths, f"{tmp_path}/none", None]], "path string")
    got = {r["path"]: r for r in fingerprints.fingerprints(frame).collect()}
    assert {p: (got[p]["fingerprint"], got[p]["size"]) for p in paths} == want
    assert max(r["bytes_read"] for r in got.values()) == 2 << 20
    assert got[f"{tmp_path}/none"]["fingerprint"] is None and got[None]["size"] is None
