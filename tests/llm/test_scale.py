"""Benchmarks of many blocks and shuffles of many buckets: the same results with bounded writes and partitions."""

import random

from cinelake.llm import decontaminate, sharding

DOCS = "doc_id long, text string"


def documents(spark, n=300):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([4, 12, 30])))) for k in range(40)]
    texts = []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if k % 5 == 0:
            text += rng.choice(items)[1].split() + rng.choice(items)[1].split()
        texts.append(" ".join(text))
    texts += [texts[0]] * 100 + [None, ""]
    return spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], DOCS), spark.createDataFrame(items, "item_id long, text string")


def rows(found):
    return sorted((r["doc_id"], r["text"] or "", r["text"] is None, r["__n_words"], [tuple(h) for h in r["__hits"]], r["__items"]) for r in found.collect())


def test_blocks_do_not_write_the_documents(spark, monkeypatch):
    docs, benchmark = documents(spark)
    want = rows(decontaminate.scan(docs, benchmark))
    assert sum(bool(r[4]) for r in want) > 100 and not all(r[4] for r in want)
    tables = []
    real = decontaminate.written
    monkeypatch.setattr(decontaminate, "written", lambda df: tables.append(real(df)) or tables[-1])
    total = sum(len(r["text"]) + 64 for r in benchmark.collect())
    for limit, most in ((8 << 20, "broadcast"), (0, "shuffle")):
        monkeypatch.setattr(decontaminate, "MAX_FOUND_BYTES", limit)
        tables.clear()
        assert rows(decontaminate.scan(docs, benchmark, total // 10 + 1)) == want, most
        assert len(tables) >= 9
        hit_texts = len({r[1] for r in want if r[4]})
        assert all("text" not in t.columns and t.count() <= hit_texts for t in tables)


def test_cutting_with_many_blocks(spark):
    docs, benchmark = documents(spark, 80)
    clean = decontaminate.decontaminate(docs, benchmark, 400)
    assert sorted((r["doc_id"], r["text"] or "") for r in clean.collect()) == sorted((r["doc_id"], r["text"] or "") for r in decontaminate.decontaminate(docs, benchmark).collect())


def test_runs_of_buckets(spark):
    docs, _ = documents(spark)
    for bucket_bytes in (2000, 1 << 20):
        want = sorted(map(tuple, sharding.external_shuffle(docs, 7, 5, bucket_bytes).collect()), key=repr)
        for partitions in (1, 3):
            few = sharding.external_shuffle(docs, 7, 5, bucket_bytes, partitions)
            assert sorted(map(tuple, few.collect()), key=repr) == want
    plan = sharding.external_shuffle(docs, 7, 5, 2000, 3)._jdf.queryExecution().executedPlan().toString()
    scattered = plan[plan.index("FlatMapGroupsInArrow") : plan.index("BroadcastExchange")]
    assert scattered.count("Exchange ") == 1 and "direct_shuffle_partition_id(__run" in scattered  # the texts are shuffled once
