"""Scores and posteriors of whole texts against plain loops, and components of odd edges."""

import math
import random

import pytest

from cinelake.llm import components, weak_labels


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["tree", "house", "###", "$$$", "Running", "the", "of", "and", "ok", "veryverylongwordindeed", "x"]
    out = [(k, " ".join(rng.choices(words, k=rng.choice([0, 1, 8, 60, 300])))) for k in range(120)]
    return [*out, (None, out[5][1]), (500, None), (501, ""), out[7], (502, "word " * 40_000)]


def test_every_row_is_scored_by_its_words(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, code string").repartition(4)
    scored, model = weak_labels.classify(docs)
    got = scored.collect()
    weights = weak_labels.train(docs, model, len(rows))
    want = []
    for i, text in rows:
        words = (text or "").encode().split()
        z = weights[-1] + sum(weights[b] for b in weak_labels.text_features(words))
        for w in words:
            z += sum(weights[b] for b in weak_labels.word_features(w)) / len(words)
        code = sum(v * 3**k for k, v in enumerate(weak_labels.votes((text or "").encode())))
        want.append((-1 if i is None else i, code, 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))))
    have = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["code"], r["score"]) for r in got)
    assert len(have) == len(rows)
    for a, b in zip(have, sorted(want)):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6


def test_components_of_odd_edges(spark):
    edges = lambda e: spark.createDataFrame(e, "a long, b long")
    assert components.connected(edges([])).count() == 0
    got = components.connected(edges([(1, 2), (2, 1), (2, 3), (7, 7), (None, 3), (4, None), (9, 8), (9, 8)])).collect()
    assert {r["node"]: r["label"] for r in got} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
