"""Centroids, whitening and word repeats against plain Python, on nulls, ties, repeats, odd lengths and no rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinelake.llm import centroids, whitening, word_repeats

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=900, dim=64, seed=4, groups=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 0.4, (groups, dim))
    x = (middle[rng.integers(0, groups, n)] + rng.normal(0, 0.15, (n, dim)) * rng.uniform(0.2, 2, dim)).astype(np.float32)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    rows += [(10_000 + k, rows[3][1], 1) for k in range(400)]  # one vector many times
    return rows + [rows[5], (None, rows[7][1], 1), (None, [0.5] * dim, 1)]


ROWS = vectors()
ODD = [(20_000, None, 0), (20_001, [], 0), (20_002, [None] * 64, 0), (20_003, [float("nan")] * 64, 0), (20_004, [float("inf")] + [0.0] * 63, 0)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS + ODD, SCHEMA).repartition(5)


def lloyd(rows, k=40, rounds=5):
    x = np.floor(256 * np.array([r[1] for r in rows], float)).astype(np.int64)
    named = sorted((hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), v.tolist()) for r, v in zip(rows, x) if r[0] is not None)
    c = np.array([v for _, v in named[:k]])
    for r in range(rounds + 1):
        squares = ((x[:, None] - c[None]) ** 2).sum(2)
        a = squares.argmin(1)
        if r < rounds:
            c = np.array([x[a == j].sum(0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    return a, squares[np.arange(len(x)), a], c


def test_centroids_against_all_distances(spark, frame, tmp_path):
    a, d, c = lloyd(ROWS)
    digest = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    own = collections.Counter()
    for j, y in zip(a.tolist(), d.tolist()):
        own[j] += y
    want = collections.Counter((r[0], j, y, own[j], int(d.sum()), digest[j]) for r, j, y in zip(ROWS, a.tolist(), d.tolist()))
    path = f"file://{tmp_path}"
    frame.withColumn("cluster", F.lit("x")).withColumn("x", F.lit(1)).withColumn("part", F.lit(2)).write.parquet(f"{path}/embeddings.parquet")
    got = centroids.query(spark, path)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == want


def test_ties_take_the_smaller_number():
    c = np.zeros((4, 64), np.int64)
    c[1, 0], c[3, 0] = 10, 10  # 0 and 2 stand in one place, 1 and 3 in another
    x = np.zeros((3, 64), np.int64)
    x[1, 0], x[2, 0] = 10, 5  # the last is as near to all
    a, u, l = np.full(3, 3, np.int32), np.full(3, np.inf), np.full(3, -np.inf)
    for _ in range(3):
        centroids.exponion(x, a, u, l, centroids.geometry(c, c))
        assert a.tolist() == [0, 1, 0]


def test_few_distances_are_taken():
    x = np.floor(256 * np.array([r[1] for r in vectors(3000, groups=40)])).astype(np.int64)
    c = x[:40].copy()
    a, u, l = np.zeros(len(x), np.int32), np.full(len(x), np.inf), np.full(len(x), -np.inf)
    before, taken = None, []
    for _ in range(8):
        taken.append(centroids.exponion(x, a, u, l, centroids.geometry(c, before)))
        assert (a == ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)).all()
        before, c = c, np.array([x[a == j].sum(0) // max(1, (a == j).sum()) if (a == j).any() else c[j] for j in range(40)])
    assert taken[0] == 40 * len(x) and sum(taken[3:]) < 0.25 * 5 * taken[0]


@pytest.mark.parametrize("rows", [[], ODD, [(None, [0.0] * 64, 0)], [(7, [0.25] * 64, 0)]])
def test_centroids_of_few_rows(spark, tmp_path, rows):
    path = f"file://{tmp_path}"
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/embeddings.parquet")
    got = centroids.query(spark, path).collect()
    if rows and rows[0][0] == 7:
        assert [tuple(r)[:5] for r in got] == [(7, 0, 0, 0, 0)]
    else:
        assert [(r["vec_id"], r["cluster"]) for r in got] == [(r[0], None) for r in rows if r not in ODD]


def plain_whitening(rows):
    x = np.floor(64 * np.array([r[1] for r in rows], float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    y = (fit - total // n) - (total % n) / n
    v = y.T @ y / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:16], w[:, ::-1][:, :16]
    out = ((x - total // n) - (total % n) / n) @ w / np.sqrt(e)
    deviation = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(r, total)) for r in x]
    return n, deviation, out, e / np.trace(v)


def test_whitening_against_numpy(spark, frame, tmp_path):
    path = f"file://{tmp_path}"
    frame.withColumn("x", F.lit(1)).withColumn("dim", F.lit("z")).write.parquet(f"{path}/embeddings.parquet")
    got = whitening.query(spark, path)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = got.collect()
    n, deviation, out, explained = plain_whitening(ROWS)
    assert len(found) == 16 * len(ROWS) and {r["n"] for r in found} == {n}
    assert max(r["identity_error"] for r in found) < 1e-9
    of = collections.defaultdict(list)
    for r in found:
        of[r["component"]].append(r)
    for k in range(16):
        rows = of[k + 1]
        assert all(abs(r["explained"] - explained[k]) < 1e-9 for r in rows)
        want = sorted(((-1 if r[0] is None else r[0]), d, y) for r, d, y in zip(ROWS, deviation, out[:, k].tolist()))
        have = sorted(((-1 if r["vec_id"] is None else r["vec_id"]), r["deviation"], r["whitened"]) for r in rows)
        flip = [(i, d, -y) for i, d, y in have]
        close = lambda a: all(x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-6 for x, y in zip(sorted(a), want))
        assert close(have) or close(flip)


def test_whitening_of_odd_tables(spark):
    made = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert whitening.whitened(made([])).count() == 0 and whitening.whitened(made(ODD)).count() == 0
    one = whitening.whitened(made([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, 0.0)] * 4
    mixed = whitening.whitened(made([(1, [0.0], 0), (2, [1.0], 0), (3, [0.0, 1.0], 0), (4, [1.0, 5.0], 0), (5, [3e38], 0)])).collect()
    seen = {(r["vec_id"], r["component"]): r for r in mixed}
    assert set(seen) == {(1, 1), (2, 1), (5, 1), (3, 1), (3, 2), (4, 1), (4, 2)}
    assert seen[1, 1]["n"] == 3 and seen[3, 1]["n"] == 2 and seen[3, 2]["whitened"] is None and seen[5, 1]["deviation"] is None
    assert abs(abs(seen[3, 1]["whitened"]) - 1) < 1e-12 and seen[4, 1]["deviation"] == 64**2 + 256**2


def test_exact_deviation_of_large_numbers():
    x = np.array([[1 << 40, 5], [3, -(1 << 20)]], np.int64)
    total = [(1 << 40) + 3, 5 - (1 << 20)]
    of = whitening.Fit(2, np.array([float(s // 2) for s in total]), np.array([s % 2 for s in total]), np.zeros((2, 1)), [1.0], 0.0)
    want = [sum((2 * int(c) - s) ** 2 for c, s in zip(r, total)) for r in x]
    assert whitening.deviations(x, of).to_pylist() == [w if w < 1 << 63 else None for w in want]


WORD = "[^\x20\x09-\x0d]+"
TEXTS = "doc_id long, text string, lang string, key string, words string"


def texts(n=140, seed=6):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ka", "lo", "é", "mi", "th", "🙂"]) for _ in range(rng.randint(1, 3))) for _ in range(70)]
    shared = [rng.choices(words, k=k) for k in (19, 20, 21, 45, 80)]
    rows = []
    for i in range(n):
        body = rng.choices(words, k=rng.choice([0, 4, 19, 20, 40, 150]))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(shared)
            at = rng.randint(0, len(body))
            cut = part[rng.randint(0, 6) :]
            body[at:at] = cut
        if i % 9 == 0:
            body += body[:50]  # repeats within a document
        if i % 12 == 0:
            body += ["no"] * 60
        rows.append((i, "".join(w + rng.choice([" ", " ", "\n", "\t ", "  "]) for w in body), "en", "k", "w"))
    rows += [(1000 + k, rows[k][1], "en", "k", "w") for k in range(6)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "k", "w"), (2002, " \n\t\x0b ", "en", "k", "w")]
    rows += [rows[20], (7, "another text of id seven " * 12, "en", "k", "w"), (None, rows[9][1], "en", "k", "w"), (None, rows[9][1], "en", "k", "w")]
    return rows


def brute_words(spark, rows):
    """Figures by (id, text): rows that repeat both count once."""
    ties = spark.createDataFrame(list({(r[0], r[1] or "") for r in rows}), "doc_id long, text string")
    order = [(-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["tie"], r["text"]) for r in ties.withColumn("tie", F.xxhash64("text", F.col("doc_id").isNull())).collect()]
    seen, out = set(), {}
    for doc, _, text in sorted(order):
        words = re.findall(WORD, text)
        gone = set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone |= set(range(i, i + 20))
            seen.add(window)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[doc, text] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def figures(spark, path, rows):
    want = brute_words(spark, rows)
    got = word_repeats.query(spark, path)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    key = lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or "")
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter((r[0], *want[key(r)]) for r in rows)
    return want


@pytest.mark.parametrize("sizes", [{}, {"SHARD_BYTES": 900, "CHUNK": 40, "STRETCH": 64}, {"HOT_ENTRIES": 2, "SHARD_BYTES": 2000}])
def test_word_repeats_against_all_windows(spark, tmp_path, monkeypatch, sizes):
    from cinelake.llm import exact_repeats

    for name, value in sizes.items():
        monkeypatch.setattr(exact_repeats if name == "HOT_ENTRIES" else word_repeats, name, value)
    rows = texts()
    path = f"file://{tmp_path}"
    spark.createDataFrame(rows, TEXTS).repartition(6).write.parquet(f"{path}/documents.parquet")
    want = figures(spark, path, rows)
    assert sum(n for _, n, _ in want.values()) > 1000 and any(n == 0 for _, n, _ in want.values())


def test_word_repeats_of_none_and_of_one_very_long_text(spark, tmp_path):
    for k, rows in enumerate([[], [(1, "w " * 30_000, "", "", ""), (2, "a b c " * 9_000, "", "", "")]]):
        path = f"file://{tmp_path}/{k}"
        spark.createDataFrame(rows, TEXTS).write.parquet(f"{path}/documents.parquet")
        figures(spark, path, rows)


@pytest.mark.parametrize("seed", range(5))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    text = []
    for _ in range(30):
        text += [rng.randint(1, 3 + 4 * seed) for _ in range(rng.randint(1, 60))] + [0]
    text = np.array(text)
    ends = np.arange(len(text))
    length, interval = word_repeats.FMIndex(text, 7).matching_statistics(text, ends)
    count = collections.Counter(tuple(text[i:j].tolist()) for j in range(len(text) + 1) for i in range(max(0, j - 7), j))
    ids = {}
    for e in ends.tolist():
        own = 0
        while own < 7 and own <= e and text[e - own] and count[tuple(text[e - own : e + 1].tolist())] > 1:
            own += 1
        assert length[e] == own
        if own == 7:
            assert ids.setdefault(tuple(text[e - 6 : e + 1].tolist()), interval[e]) == interval[e]
    assert len(set(ids.values())) == len(ids)


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    for top in (1, 2, 40, 1000):
        x = rng.integers(0, top, 777)
        tree = word_repeats.WaveletMatrix(x)
        value, low, high = rng.integers(0, top, 200), rng.integers(0, 400, 200), rng.integers(400, 778, 200)
        a, b = tree.rank(value, low, high)
        assert a.tolist() == [int((x[:k] == v).sum()) for v, k in zip(value, low)]
        assert b.tolist() == [int((x[:k] == v).sum()) for v, k in zip(value, high)]
