"""The columns that each query returns, on a small folder, against plain Python."""

import collections
import hashlib
import zlib

import pytest

from cinelake.llm import registry, suffix_tree
from tests.llm.test_operators import ITEMS, ROWS, SCHEMA, brute_repeats, text_tie

COLUMNS = {
    "op1_surrogates": ["doc_id", "n_email", "n_iban", "n_ssn", "n_card", "n_ip", "n_phone", "n_name", "text"],
    "op2_simhash": ["doc_id", "fingerprint", "component_id"],
    "op4_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op5_suffix_tree": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op6_pieces": ["doc_id", "n_ids", "ids_hash", "round_trip"],
    "op7_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op8_exact_repeats": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op9_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op12_word_repeats": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op10_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
}
TEXTS = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, int(i % 11 != 0), 0) for i in range(100)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


#: These read ``embeddings``; test_vectors_and_words.py has their rows.
OF_VECTORS = {"op11_centroids", "op13_whitening"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - OF_VECTORS))
def test_columns_and_rows(spark, folder, name):
    got = registry.QUERIES[name](spark, folder)
    if name in COLUMNS:
        assert got.columns[: len(COLUMNS[name])] == COLUMNS[name]
    found = [r["doc_id"] for r in got.select("doc_id").collect()]
    assert collections.Counter(found) == collections.Counter(i for i, _ in TEXTS)


def test_sharding_figures(spark, folder):
    got = registry.QUERIES["op4_sharding"](spark, folder).collect()
    want = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "rows", None) for i, t in TEXTS)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(40)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_repeats_figures(spark, folder):
    want = brute_repeats([(d, t) for d, _, t in text_tie(spark, TEXTS)])
    figures = {k: (n, c, s, hashlib.sha256(kept).hexdigest()) for k, (n, c, s, kept) in want.items()}
    got = registry.QUERIES["op8_exact_repeats"](spark, folder).collect()
    key = lambda i, t: (-(1 << 63) if i is None else i, t or "")
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == collections.Counter(
        (i, *figures[key(i, t)]) for i, t in TEXTS
    )


def test_held_out(spark, folder):
    got = registry.QUERIES["op5_suffix_tree"](spark, folder).select("doc_id", "held_out").collect()
    assert all(r["held_out"] == suffix_tree.held_out(r["doc_id"]) for r in got)


def test_pieces_come_back(spark, folder):
    assert registry.QUERIES["op6_pieces"](spark, folder).where("not round_trip").count() == 0
