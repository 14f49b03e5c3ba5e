"""Benchmark decontamination by a broadcast set of normalised test windows.

The windows of the benchmark (ten words, or a whole shorter item) are hashed into sorted arrays and
broadcast; each task slides the same windows over the words of its documents, looks the hashes up,
verifies every hit word by word, and reports the covered word ranges and the items found.  No row is
shuffled.  A benchmark above ``MAX_BLOCK_BYTES`` is cut into blocks that are scanned one after the
other, so that the driver and a worker hold one block at any size of the benchmark.  A pass reads the texts and
writes what it found in those that hold a window, by the text's SHA-256 digest (equal digests are taken as equal
texts); the last pass joins all of it to the documents, so no pass writes the documents themselves.

Defined results: a null or empty text has no words and no hits; an item without words has no window;
items that repeat are found each; items without an id count as one, which has no name; very long texts are
scanned whole; repeated documents are judged alike; an empty benchmark leaves every document clean; columns
of ``docs`` whose names begin with two underscores are renamed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import plain_columns, table, written

#: Words of a window.
WINDOW = 10
#: Benchmark text of one broadcast block, in bytes: above it, more blocks are made.  A block takes about twenty
#: times that in memory while it is made, and ten times kept.
MAX_BLOCK_BYTES = 8 << 20
#: What all blocks but the last found is broadcast up to so many bytes; above, it is joined by a shuffle, and each
#: text is dealt over so many tasks.
MAX_FOUND_BYTES, SALTS = 8 << 20, 16
#: Document text that a task handles at a time, in bytes (one document may be longer).
SLICE_BYTES = 2 << 20

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Lower-cases A-Z and blanks what is no word character; UTF-8 bytes beyond ASCII stay.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

HITS = "array<struct<start:int,end:int>>"


def words_in(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def rolled(columns: np.ndarray, length: int, base: int) -> np.ndarray:
    """Polynomial hash of rows of ids, given as their columns, modulo 2**64."""
    out = np.zeros(columns.shape[1], np.uint64)
    for j in range(length):
        out *= np.uint64(base)
        out += columns[j]
    return out


class Windows:
    """Hashed windows of one block of the benchmark, in arrays."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        give = self.vocabulary.setdefault
        self.item_ids = [x for x, _ in items]
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for k, (_, text) in enumerate(items):
            ids = np.array([give(w, len(self.vocabulary) + 1) for w in words_in(text)], np.uint32)
            length = min(window, len(ids))
            if length:
                rows = np.lib.stride_tricks.sliding_window_view(ids, length)
                parts.setdefault(length, []).append((rows, np.full(len(rows), k, np.int32)))
        self.by_length = []
        for length in sorted(parts):
            rows = np.concatenate([r for r, _ in parts[length]])
            owners = np.concatenate([o for _, o in parts.pop(length)])
            base = 0x9E3779B97F4A7C15
            while True:
                hashes = rolled(rows.T, length, base)
                order = np.lexsort((owners, hashes))
                hashes, rows, owners = hashes[order], rows[order], owners[order]
                same = hashes[1:] == hashes[:-1]
                if (rows[1:][same] == rows[:-1][same]).all():
                    break
                base = (base * 6364136223846793005 + 1442695040888963407) % (1 << 64) | 1
            # One row a window, and where its owners begin; an owner once.
            new = np.append(True, ~same)
            keep = new | np.append(True, owners[1:] != owners[:-1])
            first = np.flatnonzero(new[keep])
            self.by_length.append((length, base, hashes[new], rows[new], np.append(first, keep.sum()), owners[keep]))

    def owners(self, at: int, window: int) -> list[int]:
        """Places of the items that hold a window."""
        _, _, _, _, first, owners = self.by_length[at]
        return owners[first[window] : first[window + 1]].tolist()

    def search(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """Hits as (start, length, index of the length, window); unknown words part the windows."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint32, len(words))
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        hits = []
        for at, (length, base, hashes, rows, _, _) in enumerate(self.by_length):
            if len(ids) < length:
                continue
            starts = np.flatnonzero(unknown[length:] == unknown[:-length])
            if not len(starts):
                continue
            wanted = rolled(np.lib.stride_tricks.sliding_window_view(ids, length).T, length, base)[starts]
            place = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
            sure = hashes[place] == wanted
            starts, place = starts[sure], place[sure]
            if len(starts):
                sure = (ids[starts[:, None] + np.arange(length)] == rows[place]).all(1)
                hits += [(int(s), length, at, int(p)) for s, p in zip(starts[sure], place[sure])]
        return hits


def covered(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal ranges that cover the given (start, length)."""
    out: list[tuple[int, int]] = []
    for start, length in sorted(hits):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], start + length))
        else:
            out.append((start, start + length))
    return out


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """The rows of a batch in runs of about ``SLICE_BYTES`` of text, with the texts as bytes."""
    column = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
    lengths = np.nan_to_num(np.asarray(pc.binary_length(column).to_numpy(zero_copy_only=False), float))
    group = (np.cumsum(lengths) // SLICE_BYTES).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a), column.slice(a, b - a).to_pylist()


def scan_block(docs: DataFrame, block: Broadcast) -> DataFrame:
    """``docs`` with the ranges, items and words found so far, completed by one block."""
    first = "__hits" not in docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = block.value
        for batch in batches:
            for rows, texts in slices(batch):
                words: list[bytes] = []
                starts = [0]
                for text in texts:
                    words += words_in(text)
                    words.append(b" ")  # no word: parts the documents
                    starts.append(len(words))
                own: list[list[tuple[int, int]]] = [[] for _ in texts]
                items: list[set[int | None]] = [set() for _ in texts]
                hits = windows.search(words)
                places = np.searchsorted(starts, [h[0] for h in hits], side="right") - 1
                for (start, length, at, window), k in zip(hits, places.tolist()):
                    own[k].append((start - starts[k], length))
                    items[k].update(windows.item_ids[i] for i in windows.owners(at, window))
                if not first:
                    for k, (ranges, names) in enumerate(
                        zip(rows.column("__hits").to_pylist(), rows.column("__items").to_pylist())
                    ):
                        own[k] += [(x["start"], x["end"] - x["start"]) for x in ranges]
                        items[k].update(names)
                base = rows.select([c for c in rows.schema.names if c not in ("__n_words", "__hits", "__items")])
                yield pa.RecordBatch.from_arrays(
                    [
                        *base.columns,
                        pa.array(np.diff(starts) - 1, pa.int64()),
                        pa.array(
                            [[{"start": a, "end": b} for a, b in covered(x)] for x in own],
                            pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
                        ),
                        pa.array([sorted(x, key=lambda i: (i is not None, i)) for x in items], pa.list_(pa.int64())),
                    ],
                    [*base.schema.names, "__n_words", "__hits", "__items"],
                )

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if not f.name.startswith("__")]
    return docs.mapInArrow(scan, ", ".join([*kept, "`__n_words` bigint", f"`__hits` {HITS}", "`__items` array<bigint>"]))


def blocks(benchmark: DataFrame, max_block_bytes: int = MAX_BLOCK_BYTES) -> tuple[int, Callable[[int], Broadcast]]:
    """How many blocks the benchmark is cut into by the items' hashes, and what makes and broadcasts one of them."""
    context = benchmark.sparkSession.sparkContext
    sized = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    ).where(F.length("text") > 0)
    total = sized.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    count = max(1, -(-total // max_block_bytes))

    def block(k: int) -> Broadcast:
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()
        items = [(r["item_id"], r["text"].encode()) for r in rows]
        return context.broadcast(Windows(sorted(items, key=lambda x: (x[0] is not None, x))))

    return count, block


def found_by_text(docs: DataFrame, block: Broadcast) -> DataFrame:
    """(__of, __hits, __items) of the different texts that hold a window of a block, known by their digests."""
    hit = scan_block(docs.select("text"), block).where(F.size("__hits") > 0)
    return hit.select(digest().alias("__of"), "__hits", "__items").dropDuplicates(["__of"])


def digest() -> Column:
    return F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))


def with_found(docs: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """``docs`` with what the given blocks found, joined once.  A text is in a block's table once, so a group has a row a block at most."""
    every = reduce(DataFrame.unionByName, tables)
    one = written(every.groupBy("__of").agg(F.flatten(F.collect_list("__hits")).alias("__hits"), F.flatten(F.collect_list("__items")).alias("__items")))
    size = one.agg(F.sum(64 + 8 * F.size("__hits") + 8 * F.size("__items"))).first()[0] or 0
    if size <= MAX_FOUND_BYTES:
        joined = docs.withColumn("__text_of", digest()).join(F.broadcast(one), F.col("__text_of") == F.col("__of"), "left")
    else:
        # A text may be a third of all rows: each is dealt over several tasks.
        salted = docs.withColumns({"__text_of": digest(), "__salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))})
        copies = one.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, (F.col("__text_of") == F.col("__of")) & (F.col("__salt") == F.col("__copy")), "left")
    return joined.select(
        *docs.columns,
        F.coalesce("__hits", F.array().cast(HITS)).alias("__hits"),
        F.coalesce("__items", F.array().cast("array<bigint>")).alias("__items"),
    )


def scan(docs: DataFrame, benchmark: DataFrame, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``__n_words``, ``__hits`` (word ranges) and ``__items`` (ids of items found)."""
    docs = plain_columns(docs)
    count, block = blocks(benchmark, max_block_bytes)
    tables = []
    for k in range(count - 1):
        own = block(k)
        tables.append(written(found_by_text(docs, own)))
        own.destroy()
    return scan_block(with_found(docs, tables) if tables else docs, block(count - 1))


def cut(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the words of the given ranges."""
    data = text.encode()
    words = [m.span() for m in WORD.finditer(data.lower())]
    out, at = [], 0
    for start, end in ranges:
        out.append(data[at : words[start][0]])
        at = words[end - 1][1]
    return (b"".join([*out, data[at:]])).decode()


def cleaned(found: DataFrame, block: Broadcast | None) -> DataFrame:
    """Texts of a scan with the words of ``__hits`` cut out; what is left without words goes.

    With the one block of the benchmark, each text is searched again until no window is left.
    """
    columns = [c for c in found.columns if not c.startswith("__")]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column("__hits")
            hit = np.flatnonzero(pc.list_value_length(hits).to_numpy(zero_copy_only=False))
            texts = batch.column("text")
            if len(hit):
                values = texts.to_pylist()
                for k in hit.tolist():
                    ranges = [(x["start"], x["end"]) for x in hits[k].as_py()]
                    while ranges:
                        values[k] = cut(values[k], ranges)
                        words = words_in(values[k].encode())
                        ranges = covered([h[:2] for h in block.value.search(words)]) if block else []
                    if not words:
                        values[k] = None
                texts = pa.array(values, texts.type)
            gone = np.zeros(batch.num_rows, bool)
            gone[[k for k in hit.tolist() if not texts[k].is_valid]] = True
            out = pa.RecordBatch.from_arrays(
                [texts if c == "text" else batch.column(c) for c in columns], columns
            )
            yield out.filter(pa.array(~gone))

    return found.mapInArrow(clean, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name in columns))


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """``docs`` with the benchmark's passages cut out of the texts; what is left without words goes.

    A cut can bring words together that form another window, so a cut text is searched again until
    no window is left.
    """
    docs = plain_columns(docs)
    count, block = blocks(benchmark, max_block_bytes)
    if count == 1:
        own = block(0)
        done = cleaned(scan_block(docs, own), own)
    else:
        done, left = None, docs
        while done is None or not left.isEmpty():
            found = written(scan(left, benchmark, max_block_bytes))
            clean = found.where(F.size("__hits") == 0).select(*docs.columns)
            done = clean if done is None else done.unionByName(clean)
            left = written(cleaned(found.where(F.size("__hits") > 0), None))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.sort_array(F.transform("__items", lambda x: x.cast("string"))), ",")
    n_hit = F.aggregate("__hits", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.encode(names, "UTF-8"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


#: The query in DuckDB's SQL.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
  FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
  FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM di),
h AS (SELECT doc_id, item_id, dw.n, i FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
