"""Repeats of twenty words by compressed FM-indexes, one a shard.

A shard holds the passages that may repeat one another.  Passages are dealt by content: the trigger of a
window of twenty words is its six words of the least hash, and a passage is the longest run of windows
that share one trigger (about eight).  Equal windows have equal triggers, so they meet in one shard, however
large the corpus is, and no document is searched in every shard.

1. Each task parses its documents into passages.  A trigger that has one passage only, by a 128-bit digest of
   its words, needs no search: its first place stays, and further places of this passage are repeats.
2. Triggers that have several different passages are searched.  The passages of a shard, in corpus order, are
   indexed: their suffixes are sorted by twenty words, which is as deep as any search goes, and the word before
   each suffix goes into a wavelet matrix of bit vectors with counts.  The passages are then streamed through the
   index by backward search, all ends at once: from each end to the left, an interval is narrowed word by word
   while it holds two suffixes or more.  How many words it took is the matching statistic of that end; ends that
   reach twenty words are reported with their interval.  One interval is one sequence of words, so in it the first
   place in corpus order stays and the others are repeats.
3. The repeated windows of a document, twenty words each, make up the removed words.

Tasks search their own part of a shard before the shuffle, so a window meets in a later task once for each part
before it.  A shard is bounded: triggers are taken in turn until it holds ``SHARD_BYTES``; a trigger of very many
passages is cut into its windows, which are dealt by their own hash, so no trigger makes a large task.

Defined results: a null text counts as empty; a text below twenty words loses nothing.  A row is known by its id
and its text: rows without an id come before all others, rows that share an id but not the text are documents of
their own, ordered by the XXH64 of the text, and rows that repeat both get the same result and do not repeat one
another.  A very long text is parsed in stretches that overlap by a window.  Other columns of any name are not
looked at.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import table, written
from cinelake.llm.exact_repeats import (
    CHUNK,
    HOT,
    OPEN,
    ORDER,
    PLACES,
    RANKED,
    REPEATED,
    ROWS,
    compared,
    identified,
    ranked,
    runs,
    settle,
    sliding_least,
    starts_of,
    texts_of,
)
from cinelake.llm.hashing import RollingHash

#: Words of a window, and of a trigger within it.
WINDOW, TRIGGER = 20, 6
#: Windows that are parsed at a time; their number fits into the lower bits of a keyed hash.
STRETCH = 1 << 18
#: Bytes of passages that one index holds, but for a single trigger's.
SHARD_BYTES = 4_000_000
#: Seed of the rolling hash.
SEED = 20_261_128


def words_of(text: bytes) -> list[bytes]:
    """Words between the six ASCII white-space characters."""
    return text.split()


def parse(words: list[bytes], rolling: RollingHash) -> tuple[np.ndarray, ...]:
    """Passages of a stretch as (trigger hash, two halves of the digest, first window, number of windows)."""
    joined = b" ".join(words)
    data = np.frombuffer(joined, np.uint8)
    spaces = np.flatnonzero(data == 32)
    starts, ends = np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(data)]))
    n = len(words) - WINDOW + 1
    hashes = rolling.range(rolling(data), starts[: 1 - TRIGGER], ends[TRIGGER - 1 :])
    at = np.arange(len(hashes), dtype=np.uint64)
    # The upper bits decide which words are the trigger, the lower ones hold its place: of equal ones the first.
    low = np.uint64((1 << 22) - 1)
    trigger = (sliding_least((hashes & ~low) | at, WINDOW - TRIGGER + 1) & low).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(trigger)) + 1))
    end = np.concatenate((first[1:], [n]))
    own = trigger[first]
    bounds = zip(starts[first].tolist(), ends[end + WINDOW - 2].tolist(), (own - first).tolist())
    digest = hashlib.blake2b
    entry = b"".join([digest(joined[i:j], digest_size=16, salt=PLACES[k]).digest() for i, j, k in bounds])
    halves = np.frombuffer(entry, np.int64).reshape(-1, 2)
    return hashes[own].view(np.int64), halves[:, 0], halves[:, 1], first, end - first


def passages(docs: DataFrame) -> DataFrame:
    """The passages of all documents, as far as each task can settle them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = RollingHash(SEED)
        pending: list[tuple[np.ndarray, ...]] = []
        count = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                for doc, tie, text in texts_of(batch.slice(k, 64)):
                    words = words_of(text)
                    for at in range(0, len(words) - WINDOW + 1, STRETCH):
                        *hashes, first, n = parse(words[at : at + STRETCH + WINDOW - 1], rolling)
                        pending.append((*hashes, np.full(len(first), doc), np.full(len(first), tie), first + at, n))
                        count += len(first)
                        if count >= CHUNK:
                            yield from settle(*map(np.concatenate, zip(*pending)))
                            pending, count = [], 0
        if pending:
            yield from settle(*map(np.concatenate, zip(*pending)))

    return docs.mapInArrow(run, ROWS)


class WaveletMatrix:
    """Counts of each number below any place of a sequence, from one bit vector a binary digit."""

    def __init__(self, values: np.ndarray) -> None:
        self.digits = max(1, int(values.max(initial=0)).bit_length())
        self.size = len(values)
        self.bits: list[np.ndarray] = []
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for digit in range(self.digits - 1, -1, -1):
            set_ = (values >> digit & 1).astype(bool)
            packed = np.packbits(set_, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view("<u8")
            self.bits.append(packed)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(len(values) - np.count_nonzero(set_)))
            values = np.concatenate([values[~set_], values[set_]])

    def count_ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits below ``at``."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[level][word] + np.bitwise_count(self.bits[level][word] & below)

    def rank(self, value: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often ``value`` stands below ``low`` and below ``high``, for each of the three."""
        first = np.zeros(len(value), np.int64)
        for level in range(self.digits):
            digit = (value >> (self.digits - 1 - level) & 1).astype(bool)
            a, b, c = (self.count_ones(level, x) for x in (first, low, high))
            zeros = self.zeros[level]
            first, low, high = (np.where(digit, zeros + k, x - k) for x, k in ((first, a), (low, b), (high, c)))
        return low - first, high - first


class FMIndex:
    """Backward search for sequences of up to ``depth`` numbers in a sequence in which 0 parts the passages."""

    def __init__(self, text: np.ndarray, depth: int = WINDOW) -> None:
        self.depth = depth
        order = self.sorted_suffixes(text, depth)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text))))
        self.before = WaveletMatrix(text[order - 1])  # a rotation: the last number stands before the first

    @staticmethod
    def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
        """Places by the ``depth`` numbers from them on, zeros after the end (ranks of doubled length)."""
        bits = (len(text) + 1).bit_length()
        rank, reach = text.astype(np.uint64), 1
        while reach < depth:
            step = min(reach, depth - reach)
            ahead = np.concatenate([rank[step:] + np.uint64(1), np.zeros(step, np.uint64)])
            rank, reach = ranked(rank << np.uint64(bits) | ahead, bits), reach + step
        return np.argsort(rank, kind="stable")

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, interval) for each end: how many numbers up to it occur twice or more, and the start of their suffixes.

        The length stops at the index's depth.  Intervals of one length are equal only for equal sequences.
        """
        length, found = np.zeros(len(ends), np.int32), np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(text), np.int64)
        open_ = np.arange(len(ends))
        for k in range(self.depth):
            value = text[ends[open_] - k]
            a, b = self.before.rank(value, low, high)
            low, high = self.first[value] + a, self.first[value] + b
            go = (high - low >= 2) & (value > 0)
            open_, low, high = open_[go], low[go], high[go]
            length[open_], found[open_] = k + 1, low
            if not len(open_):
                break
        return length, found


#: A passage, or a part of one: (dealt, hot, doc, tie, at, words).
Piece = tuple[int, bool, int, int, int, list[bytes]]


def searched(pieces: list[Piece]) -> tuple[tuple[np.ndarray, ...], list[Piece]]:
    """Repeated windows among the pieces of a shard, as runs of places, and what is left of the pieces."""
    pieces.sort(key=lambda x: x[2:5])
    numbers: dict[bytes, int] = {}
    text: list[int] = []
    for piece in pieces:
        text.extend([numbers.setdefault(w, len(numbers) + 1) for w in piece[5]])
        text.append(0)
    whole = np.array(text, np.int64)
    n = np.fromiter((len(x[5]) - WINDOW + 1 for x in pieces), np.int64, len(pieces))
    owner = np.repeat(np.arange(len(pieces)), n)
    inner = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    starts = (np.cumsum(n + WINDOW) - n - WINDOW)[owner] + inner
    length, interval = FMIndex(whole).matching_statistics(whole, starts + WINDOW - 1)
    hit = np.flatnonzero(length == WINDOW)
    doc, tie, at = (np.array([x[k] for x in pieces], np.int64)[owner] for k in (2, 3, 4))
    at = at + inner
    # Pieces lie in corpus order, so the first of each interval is the first in the corpus.
    hit = hit[np.argsort(interval[hit], kind="stable")]
    new = starts_of(interval[hit])
    same_place = ~starts_of(interval[hit], doc[hit], tie[hit], at[hit])
    again = hit[~new & ~same_place]
    stays = np.ones(len(owner), bool)
    stays[hit[~new]] = False
    kept = np.flatnonzero(stays)
    begin = np.flatnonzero((np.diff(kept, prepend=-2) != 1) | (np.diff(owner[kept], prepend=-1) != 0))
    left = []
    for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(kept)]):
        dealt, hot, d, t, a, words = pieces[owner[kept[i]]]
        k = int(inner[kept[i]])
        left.append((dealt, hot, d, t, a + k, words[k : k + j - i + WINDOW - 1]))
    return (doc[again], tie[again], at[again], np.ones(len(again), np.int64)), left


PIECES = "dealt long, doc long, tie long, at int, n int, words binary"


def batches_of(found: tuple[np.ndarray, ...], pieces: list[Piece]) -> Iterator[pa.RecordBatch]:
    """Repeated places (with ``n`` and no words), and pieces (with words)."""
    names = ["dealt", "doc", "tie", "at", "n", "words"]
    doc, tie, at, n = runs(*found)
    columns = [doc, doc, tie, at.astype(np.int32), n.astype(np.int32)]
    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(doc), pa.binary())], names)
    if pieces:
        dealt, _, doc, tie, at, words = zip(*pieces)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        columns = [dealt, doc, tie, at, [0] * len(at), [b" ".join(w) for w in words]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def dealt_out(pieces: list[Piece]) -> Iterator[Piece]:
    """Pieces by their trigger; those of a hot trigger are cut into windows that are dealt by their own hash."""
    for piece in pieces:
        _, hot, doc, tie, at, words = piece
        if not hot:
            yield piece
            continue
        for k in range(len(words) - WINDOW + 1):
            window = words[k : k + WINDOW]
            own = hashlib.blake2b(b" ".join(window), digest_size=8).digest()
            yield int.from_bytes(own, "big", signed=True), hot, doc, tie, at + k, window


def searched_here(joined: DataFrame) -> DataFrame:
    """The passages that must be searched, less what a task's own index shows to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[Piece] = []
        size = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                for (doc, tie, text), wanted in zip(texts_of(part), part.column("wanted").to_pylist()):
                    words = words_of(text)
                    for x in wanted:
                        own = words[x["at"] : x["at"] + x["n"] + WINDOW - 1]
                        pieces.append((x["key"], x["hot"], doc, tie, x["at"], own))
                        size += sum(map(len, own))
                        if size >= SHARD_BYTES:
                            found, left = searched(pieces)
                            yield from batches_of(found, list(dealt_out(left)))
                            pieces, size = [], 0
        if pieces:
            found, left = searched(pieces)
            yield from batches_of(found, list(dealt_out(left)))

    return joined.mapInArrow(run, PIECES)


def searched_in_shards(pieces: DataFrame) -> DataFrame:
    """Repeated windows (doc, tie, at, n); ``pieces`` must be sorted within partitions by ``dealt``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "tie", "at", "n"]
        held: list[Piece] = []
        size, limit = 0, SHARD_BYTES

        def handed(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            doc, tie, at, n = runs(*found)
            columns = [doc, tie, at.astype(np.int32), n.astype(np.int32)]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns)], names)

        for batch in batches:
            done = pc.is_null(batch.column("words"))
            yield batch.filter(done).select(names)
            rows = batch.filter(pc.invert(done))
            for dealt, doc, tie, at, text in zip(*(rows.column(c).to_pylist() for c in ("dealt", "doc", "tie", "at", "words"))):
                if size >= limit:
                    last = held[-1][0]
                    found, held = searched(held)
                    yield handed(found)
                    # Other triggers are complete; what is left of this one meets the rest of it.
                    held = [x for x in held if x[0] == last == dealt]
                    size = sum(len(w) for x in held for w in x[5])
                    limit = max(SHARD_BYTES, 2 * size)
                held.append((dealt, False, doc, tie, at, text.split(b" ")))
                size += len(text)
        if held:
            yield handed(searched(held)[0])

    return pieces.mapInArrow(run, "doc long, tie long, at int, n int")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc, tie, at, n): runs of windows whose words start earlier in the corpus too.  ``docs``: (doc, tie, text)."""
    place = F.when(F.col("kind") == OPEN, F.col("key")).otherwise(F.xxhash64("doc", "tie"))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    settled = written(compared(passages(docs).repartition(width, place).sortWithinPartitions("key", "entry", "check", *ORDER)))
    hot = settled.where(F.col("kind") == HOT).select("key", F.lit(True).alias("hot")).distinct()
    wanted = (
        settled.where(F.col("kind") == RANKED)
        .join(hot, "key", "left")
        .groupBy("doc", "tie")
        .agg(F.collect_set(F.struct("key", "at", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))
    )
    pieces = searched_here(docs.join(wanted, ["doc", "tie"]).select("doc", "tie", "text", "wanted"))
    return (
        settled.where(F.col("kind") == REPEATED)
        .select(*ORDER, "n")
        .union(searched_in_shards(pieces.repartition(width, "dealt").sortWithinPartitions("dealt")))
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, kept, removed): the words left of every text, and the removed runs of words [start, end)."""
    source = identified(docs)
    gathered = repeated_windows(source.drop("doc_id")).groupBy("doc", "tie").agg(F.collect_list(F.struct("at", "n")).alias("starts"))
    joined = source.join(gathered, ["doc", "tie"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                sizes, kept, removed = [], [], []
                for (_, _, text), starts in zip(texts_of(part), part.column("starts").to_pylist()):
                    words = words_of(text)
                    spans: list[list[int]] = []
                    for at, n in sorted((x["at"], x["n"]) for x in starts or ()):
                        end = at + n + WINDOW - 1
                        if spans and at <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], end)
                        else:
                            spans.append([at, end])
                    edges = [0, *(e for s in spans for e in s), len(words)]
                    sizes.append(len(words))
                    kept.append(b" ".join([w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]))
                    removed.append([{"start": a, "end": b} for a, b in spans])
                span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
                columns = [pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(span))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_words", "kept", "removed"])

    return joined.mapInArrow(run, "doc_id long, n_words long, kept binary, removed array<struct<start:int,end:int>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", size.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
    )


SQL = f"""WITH d AS MATERIALIZED (SELECT doc_id, [w for w in string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if w <> ''] AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
r AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM r, range({WINDOW}) t(j)),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT p.doc_id, count(c.p) AS n, string_agg(word, ' ' ORDER BY p.p) FILTER (c.p IS NULL) AS kept
  FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.p = p.p GROUP BY p.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""
