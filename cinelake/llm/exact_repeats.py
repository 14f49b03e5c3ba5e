"""Exact repeats of 100 bytes by prefix-free parsing.

A rolling hash triggers phrases: the trigger of a 100-byte string is its 24-byte piece of the least
hash, and a phrase is the longest stretch of text whose 100-byte strings share one trigger.  The parse
of a document is a row a phrase, about one in forty bytes, and the dictionary is the set of distinct
phrases.  No phrase suffix of 100 bytes is a proper prefix of another, and equal 100-byte strings have
equal triggers at equal places, so the corpus order of the 100-byte prefixes of all suffixes follows from
the order of the dictionary and the order of the parse:

1. Phrases with the same trigger meet.  If all of them are one and the same entry of the dictionary, the
   parse's order of that entry (by document and place) says which is first; all others are repeats.
   Copies are settled at the price of their phrases.
2. Where different entries share a trigger, the suffix array of these entries is built by prefix doubling
   (the ranks of 8 bytes are their letters; those of 16, 32, 64 and 100 bytes are pairs of ranks), which
   compares whole bytes.  Within a rank the parse's order says which suffix is first.
3. The repeated starts of a document, each covering 100 bytes, make up the removed runs.

Each task settles what its own rows decide before the shuffle: repeats of an entry, triggers that it sees
with several entries, and suffixes that its own part of the dictionary repeats.  A trigger, entry or string
therefore meets in a later task at most once for each chunk before it, however often it occurs.  A trigger
of very many different entries is cut into its 100-byte strings, which are dealt by their own hash, so no
trigger makes a large task.

Phrases are known as one entry by 128-bit BLAKE2b digests of their bytes and of the trigger's place;
everything else is compared byte by byte.

Defined results: a null text counts as empty; a text below 100 bytes loses nothing.  A row is known by its
id and its text: rows without an id come before all others, rows that share an id but not the text are
documents of their own, ordered by the XXH64 of the text, and rows that repeat both get the same result and
do not repeat one another.  Other columns of any name are not looked at.  An empty table gives no rows.
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
from cinelake.llm.hashing import RollingHash

#: Bytes of a repeated string, and of a trigger within it.
LENGTH, TRIGGER = 100, 24
#: Bytes of text that are parsed at a time; a longer document is parsed in stretches that overlap.
SLICE_BYTES = 2 << 20
#: Phrases, or suffixes, that a task compares with one another before it hands them on.
CHUNK = 400_000
#: Bytes of dictionary entries whose suffixes are sorted at a time.
SORT_BYTES = 2_000_000
#: Seed of the rolling hash.
SEED = 20_240_601
#: Entries of one trigger after which they are dealt by 100-byte string.  At most phrases / HOT_ENTRIES triggers are.
HOT_ENTRIES = 8192
#: What a row says: to be compared by trigger, or settled as repeated, or its suffixes to be ranked, or that
#: its trigger has more than HOT_ENTRIES entries to be ranked.
OPEN, REPEATED, RANKED, HOT = 0, 1, 2, 3
NO_ID = -(1 << 63)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours: of a block's tail and the next block's head."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


def stretches(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) such that every 100-byte string lies in one stretch."""
    for at in range(0, len(text) - LENGTH + 1, SLICE_BYTES):
        yield at, text[at : at + SLICE_BYTES + LENGTH - 1]


def parse(stretch: bytes, rolling: RollingHash) -> tuple[np.ndarray, ...]:
    """Phrases as (trigger hash, two halves of the entry's digest, first start, number of starts)."""
    data = np.frombuffer(stretch, np.uint8)
    n = len(data) - LENGTH + 1
    sums = rolling(data)
    at = np.arange(len(data) - TRIGGER + 1)
    hashes = rolling.range(sums, at, at + TRIGGER)
    # The upper bits decide which piece is the trigger, the lower ones hold its place: of equal ones the first.
    keyed = (hashes & ~np.uint64((1 << 22) - 1)) | at.astype(np.uint64)
    trigger = (sliding_least(keyed, LENGTH - TRIGGER + 1) & np.uint64((1 << 22) - 1)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(trigger)) + 1))
    end = np.concatenate((first[1:], [n]))
    own = trigger[first]
    digest = hashlib.blake2b
    # One salt for each place of the trigger; the length of the bytes says how many starts there are.
    bounds = zip(first.tolist(), (end + LENGTH - 1).tolist(), (own - first).tolist())
    entry = b"".join([digest(stretch[i:j], digest_size=16, salt=PLACES[k]).digest() for i, j, k in bounds])
    halves = np.frombuffer(entry, np.int64).reshape(-1, 2)
    return hashes[own].view(np.int64), halves[:, 0], halves[:, 1], first, end - first


#: Salts of the digests, by the place of the trigger in the phrase.
PLACES = [k.to_bytes(2, "big") for k in range(2 * LENGTH)]

FIELDS = ["kind", "key", "entry", "check", "doc", "tie", "at", "n"]
ROWS = "kind int, key long, entry long, check long, doc long, tie long, at int, n int"
TYPES = [pa.int32(), *[pa.int64()] * 5, pa.int32(), pa.int32()]
#: Columns of a row's place in the corpus, in their order.
ORDER = ["doc", "tie", "at"]


def batch_of(kind: int, key, entry, check, doc, tie, at, n) -> pa.RecordBatch:
    columns = [np.full(len(key), kind), key, entry, check, doc, tie, at, n]
    return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, TYPES)], FIELDS)


def places(kind: int, key, doc, tie, at, n) -> pa.RecordBatch:
    """Rows whose entry no longer counts."""
    none = np.zeros(len(doc), np.int64)
    return batch_of(kind, none if key is None else key, none, none, doc, tie, at, n)


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def settle(key, entry, check, doc, tie, at, n) -> Iterator[pa.RecordBatch]:
    """What phrases of one task decide among themselves, and what is left to be compared.

    A row of ``n`` 0 tells the later task that this one has seen the key with several entries: ``entry`` many.
    """
    order = np.lexsort((at, tie, doc, check, entry, key))
    key, entry, check, doc, tie, at, n = (x[order] for x in (key, entry, check, doc, tie, at, n))
    new = starts_of(key, entry, check)
    again = starts_of(key, entry, check, doc, tie, at) & ~new
    if again.any():
        yield places(REPEATED, None, *runs(doc[again], tie[again], at[again], n[again]))
    key, entry, check, doc, tie, at, n = (x[new] for x in (key, entry, check, doc, tie, at, n))
    first = starts_of(key)
    size = np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1] if len(key) else n
    several = size > 1
    if several.any():
        yield places(RANKED, *(x[several] for x in (key, doc, tie, at, n)))
    one = ~several
    yield batch_of(OPEN, *(x[one] for x in (key, entry, check, doc, tie, at, n)))
    mark = several & first
    yield batch_of(OPEN, key[mark], size[mark], check[mark] * 0, doc[mark], tie[mark], at[mark], n[mark] * 0)


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, tie, text): ``doc`` has null ids before all others, ``tie`` is the hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.col("doc_id").cast("long")
    return docs.select(
        own.alias("doc_id"),
        F.coalesce(own, F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text, own.isNull()).alias("tie"),
        text.alias("text"),
    )


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    return zip(
        batch.column("doc").to_pylist(), batch.column("tie").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
    )


def phrases(docs: DataFrame) -> DataFrame:
    """The parse of all documents, as far as each task can settle it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = RollingHash(SEED)
        pending: list[tuple[np.ndarray, ...]] = []
        count = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                for doc, tie, text in texts_of(batch.slice(k, 64)):
                    for offset, stretch in stretches(text):
                        *hashes, first, n = parse(stretch, rolling)
                        size = len(first)
                        pending.append((*hashes, np.full(size, doc), np.full(size, tie), first + offset, n))
                        count += size
                        if count >= CHUNK:
                            yield from settle(*map(np.concatenate, zip(*pending)))
                            pending, count = [], 0
        if pending:
            yield from settle(*map(np.concatenate, zip(*pending)))

    return docs.mapInArrow(run, ROWS)


def runs(doc: np.ndarray, tie: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Adjacent starts of a document as one row."""
    order = np.lexsort((at, tie, doc))
    doc, tie, at, n = doc[order], tie[order], at[order], n[order]
    new = starts_of(doc, tie)
    new[1:] |= at[1:] != at[:-1] + n[:-1]
    where = np.flatnonzero(new)
    return doc[where], tie[where], at[where], np.add.reduceat(n, where) if len(where) else n


def compared(rows: DataFrame) -> DataFrame:
    """Settles the open rows of each key; ``rows`` must be sorted within partitions by key, entry, check and place.

    If a key has one entry, its first place stays and the others are repeated; with several entries all of them
    are to be ranked.  A key has as many rows as there are chunks at most, and they are held together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        found: list[tuple[np.ndarray, ...]] = []

        def handed() -> pa.RecordBatch:
            out = places(REPEATED, None, *runs(*map(np.concatenate, zip(*found))))
            found.clear()
            return out

        def by_key(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            _, key, entry, check, doc, tie, at, n = columns
            first = starts_of(key)
            group = np.cumsum(first) - 1
            new = starts_of(key, entry, check)
            real = n > 0
            several = (np.bincount(group, weights=new) > 1) | (np.bincount(group, weights=~real) > 0)
            ranked = several[group] & real
            if ranked.any():
                yield places(RANKED, *(x[ranked] for x in (key, doc, tie, at, n)))
            hot = (several & (np.bincount(group, weights=np.where(real, 1, entry)) > HOT_ENTRIES))[group] & first
            if hot.any():
                yield places(HOT, *(x[hot] for x in (key, doc, tie, at, n)))
            # In a group of one entry all but the first place are repeated.
            other = ~several[group] & ~first & starts_of(key, doc, tie, at)
            found.append((doc[other], tie[other], at[other], n[other]))

        for batch in batches:
            settled = pc.not_equal(batch.column("kind"), OPEN)
            passed = batch.filter(settled)
            if passed.num_rows:
                yield passed
            left = batch.filter(pc.invert(settled))
            if not left.num_rows:
                continue
            columns = [left.column(c).to_numpy() for c in FIELDS]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            start = int(np.flatnonzero(starts_of(columns[1]))[-1])
            held = [c[start:] for c in columns]
            if start:
                yield from by_key([c[:start] for c in columns])
            if sum(len(x[0]) for x in found) >= CHUNK:
                yield handed()
        if held is not None:
            yield from by_key(held)
        if found:
            yield handed()

    return rows.mapInArrow(run, ROWS)


def ranked(values: np.ndarray, bits: int) -> np.ndarray:
    """Rank of each value among the different ones; ``bits`` are enough for a place."""
    if bits + int(values.max()).bit_length() > 64:
        return np.unique(values, return_inverse=True)[1].astype(np.uint64)
    # Sorting value and place as one number is much faster than sorting places by value.
    packed = np.sort(values << np.uint64(bits) | np.arange(len(values), dtype=np.uint64))
    out = np.empty(len(values), np.uint64)
    number = np.cumsum(starts_of(packed >> np.uint64(bits)), dtype=np.uint64) - np.uint64(1)
    out[packed & np.uint64((1 << bits) - 1)] = number
    return out


def suffix_ranks(data: np.ndarray) -> np.ndarray:
    """Rank of the 100 bytes from each place of ``data`` on among all of them, by letter (prefix doubling)."""
    bits = len(data).bit_length()
    letters = data.astype(np.uint64)
    rank = np.zeros(len(data) - 3, np.uint64)
    for k in range(4):
        rank = rank << np.uint64(8) | letters[k : k + len(rank)]
    # How far the second half lies behind the first: 4, 8, 16, 32, 64, 100 bytes.
    for ahead in (0, 4, 8, 16, 32, LENGTH - 64):
        if ahead:
            rank = rank[:-ahead] << np.uint64(bits) | rank[ahead:]
        rank = ranked(rank, bits)
    return rank.astype(np.int64)


#: A stretch of a dictionary entry at its first place: (dealt, key, hot, doc, tie, at, bytes).
Piece = tuple[int, int, bool, int, int, int, bytes]


def combine(pieces: list[Piece]) -> tuple[tuple[np.ndarray, ...], list[Piece]]:
    """Repeated starts among some pieces, as runs of places, and what is left of the pieces."""
    pieces.sort(key=lambda x: x[3:6])
    data = np.frombuffer(b"".join(x[6] for x in pieces), np.uint8)
    size = np.fromiter((len(x[6]) for x in pieces), np.int64, len(pieces))
    n = size - LENGTH + 1
    owner = np.repeat(np.arange(len(pieces)), n)
    inner = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    rank = suffix_ranks(data)[(np.cumsum(size) - size)[owner] + inner]
    doc, tie, at = (np.array([x[k] for x in pieces], np.int64)[owner] for k in (3, 4, 5))
    at = at + inner
    # Pieces lie in corpus order, so the first of each rank is the first in the corpus.
    order = np.argsort(rank, kind="stable")
    new = np.zeros(len(order), bool)
    new[order] = starts_of(rank[order])
    again = np.zeros(len(order), bool)
    again[order] = starts_of(rank[order], doc[order], tie[order], at[order])
    again &= ~new
    one = np.ones(int(again.sum()), np.int64)
    kept = np.flatnonzero(new)
    begin = np.flatnonzero((np.diff(kept, prepend=-2) != 1) | (np.diff(owner[kept], prepend=-1) != 0))
    left = []
    for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(kept)]):
        dealt, key, hot, d, t, a, text = pieces[owner[kept[i]]]
        k = int(inner[kept[i]])
        left.append((dealt, key, hot, d, t, a + k, text[k : k + j - i + LENGTH - 1]))
    return (doc[again], tie[again], at[again], one), left


PIECES = "dealt long, doc long, tie long, at int, n int, bytes binary"


def batch_of_pieces(found: tuple[np.ndarray, ...], pieces: list[Piece]) -> Iterator[pa.RecordBatch]:
    """Repeated places (with ``n`` and no bytes), and pieces (with bytes)."""
    names = ["dealt", "doc", "tie", "at", "n", "bytes"]
    doc, tie, at, n = runs(*found)
    columns = [doc, doc, tie, at.astype(np.int32), n.astype(np.int32)]
    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(doc), pa.binary())], names)
    if pieces:
        dealt, _, _, doc, tie, at, text = zip(*pieces)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        columns = [dealt, doc, tie, at, [0] * len(at), text]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def entries(joined: DataFrame) -> DataFrame:
    """The dictionary entries whose suffixes must be ranked, less the suffixes that a task's own entries repeat.

    Pieces are dealt by trigger; those of a hot trigger are cut into 100-byte strings dealt by their own hash.
    """

    def dealt(pieces: list[Piece]) -> Iterator[Piece]:
        for piece in pieces:
            _, key, hot, doc, tie, at, text = piece
            if not hot:
                yield piece
                continue
            for k in range(len(text) - LENGTH + 1):
                string = text[k : k + LENGTH]
                own = hashlib.blake2b(string, digest_size=8).digest()
                yield int.from_bytes(own, "big", signed=True), key, hot, doc, tie, at + k, string

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[Piece] = []
        size = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                for (doc, tie, text), ranked in zip(texts_of(part), part.column("ranked").to_pylist()):
                    for x in ranked:
                        key, at, n = x["key"], x["at"], x["n"]
                        pieces.append((key, key, x["hot"], doc, tie, at, text[at : at + n + LENGTH - 1]))
                        size += n + LENGTH - 1
                        if size >= SORT_BYTES:
                            found, left = combine(pieces)
                            yield from batch_of_pieces(found, list(dealt(left)))
                            pieces, size = [], 0
        if pieces:
            found, left = combine(pieces)
            yield from batch_of_pieces(found, list(dealt(left)))

    return joined.mapInArrow(run, PIECES)


def ranked_pieces(pieces: DataFrame) -> DataFrame:
    """Repeated starts (doc, tie, at, n); ``pieces`` must be sorted within partitions by ``dealt``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "tie", "at", "n"]
        held: list[Piece] = []
        size, limit = 0, SORT_BYTES

        def handed(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            doc, tie, at, n = runs(*found)
            columns = [doc, tie, at.astype(np.int32), n.astype(np.int32)]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns)], names)

        for batch in batches:
            done = pc.is_null(batch.column("bytes"))
            yield batch.filter(done).select(names)
            rows = batch.filter(pc.invert(done))
            for dealt, doc, tie, at, text in zip(*(rows.column(c).to_pylist() for c in ("dealt", "doc", "tie", "at", "bytes"))):
                if size >= limit:
                    last = held[-1][0]
                    found, held = combine(held)
                    yield handed(found)
                    # Other groups are complete; what is left of this one meets the rest of it.
                    held = [x for x in held if x[0] == last == dealt]
                    size = sum(len(x[6]) for x in held)
                    limit = max(SORT_BYTES, 2 * size)
                held.append((dealt, 0, False, doc, tie, at, text))
                size += len(text)
        if held:
            yield handed(combine(held)[0])

    return pieces.mapInArrow(run, "doc long, tie long, at int, n int")


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(doc, tie, at, n): runs of starts whose 100 bytes start earlier in the corpus too.  ``docs``: (doc, tie, text)."""
    place = F.when(F.col("kind") == OPEN, F.col("key")).otherwise(F.xxhash64("doc", "tie"))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    settled = written(
        compared(phrases(docs).repartition(width, place).sortWithinPartitions("key", "entry", "check", *ORDER))
    )
    hot = settled.where(F.col("kind") == HOT).select("key", F.lit(True).alias("hot")).distinct()
    ranked = (
        settled.where(F.col("kind") == RANKED)
        .join(hot, "key", "left")
        .groupBy("doc", "tie")
        .agg(F.collect_set(F.struct("key", "at", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("ranked"))
    )
    pieces = entries(docs.join(ranked, ["doc", "tie"]).select("doc", "tie", "text", "ranked"))
    return (
        settled.where(F.col("kind") == REPEATED)
        .select(*ORDER, "n")
        .union(ranked_pieces(pieces.repartition(width, "dealt").sortWithinPartitions("dealt")))
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, kept, removed): the bytes left of every text, and the removed runs [start, end)."""
    source = identified(docs)
    gathered = repeated_starts(source.drop("doc_id")).groupBy("doc", "tie").agg(F.collect_list(F.struct("at", "n")).alias("starts"))
    joined = source.join(gathered, ["doc", "tie"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                sizes, kept, removed = [], [], []
                for (_, _, text), starts in zip(texts_of(part), part.column("starts").to_pylist()):
                    spans: list[list[int]] = []
                    for at, n in sorted((x["at"], x["n"]) for x in starts or ()):
                        end = min(at + n + LENGTH - 1, len(text))
                        if spans and at <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], end)
                        elif at < end:
                            spans.append([at, end])
                    edges = [0, *(e for s in spans for e in s), len(text)]
                    sizes.append(len(text))
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    removed.append([{"start": a, "end": b} for a, b in spans])
                span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(sizes, pa.int64()),
                        pa.array(kept, pa.binary()),
                        pa.array(removed, pa.list_(span)),
                    ],
                    ["doc_id", "n_bytes", "kept", "removed"],
                )

    return joined.mapInArrow(
        run, "doc_id long, n_bytes long, kept binary, removed array<struct<start:int,end:int>>"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = remove_repeats(table(spark, sf_dir, "documents"))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    return removed.select(
        "doc_id",
        "n_bytes",
        size.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
