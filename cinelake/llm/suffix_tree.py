"""Language-model scoring by a probabilistic suffix tree over words.

A state of the tree is a string of words that may precede a token, and its suffix one word shorter is its
parent; the root holds the word counts of all training texts.  Level by level, every string that occurs
``LEAST`` times at least and whose parent was retained is tested: its next-symbol counts against the
parent's distribution, each occurrence judged by the counts without itself.  It is retained if its
divergence from the parent saves more than ``GAIN`` nats over all its occurrences; a string that occurs as
often as its parent has the same successors and needs no test.  Levels are added until no string is left to
be tested, so neither depth nor size of the tree is fixed: it grows with the corpus.

A retained state takes ``DISCOUNT`` from each count of two or more and gives that and the single counts to
its parent's distribution, so every distribution sums to one.  A token is scored by the longest retained
state before it.  States are closed under suffixes, so that state's log-probability is the root's plus, for
each retained state before the token, what the state gives its parent, plus, where the pair is counted, what
the pair adds.  Each of these belongs to one string of words: the score of a text is a sum over its strings.

Strings are known by 64-bit hashes.  Counts, states and pairs stay in tables and meet the texts by joins.
Two things of bounded size are broadcast, for speed alone: for each length a bitmap of ``FILTER_BITS`` bits
at most that tells most of the strings that can count no more, and the values of the ``FREQUENT`` most
frequent strings; whatever the bitmaps let pass and whatever is not frequent is looked up in the tables.

Defined results: null text counts as empty, whose only token is the end; a null id counts as the empty
string and is held out; very long texts are scored whole; repeated rows are scored each; other columns of
any name are not looked at; an empty table gives no rows; without training tokens every probability is 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinelake.llm.common import discard, short_lived, stored, table
from cinelake.llm.hashing import P5, mixed, pair_hash

#: A string or pair below this count cannot show a divergence.
LEAST = 2
#: Nats that a state must save.
GAIN = 4.0
#: Taken from each counted pair.
DISCOUNT = 0.6
#: Added to every count at the root.
ADDED = 0.1
#: Bits of a bitmap: eight for each of its strings, and so many at most (32 MB); strings whose values are broadcast (26 MB).
FILTER_BITS, FREQUENT = 1 << 28, 800_000
#: Bits of a block of a bitmap and of the smallest bitmap, as powers of two.
BLOCK_BITS, LEAST_BITS = 21, 16
#: Partitions in which strings of texts are looked up: every one gives back sums for nearly every text, so they grow more slowly than others.
LOOKUPS = 128
#: The end of a text, as a word; no word holds a space.
END_WORD = b" end"
#: Text bytes that a task handles at a time (one text may be longer; arrays of more leave the cache), and tokens whose counts it holds.
SLICE_BYTES, HELD = 512 << 10, 2_000_000


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(ids, texts as bytes) of runs of rows of bounded bytes."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
            ids.append(doc_id.as_py())
            texts.append(text.as_py() or b"")
            size += len(texts[-1])
            if size >= SLICE_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


#: Which bytes part words, as bytes 0 and 1.
PARTING = np.isin(np.arange(256), [32, *range(9, 14)]).tobytes()


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, eight bytes at a time; ``data`` must go on for eight bytes after the last."""
    eight = np.ndarray(len(data) - 7, np.uint64, data, strides=(1,))
    size = stop - start
    own = mixed(eight[start] & MASKS[np.minimum(size, 8)] ^ size.astype(np.uint64) * P5)
    some = np.flatnonzero(size > 8)
    at = 8
    while len(some):
        own[some] = mixed(own[some] ^ eight[start[some] + at] & MASKS[np.minimum(size[some] - at, 8)])
        at += 8
        some = some[size[some] > at]
    return own


#: The bytes of a little-endian number that the first 0 to 8 of eight bytes make up.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
END = word_hashes(np.frombuffer(END_WORD + bytes(8), np.uint8), np.array([0]), np.array([len(END_WORD)]))[0]


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, the end of each text included; index of its first token for each text, and of the end)."""
    lower = b" ".join([b"", *texts, b" " * 8]).lower()
    data, parting = np.frombuffer(lower, np.uint8), np.frombuffer(lower.translate(PARTING), bool)
    edge = np.flatnonzero(parting[1:] != parting[:-1])
    start, stop = edge[::2] + 1, edge[1::2] + 1
    cuts = np.cumsum([len(t) + 1 for t in texts])
    words = np.searchsorted(start, cuts, side="left")
    first = np.concatenate(([0], words + np.arange(1, len(texts) + 1)))
    hashes, is_word = np.full(first[-1], END), np.ones(first[-1], bool)
    is_word[first[1:] - 1] = False
    hashes[is_word] = word_hashes(data, start, stop)
    return hashes, first


def together(keys: np.ndarray) -> np.ndarray:
    """An order in which equal numbers stand together, but for rare ones: by their upper bits, then by place.

    Numbers and places are sorted as one, which is much faster than to sort places by number.
    """
    bits = np.uint64(len(keys).bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    return (np.sort(keys & ~mask | np.arange(len(keys), dtype=np.uint64)) & mask).astype(np.int64)


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Indices of the rows that differ from the one before them."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def strings(hashes: np.ndarray, first: np.ndarray, length: int, may: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1 on: the tokens that end a string of it, and the hashes of these strings.

    Of a length and its hashes ``may`` tells which are of use, also as a part of longer strings; None: all of them.
    """
    at, own = np.arange(len(hashes)), hashes
    for k in range(1, length + 1):
        some = may(k, own) if may else None
        if some is not None:
            at, own = at[some], own[some]
        yield at, own
        if k < length:
            # The next string joins the one that ends a token earlier with the one that ends here.
            joins = at[1:] - at[:-1] == 1
            if k == 1:  # the first token of a text has none before it
                starts = np.zeros(len(hashes), bool)
                starts[first[:-1]] = True
                joins &= ~starts[at[1:]]
            here = np.flatnonzero(joins) + 1
            at, own = at[here], pair_hash(own[here - 1], own[here])


def passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmap_of(grams: DataFrame) -> np.ndarray:
    """The bits of the hashes in the column ``gram``, set block by block in the tasks."""
    size = min(max(1 << LEAST_BITS, 1 << (8 * grams.count()).bit_length()), FILTER_BITS)
    block_bits = min(BLOCK_BITS, size.bit_length() - 1)
    place = F.col("gram").bitwiseAND(F.lit(size - 1)).cast("int")
    block = F.shiftright("place", block_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            places = batch.column(0).to_numpy()
            blocks = places >> block_bits
            for k in np.unique(blocks).tolist():
                own = bits.setdefault(k, np.zeros(1 << block_bits, bool))
                own[places[blocks == k] & (1 << block_bits) - 1] = True
        packed = [np.packbits(x, bitorder="little").tobytes() for x in bits.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int32()), pa.array(packed, pa.binary())], ["block", "bits"])

    with short_lived(grams.sparkSession):
        rows = grams.select(place.alias("place")).repartition(block).mapInArrow(run, "block int, bits binary").collect()
    out = np.zeros(size // 8, np.uint8)
    for k, bits in rows:
        out[k * len(bits) : (k + 1) * len(bits)] = np.frombuffer(bytes(bits), np.uint8)
    return out


def shuffled(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_bits(partitions: int) -> int:
    """Bits of a hash that tell its bucket: four buckets or more for each partition of a shuffle."""
    return (4 * partitions - 1).bit_length()


def lookups(spark: SparkSession) -> int:
    """Partitions in which strings are looked up: those of the session's shuffles as far as ``LOOKUPS``, then one for sixteen of them."""
    n = shuffled(spark)
    return min(n, max(LOOKUPS, n // 16))


def dealt(rows: DataFrame, partitions: int, *order) -> DataFrame:
    """Rows of packed numbers by bucket, in order within each partition."""
    return rows.repartition(partitions, "bucket").sortWithinPartitions(*order)


def turned(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Hashes with their lowest bits first, so that in order they stand by bucket."""
    return hashes >> np.uint64(bits) | hashes << np.uint64(64 - bits)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, all first bytes before all second ones: upper bytes of small numbers take no room in a shuffle."""
    return b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in columns)


def unpacked(data: pa.BinaryScalar, *kinds: type) -> list[np.ndarray]:
    """The columns of a packed row, as copies: Arrow's memory, which a view of a single number would be, can't be written to."""
    buffer, sizes, at, out = np.frombuffer(data.as_buffer(), np.uint8), [np.dtype(k).itemsize for k in kinds], 0, []
    n = len(buffer) // sum(sizes)
    for kind, size in zip(kinds, sizes):
        out.append(buffer[at : at + size * n].reshape(size, n).T.copy().view(kind).reshape(n))
        at += size * n
    return out


def joined(rows: Iterator[list], *kinds: type) -> list[np.ndarray]:
    """The columns of several packed rows; the data is each row's last column."""
    return [np.concatenate(x) for x in zip(*(unpacked(r[-1], *kinds) for r in rows))]


def steps(keys: np.ndarray) -> np.ndarray:
    """Distances of numbers nearly in order, and ``np.cumsum`` gives the numbers again."""
    return np.diff(keys, prepend=np.uint64(0))


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Rows as lists: numbers as such, and the last column, bytes, as it lies in Arrow's memory."""
    for batch in batches:
        *numbers, data = batch.columns
        yield from map(list, zip(*(x.to_pylist() for x in numbers), data))


def by_bucket(key: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The buckets of turned hashes in order, and where each lies."""
    bucket = key >> np.uint64(64 - bits)
    at = firsts(bucket)
    for a, b in zip(at.tolist(), np.append(at[1:], len(key)).tolist()):
        yield int(bucket[a]), slice(a, b)


def counted(docs: DataFrame, names: list[str], keys, least: int = 1) -> DataFrame:
    """Sums over all training tokens of what ``keys`` gives for the tokens of some texts: arrays of hashes, one for each of ``names``.

    Each task adds up what it holds before it hands it on, as a row of packed numbers for each bucket of hashes; sums
    below ``least`` are left out where a bucket is added up.
    """
    partitions = shuffled(docs.sparkSession)
    bits = bucket_bits(partitions)

    def hashed(columns: list[np.ndarray]) -> np.ndarray:
        return turned(columns[0] if len(columns) == 1 else pair_hash(*columns), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[list[np.ndarray]] = []

        def flushed() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*pending)]
            pending.clear()
            key = hashed(columns)
            order = together(key)
            key, columns = key[order], [x[order] for x in columns]
            at = firsts(*columns)
            n = np.diff(np.append(at, len(order)))
            key, columns = key[at], [x[at] for x in columns]
            rows = [(k, packed(*(x[part] for x in columns), n[part])) for k, part in by_bucket(key, bits)]
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "data"]
            )

        for ids, texts in rows_of(batches):
            pending.append(keys(*tokens([t for i, t in zip(ids, texts) if not held_out(i)])))
            if sum(len(x[0]) for x in pending) >= HELD:
                yield flushed()
        if pending:
            yield flushed()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(each(batches), lambda r: r[0]):
            *columns, n = joined(rows, *[np.uint64] * len(names), np.int64)
            key = hashed(columns)
            order = together(key)
            new = firsts(*(x[order] for x in columns))
            kept = key[order] >> np.uint64(len(key).bit_length())
            if (kept[new[1:]] == kept[new[1:] - 1]).any():  # different strings alike in the bits by which they were put in order
                order = np.lexsort(columns)
                new = firsts(*(x[order] for x in columns))
            if not len(order):
                continue
            total = np.add.reduceat(n[order], new)
            some = total >= least
            arrays = [pa.array(x[order[new[some]]].view(np.int64)) for x in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total[some])], [*names, "n"])

    rows = dealt(plain(docs).mapInArrow(run, "bucket int, data binary"), partitions, "bucket")
    return rows.mapInArrow(add_up, ", ".join(f"{n} long" for n in [*names, "n"]))


@dataclass
class Tree:
    """``words``: (gram, n).  ``levels``: for each length, the counted pairs of the retained states, (ctx, suffix,
    n, total, log, adds, gives, gram): state, pair without its first word, counts of pair and state, natural
    logarithms of the pair's probability, of what it adds and of what the state gives its parent, whole pair."""

    tokens: int
    distinct: int
    words: DataFrame
    levels: list[DataFrame]
    #: Where the tables lie.
    paths: list[str] = field(default_factory=list)
    #: For each length, the bitmap of the counted strings of it (of words, those that occur ``LEAST`` times).
    maps: list[Broadcast] = field(default_factory=list)

    def root_log(self, count: Column) -> Column:
        return F.log((count + ADDED) / (self.tokens + ADDED * (self.distinct + 1)))


def pair_counts(docs: DataFrame, states: DataFrame, maps: list[Broadcast]) -> tuple[DataFrame, str]:
    """A table and its path: (ctx, suffix, n) of the pairs of states (``gram``) and tokens of which the last of ``maps`` has the string without its first word."""
    length = len(maps)
    of_states = docs.sparkSession.sparkContext.broadcast(bitmap_of(states)) if length > 1 else maps[0]

    def may(k: int, own: np.ndarray) -> np.ndarray | None:
        # A longer string can only be a state, or the pair's end, if what it holds was counted.
        return passes(maps[k - 1].value, own) if 1 < k < length else None

    def keys(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        for at, own in strings(hashes, first, length, may):
            pass
        suffix = passes(maps[-1].value, own)
        state = passes(of_states.value, own) if length > 1 else suffix
        here = np.flatnonzero(suffix[1:] & state[:-1] & (np.diff(at) == 1)) + 1
        if length == 1:  # the first token of a text has no word before it
            here = here[~np.isin(here, first[:-1])]
        return [own[here - 1], own[here]]

    out = stored(counted(docs, ["ctx", "suffix"], keys, LEAST))
    if length > 1:
        of_states.destroy()
    return out


def judged(pairs: DataFrame) -> DataFrame:
    """The pairs (ctx, suffix, n, total, parent) of states that pass the divergence test, as a level of the tree.

    ``parent``: natural logarithm of the token's probability in the parent state.
    """
    state = Window.partitionBy("ctx")
    n, total, types, once = (F.col(c) for c in ("n", "total", "types", "once"))
    prior = F.exp("parent")
    others = total - 1  # occurrences without the one that is judged
    seen = (n - 1 - DISCOUNT) / others + (DISCOUNT * types + once) / others * prior
    unseen = (DISCOUNT * (types - 1) + once + 1) / others * prior
    saved = n * (F.log(F.when(n > 2, seen).otherwise(unseen)) - F.col("parent"))
    # A single token has its share of what is given to the parent, less itself; where that is nothing, of a discount.
    lone = F.when(once > 0, once * F.log(F.greatest(DISCOUNT * types + once - 1, F.lit(DISCOUNT)) / others)).otherwise(0.0)
    gives = (DISCOUNT * types + once) / total
    log = F.log((n - DISCOUNT) / total + gives * prior)
    return (
        pairs.withColumn("types", F.count("*").over(state))
        .withColumn("once", total - F.sum("n").over(state))
        .withColumn("gain", F.sum(saved).over(state) + lone)
        .where(F.col("gain") > GAIN)
        .select(
            "ctx",
            "suffix",
            "n",
            "total",
            log.alias("log"),
            (log - F.col("parent") - F.log(gives)).alias("adds"),
            F.log(gives).alias("gives"),
        )
    )


def states_of(level: DataFrame) -> DataFrame:
    return level.groupBy("ctx").agg(F.first("total").alias("total"), F.first("gives").alias("gives"))


def fit(docs: DataFrame, depth: int | None = None) -> Tree:
    """The tree of the training texts; ``depth`` may end it early."""
    words, path = stored(counted(docs, ["gram"], lambda hashes, first: [hashes]))
    total = words.agg(F.sum("n"), F.count("*")).first()
    tree = Tree(total[0] or 0, total[1] or 0, words, [], [path])
    known = words.where(F.col("n") >= LEAST).select("gram", tree.root_log(F.col("n")).alias("parent"))
    states = words.where(F.col("n") >= LEAST).select("gram", F.col("n").alias("total"))
    broadcast = docs.sparkSession.sparkContext.broadcast
    while (depth is None or len(tree.levels) < depth) and not states.isEmpty():
        if not tree.maps:
            tree.maps.append(broadcast(bitmap_of(known)))
        counts, of_counts = pair_counts(docs, states, tree.maps)
        pairs = counts.join(known.select(F.col("gram").alias("suffix"), "parent"), "suffix").join(
            states.select(F.col("gram").alias("ctx"), "total"), "ctx"
        )
        level, path = stored(judged(pairs))
        tree.paths.append(path)
        discard(docs.sparkSession, of_counts)
        level = level.withColumn("gram", F.xxhash64("ctx", "suffix"))
        if level.isEmpty():
            break
        tree.levels.append(level)
        tree.maps.append(broadcast(bitmap_of(level)))
        known = level.select("gram", F.col("log").alias("parent"))
        # A longer string is a state to be tested if its parent is retained and has other occurrences too.
        parents = states_of(level).select(F.col("ctx").alias("suffix"), F.col("total").alias("of_parent"))
        states, path = stored(
            level.select("gram", "suffix", "n")
            .join(parents, "suffix")
            .where(F.col("n") < F.col("of_parent"))
            .select("gram", F.col("n").alias("total"))
        )
        tree.paths.append(path)
    return tree


def values(tree: Tree) -> DataFrame:
    """(gram, n, base, value): what an occurrence of a string counts in the base and in the score, in log10.

    A string may have two rows: as a pair (or word), and as a state.  Words lie above an unknown word's value.
    """
    unknown = tree.root_log(F.lit(0))
    base = (tree.root_log(F.col("n")) - unknown) / F.log(F.lit(10.0))
    parts = [tree.words.select("gram", "n", base.alias("base"), base.alias("value"))]
    for level in tree.levels:
        none = F.lit(0.0).alias("base")
        scaled = [(F.col(c) / F.log(F.lit(10.0))).alias("value") for c in ("adds", "gives")]
        parts.append(level.select("gram", "n", none, scaled[0]))
        parts.append(states_of(level).select(F.col("ctx").alias("gram"), F.col("total").alias("n"), none, scaled[1]))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def frequent(of: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """The least count of the strings whose values are broadcast, their hashes in order, and (base, value, known) of each."""
    # Quarters of powers of two: a bounded number of rows.
    step = F.floor(F.log2("n") * 4)
    sizes = of.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    least, size = 1 << 62, 0
    for row in sizes:
        size += row["count"]
        if size > FREQUENT:
            break
        least = int(np.ceil(2 ** (row["step"] / 4) - 1e-9))
    rows = of.where(F.col("n") >= least).groupBy("gram").agg(
        F.sum("base").alias("base"), F.sum("value").alias("value"), F.max((F.col("base") != 0).cast("double")).alias("known")
    )
    with short_lived(of.sparkSession):
        found = rows.toArrow()
    grams = found.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(grams)
    return least, grams[order], np.stack([found.column(c).to_numpy()[order] for c in ("base", "value", "known")], 1)


#: What a row of packed numbers holds: values of strings, strings of texts, texts.
VALUES, STRINGS, TEXTS = 0, 1, 2
PACKED = "bucket int, kind int, part long, data binary"


def packed_rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["bucket", "kind", "part", "data"])


def packed_values(of: DataFrame, bits: int) -> DataFrame:
    """Rows of packed values (gram, base, value), by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []

        def flushed() -> pa.RecordBatch:
            gram, base, value = (np.concatenate([b.column(k).to_numpy() for b in pending]) for k in range(3))
            pending.clear()
            key = turned(gram.view(np.uint64), bits)
            order = together(key)
            key, base, value = key[order], base[order], value[order]
            return packed_rows([(k, VALUES, 0, packed(steps(key[x]), base[x], value[x])) for k, x in by_bucket(key, bits)])

        for batch in batches:
            if batch.num_rows:
                pending.append(batch)
            if sum(b.num_rows for b in pending) >= HELD:
                yield flushed()
        if pending:
            yield flushed()

    return of.select("gram", "base", "value").mapInArrow(run, PACKED)


def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of kind and part: for each part of the texts, the sums of what its strings count, and the texts."""
    pending: list[list[np.ndarray]] = []
    own, base, value = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for (kind, part), rows in groupby(((r[1], r[2], r[3]) for r in each(batches)), lambda r: r[:2]):
        if kind == VALUES:
            for r in rows:
                step, *figures = unpacked(r[-1], np.uint64, np.float64, np.float64)
                pending.append([np.cumsum(step, dtype=np.uint64), *figures])
            own, base, value = (np.concatenate(x) for x in zip(*pending))
            order = np.argsort(own)
            new = firsts(own[order])
            own, base, value = own[order][new], np.add.reduceat(base[order], new), np.add.reduceat(value[order], new)
            pending.clear()
        elif kind == STRINGS:
            key, who, n = [], [], []
            for r in rows:
                step, *figures = unpacked(r[-1], np.uint64, np.uint32, np.uint32)
                for x, y in zip((key, who, n), (np.cumsum(step, dtype=np.uint64), *figures)):
                    x.append(y)
            key, who, n = np.concatenate(key), np.concatenate(who), np.concatenate(n)
            if not len(own):
                continue
            place = np.minimum(np.searchsorted(own, key), len(own) - 1)
            hit = np.flatnonzero(own[place] == key)
            place, who, n = place[hit], who[hit], n[hit]
            sums = [np.bincount(who, n * x) for x in (base[place] != 0, base[place], value[place])]
            some = np.flatnonzero(np.bincount(who))
            if len(some):
                data = packed(some.astype(np.uint32), sums[0][some].astype(np.int64), sums[1][some], sums[2][some])
                yield packed_rows([(0, STRINGS, part, data)])
        else:
            for r in rows:
                yield packed_rows([(0, TEXTS, part, r[-1].as_py())])


#: The columns of packed texts: doc_id and whether there is one, tokens, known ones, base, score.
OF_TEXT = (np.int64, np.uint8, np.int64, np.int64, np.float64, np.float64)


def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of part, texts first: the rows of the texts."""
    for _, rows in groupby(each(batches), lambda r: r[2]):
        ids, there, n_tokens, *sums = unpacked(next(rows)[-1], *OF_TEXT)
        for r in rows:
            who, *more = unpacked(r[-1], np.uint32, np.int64, np.float64, np.float64)
            for x, y in zip(sums, more):
                x[who] += y
        arrays = [pa.array(ids, mask=there == 0), *map(pa.array, [n_tokens, *sums])]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "n_known", "base_score", "score"])


def score_texts(docs: DataFrame, depth: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    spark = docs.sparkSession
    tree = fit(docs, depth)
    of, _ = stored(values(tree))
    for path in tree.paths:
        discard(spark, path)
    least, grams, figures = frequent(of)
    longest, partitions, maps = len(tree.levels) + 1, lookups(spark), tree.maps
    bits = bucket_bits(partitions)
    unknown = float(np.log10(ADDED / (tree.tokens + ADDED * (tree.distinct + 1)))) if tree.tokens else 0.0
    model = spark.sparkContext.broadcast((grams, figures))

    def may(k: int, own: np.ndarray) -> np.ndarray | None:
        # A string that counts begins and ends with strings that count; every word of the training texts does.
        return passes(maps[k - 1].value, own) if k > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of_own = model.value
        part = TaskContext.get().partitionId() << 32
        texts_held: list[list[np.ndarray]] = []
        rare_held: list[tuple[np.ndarray, np.ndarray]] = []

        def flushed() -> pa.RecordBatch:
            # The strings of some texts by bucket, with the text of each and how often it holds it.
            who, string = (np.concatenate(x) for x in zip(*rare_held))
            key = turned(string, bits)
            order = together(key)
            who, key = who[order], key[order]
            at = firsts(key, who)
            n = np.diff(np.append(at, len(key))).astype(np.uint32)
            who, key = who[at].astype(np.uint32), key[at]
            rows = [(k, STRINGS, part, packed(steps(key[x]), who[x], n[x])) for k, x in by_bucket(key, bits)] if len(key) else []
            rows.append(((part + (part >> 32)) % (1 << bits), TEXTS, part, packed(*(np.concatenate(x) for x in zip(*texts_held)))))
            texts_held.clear()
            rare_held.clear()
            return packed_rows(rows)

        for ids, texts in rows_of(batches):
            hashes, first = tokens(texts)
            size = len(ids)
            owner = np.repeat(np.arange(size), np.diff(first))
            before = sum(len(x[0]) for x in texts_held)
            sums = np.zeros((3, size))
            for at, string in strings(hashes, first, longest, may):
                order = together(string)
                at, string = at[order], string[order]
                sure = np.zeros(len(string), bool)
                if len(own):
                    place = np.minimum(np.searchsorted(own, string), len(own) - 1)
                    sure = own[place] == string
                    figure, who = of_own[place[sure]], owner[at[sure]]
                    for k in range(3):
                        sums[k] += np.bincount(who, figure[:, k], size)
                rare_held.append((owner[at[~sure]] + before, string[~sure]))
            n_tokens = np.diff(first)
            there = np.array([i is not None for i in ids], np.uint8)
            known, base, score = sums[2].astype(np.int64), sums[0] + n_tokens * unknown, sums[1] + n_tokens * unknown
            texts_held.append([np.array([i or 0 for i in ids], np.int64), there, n_tokens.astype(np.int64), known, base, score])
            if sum(len(x) for x, _ in rare_held) >= HELD // 2:
                yield flushed()
                part += 1
        if texts_held:
            yield flushed()

    rest = packed_values(of.where(F.col("n") < least), bits)
    rows = dealt(rest.union(plain(docs).mapInArrow(run, PACKED)), partitions, "kind", "part")
    parts = rows.mapInArrow(looked_up, PACKED).repartition("part").sortWithinPartitions("part", F.desc("kind"))
    return parts.mapInArrow(added_up, "doc_id long, n_tokens long, n_known long, base_score double, score double").select(
        "doc_id", "n_tokens", "n_known", F.lit(tree.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return score_texts(table(spark, sf_dir, "documents")).select(
        "doc_id",
        (F.crc32(F.encode(text_id, "UTF-8")) % 10 == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )
