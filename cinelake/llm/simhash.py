"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bits gets a non-zero vector of ``radius + 1`` bits, and each non-zero vector v of that
length a mask of the bits whose vectors have an odd product with v.  Any ``radius`` differing bits
span at most ``radius`` dimensions, so some v is orthogonal to all of them: in that table the two
fingerprints agree on the whole mask.  Every pair within the radius therefore meets in some bucket.

Inside the buckets nothing is paired off.  Equal fingerprints are merged first.  A bucket of two is
compared directly; in a larger one every member is compared with the smallest, and components of
these stars are formed.  Only buckets that then still hold several components are searched further:
in blocks of bounded size, comparing members of different components and returning a spanning forest of the
components in sight: fewer links than components.  So the links that are left out join what is joined already.

Defined results: a text without words (null, empty, white space) has fingerprint zero and is linked
like any other; a text of fewer words than a shingle is one shingle; rows without an id are
fingerprinted and grouped but never name a group (a group of such rows alone has a null id); repeated
rows are one group; an empty table gives an empty result.  A very long text is taken whole, its shingles'
bits counted a stretch at a time.  Other columns of any name are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import checkpointed, table
from cinelake.llm.components import connected

BITS = 64
#: Words of a shingle.
SHINGLE = 4
#: Seed of the shingles' XXH64.
SEED = 42
#: Fingerprints link at so many differing bits or fewer.
RADIUS = 4
#: Members of a bucket that a task holds on either side when it compares two blocks.
BLOCK = 4096
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the text's word shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, CHUNK):
        some = hashes[k : k + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of all whole texts; ``fp`` is the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column(1).cast(pa.binary())
                fps = pa.array([fingerprint(x.as_py()) for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), fps], ["doc_id", "fp"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """One mask for each non-zero vector of ``radius + 1`` bits."""
    size = (1 << (radius + 1)) - 1
    vectors = [k % size + 1 for k in range(bits)]
    return [sum(1 << k for k in range(bits) if (vectors[k] & v).bit_count() % 2) for v in range(1, size + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near(a, b, radius: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def spanning_links(fp: np.ndarray, label: np.ndarray, radius: int, rows: int = 256) -> list[tuple[int, int]]:
    """A spanning forest, by label, of the links between members of different labels that are near."""
    names, own = np.unique(label, return_inverse=True)
    root = np.arange(len(names))  # the least label that each is joined to so far
    found: list[tuple[int, int]] = []
    for k in range(0, len(fp), rows):
        close = np.bitwise_count(fp[k : k + rows, None] ^ fp[None, :]) <= radius
        # Roots change from one stretch of rows to the next, so an order of roots would drop links: only equal ones may go.
        close &= root[own[k : k + rows, None]] != root[own[None, :]]
        i, j = np.nonzero(close)
        for a, b in np.unique(np.stack([own[i + k], own[j]], 1), axis=0).tolist() if len(i) else ():
            least, other = sorted((root[a], root[b]))
            if least != other:
                root[root == other] = least
                found.append((names[a], names[b]))
    return found


def crossing(members: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the labels of a bucket's members that are near, by pairs of blocks.

    ``members``: (t, k, fp, label, n).  A bucket's members are dealt into blocks by hash; each pair of
    blocks is a task of its own with two blocks of rows at most, and returns only links that join labels which
    its links before do not join.
    """
    count = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), count).cast("int")
    dealt = (
        members.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
        .select(
            "t", "k", "fp", "label", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")
        )
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        found = spanning_links(rows["fp"].to_numpy().view(np.uint64), rows["label"].to_numpy(), radius)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("t", "k", "x", "y").applyInPandas(compare, "a long, b long")


def components(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(fp, label) of the linked among distinct fingerprints; those without a link are left out."""
    masks = F.array(*(F.lit(signed(m)) for m in covering_masks(radius)))
    keys = fps.select("fp", F.posexplode(masks).alias("t", "mask")).select(
        "fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("k")
    )
    buckets = checkpointed(
        keys.groupBy("t", "k")
        .agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
        .where(F.col("n") > 1)
    )
    crowded = buckets.where(F.col("n") > 2).select("t", "k", "n", "lo")
    members = checkpointed(keys.join(crowded, ["t", "k"]))
    links = (
        buckets.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
        .union(members.select(F.col("fp").alias("a"), F.col("lo").alias("b")))
        .where(near("a", "b", radius))
    )
    stars = connected(links)
    labelled = members.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select(
        "t", "k", "n", "fp", F.coalesce("label", "fp").alias("label")
    )
    mixed = (
        labelled.groupBy("t", "k")
        .agg(F.min("label").alias("first"), F.max("label").alias("last"))
        .where(F.col("first") != F.col("last"))
        .select("t", "k")
    )
    more = checkpointed(crossing(labelled.join(mixed, ["t", "k"], "left_semi"), radius, block).distinct())
    if more.isEmpty():
        return stars.withColumnRenamed("node", "fp")
    whole = stars.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more)
    return connected(whole).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links reach from the document's fingerprint."""
    own = checkpointed(fingerprints(docs))
    merged = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = components(merged.select("fp"), radius, block).join(merged, "fp")
    reached = linked.groupBy("label").agg(F.min("first").alias("reached"))
    named = linked.join(reached, "label").select("fp", "reached")
    whole = merged.join(named, "fp", "left").select("fp", F.coalesce("reached", "first").alias("component_id"))
    return own.join(whole, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` without near-duplicates: the document with the smallest id of each group stays.

    Rows that repeat the id of one that stays are near-duplicates of it if its text is theirs.  Rows
    without an id stay.
    """
    found = checkpointed(near_duplicates(docs, radius))
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    again = found.groupBy("doc_id").count().where((F.col("count") > 1) & F.col("doc_id").isNotNull())
    kept = docs.join(gone, "doc_id", "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    ids = again.select("doc_id")
    return (
        kept.join(ids, "doc_id", "left_anti")
        .unionByName(kept.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
        .select(*docs.columns)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
