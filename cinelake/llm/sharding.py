"""Two-pass external shuffle into shards.

Pass one scatters the records by a seeded hash into as many buckets as keep a bucket's bytes within
memory, a partition each, or a partition for a run of buckets where there are more than ``PARTITIONS``: a
partition is sorted by bucket on disk, and one bucket is in memory at a time.  Pass two puts a bucket's records into a fixed order and shuffles them by
Fisher-Yates with a generator seeded by the bucket.  A table of the buckets' counts, summed up in order,
gives each bucket its place in the whole, and the whole, cut into equal stretches, gives the shards, whose
counts differ by one at most; a shard is made of a few whole or cut buckets.  The result depends on the seed
and the records alone, so a task that runs again gives the same rows.

Defined results: a null text counts no bytes; rows without an id are dealt by what else they hold; equal rows
are dealt by their number among themselves too, so that they do not crowd one bucket, and have a slot each; a very long text is a record like any other and may exceed a bucket's bytes; an empty
table gives no rows; columns of ``docs`` whose names begin with two underscores are renamed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinelake.llm.common import plain_columns, table, written

SHARDS = 40
SEED = 20_240_607
#: Bytes of a bucket, at most on average: what a task holds in memory.
BUCKET_BYTES = 32 << 20
#: Partitions of the scatter at most: the driver keeps track of each one's part in each task.
PARTITIONS = 20_000
#: Equal records that one row stands for while they are numbered.
CHUNK = 1 << 14
#: What a record counts besides its text.
RECORD_BYTES = 16


def text_bytes() -> Column:
    return F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")


def dealt(docs: DataFrame, buckets: int, seed: int) -> DataFrame:
    """``docs`` with ``__key``, a hash of the whole record and its number among equal ones, and ``__bucket``."""
    columns = [f.name for f in docs.schema if not f.dataType.simpleString().startswith("map")]
    keyed = docs.withColumn("__key", F.xxhash64(F.lit(seed), *columns))
    repeated = written(keyed.groupBy("__key").count().where(F.col("count") > 1).select(F.col("__key").alias("__of")))
    numbered = keyed
    if not repeated.isEmpty():
        # Equal records are counted, which takes their crowd off the shuffle, and dealt out again by their numbers.
        same = F.col("__key") == F.col("__of")
        counted = keyed.join(repeated, same, "left_semi").groupBy(*keyed.columns).agg(F.count("*").alias("__n"))
        chunks = counted.select("*", F.explode(F.expr(f"sequence(0, (__n - 1) div {CHUNK})")).alias("__chunk"))
        last = F.least(F.col("__chunk") * CHUNK + CHUNK, F.col("__n"))
        again = chunks.repartition("__key", "__chunk").select(
            "*", F.explode(F.sequence(F.col("__chunk") * CHUNK + 1, last)).alias("__number")
        )
        numbered = keyed.join(repeated, same, "left_anti").unionByName(
            again.select(*docs.columns, F.xxhash64("__key", "__number").alias("__key"))
        )
    return numbered.withColumn("__bucket", F.pmod(F.xxhash64("__key"), F.lit(buckets)).cast("int"))


def external_shuffle(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, partitions: int = PARTITIONS
) -> DataFrame:
    """``docs`` with ``__shard`` and ``__slot``; the counts of any two shards differ by one at most."""
    docs = plain_columns(docs)
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + RECORD_BYTES
    rows, total = docs.agg(F.count("*"), F.sum(size)).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    scattered = dealt(docs, buckets, seed)
    # One row a bucket: how many records lie before it.
    before = F.sum("count").over(Window.orderBy("__bucket")) - F.col("count")
    offsets = written(scattered.groupBy("__bucket").count().select(F.col("__bucket").alias("__of"), before.alias("__before")))
    names = docs.columns

    def shuffle(key: tuple[pa.Scalar, ...], records: pa.Table) -> pa.Table:
        order = [("__key", "ascending"), ("doc_id", "ascending"), ("text", "ascending")]
        fixed = pc.sort_indices(records.select(["__key", "doc_id", "text"]), order)
        # Generator.permutation is a Fisher-Yates shuffle.
        order = fixed.to_numpy()[np.random.Generator(np.random.PCG64([seed, key[-1].as_py()])).permutation(len(fixed))]
        out = records.take(pa.array(order)).select([*names, "__bucket"])
        return out.append_column("__at", pa.array(np.arange(len(order)), pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    # A run of buckets a partition: one bucket, so that a task's share stays a bucket's, up to the largest number of partitions.
    run = -(-buckets // partitions)
    shuffled = (
        scattered.withColumn("__run", F.expr(f"cast(__bucket div {run} as int)"))
        .repartitionById(-(-buckets // run), "__run")
        .groupBy("__run", "__bucket")
        .applyInArrow(shuffle, f"{schema}, `__bucket` int, `__at` bigint")
    )
    return (
        shuffled.join(offsets, F.col("__bucket") == F.col("__of"))
        .withColumn("__number", F.col("__before") + F.col("__at"))
        # Shard k begins at k * rows div shards.
        .withColumn("__shard", F.expr(f"cast(((__number + 1) * {shards} - 1) div {max(rows, 1)} as int)"))
        .withColumn("__slot", F.expr(f"__number - cast(__shard as bigint) * {rows} div {shards}"))
        .select(*names, "__shard", "__slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Shuffles ``docs`` and writes one folder of Parquet files a shard, with each record's slot."""
    external_shuffle(docs, shards, seed).withColumnRenamed("__shard", "shard").withColumnRenamed(
        "__slot", "slot"
    ).write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return external_shuffle(docs).select(
        "doc_id",
        (F.octet_length(text_bytes()) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(text_bytes()).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
