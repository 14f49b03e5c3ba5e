"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex of the separators between white-space words (space and tab to carriage return).
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, by Spark's own reader (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_columns(docs: DataFrame) -> DataFrame:
    """``docs``, with ``in`` put before the names that begin with two underscores: those names are the operators' own."""
    taken, names = set(docs.columns), []
    for c in docs.columns:
        new = c
        while new.startswith("__") or new != c and new in taken:
            new = f"in{new}"
        taken.add(new)
        names.append(new)
    return docs.toDF(*names)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """White-space words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where the session names none, a local session gets a temporary folder, and a cluster is an error: a folder
    of the driver's machine would be lost on the executors'.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Spark removes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_lived(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that end within are removed: their results are whole tables or on the driver."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df``, computed once and written as a Parquet table in the shared folder, and its path; shuffle files are removed."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4()}"
    with short_lived(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """``df``, computed once and written as a Parquet table in the shared folder; its shuffle files are removed."""
    return stored(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing will read any more, by Hadoop's file system of that path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are there and finite."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))
