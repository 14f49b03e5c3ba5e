"""Atomic publication of tables: manifests, plans, benchmark exports.

Data is staged in a folder of its own, and a manifest that names it is put in place last, by a rename.  A reader sees the
table of the last whole publication or, if there is no readable manifest or its data is not complete, none.  All paths go
through Hadoop's file systems, so any store of Spark's will do whose rename is atomic.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

MANIFEST = "manifest.json"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside its place and renamed over it."""
    fs, where = _files(spark, path)
    staged = where.suffix(f".{uuid.uuid4()}.tmp")
    out = fs.create(staged, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    rename = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(staged, where, options)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; null if there is none or it is no UTF-8."""
    fs, where = _files(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        data = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return None


def read_manifest(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """The manifest of a folder; none if it is missing, damaged, or no JSON object."""
    try:
        text = read_text(spark, f"{path}/{MANIFEST}")
        found = json.loads(text) if text is not None else None
    except ValueError:
        return None
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() == "ChecksumException":
            return None
        raise
    return found if isinstance(found, dict) else None


def publish(df: DataFrame, path: str, about: dict[str, Any] | None = None) -> dict[str, Any]:
    """Write ``df`` as the table of ``path``, with ``about`` in its manifest; the former table goes when the new one is in place."""
    spark = df.sparkSession
    before = read_manifest(spark, path)
    name = f"data-{uuid.uuid4()}"
    df.write.parquet(f"{path}/{name}")
    manifest = {"data": name, "schema": json.loads(df.schema.json()), "about": about or {}}
    write_text(spark, f"{path}/{MANIFEST}", json.dumps(manifest, indent=2, default=str))
    if before and isinstance(before.get("data"), str):
        fs, where = _files(spark, f"{path}/{before['data']}")
        fs.delete(where, True)
    return manifest


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that was last published in ``path``, or none."""
    manifest = read_manifest(spark, path)
    if manifest is None or not isinstance(manifest.get("data"), str):
        return None
    fs, where = _files(spark, f"{path}/{manifest['data']}/_SUCCESS")
    return spark.read.parquet(f"{path}/{manifest['data']}") if fs.exists(where) else None
