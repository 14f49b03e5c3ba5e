"""Fingerprints of large files by their ends (F11): size, time of change, first and last MiB."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

#: Bytes of either end.  Fixed value.
SAMPLE = 1 << 20


def fingerprint(store: fs.FileSystem, path: str, sample: int = SAMPLE) -> tuple[str | None, int | None, int]:
    """(digest, size, bytes read) of a file; the end is read only if it does not overlap what was read before it."""
    info = store.get_file_info(path)
    if info.type != fs.FileType.File:
        return None, None, 0
    h = hashlib.blake2b(info.size.to_bytes(8, "little") + (info.mtime_ns or 0).to_bytes(8, "little"), digest_size=16)
    with store.open_input_file(path) as file:
        head = file.read_at(min(sample, info.size), 0)
        tail = file.read_at(sample, info.size - sample) if info.size > 2 * sample else b""
    h.update(head)
    h.update(tail)
    return h.hexdigest(), info.size, len(head) + len(tail)


def fingerprints(files: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``files`` (path, a URI or a local path) with fingerprint, size and bytes_read; null for what is no file.

    Files are dealt over tasks, and a task holds the two ends of one file at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                if path is None:
                    rows.append((None, None, 0))
                    continue
                store, own = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
                rows.append(fingerprint(store, own, sample))
            digest, size, read = zip(*rows) if rows else ((), (), ())
            columns = [batch.column("path"), pa.array(digest, pa.string()), pa.array(size, pa.int64()), pa.array(read, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["path", "fingerprint", "size", "bytes_read"])

    return files.select("path").mapInArrow(run, "path string, fingerprint string, size long, bytes_read long")
