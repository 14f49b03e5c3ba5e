"""A streaming source of growing log files (T06): ``spark.readStream.format("log_tail").load(pattern)``.

The offset of a stream is, for each file that the pattern lists, how many bytes have been read and a digest of the file's
first line.  The digest tells a file that was moved away (it goes on at its offset under the new name) from a new one of
its old name (it starts at 0); a file that is shorter than its offset starts again too.  Only whole lines are read, and a
batch's ranges end at line ends, so no line is lost or comes twice when files grow, roll over, or the stream restarts.
Ranges are read in tasks, a piece at a time, from any store that Arrow opens.

A file that is truncated and grows beyond its offset with the same first line between two batches cannot be told from one
that only grew.  A rolled file must still match the pattern (``app.log*``), else what was not read of it is lost.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that are read at a time, and bytes of a range that one task reads.
PIECE, RANGE = 1 << 16, 64 << 20


class Tail(NamedTuple):
    """A file as it was seen: its path, the digest of its first line, and where its last whole line ends."""

    path: str
    head: str
    end: int


def opened(pattern: str) -> tuple[fs.FileSystem, str, str]:
    """The store, folder and name pattern of a path pattern."""
    folder, _, name = pattern.rpartition("/")
    store, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    return store, path, name


def first_line(file) -> bytes | None:
    """Up to the first line end; none while there is none."""
    text = b""
    while piece := file.read_at(min(PIECE, file.size() - len(text)), len(text)):
        at = piece.find(b"\n")
        text += piece if at < 0 else piece[:at]
        if at >= 0:
            return text
    return None


def last_end(file, low: int) -> int:
    """The place after the last line end of the file, ``low`` if none comes after it."""
    high = file.size()
    while high > low:
        start = max(low, high - PIECE)
        at = file.read_at(high - start, start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        high = start
    return low


def seen(pattern: str) -> list[Tail]:
    store, folder, name = opened(pattern)
    out = []
    for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if info.type == fs.FileType.File and fnmatch.fnmatch(info.base_name, name):
            try:
                with store.open_input_file(info.path) as file:
                    line = first_line(file)
                    if line is not None:
                        out.append(Tail(info.base_name, hashlib.blake2b(line, digest_size=16).hexdigest(), last_end(file, len(line) + 1)))
            except FileNotFoundError:  # it rolled over meanwhile
                continue
    return out


def begun(start: dict, tail: Tail) -> int:
    """How far the file has been read by the offset ``start``: under its own name or, if that now holds another, a former one."""
    own = start.get(tail.path)
    if own and own["head"] == tail.head:
        return own["end"] if own["end"] <= tail.end else 0
    moved = [x["end"] for name, x in start.items() if x["head"] == tail.head and x["end"] <= tail.end]
    return max(moved, default=0)


class Range(InputPartition):
    def __init__(self, path: str, head: str, start: int, end: int) -> None:
        self.path, self.head, self.start, self.end = path, head, start, end


class LogTailReader(DataSourceStreamReader):
    def __init__(self, pattern: str) -> None:
        self.pattern = pattern

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {t.path: {"head": t.head, "end": t.end} for t in seen(self.pattern)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for path, x in end.items():
            low = begun(start, Tail(path, x["head"], x["end"]))
            # A long range is cut by bytes; a piece takes the lines that begin in it.
            out += [Range(path, x["head"], at, min(at + RANGE, x["end"])) for at in range(low, x["end"], RANGE)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        store, folder, _ = opened(self.pattern)
        names = [partition.path, *(t.path for t in seen(self.pattern) if t.head == partition.head and t.path != partition.path)]
        for name in names:
            try:
                with store.open_input_file(f"{folder}/{name}") as file:
                    line = first_line(file)
                    if line is not None and hashlib.blake2b(line, digest_size=16).hexdigest() == partition.head and file.size() >= partition.end:
                        yield from lines(file, partition.start, partition.end, partition.path)
                        return
            except FileNotFoundError:
                continue
        raise FileNotFoundError(f"{partition.path} was removed before bytes {partition.start} to {partition.end} were read")


def lines(file, start: int, end: int, name: str) -> Iterator[tuple]:
    """(file, at, line) of the lines that begin from ``start`` to ``end``."""
    at = start
    if start and file.read_at(1, start - 1) != b"\n":
        while True:  # the line before belongs to the range before
            piece = file.read_at(PIECE, at)
            k = piece.find(b"\n")
            if k >= 0 or not piece:
                at += k + 1
                break
            at += len(piece)
    rest, place = b"", at
    while place < end:
        piece = file.read_at(PIECE, at)
        if not piece:
            return
        at += len(piece)
        *whole, rest = (rest + piece).split(b"\n")
        for line in whole:
            if place >= end:
                return
            yield name, place, line.rstrip(b"\r").decode("utf-8", "replace")
            place += len(line) + 1


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogTailReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogTail)
