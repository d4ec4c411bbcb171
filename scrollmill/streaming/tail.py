"""JSONL files as a stream: a source whose offset is the byte reached in each file.

The built-in file source takes a file for unchanging; transcripts grow. Each micro-batch lists
the files, reads from the last offset to the last complete line, a range a task, and moves on.
"""

from __future__ import annotations

import os

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from scrollmill.sources.jsonl import discover, ranges, records

_SCHEMA = "source_path string, byte_start bigint, byte_end bigint, line string"


def last_line_end(path: str, start: int, size: int) -> int:
    """The byte after the last line end in [start, size), or `start` if there is none."""
    with open(path, "rb") as f:
        at = size
        while at > start:
            lo = max(start, at - (1 << 16))
            f.seek(lo)
            found = f.read(at - lo).rfind(b"\n")
            if found >= 0:
                return lo + found + 1
            at = lo
    return start


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, stop: int) -> None:
        self.path, self.start, self.end, self.stop = path, start, end, stop


class TailReader(DataSourceStreamReader):
    def __init__(self, roots: list[str]) -> None:
        self.roots = roots

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: last_line_end(p, 0, os.path.getsize(p)) for p in discover(self.roots) or []}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        # a file that became shorter is another one: it is read anew
        begin = {p: start.get(p, 0) if stop >= start.get(p, 0) else 0 for p, stop in end.items()}
        return [Range(p, a, b, stop) for p, stop in sorted(end.items()) for _, a, b in ranges(p, begin[p], stop)]

    def read(self, partition: Range):
        for a, b, data in records(partition.path, partition.start, partition.end, partition.stop):
            try:
                line = None if data is None else data.decode()
            except UnicodeDecodeError:  # malformed, as in the batch reader
                line = None
            yield partition.path, a, b, line

    def commit(self, end: dict) -> None:
        return None


class JsonlTail(DataSource):
    """`spark.readStream.format("jsonl_tail").option("roots", "/a:/b").load()`"""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader([r for r in self.options.get("roots", "").split(":") if r])


def register(spark) -> None:
    spark.dataSource.register(JsonlTail)
