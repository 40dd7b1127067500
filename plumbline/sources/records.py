"""Record files as a Python data source: one JSON object a line, read in byte ranges, in batch or as a stream.

``spark.dataSource.register(Records)`` and ``spark.read.format("records").schema(...).load(path)``; path is a file or a folder of files ending in
``suffix``. A range takes the lines that begin in it, so a file is read by many tasks, and no line twice. Pushed filters (equality, membership,
null tests, comparisons on top-level columns) are tried on a record before it becomes a row; the session's
``spark.sql.python.filterPushdown.enabled`` turns them on. A line that is no object, or a value that doesn't fit the schema, is an
error that names the file and the line's place.

As a stream, files come in the order of their names and only the last one grows: an offset is a file's name and a place in it, and a batch ends at
a line's end.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SPLIT_BYTES, BATCH_ROWS, BLOCK = 64 << 20, 2000, 1 << 20


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """Files of path with their sizes, by name; hidden ones are left out."""
    from pyarrow import fs

    system, root = _system(path)
    own = system.get_file_info(root)
    if own.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [own] if own.is_file else [f for f in system.get_file_info(fs.FileSelector(root)) if f.is_file and f.base_name.endswith(suffix) and f.base_name[0] not in "._"]
    return sorted((f.path, f.size) for f in found)


def ranges(files: list[tuple[str, int]], split: int, first: int = 0) -> list[Range]:
    """Byte ranges of about split bytes; ``first`` is where the first file's begin."""
    out = []
    for i, (name, size) in enumerate(files):
        start = first if i == 0 else 0
        out += [Range(name, at, min(at + split, size)) for at in range(start, size, split)]
    return out


def lines(stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Place and text of each line that begins in the range."""
    at = max(0, start - 1)
    stream.seek(at)
    held, fresh = b"", start == 0
    while True:
        block = stream.read(BLOCK)
        *whole, held = (held + block).split(b"\n")
        if not block and held:
            whole, held = [held], b""
        for line in whole:
            if fresh:
                if at >= end:
                    return
                yield at, line
            fresh = True
            at += len(line) + 1
        if not block or (fresh and at >= end):
            return


class _Ranges:
    """Reads one range as Arrow batches."""

    def __init__(self, schema: StructType, path: str, options: Mapping[str, str]):
        self.schema, self.path = schema, path
        self.suffix, self.split = options.get("suffix", ".jsonl"), int(options.get("splitBytes", SPLIT_BYTES))
        self.keep = {k: set(v) for k, v in json.loads(options.get("keep", "{}")).items()}
        if self.split <= 0:
            raise ValueError("splitBytes must be positive")
        if unknown := set(self.keep) - set(schema.names):
            raise ValueError(f"no columns {sorted(unknown)} to keep values of")

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(self.schema)
        system, _ = _system(self.path)
        rows: list[dict] = []
        with system.open_input_file(partition.file) as stream:
            for at, line in lines(stream, partition.start, partition.end):
                if not line.strip():
                    continue
                try:
                    record = json.loads(line)
                    if not isinstance(record, dict):
                        raise ValueError("no object")
                    if all(record.get(k) in v for k, v in self.keep.items()):
                        rows.append(record)
                    if len(rows) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows = []
                except (ValueError, TypeError, pa.ArrowInvalid) as e:
                    raise ValueError(f"{partition.file} at {at}: {e}") from e
        if rows:
            try:
                yield pa.RecordBatch.from_pylist(rows, kind)
            except (TypeError, pa.ArrowInvalid) as e:
                raise ValueError(f"{partition.file} before {partition.end}: {e}") from e


class RecordReader(_Ranges, DataSourceReader):
    def partitions(self) -> list[Range]:
        return ranges(listed(self.path, self.suffix), self.split)


class RecordStream(_Ranges, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"file": "", "at": 0}

    def _after(self, start: dict) -> tuple[list[tuple[str, int]], int]:
        """Files not yet read to their end, and where the first of them goes on."""
        own = [(n, s) for n, s in listed(self.path, self.suffix) if n > start["file"] or (n == start["file"] and s > start["at"])]
        return own, start["at"] if own and own[0][0] == start["file"] else 0

    def latestOffset(self) -> dict:
        """The end of the last whole line that is there."""
        for name, size in reversed(listed(self.path, self.suffix)):
            system, _ = _system(self.path)
            with system.open_input_file(name) as f:
                at = size
                while at > 0:
                    begin = max(0, at - BLOCK)
                    f.seek(begin)
                    cut = f.read(at - begin).rfind(b"\n")
                    if cut >= 0:
                        return {"file": name, "at": begin + cut + 1}
                    at = begin
        return self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        own, first = self._after(start)
        upto = [(n, end["at"] if n == end["file"] else s) for n, s in own if n <= end["file"]]
        return ranges(upto, self.split, first)

    def commit(self, end: dict) -> None:
        pass


class Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        raise ValueError("give a schema: records have none of their own")

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordReader(schema, self.options["path"], self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return RecordStream(schema, self.options["path"], self.options)
