"""A data source of tagged JSON lines: `spark.read.format("graphlines").load(folder)`, and as a stream.

One line is a node of a conversation tree, a branch of it, or an echo event. Files are read in
splits of bytes; a line belongs to the split that it begins in, so the same rows come whatever the
size of a split. A partition takes splits that follow one another, more of them the more there are:
small splits make no more partitions than a scheduler bears. As a stream, an offset says how many bytes of each file have been
read: files may grow, and only what ends in a line break is read. A line that isn't a record comes
with kind `rejected` and the reason, its text in `content`.

Options: path; splitBytes (64 MiB); maxBytesPerTrigger for streams (all that there is).
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SPLIT = 64 << 20
#: Partitions of a read, unless they would be larger than SPLIT each.
PARTITIONS = 256
SCHEMA = """file string, offset long, kind string, id string, conversation_id string, parent_id string, role string, timestamp_ns long, content string,
    leaf_node_id string, canonical boolean, title string, message_id string, sequence long, model_round int, event_kind string, correlation_id string, name string, problem string"""
_FIELDS = [f.split()[0] for f in SCHEMA.replace("\n", " ").split(",")]
#: What a record of a kind must have.
REQUIRED = {"node": ("id", "conversation_id", "role", "timestamp_ns", "content"), "branch": ("id", "conversation_id", "leaf_node_id"), "echo": ("conversation_id", "message_id", "sequence", "event_kind")}
_TYPES = {"timestamp_ns": int, "sequence": int, "model_round": int, "canonical": bool}


def parsed(file: str, offset: int, line: bytes) -> tuple | None:
    """The row of a line; None for a blank one."""
    if not line.strip():
        return None
    row, problem = {}, None
    try:
        row = json.loads(line.decode())
        if not isinstance(row, dict):
            problem = "not an object"
        elif row.get("kind") not in REQUIRED:
            problem = "unknown kind"
        else:
            lacking = [f for f in REQUIRED[row["kind"]] if row.get(f) is None]
            wrong = [f for f in _FIELDS if row.get(f) is not None and type(row[f]) is not _TYPES.get(f, str)]
            problem = f"lacks {lacking[0]}" if lacking else f"wrong type of {wrong[0]}" if wrong else None
    except ValueError:  # no UTF-8, no JSON
        problem = "not JSON"
    if problem:
        row = {"kind": "rejected", "content": line.decode(errors="replace").rstrip("\r\n")}
    return tuple({**row, "file": file, "offset": offset, "problem": problem}.get(f) for f in _FIELDS)


def _system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def sizes(path: str) -> dict[str, int]:
    """Bytes of each file of a folder, by name; hidden files aren't data."""
    fs, at = _system(path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=False))
    return {f.base_name: f.size for f in found if f.is_file and not f.base_name.startswith(("_", "."))}


def split_bytes(size: int, asked: int) -> int:
    """Bytes of a partition of so many in all: whole splits of what was asked for."""
    least = min(-(-size // PARTITIONS), SPLIT)
    return asked * max(1, -(-least // asked))


class Stretch(InputPartition):
    """The lines of a file that begin in a stretch of bytes."""

    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def stretches(parts: dict[str, tuple[int, int]], split: int) -> list[Stretch]:
    return [Stretch(f, a, min(a + split, end)) for f, (start, end) in sorted(parts.items()) for a in range(start, end, split)]


def lines(path: str, part: Stretch) -> Iterator[tuple]:
    fs, at = _system(path)
    with io.BufferedReader(fs.open_input_file(f"{at}/{part.file}"), 1 << 16) as f:
        place = part.start
        if place:
            f.seek(place - 1)  # the line that holds the byte before is another's, unless it ends there
            place += len(f.readline()) - 1
        while place < part.end:
            line = f.readline()
            if not line:
                return
            if (row := parsed(part.file, place, line)) is not None:
                yield row
            place += len(line)


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Stretch]:
        found = sizes(self.path)
        return stretches({f: (0, n) for f, n in found.items()}, split_bytes(sum(found.values()), self.split))

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return lines(self.path, partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """Of each file, the bytes up to its last line break."""
        return {f: n for f, size in sizes(self.path).items() if (n := self._whole(f, size))}

    def _whole(self, file: str, size: int, step: int = 1 << 16) -> int:
        fs, at = _system(self.path)
        with fs.open_input_file(f"{at}/{file}") as f:
            end = size
            while end > 0:
                begin = max(0, end - step)
                f.seek(begin)
                if (k := f.read(end - begin).rfind(b"\n")) >= 0:
                    return begin + k + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        new = {f: (start.get(f, 0), n) for f, n in end.items() if n > start.get(f, 0)}
        return stretches(new, split_bytes(sum(b - a for a, b in new.values()), self.split))

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return lines(self.path, partition)


class GraphLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "graphlines"

    def schema(self) -> str:
        return SCHEMA

    def _of(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("splitBytes", SPLIT))

    def reader(self, schema) -> Reader:
        return Reader(*self._of())

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(*self._of())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GraphLines)
