"""A log file's lines as a Spark data source that knows byte offsets: its end in a batch, what is added in a stream.

    spark.dataSource.register(Tail)
    spark.read.format("tail").load(path)                            # the lines of the last ``first`` bytes
    spark.readStream.format("tail").option("first", 8000).load(path)

Rows are ``path, offset, line``.  Reading begins ``first`` bytes before the end, with
the line after the one that stands there; a line is read once it has ended.  A stream's
offset is the byte after the last whole line, so a restart goes on where the last
batch ended.  What is added is read in ranges of ``RANGE`` bytes, each by its own task.
A file that is shorter than before was begun anew and is read from its start; a
missing file has no lines.  Bytes that aren't UTF-8 become replacement characters.

Paths are those of ``pyarrow.fs`` (local, ``hdfs://``, ``s3://``); it must find the file where tasks run.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FIRST, RANGE, STEP = 8_000, 16 << 20, 64 << 10


def _opened(path: str):
    """The file for random access and its size; None and 0 if there is none."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    if system.get_file_info(name).type != fs.FileType.File:
        return None, 0
    f = system.open_input_file(name)
    return f, f.size()


def _line_start(f, at: int, size: int) -> int:
    """The first byte after a line break that stands at ``at`` or later; ``size`` if there is none."""
    while at < size:
        f.seek(at)
        found = f.read(STEP).find(b"\n")
        if found >= 0:
            return at + found + 1
        at += STEP
    return size


def _whole_end(f, size: int) -> int:
    """The byte after the last line break."""
    end = size
    while end > 0:
        begin = max(0, end - STEP)
        f.seek(begin)
        found = f.read(end - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        end = begin
    return 0


def first_offset(path: str, first: int) -> int:
    f, size = _opened(path)
    return 0 if f is None or size <= first else min(_line_start(f, size - first, size), _whole_end(f, size))


def last_offset(path: str) -> int:
    f, size = _opened(path)
    return 0 if f is None else _whole_end(f, size)


def lines_between(path: str, begin: int, end: int, start: int) -> Iterator[tuple[str, int, str]]:
    """The lines that start in ``[begin, end)``; ``start`` is the first byte of any line that is asked for."""
    f, size = _opened(path)
    if f is None:
        return
    at = begin if begin == start else _line_start(f, begin - 1, size)
    f.seek(at)
    rest = b""
    while at < end:
        block = f.read(STEP)
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            if at >= end:
                return
            yield path, at, line.removesuffix(b"\r").decode("utf-8", errors="replace")
            at += len(line) + 1
        if not block:
            return


class Range(InputPartition):
    def __init__(self, begin: int, end: int, start: int) -> None:
        super().__init__((begin, end, start))


def ranges(begin: int, end: int) -> list[Range]:
    return [Range(a, min(a + RANGE, end), begin) for a in range(begin, end, RANGE)]


class _Lines:
    def __init__(self, options) -> None:
        self.path, self.first = options["path"], int(options.get("first", FIRST))

    def read(self, partition: Range) -> Iterator[tuple]:
        return lines_between(self.path, *partition.value) if partition is not None else iter(())


class TailReader(_Lines, DataSourceReader):
    def partitions(self) -> list[Range]:
        return ranges(first_offset(self.path, self.first), last_offset(self.path)) or [Range(0, 0, 0)]


class TailStreamReader(_Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"at": first_offset(self.path, self.first)}

    def latestOffset(self) -> dict:
        return {"at": last_offset(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(start["at"] if start["at"] <= end["at"] else 0, end["at"])


class Tail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, offset long, line string"

    def reader(self, schema) -> TailReader:
        return TailReader(self.options)

    def streamReader(self, schema) -> TailStreamReader:
        return TailStreamReader(self.options)
