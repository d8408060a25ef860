"""Lines of files that may still grow, as a batch and as a stream.

Spark's own file stream takes a file once and never looks at it again. A sampler's log grows
while it is read, so this source keeps a byte offset per file. It hands on whole lines and
nothing else: what they hold is parsed by Spark (:func:`rollframe.sources.readers.parse_device_lines`).
Files are reached through Arrow's filesystems, so any address those know will do.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path STRING, offset BIGINT, value STRING"
#: Bytes of a file that one task reads, and that it holds at once.
RANGE_BYTES = 64 << 20
CHUNK_BYTES = 1 << 20


class Range(InputPartition):
    """The lines of a file that begin in ``start`` to ``end``."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _open(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)


def sizes(address: str, suffix: str) -> dict[str, int]:
    """Size of every file below a folder, or of the one file."""
    files, path = _open(address)
    found = files.get_file_info(path)
    if found.type == fs.FileType.Directory:
        found = files.get_file_info(fs.FileSelector(path, recursive=True))
    else:
        found = [found]
    hidden = lambda name: name.startswith(("_", "."))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not hidden(f.base_name)}


def whole_lines_end(address: str, path: str, start: int, size: int) -> int:
    """Behind the last line end between ``start`` and ``size``; ``start`` if there is none."""
    files, _ = _open(address)
    with files.open_input_file(path) as f:
        end = size
        while end > start:
            begin = max(start, end - CHUNK_BYTES)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return start


def lines_of(address: str, part: Range) -> Iterator[pa.RecordBatch]:
    """Lines that begin in the range, in batches; a line belongs to the range where it begins."""
    files, _ = _open(address)
    with files.open_input_file(part.path) as f:
        at, held = part.start, b""
        if at:  # what began before the range ends at its first line end
            f.seek(at - 1)
            while True:
                piece = f.read(CHUNK_BYTES)
                cut = piece.find(b"\n")
                if cut >= 0:
                    held = piece[cut + 1:]
                    at = f.tell() - len(held)
                    break
                if not piece:
                    return
        done = False
        while at < part.end and not done:
            piece = f.read(CHUNK_BYTES)
            done = not piece
            rows = (held + piece).split(b"\n")
            held = rows.pop()
            if done and held:  # the last line of the file has no end
                rows.append(held)
            places, texts = [], []
            for row in rows:
                if at >= part.end:
                    break
                places.append(at)
                texts.append(row.removesuffix(b"\r").decode("utf-8", "replace"))
                at += len(row) + 1
            if texts:
                yield pa.RecordBatch.from_pydict({"path": [part.path] * len(texts), "offset": places, "value": texts})


def ranges(path: str, start: int, end: int, step: int) -> list[Range]:
    return [Range(path, a, min(end, a + step)) for a in range(start, end, step)]


class TailedLines(DataSource):
    """Options: ``path`` (a file or folder), ``suffix`` of the files, ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "tailed_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Lines:
    def __init__(self, options):
        self.address, self.suffix = options["path"], options.get("suffix", "")
        self.step = int(options.get("rangeBytes", RANGE_BYTES))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from lines_of(self.address, partition)


class _Batch(_Lines, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [r for path, size in sorted(sizes(self.address, self.suffix).items()) for r in ranges(path, 0, size, self.step)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from super().read(partition)


class _Stream(_Lines, DataSourceStreamReader):
    """The offset is the end of the last whole line of every file."""

    known: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        known = self.known or {}
        for path, size in sizes(self.address, self.suffix).items():
            start = known.get(path, 0)
            if size > start:
                known[path] = whole_lines_end(self.address, path, start, size)
        self.known = known
        return {"files": json.dumps(known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, upto = json.loads(start["files"]), json.loads(end["files"])
        self.known = {**upto, **{p: max(upto.get(p, 0), n) for p, n in (self.known or {}).items()}}
        return [r for path, size in sorted(upto.items()) for r in ranges(path, before.get(path, 0), size, self.step)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from super().read(partition)

    def commit(self, end: dict) -> None:
        pass


def _options(reader, path: str, suffix: str, range_bytes: int):
    return reader.format("tailed_lines").option("path", path).option("suffix", suffix).option("rangeBytes", range_bytes)


def read_lines(spark: SparkSession, path: str, suffix: str = "", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines as (path, offset, value); the offset is the byte where the line begins."""
    spark.dataSource.register(TailedLines)
    return _options(spark.read, path, suffix, range_bytes).load()


def stream_lines(spark: SparkSession, path: str, suffix: str = "", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """As :func:`read_lines`, and on from there: every batch has the whole lines that came since the last."""
    spark.dataSource.register(TailedLines)
    return _options(spark.readStream, path, suffix, range_bytes).load()
