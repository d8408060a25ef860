"""Folders of small files as rows: run folders, evaluation dumps.

A folder counts if it holds the main file; the others come along where they are there. Filters on
the folder's path, and on fields of the main file named as keys, are pushed into the source: a
folder that they rule out has none of its other files opened. The driver lists the first level
only; what lies below is listed by the tasks that read it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from rollframe.sources.tails import _open

#: First-level folders of a task, and rows of a batch.
TASK_FOLDERS = 128
BATCH_ROWS = 256


def column_of(name: str) -> str:
    """``gpu_metrics/gpu_summary.json`` is column ``gpu_summary``."""
    return name.rsplit("/", 1)[-1].split(".")[0]


class Part(InputPartition):
    def __init__(self, folders: list[str]):
        self.folders = folders


class Folders(DataSource):
    """Options: ``path``, ``main`` file, ``others`` and ``keys`` by comma."""

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        names = ["folder", *self._listed("keys"), *(column_of(f) for f in (self.options["main"], *self._listed("others")))]
        return ", ".join(f"{n} STRING" for n in names)

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options["path"], self.options["main"], self._listed("others"), self._listed("keys"))

    def _listed(self, name: str) -> list[str]:
        return [x for x in self.options.get(name, "").split(",") if x]


class FolderReader(DataSourceReader):
    def __init__(self, address: str, main: str, others: list[str], keys: list[str]):
        self.address, self.main, self.others, self.keys = address, main, others, keys
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In, StringStartsWith)) and len(f.attribute) == 1 else None
            if name not in ("folder", *self.keys):
                yield f
            elif isinstance(f, StringStartsWith):
                self.wanted.append((name, "prefix", f.value))
            else:
                self.wanted.append((name, "any", [f.value] if isinstance(f, EqualTo) else list(f.value)))

    def keeps(self, name: str, value: str | None) -> bool:
        for own, kind, want in self.wanted:
            if own == name and (value is None or (not value.startswith(want) if kind == "prefix" else value not in want)):
                return False
        return True

    def partitions(self) -> list[Part]:
        files, path = _open(self.address)
        root = files.normalize_path(path).rstrip("/")
        below = sorted(f.path for f in files.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory)
        return [Part([root + "/."]), *(Part(below[i: i + TASK_FOLDERS]) for i in range(0, len(below), TASK_FOLDERS))]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        files, _ = _open(self.address)
        names = ["folder", *self.keys, *(column_of(f) for f in (self.main, *self.others))]
        held: list[tuple] = []
        for folder in partition.folders:
            for found in self._found(files, folder):
                row = self._row(files, found)
                if row is not None:
                    held.append(row)
                if len(held) == BATCH_ROWS:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*held))), pa.schema([(n, pa.string()) for n in names]))
                    held = []
        if held:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*held))), pa.schema([(n, pa.string()) for n in names]))

    def _found(self, files: fs.FileSystem, folder: str) -> Iterator[str]:
        """Folders with a main file at and below this one; of the root, itself alone."""
        own = folder.endswith("/.")
        folder = folder.removesuffix("/.")
        for f in files.get_file_info(fs.FileSelector(folder, recursive=not own)):
            if f.type == fs.FileType.File and f.path.endswith("/" + self.main):
                yield f.path.removesuffix("/" + self.main)

    def _row(self, files: fs.FileSystem, folder: str) -> tuple | None:
        if not self.keeps("folder", folder):
            return None
        text, keys = self._text(files, f"{folder}/{self.main}"), []
        if self.keys:
            try:
                fields = json.loads(text)
            except ValueError:
                fields = None
            for key in self.keys:
                value = fields.get(key) if isinstance(fields, dict) else None
                value = value if value is None or isinstance(value, str) else json.dumps(value)
                if not self.keeps(key, value):
                    return None
                keys.append(value)
        return (folder, *keys, text, *(self._text(files, f"{folder}/{name}") for name in self.others))

    @staticmethod
    def _text(files: fs.FileSystem, path: str) -> str | None:
        try:
            with files.open_input_file(path) as f:
                return f.read().decode("utf-8", "replace")
        except FileNotFoundError:
            return None


def read_folders(spark: SparkSession, path: str, main: str, others: list[str] = (), keys: list[str] = ()) -> DataFrame:
    """One row per folder: its path, the keys, and the text of each file (null if it is not there)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Folders)
    return spark.read.format("folders").option("path", path).option("main", main).option("others", ",".join(others)).option("keys", ",".join(keys)).load()
