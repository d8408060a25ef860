"""Sinks: declared columns, step folders, gated publication."""

from __future__ import annotations

import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollframe.sources.tails import _open

POINTER = "path STRING, version BIGINT, row_count BIGINT, previous STRING"


def write_csv(rows: DataFrame, path: str, fields: list[str], mode: str = "errorifexists") -> None:
    """CSV with exactly these columns; columns that are not there are written empty."""
    cols = [F.col(f"`{f}`") if f in rows.columns else F.lit(None).cast("string").alias(f) for f in fields]
    rows.select(*cols).write.mode(mode).csv(path, header=True)


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def write_files(files: DataFrame, root: str) -> int:
    """Write rows of (path, value) as files of that text below ``root``; the number of files.

    Every task writes the rows it holds. A task that runs again writes the same files again.
    """
    def save(batches):
        store, base = _open(root)
        made: set[str] = set()
        for batch in batches:
            for path, value in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist()):
                where = f"{base.rstrip('/')}/{path.lstrip('/')}"
                parent = where.rsplit("/", 1)[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(where) as out:
                    out.write((value or "").encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})
    return files.select("path", "value").mapInArrow(save, "n long").agg(F.sum("n")).first()[0] or 0


def write_packed(files: DataFrame, root: str) -> None:
    """Append rows of (path, value) to packs: tables of whole small files by file name. A million
    files of some hundred bytes would take a disk block each; packed they take their bytes."""
    files.select("path", "value", F.regexp_extract("path", r"([^/]+)$", 1).alias("name")).write.mode("append").partitionBy("name").parquet(root)


def write_rollouts(rows: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Rollout rows by step, one folder per step. Tasks write what they hold, so a step with
    most of the rows is still written in parallel."""
    rows.write.mode(mode).partitionBy("step").format(fmt).save(path)


def publish(rows: DataFrame, registry: DataFrame, base: str) -> str:
    """Publish a result table: refused while the registry is incomplete.

    Rows go to a new version folder; only when that is written does a pointer row follow,
    which names the version it replaces. Readers follow the newest pointer. A version number is
    claimed by creating a file that must not be there yet, so two publishers never share one.
    """
    spark = rows.sparkSession
    if registry.select("registry_complete").first()[0] is not True:
        raise ValueError("result registry is incomplete; refusing to publish")
    target = f"{base}/versions/{uuid.uuid4().hex}"
    rows.write.parquet(target)
    current = current_pointer(spark, base)
    version, previous = _claim(spark, base, current.version + 1 if current else 1), current.path if current else None
    count = spark.read.parquet(target).count()
    spark.createDataFrame([(target, version, count, previous)], POINTER).coalesce(1).write.mode("append").json(f"{base}/pointers")
    return target


def _claim(spark: SparkSession, base: str, version: int) -> int:
    """The first free version from this one on, claimed by an exclusive create."""
    jvm = spark.sparkContext._jvm
    while True:
        where = jvm.org.apache.hadoop.fs.Path(f"{base}/claims/{version}")
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.create(where, False).close()
            return version
        except Py4JJavaError as error:
            if not files.exists(where):
                raise error
            version += 1


def current_pointer(spark: SparkSession, base: str):
    """The newest pointer row, or None before the first publication."""
    try:
        pointers = spark.read.schema(POINTER).json(f"{base}/pointers")
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return pointers.orderBy(F.col("version").desc()).first()


def read_published(spark: SparkSession, base: str) -> DataFrame:
    pointer = current_pointer(spark, base)
    if pointer is None:
        raise ValueError(f"nothing is published at {base}")
    return spark.read.parquet(pointer.path)
