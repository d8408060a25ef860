"""What the operators of this subpackage share: reading, staging, and mapping over slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rollframe.llm.words import slices
from rollframe.session import stage_path

#: Stands for a null id in joins and orders; such rows come before all others.
NO_ID = -(1 << 63)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``opN_<name>``, with its SQL twin if there is one."""
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def key_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def staged(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write to the shared folder and read back: fixes row keys and cuts the lineage."""
    path = stage_path(df.sparkSession, "llm")
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Texts are long, so Spark's usual ten thousand rows a batch would be tens of megabytes in
#: every worker and executor. Kept as they are where the session sets its own.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def small_batches(spark: SparkSession) -> None:
    for key, (usual, ours) in _BATCHES.items():
        if spark.conf.get(key, None) == usual:
            spark.conf.set(key, ours)


def map_slices(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str | StructType, column: str = "text") -> DataFrame:
    """``work`` on slices of about ``SLICE_BYTES`` of text; it returns columns by name, or nothing."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, column):
            out = work(piece)
            if out is not None:
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)
    return df.mapInArrow(run, schema)


def packed(docs: DataFrame) -> DataFrame:
    """Whole rows as one struct ``row`` beside doc_id, text and the hash of the text: no column of
    the table can clash with one that an operator adds, whatever its name."""
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(every, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "fp", F.xxhash64("text"))


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column of the table has it."""
    while name.lower() in [c.lower() for c in docs.columns]:
        name += "_"
    return name


def texts(df: DataFrame, *more: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and text columns alone, under fixed names, whatever else the table holds."""
    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), *more)
