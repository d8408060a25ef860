"""The query registry and the few helpers every registered query uses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register a query under its inventory id, with its equivalent SQL if there is one."""
    def add(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = lambda spark, sf: tidy(fn(spark, sf))
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return add


def tidy(df: DataFrame) -> DataFrame:
    """Round floating columns so that the order of additions does not show.

    Rounding to twelve digits first puts values that are ties but for it back on the tie.
    """
    return df.select(*[
        (F.round(F.round(F.col(f"`{n}`"), 12), 6) + F.lit(0.0)).alias(n) if t in ("double", "float") else F.col(f"`{n}`")
        for n, t in df.dtypes])


#: Rows of heavy work that a task takes at most.
HEAVY_ROWS = 50_000


def enough_tasks(df: DataFrame) -> DataFrame:
    """For heavy work per row: no fewer tasks than cores, and so many that a task's rows do not
    grow with the table, where the scan alone has fewer. Rows are counted by the files' footers."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // HEAVY_ROWS))
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def r6(expr: str) -> str:
    """The same rounding in SQL text."""
    return f"(round(round(CAST({expr} AS DOUBLE), 12), 6) + 0.0)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")
