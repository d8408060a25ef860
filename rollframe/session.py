"""Session helpers: defaults for a local run and the shared staging folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_staged: dict[str, list[str]] = {}


def build_session(app_name: str = "rollframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; a cluster passes its own master."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a skewed join side even where that costs a later shuffle.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if (master or "").startswith("local"):
        defaults["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="spark-")
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A machine-local one will do only where there is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share: the master is {master}")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-")
    return _local_dirs[app]


def stage_path(spark: SparkSession, kind: str = "stage") -> str:
    """A fresh folder name below the shared folder."""
    path = f"{shared_dir(spark)}/rollframe-{kind}/{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete what this session has staged (after the first ``since`` folders); nothing may read it any more."""
    kept = _staged.get(spark.sparkContext.applicationId, [])
    paths, kept[since:] = kept[since:], []
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what is staged inside; results have to be written or collected by then."""
    before = len(_staged.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, before)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage, survives lost executors, and keeps column pruning and
    filter pushdown, which an RDD checkpoint does not.
    """
    path = stage_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
