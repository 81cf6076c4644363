"""Tables in the folder that driver and executors share, which cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_within: ContextVar[str | None] = ContextVar("scratch folder", default=None)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under the application's id.

    The cluster names the place in spark.checkpoint.dir, or the program by setCheckpointDir. A temporary folder will do
    only where driver and executors are one process.
    """
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        top = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(top)
    under = _within.get() or f"{top.rstrip('/')}/{sc.applicationId}"
    return f"{under}/{name}-{uuid.uuid4().hex}"


@contextmanager
def within(path: str) -> Iterator[None]:
    """What is written inside goes under `path`, which shared_path gave. Other threads are not affected."""
    token = _within.set(path)
    try:
        yield
    finally:
        _within.reset(token)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A shared folder for what is written inside, deleted behind it: results that go on are written before it ends, to a
    path taken outside. Scopes of other threads and calls have folders of their own."""
    path = shared_path(spark, name)
    try:
        with within(path):
            yield path
    finally:
        removed(spark, path)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What a query inside shuffles is deleted when it ends, not when the driver's memory is next cleared. For queries that
    are written or collected once."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing will read again."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, written once and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer splits than there are cores, dealt evenly over them; larger ones, and results of a
    shuffle, stay as they are. Splits of a file without as many row groups are empty, so such a table would be cut into
    terms, sentences or vectors by one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
