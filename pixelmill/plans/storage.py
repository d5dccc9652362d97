"""Cutting lineage through tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}
_here = threading.local()  # paths of the innermost scratch() of a thread


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a new local one only where that setting is absent and so is a cluster (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path of its own in the checkpoint folder; what is written there goes when the driver's interpreter ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"
    _written[path] = spark
    if getattr(_here, "paths", None) is not None:
        _here.paths.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the checkpoint folder and read it back.

    The copy outlives lost executors, ends the lineage, and is columnar, so later readers prune it.
    Tables are removed when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, "tables")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, by: str = "image_id") -> DataFrame:
    """``df`` as a table of the warehouse, in ``buckets`` by a key.

    Pixels and images kept so, in as many buckets, join by image_id without moving again: of use where one
    collection goes through many operators and its images are too many to broadcast.
    """
    df.write.bucketBy(buckets, by).sortBy(by).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


@contextmanager
def scratch():
    """Tables written inside, by this thread, go at its end, but for those that ``keep``, which it gives, has written.

    A result that is kept is a table, so nothing reads the others afterwards. Tables of queries in other threads stay.
    """
    mine: list[str] = []
    outer, _here.paths = getattr(_here, "paths", None), mine

    def keep(df: DataFrame) -> DataFrame:
        _here.paths = outer
        try:
            return materialize(df)
        finally:
            _here.paths = mine

    try:
        yield keep
    finally:
        _here.paths = outer
        for path in mine:
            if path in _written:
                _delete(path, _written.pop(path))


def _hadoop(path: str, spark: SparkSession):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(path: str, spark: SparkSession) -> bool:
    store, at = _hadoop(path, spark)
    return store.exists(at)


def located(path: str, spark: SparkSession) -> tuple[str, bool]:
    """(a path as Spark's readers write it, with its store; whether it exists)."""
    store, at = _hadoop(path, spark)
    return store.makeQualified(at).toString(), store.exists(at)


def touch(path: str, spark: SparkSession) -> None:
    """An empty file, where Spark keeps its files."""
    store, at = _hadoop(path, spark)
    store.create(at, True).close()


def _delete(path: str, spark: SparkSession) -> None:
    store, at = _hadoop(path, spark)
    store.delete(at, True)


@atexit.register
def _remove() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(path, spark)
        except Exception:  # the session is gone: nothing to remove with
            return
