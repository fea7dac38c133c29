"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: While a table is written: its shuffles are dropped at once, and Python gets small batches, so that neither
#: Arrow's buffers in the JVM nor a worker's grow with long texts.
WHILE_SAVING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2048"}


_lock = threading.Lock()
#: By session: how many tables are being written, and its settings before the first of them.
_writing: dict[int, tuple[int, dict[str, str | None]]] = {}
_swept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, a temporary one, but on a local master only:
    elsewhere executors would write to folders that nobody else can read."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="webloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """WHILE_SAVING holds from the first of several threads that write until the last is done."""
    own = id(spark._jsparkSession)
    with _lock:
        depth, before = _writing.get(own) or (0, {k: spark.conf.get(k, None) for k in WHILE_SAVING})
        _writing[own] = (depth + 1, before)
        if not depth:
            for k, v in WHILE_SAVING.items():
                spark.conf.set(k, v)
    try:
        yield
    finally:
        with _lock:
            depth, before = _writing.pop(own)
            if depth > 1:
                _writing[own] = (depth - 1, before)
            else:
                for k, v in before.items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    The table stays until ``discard`` or the end of the application, whichever is first.
    """
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/webloom/{spark.sparkContext.applicationId}"
    if top not in _swept:
        _swept.add(top)
        atexit.register(_sweep, spark, top)
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    with _settings(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_saved_at", None):
            _remove(t.sparkSession, path)


def _sweep(spark: SparkSession, top: str) -> None:
    with suppress(Py4JError, OSError):  # at the end Spark's JVM may be gone already
        _remove(spark, top)


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None:  # stopped: nobody can reach the folder any more
        return
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
