"""Cutting lineage with written tables in the folder that the cluster shares.

A lost executor loses its shuffle files; a Parquet table in ``spark.checkpoint.dir`` survives it, and its
file sizes let Catalyst decide on a broadcast from a measured size rather than from a guess. Tables go with ``drop`` as soon as nothing needs them,
with ``clear``, or when the driver's process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset (tests) one of this machine is made."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="attestor-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: set[str] = set()


def new_path(spark: SparkSession, label: str) -> str:
    folder = f"{shared_dir(spark)}/attestor-{spark.sparkContext.applicationId}"
    if folder not in _made:
        _made.add(folder)
        atexit.register(_clear_at_exit, spark, folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the table read back; the write's shuffle files go as soon as it is done."""
    path = new_path(df.sparkSession, label)
    with _held(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_each(parts: Iterable[DataFrame], label: str) -> DataFrame:
    """``cut`` of the union of ``parts`` of one schema, at least one, written one after the other: each is made when it is asked for, and its shuffle files go before the next one begins."""
    path = None
    for df in parts:
        path = path or new_path(df.sparkSession, label)
        with _held(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by ``cut`` once nothing lazy reads them any more."""
    for table in tables:
        folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
        for folder in folders:
            if "/attestor-" in folder:
                remove(table.sparkSession, folder)


def remove(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path, jsc = jvm.org.apache.hadoop.fs.Path(folder), spark.sparkContext._jsc
    path.getFileSystem(jsc.hadoopConfiguration() if jsc else jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


_lock = threading.Lock()
_holders: dict[str, list] = {}


@contextmanager
def _held(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Sets a session setting that changes no result while any holder needs it; the first one's previous value returns after the last one."""
    with _lock:
        entry = _holders.setdefault(name, [0, spark.conf.get(name, None)])
        entry[0] += 1
        spark.conf.set(name, value)
    try:
        yield
    finally:
        with _lock:
            entry[0] -= 1
            if not entry[0]:
                del _holders[name]
                spark.conf.unset(name) if entry[1] is None else spark.conf.set(name, entry[1])


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While it holds, actions hand Python ``rows`` rows at a time: for whole texts, whose batches the default would make large."""
    with _held(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has written with ``cut``; nothing lazy may read them any more."""
    remove(spark, f"{shared_dir(spark)}/attestor-{spark.sparkContext.applicationId}")


def _clear_at_exit(spark: SparkSession, folder: str) -> None:
    with suppress(Exception):  # the JVM may be gone
        remove(spark, folder)
