"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: What a word is, everywhere in this package: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows without an id rank after all others.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one that driver and executors share, ``spark.checkpoint.dir``.

    Where that is unset, a folder of this machine serves if driver and executors are one process, as
    in tests; on a cluster it is an error. The application's folder goes when Python ends.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir()
    path = f"{base.rstrip('/')}/folioflow-{context.applicationId}"
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(context._jsc.hadoopConfiguration()).mkdirs(at) and path not in _FOLDERS:
        _FOLDERS.add(path)
        atexit.register(_remove, at, context._jsc.hadoopConfiguration())
    return path


#: Folders that are removed when Python ends.
_FOLDERS: set[str] = set()


def _remove(at, conf) -> None:
    with suppress(Exception):  # the JVM may have ended first
        at.getFileSystem(conf).delete(at, True)


#: The list that notes paths, and the scope around it.
_NOTED: ContextVar[tuple | None] = ContextVar("_NOTED", default=None)


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of what is materialised inside."""
    paths: list[str] = []
    token = _NOTED.set((paths, _NOTED.get()))
    try:
        yield paths
    finally:
        _NOTED.reset(token)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialised inside is deleted at the end."""
    with noted() as paths:
        yield
    discard(spark, paths)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session that holds inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialise(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage durably: a lost executor costs a re-read, not a recomputation. Shuffle
    files that only the written rows needed go as soon as these are written. ``keep``: it outlasts
    the nearest :func:`scratch`, as the result reads it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").parquet(path)
    scope = _NOTED.get()
    if keep and scope is not None:
        scope = scope[1]
    if scope is not None:
        scope[0].append(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, mb: int = 4) -> None:
    """Bound the bytes of an Arrow batch, so that very long texts don't gather in one; a lower bound of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > mb << 20:
        spark.conf.set(key, str(mb << 20))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
