"""Session helpers: UTC timestamps, shared scratch space, size-checked broadcast."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a side may have before it is no longer worth a broadcast. Every broadcast
# in this library is of narrow rows (< 100 bytes), so the bound is about 20 MB.
BROADCAST_ROWS = 200_000

# Spark's setting that removes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_cleaning: dict[str, tuple[int, str | None]] = {}
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_collected: ContextVar[list[DataFrame] | None] = ContextVar("collected", default=None)


def use_utc(spark: SparkSession) -> SparkSession:
    """Window borders and date partitions are defined in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written intermediates that every executor can read.

    It lies below ``spark.checkpoint.dir``, or, where that is unset, beside the tables of
    ``spark.sql.warehouse.dir``, which a cluster shares as well. It goes when the session's
    JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several later jobs read, and read it back.

    Unlike a cache this survives lost executors and cuts the lineage.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    _places[written] = path
    return written


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries inside remove their shuffle files as they end, not when the driver happens to collect its garbage.

    Several threads may be inside; the session's own setting comes back after the last one.
    """
    session = f"{spark.sparkContext.applicationId}:{id(spark)}"
    with _lock:
        inside, own = _cleaning.get(session, (0, spark.conf.get(_CLEANUP, None)))
        _cleaning[session] = (inside + 1, own)
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            inside, own = _cleaning.pop(session)
            if inside > 1:
                _cleaning[session] = (inside - 1, own)
            elif own is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, own)


def store(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` for wide tables: packed closely, without the shuffle files that made it, and
    deleted by ``release`` as soon as nothing reads it."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, name)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    _places[stored] = path
    if _collected.get() is not None:
        _collected.get().append(stored)
    return stored


@contextmanager
def collected() -> Iterator[list[DataFrame]]:
    """A list that holds, at the end, the tables that were stored inside and not released."""
    tables: list[DataFrame] = []
    token = _collected.set(tables)
    try:
        yield tables
    finally:
        _collected.reset(token)
        tables[:] = [t for t in tables if t in _places]


def release(*tables: DataFrame) -> None:
    """Delete what ``store`` or ``materialize`` wrote. Nothing that reads these tables may run afterwards."""
    for table in tables:
        path = _places.pop(table)
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after a bounded count proves the side is small.

    Beyond the bound the join is told to shuffle, and adaptive execution splits skewed
    partitions. Left to itself Spark could still broadcast: it guesses the size from the
    files below, which says nothing of rows that an ``explode`` makes.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df.hint("merge")
