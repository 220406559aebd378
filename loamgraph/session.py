"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "loamgraph", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of applications whose session names none, by application id: Spark 4 doesn't let a running session take the setting.
_own_dirs: dict[str, str] = {}
_lock = threading.RLock()
#: Writers that need CLEANUP now, and what it was before the first of them, by session.
_cleaning: dict[int, list] = {}
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one on a single machine where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _own_dirs.setdefault(app, "file://" + os.path.join(tempfile.gettempdir(), f"loamgraph-shared-{app}"))
    return found.rstrip("/")


@contextlib.contextmanager
def _cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    """CLEANUP is on while any thread is inside; the last one to leave puts the session's own value back."""
    key = id(spark._jsparkSession)
    with _lock:
        held = _cleaning.setdefault(key, [0, spark.conf.get(CLEANUP, "false")])
        held[0] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(CLEANUP, held[1])
                del _cleaning[key]


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df to the shared folder, in folders by column `by` if given, and read it back: cuts the lineage and survives lost executors.

    The shuffle files behind it are dropped once the table is written; should
    another plan still hold them, Spark makes them again. The table goes with
    discard(), at the end of the scratch() block it was written in, or with
    the application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        with _cleaned_shuffles(spark):
            (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        at, fs = _place(spark, path)
        fs.deleteOnExit(at)  # takes what exists only
    out = spark.read.schema(df.schema).parquet(path)
    out._loam_path = path
    for scope in getattr(_scopes, "open", []):
        scope.append(path)
    return out


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    at, fs = _place(spark, path)
    fs.delete(at, True)
    fs.cancelDeleteOnExit(at)


def discard(df: DataFrame | None) -> None:
    """Delete the files behind a frame that materialise() returned."""
    path = getattr(df, "_loam_path", None)
    if path:
        _delete(df.sparkSession, path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end of the block what materialise() wrote in it, in this thread.

    Frames made in the block read those tables: use them, or write what is to
    stay, before the block ends.
    """
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    mine: list[str] = []
    _scopes.open.append(mine)
    try:
        yield
    finally:
        _scopes.open.pop()
        for path in mine:
            _delete(spark, path)
