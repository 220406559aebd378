"""History kept up to date from a stream of commits.

Two ways. append_history() keeps every touch and aggregates when asked.
keep_history() keeps a row for each path and author, whose numbers Spark's
state store carries from batch to batch: a batch writes the rows it changes and
reads no other, and a path that everybody touches is many small rows, no large
one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import file_history

_STATE = "path string, author string, commits long, last long, version long"


def append_history(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append what the feed has got to a Parquet table of touches, then stop; run it again for what came later.

    Every touch counts, equal ones too, and logs aren't in order of time: no
    watermark drops what comes late, and no state is kept.
    The table is written by batches that Spark numbers; a batch that is run
    again replaces its own folder, so nothing counts twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.select("path", "author", "ts").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history_of(spark: SparkSession, target: str) -> DataFrame:
    """Histories of a table that append_history() wrote."""
    return file_history(spark.read.schema("path string, author string, ts long, batch long").parquet(target))


def keep_history(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Count what the feed has got by path and author, and write the rows that have changed as a version of their own; run it again for what came later.

    Counts are of all touches so far, in whatever order they came; none are
    dropped for being late. A batch that is run again replaces its version.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/version={2 * number}")

    counted = stream.groupBy("path", "author").agg(F.count(F.lit(1)).alias("commits"), F.max("ts").alias("last"))
    return counted.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _latest(spark: SparkSession, target: str) -> DataFrame:
    """(path, author, commits, last): the newest row of each path and author; a null author is one like others."""
    rows = spark.read.schema(_STATE).parquet(target)
    newest = rows.groupBy("path", "author").agg(F.max_by(F.struct("commits", "last"), "version").alias("now"))
    return newest.select("path", "author", "now.commits", "now.last")


def kept_history(spark: SparkSession, target: str) -> DataFrame:
    """path, git_commits, git_authors, git_last_commit of a table that keep_history() wrote."""
    return _latest(spark, target).groupBy("path").agg(F.sum("commits").alias("git_commits"), F.count("author").alias("git_authors"), F.max("last").alias("git_last_commit"))


def compact(spark: SparkSession, target: str) -> None:
    """Put all versions of a kept history into one, then delete them.

    Its rows repeat what they hold, so a reader that sees both, or a run that
    stops in between, is right; readers that are at work when versions are
    deleted have to begin again. Not while a batch is written.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(at) if s.getPath().getName().startswith("version="))
    if len(versions) < 2:
        return
    top = versions[-1] | 1  # odd: behind the batch of that number, before the next one
    if top == versions[-1]:
        return
    _latest(spark, target).write.mode("overwrite").parquet(f"{target}/version={top}")
    for v in versions:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/version={v}"), True)
