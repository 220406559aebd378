"""Commit history by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_history(commits: DataFrame) -> DataFrame:
    """(path, author, ts seconds) -> path, git_commits, git_authors, git_last_commit; each touch counts."""
    return commits.groupBy("path").agg(F.count(F.lit(1)).alias("git_commits"), F.countDistinct("author").alias("git_authors"), F.max("ts").alias("git_last_commit"))


def with_history(files: DataFrame, history: DataFrame, tracked: DataFrame) -> DataFrame:
    """files plus history: NULL outside tracked folders, 0 in them without commits. tracked: (root) of work trees."""
    from ..functions.paths import ancestors, dirname

    roots = files.select("path", F.explode(ancestors(dirname(F.col("path")))).alias("root")).join(tracked, "root", "left_semi").select("path").distinct().withColumn("in_repo", F.lit(True))
    out = files.join(history, "path", "left").join(roots, "path", "left")
    zero = lambda c: F.when(F.col("in_repo"), F.coalesce(c, F.lit(0))).alias(c)
    return out.select(*files.columns, zero("git_commits"), zero("git_authors"), F.when(F.col("in_repo"), F.col("git_last_commit")).alias("git_last_commit"))
