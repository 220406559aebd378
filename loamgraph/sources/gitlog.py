"""git history as rows (path, author, ts seconds) of every touch: a Spark data source for batches and streams.

    spark.dataSource.register(GitLogSource)
    spark.read.format("git_log").option("roots", json.dumps([...])).load()
    spark.readStream.format("git_log").option("roots", ...).load()

A partition is a stretch of one work tree's commits, `commits` of them at most
(an option). The driver asks for heads and numbers of commits only; each task
runs `git log` on its stretch and passes the lines on as they come. Heads are
taken once, so all tasks see one history. A stream's offset is the head of each
work tree; a batch has the commits that its end reaches and its start doesn't,
whatever was rewritten in between.
"""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

HEAD = "\x01"
COMMAND = ["log", "--no-merges", "--no-renames", "--name-only", f"--format={HEAD}%ct%x09%ae"]
SCHEMA = "root string, path string, author string, ts long"
#: Commits of a partition, rows of a batch.
COMMITS, BATCH = 2_000, 20_000


def parse(lines: DataFrame) -> DataFrame:
    """lines(root, n, value) of a log kept as text -> path, author, ts: each path line belongs to the last header before it."""
    is_head = F.startswith("value", F.lit(HEAD))
    by = Window.partitionBy("root").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("head", F.last(F.when(is_head, F.col("value")), ignorenulls=True).over(by)).filter(~is_head & (F.trim("value") != ""))
    parts = F.split(F.substring("head", F.lit(2), F.length("head")), "\t")
    return rows.select(F.concat("root", F.lit("/"), "value").alias("path"), parts[1].alias("author"), parts[0].cast("long").alias("ts"))


def _git(root: str, *args: str) -> subprocess.CompletedProcess:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace", env=os.environ | {"LC_ALL": "C"})


def work_tree(folder: str) -> str | None:
    """The top of the work tree that the folder is in; None if there is none, or no git."""
    try:
        out = _git(folder, "rev-parse", "--show-toplevel")
    except OSError:
        return None
    return out.stdout.strip() or None if out.returncode == 0 else None


def head(root: str) -> str | None:
    """The commit a work tree is at; None before the first one."""
    out = _git(root, "rev-parse", "--verify", "-q", "HEAD^{commit}")
    return out.stdout.strip() or None if out.returncode == 0 else None


class Stretch(InputPartition):
    """`count` commits of a work tree after the first `skip`, among those that `wanted` (commits, ^commits) names."""

    def __init__(self, root: str, wanted: list[str], skip: int, count: int):
        self.root, self.wanted, self.skip, self.count = root, wanted, skip, count


def stretches(root: str, wanted: list[str], size: int) -> list[Stretch]:
    out = _git(root, "rev-list", "--count", "--no-merges", *wanted)
    if out.returncode:
        raise RuntimeError(f"git rev-list in {root}: {out.stderr.strip()}")
    return [Stretch(root, wanted, k, size) for k in range(0, int(out.stdout), size)]


def touches(part: Stretch) -> Iterator[pa.RecordBatch]:
    """Rows of one stretch, read from git line by line."""
    command = ["git", "-c", "core.quotePath=false", "-C", part.root, *COMMAND, f"--skip={part.skip}", f"--max-count={part.count}", *part.wanted, "--"]
    rows, author, ts = [], None, None

    def batch():
        paths, authors, times = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([part.root] * len(rows)), pa.array(paths), pa.array(authors), pa.array(times, pa.int64())], names=["root", "path", "author", "ts"])

    with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, errors="replace", env=os.environ | {"LC_ALL": "C"}) as log:
        for line in log.stdout:
            line = line.rstrip("\n")
            if line.startswith(HEAD):
                when, _, author = line[1:].partition("\t")
                ts = int(when)
            elif line:
                rows.append((f"{part.root}/{line}", author, ts))
                if len(rows) == BATCH:
                    yield batch()
                    rows = []
        failed = log.stderr.read()
    if log.returncode:
        raise RuntimeError(f"git log in {part.root}: {failed.strip()}")
    if rows:
        yield batch()


class _Options:
    def __init__(self, options: dict[str, str]):
        folders = json.loads(options["roots"]) if "roots" in options else [options["path"]]
        self.roots = sorted({r for f in folders if (r := work_tree(f))})
        self.size = int(options.get("commits", str(COMMITS)))


class GitLogReader(_Options, DataSourceReader):
    def partitions(self) -> list[Stretch]:
        return [p for r in self.roots if (h := head(r)) for p in stretches(r, [h], self.size)]

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        return touches(partition) if partition else iter(())


class GitLogStreamReader(_Options, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {r: h for r in self.roots if (h := head(r))}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return [p for r, h in sorted(end.items()) if start.get(r) != h for p in stretches(r, [h] + ([f"^{start[r]}"] if r in start else []), self.size)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return touches(partition)


class GitLogSource(DataSource):
    """Touches of the work trees that folders are in; git and the trees must be there on all executors."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GitLogReader:
        return GitLogReader(self.options)

    def streamReader(self, schema) -> GitLogStreamReader:
        return GitLogStreamReader(self.options)


def read(spark: SparkSession, folders: list[str], commits: int = COMMITS) -> tuple[DataFrame, DataFrame]:
    """(commits, work trees) of the folders."""
    spark.dataSource.register(GitLogSource)
    rows = spark.read.format("git_log").options(roots=json.dumps(list(folders)), commits=str(commits)).load()
    roots = sorted({r for f in folders if (r := work_tree(f))})
    return rows.select("path", "author", "ts"), spark.createDataFrame([(r,) for r in roots], "root string")


def read_stream(spark: SparkSession, folders: list[str], commits: int = COMMITS) -> DataFrame:
    """Touches as a stream: first all of the history, then what new heads add."""
    spark.dataSource.register(GitLogSource)
    return spark.readStream.format("git_log").options(roots=json.dumps(list(folders)), commits=str(commits)).load().select("path", "author", "ts")
