"""Folders of sources as a Spark data source: tasks list the folders and read the files, the driver opens the topmost ones only.

    spark.dataSource.register(TreeSource)
    spark.read.format("source_tree").option("roots", json.dumps([...])).load()

Options: `roots` (JSON list) or `path` (one root); `text` = false leaves the
texts NULL and the files closed; `tasks` is how many folders the driver may
open to deal out what is below them. Conditions on language, extension and the
beginning of path are pushed into the listing with `pushdown` = true, which
Spark takes only where spark.sql.python.filterPushdown.enabled is set (read()
looks): other folders aren't entered, other files aren't opened.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from .files import LANGUAGE, NOISE, SKIPPED

#: Bytes of texts in a batch; a longer file is a batch of its own.
BATCH = 8_000_000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SCHEMA = "path string, extension string, language string, n_bytes long, text string"


def noise(name: str) -> bool:
    return name in NOISE or (name.endswith(".min.js") and len(name) > len(".min.js"))


@dataclass
class Wanted:
    """What the listing is narrowed to; None stands for everything."""

    languages: set[str] | None = None
    extensions: set[str] | None = None
    prefixes: list[str] = field(default_factory=list)

    def take(self, f: Filter) -> bool:
        """Note the condition; False if it isn't one that the listing can answer."""
        column = f.attribute if isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)) else None
        if isinstance(f, IsNotNull):
            return column != ("text",)
        if column in (("language",), ("extension",)) and isinstance(f, (EqualTo, In)):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            name = "languages" if column == ("language",) else "extensions"
            have = getattr(self, name)
            setattr(self, name, values if have is None else have & values)
            return True
        if column == ("path",) and isinstance(f, (EqualTo, StringStartsWith)):
            self.prefixes.append(f.value)
            return isinstance(f, StringStartsWith)  # a path that goes on is not the one asked for
        return False

    def folder(self, path: str) -> bool:
        """Whether files below the folder may be wanted."""
        below = path.rstrip("/") + "/"
        return all(below.startswith(p) or p.startswith(below) for p in self.prefixes)

    def file(self, path: str, extension: str) -> bool:
        return all(path.startswith(p) for p in self.prefixes) and (self.extensions is None or extension in self.extensions) and (self.languages is None or LANGUAGE[extension] in self.languages)


class Listing:
    """Walks below the roots by rules that need no memory of what was seen elsewhere.

    A folder that is a root of its own is left to that root. A link is followed
    unless it leads to a folder that contains it, or to one that is listed at
    its own place below a root.
    """

    def __init__(self, roots: Iterable[str], wanted: Wanted | None = None):
        self.roots = sorted({os.path.abspath(r) for r in roots})
        self.real = [os.path.realpath(r) for r in self.roots]
        self.wanted = wanted or Wanted()

    def follows(self, link: str) -> bool:
        to, at = os.path.realpath(link), os.path.realpath(os.path.dirname(link))
        if (at + "/").startswith(to.rstrip("/") + "/"):
            return False
        for root in self.real:
            if to == root or (to.startswith(root.rstrip("/") + "/") and not set(to[len(root) :].split("/")) & set(SKIPPED)):
                return False
        return True

    def open(self, folder: str) -> tuple[list[str], list[tuple[str, str, int]]]:
        """(folders to enter, (path, extension, bytes) of files that are wanted) of one folder, by name; one that can't be opened is empty."""
        inner, files = [], []
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return inner, files
        for e in entries:
            try:
                if e.is_dir():
                    if e.name not in SKIPPED and e.path not in self.roots and self.wanted.folder(e.path) and (not e.is_symlink() or self.follows(e.path)):
                        inner.append(e.path)
                    continue
                extension = "." + e.name.rsplit(".", 1)[1] if "." in e.name else ""
                if extension in LANGUAGE and not noise(e.name) and self.wanted.file(e.path, extension) and e.is_file():
                    files.append((e.path, extension, e.stat().st_size))
            except OSError:
                continue
        return inner, files

    def below(self, folder: str) -> Iterator[tuple[str, str, int]]:
        stack = [folder]
        while stack:
            inner, files = self.open(stack.pop())
            yield from files
            stack += reversed(inner)


class Part(InputPartition):
    """A folder, with all that is below it if `deep`."""

    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        found = json.loads(options["roots"]) if "roots" in options else [options["path"]]
        self.roots = list(found)
        self.texts = options.get("text", "true").lower() != "false"
        self.tasks = int(options.get("tasks", "64"))
        self.wanted = Wanted()

    def partitions(self) -> list[Part]:
        listing = Listing(self.roots, self.wanted)
        out, queue, opened = [], [r for r in listing.roots if self.wanted.folder(r)], 0
        while queue and opened < self.tasks and len(queue) < self.tasks:
            folder = queue.pop(0)
            opened += 1
            queue += listing.open(folder)[0]
            out.append(Part(folder, False))
        return out + [Part(f, True) for f in queue]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no folder is wanted
            return
        listing = Listing(self.roots, self.wanted)
        rows, size = [], 0
        for path, extension, n in listing.below(partition.folder) if partition.deep else listing.open(partition.folder)[1]:
            text = None
            if self.texts:
                try:
                    with open(path, "rb") as f:
                        text = f.read().decode("utf-8", "replace")
                except OSError:
                    pass
                if rows and size + n > BATCH:
                    yield _batch(rows)
                    rows, size = [], 0
            rows.append((path, extension, LANGUAGE[extension], n, text))
            size += n if self.texts else 1000
            if size > BATCH:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


class NarrowedTreeReader(TreeReader):
    """Answers conditions itself; Spark refuses a reader that could, where it may not."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.wanted.take(f)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "extension", "language", "n_bytes", "text"])


class TreeSource(DataSource):
    """Source files below folders that are mounted on all executors: path, extension, language, n_bytes, text (NULL where a file can't be read)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return (NarrowedTreeReader if self.options.get("pushdown", "false").lower() == "true" else TreeReader)(self.options)


def read(spark: SparkSession, roots: Iterable[str], **options: str) -> DataFrame:
    """Rows of SCHEMA below the roots, with conditions pushed into the listing where the session allows it."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").options(roots=json.dumps(list(roots)), pushdown=spark.conf.get(PUSHDOWN, "false"), **options).load()
