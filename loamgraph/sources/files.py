"""Folders of files as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..session import materialise

#: Folders that hold no sources of their own.
SKIPPED = [".git", "bin", "obj", "build", "node_modules", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", "vendor", "dist", ".next", "coverage"]
#: Files that tools write.
NOISE = ["package-lock.json", "npm-shrinkwrap.json"]
#: Languages by extension, in either direction.
EXTENSIONS = {
    "c": [".c", ".h"], "csharp": [".cs"], "lisp": [".lisp", ".lsp", ".cl"], "python": [".py", ".pyi"], "go": [".go"], "php": [".php"], "vbnet": [".vb"],
    "javascript": [".js", ".mjs", ".cjs", ".jsx"], "typescript": [".ts", ".mts", ".cts"], "tsx": [".tsx"], "json": [".json"], "bash": [".sh", ".bash"], "proto": [".proto"],
    "sql": [".sql"], "powershell": [".ps1", ".psm1", ".psd1"], "batch": [".bat", ".cmd"], "html": [".html", ".htm"], "css": [".css"], "markdown": [".md", ".markdown"],
}
LANGUAGE = {e: lang for lang, es in EXTENSIONS.items() for e in es}


def language_of(path: Column) -> Column:
    """By extension, in its own case; NULL for others."""
    return F.create_map(*[F.lit(x) for kv in LANGUAGE.items() for x in kv])[paths.extension(path)]


def is_noise(path: Column) -> Column:
    return paths.let(paths.basename(path), lambda name: name.isin(*NOISE) | (F.endswith(name, F.lit(".min.js")) & (F.length(name) > 7)))


def claimed(listing: DataFrame) -> DataFrame:
    """listing(path, ...) -> rows some language claims, with column language; noise and skipped folders aside."""
    parts = F.split(paths.dirname(F.col("path")), "/")
    skipped = F.arrays_overlap(parts, F.lit(SKIPPED))
    return listing.withColumn("language", language_of(F.col("path"))).filter(F.col("language").isNotNull() & ~is_noise(F.col("path")) & ~skipped)


def union_roots(roots: list[DataFrame]) -> DataFrame:
    """Rows of several roots, each path once."""
    return reduce(DataFrame.unionByName, roots).dropDuplicates(["path"])


def with_ids(files: DataFrame, column: str = "file_id", order: str | list[Column] = "path", spread: int | None = None) -> DataFrame:
    """Dense ids from 0 in order of path, or of other columns.

    Range partitions are numbered each by a window of its own and shifted by
    the sizes of those before; no partition ever holds all rows. The ranges are
    written once, so that numbers and rows belong together. Rows that are equal
    in the order share a partition, and which of them comes first is open.
    Other columns may have any names.
    """
    spark = files.sparkSession
    n = spread or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(order)] if isinstance(order, str) else order
    part, shift = "_part", "_before"
    while {part, shift} & {c.lower() for c in files.columns}:
        part, shift = part + "_", shift + "_"
    dealt = materialise(files.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()), "ids")
    sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(shift))  # one row a partition
    at = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1 + F.col(shift)
    return dealt.join(F.broadcast(before), part).withColumn(column, at.cast("long")).drop(part, shift)


def read_tree(spark: SparkSession, roots: list[str], tasks: int = 64, **options: str) -> DataFrame:
    """Source files below the roots: file_id, path, language, text, n_bytes; text is NULL where a file can't be read.

    Tasks list the folders and read the files (sources/trees.py), so the roots
    must be mounted on all executors; the driver opens `tasks` folders at most.
    Spark's own readers skip names that begin with `_` or `.`, and with them
    `__init__.py`; see read_store() for trees in an object store.
    """
    from . import trees

    return with_ids(trees.read(spark, roots, tasks=str(tasks), **options).select("path", "language", "text", "n_bytes"))


def read_store(spark: SparkSession, roots: list[str]) -> DataFrame:
    """The same from any store that Spark reads, without names that begin with `_` or `.`."""
    globs = "*.{" + ",".join(e[1:] for e in LANGUAGE) + "}"

    def below(root: str) -> DataFrame:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", globs).load(root)
        rows = rows.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), "content", F.col("length").alias("n_bytes"))
        inside = F.substring("path", F.lit(len(root.rstrip("/")) + 1), F.length("path"))  # skipped folders count below the root only
        parts = F.split(paths.dirname(inside), "/")
        return rows.withColumn("language", language_of(F.col("path"))).filter(F.col("language").isNotNull() & ~is_noise(F.col("path")) & ~F.arrays_overlap(parts, F.lit(SKIPPED)))

    text = F.make_valid_utf8(F.col("content").cast("string"))
    return with_ids(union_roots([below(r) for r in roots]).select("path", "language", text.alias("text"), "n_bytes"))
