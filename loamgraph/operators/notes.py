"""Notes and positions kept beside a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def for_path(notes: DataFrame, path: str) -> DataFrame:
    return notes.filter((F.col("path") == path) | F.array_contains("group_paths", path))


def for_paths(notes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, id) of every note that is about one of wanted(path), directly or as a member of its group."""
    about = notes.select("id", F.explode(F.array_compact(F.array_union(F.coalesce("group_paths", F.array().cast("array<string>")), F.array("path")))).alias("path"))
    return about.join(wanted, "path", "left_semi").select("path", "id").distinct()


def for_exact_group(notes: DataFrame, group: list[str]) -> DataFrame:
    """Group notes about exactly these paths, in any order."""
    want = F.array_distinct(F.array(*[F.lit(p) for p in group]))
    own = F.array_distinct("group_paths")
    return notes.filter((F.size(own) == F.size(want)) & (F.size(F.array_except(own, want)) == 0))


def stale(positions: DataFrame, files: DataFrame) -> DataFrame:
    """(path, hash, current) of stored positions whose file has changed since."""
    return positions.select("path", "hash").join(files.select("path", F.col("hash").alias("current")), "path").filter("hash <> current")


def upsert_positions(positions: DataFrame, new: DataFrame) -> DataFrame:
    """positions with those of new(path, hash, x, y, z) put in the place of older ones."""
    keys = [c for c in positions.columns if c != "path"]
    n = new.select("path", *[F.col(c).alias(f"_{c}") for c in keys], F.lit(True).alias("_is"))
    both = positions.join(n, "path", "full_outer")
    return both.select("path", *[F.when(F.col("_is"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in keys])
