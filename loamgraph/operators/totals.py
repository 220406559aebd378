"""Code totals: the state that merges, and estimates made once for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cost
from ..functions.cost import CostParams

FIELDS = ["sloc", "chars", "decisions", "decision_sloc", "files"]


def code_totals(stats: DataFrame, *by: str) -> DataFrame:
    """(language, lines, blank_lines, comment_lines, chars, complexity) -> sums by group; files without code lines don't count.

    Plain sums, so partial aggregation before the shuffle does nearly all of
    the work and groups merge in any order.
    """
    n = cost.sloc(F.col("lines"), F.col("blank_lines"), F.col("comment_lines"), F.col("language"))
    rows = stats.withColumn("_n", n)
    some = lambda c: F.sum(F.when(F.col("_n") > 0, c).otherwise(0)).cast("long")
    known = F.col("complexity").isNotNull()
    return rows.groupBy(*by).agg(
        some(F.col("_n")).alias("sloc"),
        some(F.coalesce("chars", F.col("lines") * cost.CHARS_PER_LINE)).alias("chars"),
        some(F.when(known, F.col("complexity")).otherwise(0)).alias("decisions"),
        some(F.when(known, F.col("_n")).otherwise(0)).alias("decision_sloc"),
        some(F.lit(1)).alias("files"),
    )


def merge(totals: DataFrame, *by: str) -> DataFrame:
    """Totals of finer groups -> of coarser ones."""
    return totals.groupBy(*by).agg(*[F.sum(f).cast("long").alias(f) for f in FIELDS])


def fields() -> dict[str, Column]:
    return {f: F.coalesce(F.col(f), F.lit(0)) for f in FIELDS}


def estimated(totals: DataFrame, p: CostParams | None = None) -> DataFrame:
    """totals plus the estimate by hand, the one in tokens and the blended value: once a group, never a sum of estimates."""
    p, t = p or CostParams(), fields()
    more = {**cost.cocomo(t["sloc"], p), **cost.ai_estimate(t, p), "value": cost.value(t, p)}
    return totals.withColumns(more)


def selected(stats: DataFrame, selection: DataFrame) -> DataFrame:
    """Totals of the files whose path is in selection(path)."""
    return code_totals(stats.join(selection, "path", "left_semi"))
