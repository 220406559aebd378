"""Per-file statistics that need no parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK = r"^[ \t\r\f]*$"


def lines_of(text: Column) -> Column:
    """Lines without their ends; a last line end opens no new line."""
    parts = F.split(text, "\n", -1)
    return F.when(F.endswith(text, F.lit("\n")) | (text == ""), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def line_stats(files: DataFrame) -> DataFrame:
    """file_id, lines, blank_lines, chars (bytes). A null text has null statistics."""
    split = F.size(F.split("text", "\n", -1))
    ends = F.endswith("text", F.lit("\n")) | (F.col("text") == "")
    blank = F.regexp_count("text", F.lit(r"(?m)^[ \t\r\f]*$"))
    # the place after a last line end is an empty line to the pattern, not to us
    return files.select(
        "file_id",
        (split - ends.cast("int")).alias("lines"),
        F.when(F.col("text") == "", 0).otherwise(blank - F.endswith("text", F.lit("\n")).cast("int")).alias("blank_lines"),
        F.octet_length("text").alias("chars"),
    )


def max_indent(files: DataFrame) -> DataFrame:
    """file_id, max_indent: widest indent over the most common increase (1 to 8, ties to the smaller; a tab is 4).

    Without a shuffle: the lines of a file stay an array in its row. A null text,
    or one without an increase, gives 0; each row of files gives one.
    """
    lead = lambda line: F.regexp_extract(line, r"^([ \t]*)", 1)
    width = F.transform(F.filter(lines_of(F.col("text")), lambda line: ~line.rlike(BLANK)), lambda line: F.length(F.replace(lead(line), F.lit("\t"), F.lit("    "))))
    rows = files.select("file_id", width.alias("w"))
    rows = rows.select("file_id", "w", F.zip_with("w", F.slice("w", 2, F.size("w")), lambda a, b: b - a).alias("up"))
    # the greatest (count, -increase) is the most common one, the smallest of equals
    times = lambda k: F.struct(F.size(F.filter("up", lambda u: u == k)).alias("c"), F.lit(-k).alias("k"))
    best = F.greatest(*[times(k) for k in range(1, 9)])
    rows = rows.select("file_id", F.array_max("w").alias("widest"), best.alias("best"))
    return rows.select("file_id", F.coalesce(F.when(F.col("best.c") > 0, F.floor(F.col("widest") / -F.col("best.k"))), F.lit(0)).cast("int").alias("max_indent"))


def hot_functions(functions: DataFrame, most: int = 5, least: int = 10) -> DataFrame:
    """(file_id, seq, line, complexity, name) -> file_id, hot: up to `most` functions of complexity `least` or more, ties to the earlier seq."""
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("complexity"), "seq"))
    top = functions.filter(F.col("complexity") >= least).withColumn("rank", rank).filter(F.col("rank") <= most)
    hot = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line", "complexity", "name"))), lambda x: F.struct(x["line"].alias("line"), x["complexity"].alias("complexity"), x["name"].alias("name")))
    return top.groupBy("file_id").agg(hot.alias("hot"))
