"""Scanners over DataFrames: one Python pass over the files, then plain columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import fnv1a
from .base import statistics, tokens
from .registry import CLONED, SCANNERS

STATS = "lines int, blank_lines int, comment_lines int, chars int, max_indent int, parse_errors int, complexity int, functions int, max_function_complexity int, hot array<struct<line:int,complexity:int,name:string>>"
SCHEMA = f"file_id long, decls array<struct<kind:string,key:string>>, refs array<struct<kind:string,raw:string,scope:string>>, stats struct<{', '.join(c.replace(' ', ':', 1) for c in STATS.split(', '))}>, toks array<string>, rows array<int>, hash string, error string"
#: Files of more bytes than this have no tokens (a fixed value).
TOKEN_BYTES = 1 << 20


def scan_files(files: DataFrame, with_tokens: bool = True) -> DataFrame:
    """files(file_id, path, language, text) -> one row each of facts, statistics and tokens.

    A file whose scanner fails keeps its row, without facts, and says why. A
    null text is a file that couldn't be read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file_id, path, language, text in batch[["file_id", "path", "language", "text"]].itertuples(index=False):
                row = {"file_id": file_id, "decls": [], "refs": [], "stats": None, "toks": [], "rows": [], "hash": None, "error": None}
                try:
                    f = SCANNERS[language](path, text)
                    row["decls"] = [{"kind": k, "key": v} for k, v in f.decls]
                    row["refs"] = [{"kind": k, "raw": v, "scope": s} for k, v, s in f.refs]
                    row["stats"] = statistics(text, f)
                    row["hash"] = f"{fnv1a(text.encode('utf-8', 'replace')):016x}"
                    if with_tokens and language in CLONED and row["stats"]["chars"] <= TOKEN_BYTES:
                        row["toks"], row["rows"] = tokens(text, f)
                except Exception as e:  # one odd file must not end the build
                    row["error"] = f"{type(e).__name__}: {e}"[:200]
                out.append(row)
            yield pd.DataFrame(out, columns=["file_id", "decls", "refs", "stats", "toks", "rows", "hash", "error"])

    return files.select("file_id", "path", "language", "text").mapInPandas(run, SCHEMA)


def decls_of(facts: DataFrame) -> DataFrame:
    return facts.select("file_id", F.posexplode("decls").alias("seq", "d")).select("file_id", "seq", "d.kind", "d.key")


def refs_of(facts: DataFrame) -> DataFrame:
    return facts.select("file_id", F.posexplode("refs").alias("seq", "r")).select("file_id", "seq", "r.kind", "r.raw", "r.scope")


def stats_of(facts: DataFrame) -> DataFrame:
    return facts.select("file_id", "stats.*", "hash", "error")


def tokens_of(facts: DataFrame) -> DataFrame:
    return facts.filter(F.size("toks") > 0).select("file_id", "toks", "rows")
