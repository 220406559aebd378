"""The engine in SQL: scanners as table functions, operators as views.

    from loamgraph import sql

    sql.views(spark, files)        # files(file_id, path, language, text)
    spark.sql("SELECT target, count(*) FROM edges GROUP BY target")

register() alone makes the scanners known, for use beside LATERAL:

    SELECT f.path, r.raw FROM files f, LATERAL scan_refs(f.language, f.path, f.text) r

A table function scans a text for itself; scan.facts reads it once for
everything, which a whole build prefers.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .operators import filestats, graph, resolve
from .scan.base import statistics, tokens
from .scan.facts import STATS
from .scan.registry import CLONED, SCANNERS
from .sources import tsconfig


def _facts(language, path, text):
    """What the language's scanner finds; None for other languages, unread files, and texts that the scanner fails on."""
    if text is None or language not in SCANNERS:
        return None
    try:
        return SCANNERS[language](path, text)
    except Exception:  # one odd file must not end the query
        return None


@udtf(returnType="seq int, kind string, key string")
class ScanDecls:
    """Keys that a file declares, in order."""

    def eval(self, language: str, path: str, text: str) -> Iterator[tuple]:
        f = _facts(language, path, text)
        yield from ((i, k, v) for i, (k, v) in enumerate(f.decls if f else ()))


@udtf(returnType="seq int, kind string, raw string, scope string")
class ScanRefs:
    """References of a file, in order."""

    def eval(self, language: str, path: str, text: str) -> Iterator[tuple]:
        f = _facts(language, path, text)
        yield from ((i, k, v, s) for i, (k, v, s) in enumerate(f.refs if f else ()))


@udtf(returnType=STATS)
class ScanStats:
    """One row of statistics; none for a file that can't be scanned."""

    def eval(self, language: str, path: str, text: str) -> Iterator[tuple]:
        if f := _facts(language, path, text):
            s = statistics(text, f)
            yield tuple(s[c.split()[0]] for c in STATS.split(", "))


@udtf(returnType="pos int, token string, row int")
class ScanTokens:
    """Tokens without comments, of the languages whose copies are looked for."""

    def eval(self, language: str, path: str, text: str) -> Iterator[tuple]:
        f = _facts(language, path, text)
        if f and language in CLONED:
            yield from ((i, t, r) for i, (t, r) in enumerate(zip(*tokens(text, f), strict=True)))


FUNCTIONS = {"scan_decls": ScanDecls, "scan_refs": ScanRefs, "scan_stats": ScanStats, "scan_tokens": ScanTokens}

#: Views that are SQL over others, in order; {p} is the prefix of their names.
VIEWS = {
    "decls": "SELECT f.file_id, d.* FROM {p}files f, LATERAL scan_decls(f.language, f.path, f.text) d",
    "refs": "SELECT f.file_id, f.path, f.language, r.* FROM {p}files f, LATERAL scan_refs(f.language, f.path, f.text) r",
    "symbols": "SELECT key, max_by(file_id, struct(file_id, seq)) AS file_id FROM {p}decls GROUP BY key",
    "resolved": """SELECT r.file_id, r.seq, any_value(r.kind) AS kind, any_value(r.raw) AS raw, min_by(s.file_id, c.pos) FILTER (WHERE s.file_id IS NOT NULL) AS target
        FROM {p}refs r LEFT JOIN {p}candidates c ON c.file_id = r.file_id AND c.seq = r.seq LEFT JOIN {p}symbols s ON s.key = c.key GROUP BY r.file_id, r.seq""",
    "edges": """SELECT DISTINCT file_id AS source, target, CASE kind {kinds} END AS kind FROM {p}resolved WHERE target <> file_id""",
    "unresolved": "SELECT f.file_id, count_if(r.file_id IS NOT NULL AND r.target IS NULL) AS unresolved FROM {p}files f LEFT JOIN {p}resolved r ON r.file_id = f.file_id GROUP BY f.file_id",
    "stats": "SELECT f.file_id, s.* FROM {p}files f, LATERAL scan_stats(f.language, f.path, f.text) s",
}


def register(spark: SparkSession) -> None:
    """Make the scanners known as table functions."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)


def candidates(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs(file_id, path, language, seq, kind, raw, scope) -> file_id, seq, pos, key: the keys that each reference tries, in order."""
    own = files.select("path", "language")
    config = tsconfig.nearest(own.filter(F.col("language").isin("javascript", "typescript", "tsx")), tsconfig.configs(files.filter("language = 'json'")))
    rows = refs.join(resolve.imports_of(refs), "file_id", "left").join(config, "path", "left")
    return resolve.candidates(rows).select("file_id", "seq", F.posexplode("candidates").alias("pos", "key"))


def views(spark: SparkSession, files: DataFrame, prefix: str = "") -> list[str]:
    """Register the scanners, and a temporary view for each operator from files to edges; returns the views' names.

    files, decls, refs, candidates, symbols, resolved, edges, unresolved,
    stats, lines and fan. Views are plans: each query that names them runs them.
    """
    register(spark)
    kinds = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in resolve.LABEL.items())
    files.createOrReplaceTempView(f"{prefix}files")
    made = [f"{prefix}files"]

    def view(name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(prefix + name)
        made.append(prefix + name)

    for name, text in VIEWS.items():
        if name == "resolved":
            view("candidates", candidates(spark.table(f"{prefix}refs"), files))
        view(name, spark.sql(text.format(p=prefix, kinds=kinds)))
    view("lines", filestats.line_stats(files))
    view("fan", graph.fan(files.select(F.col("file_id").alias("id")), spark.table(f"{prefix}edges")))
    return made
