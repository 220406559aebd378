"""From files to the graph: scan, resolve, statistics, history, duplicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clones, graph, history, resolve
from ..scan import facts as scans
from ..session import materialise
from ..sources import tsconfig


@dataclass
class Build:
    nodes: DataFrame
    edges: DataFrame
    clones: DataFrame
    resolved: DataFrame


def resolved_references(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Every reference with its target file, NULL where it has none."""
    refs = scans.refs_of(facts)
    own = files.select("file_id", "path", "language")
    config = tsconfig.nearest(own.filter(F.col("language").isin("javascript", "typescript", "tsx")), tsconfig.configs(files.filter("language = 'json'")))
    rows = refs.join(own, "file_id").join(resolve.imports_of(refs), "file_id", "left").join(config, "path", "left")
    return resolve.ordered_probe(resolve.candidates(rows), resolve.symbols(scans.decls_of(facts)))


def build(files: DataFrame, commits: DataFrame | None = None, tracked: DataFrame | None = None, with_clones: bool = True) -> Build:
    """files(file_id, path, language, text) -> nodes, edges and clones.

    Facts are written once: references, statistics and tokens all read them.
    """
    facts = materialise(scans.scan_files(files, with_clones), "facts")
    resolved = materialise(resolved_references(files, facts), "resolved")
    edges = resolve.edges(resolved)
    nodes = files.select(F.col("file_id").alias("id"), "path", "language")
    blast, cycle = graph.blast_and_cycles(nodes, edges)
    out = nodes.join(scans.stats_of(facts).withColumnRenamed("file_id", "id"), "id", "left")
    more = [graph.fan(nodes, edges), resolve.unresolved(files, resolved).withColumnRenamed("file_id", "id"), blast, cycle]
    for m in more:
        out = out.join(m, "id", "left")
    if commits is not None:
        out = history.with_history(out, history.file_history(commits), tracked if tracked is not None else commits.sparkSession.createDataFrame([("/",)], "root string"))
    else:
        out = out.withColumns({"git_commits": F.lit(None).cast("long"), "git_authors": F.lit(None).cast("long"), "git_last_commit": F.lit(None).cast("long")})
    rank = graph.hotspots(out.select("id", F.col("git_commits").alias("commits"), "complexity")).select("id", "hotspot_rank")
    out = out.join(rank, "id", "left")
    toks = scans.tokens_of(facts)
    found = clones.clones(toks)
    return Build(out, edges, found, resolved)
