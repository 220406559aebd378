"""Graph operators over edges(source, target, kind)."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialise
from ..sources.files import with_ids

#: Components times nodes beyond which blast radius isn't computed (a fixed value).
BUDGET = 400_000_000
#: Longs of 64 nodes in a row of bits.
WORDS = 16


def pairs(edges: DataFrame) -> DataFrame:
    """Distinct directed pairs, kinds and self-edges aside."""
    return edges.select("source", "target").filter("source <> target").distinct()


def fan(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out: numbers of distinct neighbours. One pass over both ends of each pair."""
    p = pairs(edges)
    ends = p.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(p.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    n = ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return nodes.select("id").join(n, "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).cast("long").alias("fan_in"), F.coalesce("fan_out", F.lit(0)).cast("long").alias("fan_out"))


def closure(edges: DataFrame, budget: int | None = None) -> DataFrame | None:
    """(u, v) for each v that u reaches over one edge or more; None once there are more than `budget` pairs.

    Semi-naive: only pairs found in the last round are extended. Each round is
    written to the shared folder, so a lost executor costs that round alone.
    """
    step = materialise(pairs(edges).withColumnsRenamed({"source": "u", "target": "v"}), "closure")
    reach, delta, rounds = step, step, [step]
    size = step.count() if budget is not None else 0
    while True:
        new = delta.join(step.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").select("u", F.col("w").alias("v")).distinct().join(reach, ["u", "v"], "left_anti")
        delta = materialise(new, "closure")
        if delta.isEmpty():
            discard(delta)
            return reach
        rounds.append(delta)
        reach = reach.unionByName(delta)
        if budget is not None:
            size += delta.count()
            if size > budget:
                for r in rounds:
                    discard(r)
                return None


def blast_radius(nodes: DataFrame, reach: DataFrame | None) -> DataFrame:
    """id, blast_radius: how many others reach the node; NULL without a closure."""
    if reach is None:
        return nodes.select("id", F.lit(None).cast("long").alias("blast_radius"))
    n = reach.filter("u <> v").groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("blast_radius"))


def blast_allowed(nodes: DataFrame, cycle: DataFrame) -> bool:
    """Whether strongly connected components times nodes are within BUDGET; cycle has cycle_size of each node."""
    got = cycle.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("cycle_size") > 1, 1 / F.col("cycle_size")).otherwise(1.0)).alias("parts")).first()
    return round(got["parts"] or 0) * got["n"] <= BUDGET


def condensation(cycle: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, part) of each node and (source, target) between parts, without cycles: a part is a strongly connected component, named by its smallest node."""
    part = cycle.select("id", F.coalesce("cycle_id", "id").alias("part"))
    ends = pairs(edges).join(part.withColumnsRenamed({"id": "source", "part": "s"}), "source").join(part.withColumnsRenamed({"id": "target", "part": "t"}), "target")
    return part, pairs(ends.select(F.col("s").alias("source"), F.col("t").alias("target")))


def levels(parts: DataFrame, links: DataFrame) -> DataFrame:
    """(part), acyclic (source, target) -> part, level: the length of the longest way that ends there.

    Parts that no open link reaches are peeled off, with the links that leave
    them. A level takes two small tables; its links are read once more only.
    """
    rest, left, done = parts.select("part").distinct(), materialise(links, "peel-links"), Gathered("levels")
    told = None
    for level in itertools.count():
        blocked = left.select(F.col("target").alias("part"), F.lit(True).alias("blocked")).distinct()
        before, told = told, materialise(rest.join(blocked, "part", "left"), "peel")
        discard(before)
        done.add(materialise(told.filter("blocked is null").select("part", F.lit(level).alias("level")), "level"))
        rest = told.filter("blocked").select("part")
        if rest.isEmpty():
            break
        kept = materialise(left.join(rest.withColumnRenamed("part", "source"), "source", "left_semi"), "peel-links")
        discard(left)
        left = kept
    for t in (left, told):
        discard(t)
    return done.table()


class Gathered:
    """Tables of many rounds as one; MANY of them are put together at a time, so that plans don't grow with the rounds."""

    MANY = 32

    def __init__(self, name: str):
        self.name, self.parts = name, []

    def add(self, table: DataFrame) -> None:
        self.parts.append(table)
        if len(self.parts) == self.MANY:
            self.parts = [self.table()]

    def table(self) -> DataFrame:
        """All of them, written once; what was added is gone."""
        out = materialise(reduce(DataFrame.unionByName, self.parts), self.name)
        for t in self.parts:
            discard(t)
        self.parts = [out]
        return out


def reach_counts(parts: DataFrame, links: DataFrame) -> DataFrame:
    """(id, part), acyclic (source, target) over parts -> part, n: how many nodes lie in the part or in parts that reach it.

    Nodes are numbered along the levels and kept as bits: a row (part, slice)
    holds WORDS longs, 64 nodes each, and only slices with a bit have a row, so
    that the parts' ancestors take nodes / 8 bytes each at most. Level by level
    a part's bits are its own nodes' and those that came over its links, joined
    by bit_or, which Spark aggregates before it shuffles; what a level sends on
    is written by the level that will read it. No pair of nodes is a row.
    """
    level = levels(parts, links)
    words, span = [f"b{k}" for k in range(WORDS)], 64 * WORDS
    either = [F.bit_or(w).alias(w) for w in words]
    placed = with_ids(parts.join(level, "part"), "place", [F.col("level"), F.col("part"), F.col("id")])
    at = F.col("place") % span
    bits = [F.when(F.floor(at / 64) == k, F.expr(f"shiftleft(1L, cast((place % {span}) % 64 as int))")).otherwise(F.lit(0).cast("long")).alias(w) for k, w in enumerate(words)]
    own = placed.select("part", "level", F.floor(F.col("place") / span).alias("slice"), *bits).groupBy("part", "level", "slice").agg(*either)
    own = materialise(own, "bits-own", "level")
    onward = links.join(level.withColumnsRenamed({"part": "target", "level": "to"}), "target").join(level.withColumnsRenamed({"part": "source", "level": "from"}), "source")
    onward = materialise(onward.select("source", "target", "from", "to"), "bits-links", "from")
    reads: dict[int, list[int]] = {}  # which levels a level gets bits from
    for r in onward.select("from", "to").distinct().collect():
        reads.setdefault(r["to"], []).append(r["from"])
    sends = {m for ms in reads.values() for m in ms}
    ones = reduce(Column.__add__, [F.bit_count(w) for w in words])
    sent, out = {}, Gathered("reach")
    for n in range(level.agg(F.max("level")).first()[0] + 1 if not level.isEmpty() else 0):
        rows = own.filter(F.col("level") == n).select("part", "slice", *words)
        for m in reads.get(n, ()):
            rows = rows.unionByName(sent[m].filter(F.col("to") == n).select("part", "slice", *words))
        full = materialise(rows.groupBy("part", "slice").agg(*either), "bits") if n in reads else rows
        out.add(materialise(full.groupBy("part").agg(F.sum(ones).cast("long").alias("n")), "reach"))
        if n in sends:
            step = onward.filter(F.col("from") == n).select(F.col("source").alias("part"), "target", "to")
            sent[n] = materialise(full.join(step, "part").groupBy(F.col("target").alias("part"), "to", "slice").agg(*either), "bits-sent", "to")
        discard(full)
    for t in [level, own, onward, *sent.values()]:
        discard(t)
    return out.table() if out.parts else parts.select("part", F.lit(0).cast("long").alias("n")).limit(0)


def blast_from_cycles(nodes: DataFrame, edges: DataFrame, cycle: DataFrame) -> DataFrame:
    """id, blast_radius over the condensation of the graph; cycle is what cycles_large() gives, on a table. NULL beyond BUDGET."""
    if not blast_allowed(nodes, cycle):
        return blast_radius(nodes, None)
    parts, links = condensation(cycle, edges)
    parts, links = materialise(parts, "parts"), materialise(links, "part-links")
    n = reach_counts(parts, links)
    # nodes of edges that aren't listed take part in ways, but have no row
    out = materialise(nodes.select("id").join(parts, "id", "left").join(n, "part", "left").select("id", (F.coalesce("n", F.lit(1)) - 1).alias("blast_radius")), "blast")
    for t in (parts, links, n):
        discard(t)
    return out


def blast_and_cycles(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """blast_radius() and cycles() of a graph, without its closure; beyond BUDGET the first has NULLs. Edges to nodes that aren't listed are left out."""
    known = pairs(edges)
    for end in ("source", "target"):
        known = known.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    known = materialise(known.select("source", "target"), "known-edges")
    found = cycles_large(nodes, known)
    out = blast_from_cycles(nodes, known, found)
    discard(known)
    return out, found


def _cycles(nodes: DataFrame, member: DataFrame) -> DataFrame:
    """(id, root) of nodes in components of two or more -> id, cycle_id (smallest member), cycle_size (0 outside)."""
    size = member.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    both = member.join(size, "root").filter("n > 1").select("id", "least", "n")
    return nodes.select("id").join(both, "id", "left").select("id", F.col("least").alias("cycle_id"), F.coalesce("n", F.lit(0)).alias("cycle_size"))


def cycles(nodes: DataFrame, reach: DataFrame) -> DataFrame:
    """Strongly connected components from a closure: those that reach each other."""
    back = reach.select(F.col("v").alias("u"), F.col("u").alias("v"))
    mutual = reach.join(back, ["u", "v"]).groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
    return _cycles(nodes, mutual.select("id", F.least("id", "root").alias("root")))


def cycles_large(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same without a closure: trim nodes that have no way in or out, colour forward by the largest id, confirm backward from it.

    For graphs of any size: state is one row a node. The result is a table.
    """
    left = materialise(pairs(edges), "scc-edges")
    done, tables = None, []
    while True:
        while True:  # trim
            n = left.count()
            both = left.select("source").distinct().join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
            kept = materialise(left.join(both, "source", "left_semi").join(both.withColumnRenamed("source", "target"), "target", "left_semi").select("source", "target"), "scc-edges")
            discard(left)
            left = kept
            if left.count() == n:
                break
        if left.isEmpty():
            break
        ids = left.select(F.col("source").alias("id")).distinct()
        colour_table = materialise(ids.select("id", F.col("id").alias("c")), "scc-colour")
        colour = colour_table
        while True:
            push = left.join(colour.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.max("c").alias("m"))
            new = materialise(colour.join(push, "id", "left").select("id", F.greatest("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") > F.col("c")).alias("moved")), "scc-colour")
            discard(colour_table)
            colour_table, colour = new, new.select("id", "c")
            if new.filter("moved").isEmpty():
                break
        inside = left.join(colour.withColumnsRenamed({"id": "source", "c": "cs"}), "source").join(colour.withColumnsRenamed({"id": "target", "c": "ct"}), "target").filter("cs = ct").select("source", "target")
        inside = materialise(inside, "scc-inside")
        found = materialise(colour.filter("id = c").select("id", F.col("c").alias("root")), "scc-found")
        tables += [colour_table, inside, found]
        front = found
        while True:
            back = inside.join(front.withColumnRenamed("id", "target"), "target").select(F.col("source").alias("id"), "root").distinct().join(found, "id", "left_anti")
            front = materialise(back, "scc-found")
            tables.append(front)
            if front.isEmpty():
                break
            found = found.unionByName(front)
        done = found if done is None else done.unionByName(found)
        rest = left.join(found.select(F.col("id").alias("source")), "source", "left_anti").join(found.select(F.col("id").alias("target")), "target", "left_anti").select("source", "target")
        tables.append(left)
        left = materialise(rest, "scc-edges")
    if done is None:
        done = nodes.select("id", F.col("id").alias("root")).limit(0)
    out = materialise(_cycles(nodes, done), "cycles")
    for t in [left, *tables]:
        discard(t)
    return out


def hotspots(stats: DataFrame) -> DataFrame:
    """(id, commits, complexity) -> id, hotspot_rank by commits * complexity, ties to the smaller id; only where both are positive."""
    some = stats.filter("commits > 0 and complexity > 0").select("id", (F.col("commits") * F.col("complexity")).alias("score"))
    rank = with_ids(some, "place", [F.desc("score"), F.col("id")]).select("id", (F.col("place") + 1).alias("hotspot_rank"))
    return stats.select("id").join(rank, "id", "left")


def neighbours(edges: DataFrame, node: int) -> DataFrame:
    return edges.filter((F.col("source") == node) | (F.col("target") == node))


def cycle_mates(cycle: DataFrame, most: int = 4) -> DataFrame:
    """id, mates (the first `most` others of its cycle by id), more (how many others are left)."""
    some = cycle.filter(F.col("cycle_id").isNotNull()).select("id", "cycle_id", "cycle_size")
    # most + 1 ids of a cycle hold the first `most` others of any member
    rank = F.row_number().over(Window.partitionBy("cycle_id").orderBy("id"))
    first = some.withColumn("r", rank).filter(F.col("r") <= most + 1).groupBy("cycle_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    mates = F.slice(F.array_except("ids", F.array("id")), 1, most)
    return some.join(first, "cycle_id").select("id", mates.alias("mates"), F.greatest(F.col("cycle_size") - 1 - most, F.lit(0)).cast("long").alias("more"))


def top_depended(edges: DataFrame, most: int = 5) -> DataFrame:
    """id, uses: by number of edges, each kind counted; ties to the smaller id."""
    return edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("uses")).orderBy(F.desc("uses"), "id").limit(most)


def language_histogram(nodes: DataFrame, most: int | None = 32) -> DataFrame:
    """language, n, in order of first appearance by id; the first `most` of them (None: all)."""
    rows = nodes.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).orderBy("first_id")
    return rows if most is None else rows.limit(most)


def top_scores(scores: DataFrame, most: int = 3) -> DataFrame:
    """(id, score) -> the highest positive ones, ties to the smaller id."""
    return scores.filter("score > 0").orderBy(F.desc("score"), "id").limit(most)
