"""Connected components of a graph of long ids, by alternating large and small stars.

In a large-star step each node points its larger neighbours at the smallest id
it sees; in a small-star step its smaller ones. Both keep the components, and
the edges end up as stars around the smallest id of each component. A node with
very many neighbours is an ordinary group of a partial aggregate and a join
that adaptive execution can split; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest v of each u. Grouped by another form of the key, so that a join with it deals both sides out anew: only then can adaptive execution split a hot key of the join."""
    return edges.groupBy(F.bitwise_not("u").alias("w")).agg(F.min("v").alias("m")).select(F.bitwise_not("w").alias("u"), "m")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v, distinct."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = _least(edges)
        out = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) undirected -> (id, component), one row for each id on an edge; component is the smallest id it reaches."""
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    while True:
        new = materialise(_star(_star(now, True), False), "edges")
        # a fixed point holds the same pairs as before: compared by number, sum of hashes and their exclusive or
        same = [f.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.bit_xor(F.xxhash64("v", "u")).alias("g")).first() for f in (now, new)]
        discard(now)
        now = new
        if same[0] == same[1]:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
