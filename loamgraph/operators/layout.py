"""Force layout in three dimensions, bounding radius, nearest node.

The layout is one array problem: nodes and edges come to the driver, as the
plan that uses it draws them there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.values import fnv1a

ITERATIONS, FULL, LEAST, LENGTH = 300, 1500, 60, 2.2


def iterations(n: int, wanted: int = ITERATIONS) -> int:
    """All of them up to FULL nodes, fewer beyond, LEAST at least."""
    return wanted if n <= FULL else max(LEAST, wanted * FULL // n)


def _unit(h: int) -> np.ndarray:
    """Three numbers in -1..1 from a hash."""
    return np.array([(h >> s & 0xFFFF) / 32767.5 - 1 for s in (0, 16, 32)])


def layout(nodes: DataFrame, edges: DataFrame, wanted: int = ITERATIONS) -> DataFrame:
    """id, x, y, z: springs along edges, repulsion between all pairs, a pull of each node to its folder's place; centred."""
    ends = nodes.agg(F.min("path").alias("a"), F.max("path").alias("b"))
    prefix = ends.select(paths.common_prefix(F.col("a"), F.col("b"))).first()[0] or ""
    rows = nodes.select("id", "path", paths.group_key(F.col("path"), F.lit(prefix)).alias("g"), paths.dirname(F.col("path")).alias("d")).orderBy("id").collect()
    if not rows:
        return nodes.select("id", *[F.lit(0.0).alias(c) for c in "xyz"])
    at = {r["id"]: i for i, r in enumerate(rows)}
    home = np.array([_unit(fnv1a(r["g"].encode())) * 6 + _unit(fnv1a(r["d"].encode())) * 1.8 for r in rows])
    pos = home + np.array([_unit(fnv1a(r["path"].encode())) * 0.6 for r in rows])
    pairs = np.array([(at[r["source"]], at[r["target"]]) for r in edges.select("source", "target").distinct().collect() if r["source"] in at and r["target"] in at and r["source"] != r["target"]], dtype=int).reshape(-1, 2)
    heat = 3.0
    for _ in range(iterations(len(rows), wanted) if len(rows) > 1 else 0):
        move = np.zeros_like(pos)
        for s in range(0, len(pos), 512):  # repulsion, a block of rows at a time
            d = pos[s : s + 512, None] - pos[None]
            r2 = np.maximum((d * d).sum(2), 1e-4)
            move[s : s + 512] += (d * (LENGTH**2 / r2)[..., None]).sum(1)
        if len(pairs):
            d = pos[pairs[:, 0]] - pos[pairs[:, 1]]
            pull = d * (np.linalg.norm(d, axis=1, keepdims=True) / LENGTH)
            np.add.at(move, pairs[:, 0], -pull)
            np.add.at(move, pairs[:, 1], pull)
        move += (home - pos) * 0.6 - pos * 0.05
        size = np.maximum(np.linalg.norm(move, axis=1, keepdims=True), 1e-9)
        pos = pos + move / size * np.minimum(size, heat)
        heat *= 0.96
    pos -= pos.mean(axis=0)
    return nodes.sparkSession.createDataFrame([(r["id"], *map(float, p)) for r, p in zip(rows, pos, strict=True)], "id long, x double, y double, z double")


def bounding_radius(positions: DataFrame) -> DataFrame:
    return positions.agg(F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).alias("radius"))


def nearest(points: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """The node(id, x, y) nearest to a point, within a radius; ties to the smaller id."""
    d = (F.col("x") - x) ** 2 + (F.col("y") - y) ** 2
    return points.withColumn("d", d).filter(F.col("d") <= radius * radius).orderBy("d", "id").limit(1).select("id")
