"""Near-duplicate vectors by an epsilon grid order join.

Vectors are made unit length, so that cosine >= c means a distance of at most
eps = sqrt(2 - 2c), and turned onto the principal axes of a bounded sample (an
orthogonal turn changes no distance). On the AXES leading ones space is cut into
cells of side eps; equal vectors are one class, and the classes are sorted by
their cells on all of these axes, identical cells by a hash. The sorted sequence
is cut into blocks of BLOCK.

The sequence is joined with itself recursively: an interval of FAN^k blocks has
the bounding box of what is in it, a pair of intervals whose boxes are more than
eps apart is dropped with all that lies below it, others are replaced by the
pairs of their parts. Down to blocks this is a join of tables of boxes, a level
a round; inside a pair of blocks it goes on in a task, and pairs of at most LEAF
vectors a side are compared in full. What a product in single precision can't
rule out is decided by the cosine of the vectors as given, in double precision.

A cell with a third of all vectors is many blocks, each pair of which is a
task's work of its own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise
from .components import components
from .vectors import cosines, dimensions, matrix, sample_of, unit, valid

COSINE, BLOCK, LEAF, SAMPLE, AXES, FAN = 0.9, 4096, 256, 20_000, 16, 16
#: What a cosine of unit vectors in single precision may be wrong by, and a distance computed from coordinates.
ROUGH, SLACK = 1e-5, 1e-6


def axes(rows: DataFrame, dim: int) -> np.ndarray:
    """Principal axes of a sample of about SAMPLE rows, all `dim` of them, as columns."""
    x = sample_of(rows, SAMPLE, "axes")
    if not len(x):
        return np.eye(dim)
    x = unit(x)
    x = x - x.mean(axis=0)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


def near_pairs(a: np.ndarray, b: np.ndarray, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of unit vectors whose cosine may reach `cosine`, each once; same: a is b, and i < j only.

    a and b are in grid order with principal coordinates first, in single precision.
    """
    k, eps = min(AXES, a.shape[1]), (2 - 2 * cosine) ** 0.5 + SLACK
    rough = ROUGH + 1e-7 * a.shape[1] ** 0.5
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, m, j, n = stack.pop()
        if same and n <= i:
            continue
        p, q = a[i:m, :k], b[j:n, :k]
        gap = np.maximum(0, np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)))
        if (gap * gap).sum() > eps**2:
            continue
        if m - i <= LEAF and n - j <= LEAF:
            x, y = np.nonzero(a[i:m] @ b[j:n].T >= cosine - rough)
            x, y = x + i, y + j
            if same:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x, y
        else:
            halves = lambda s, e: [(s, e)] if e - s <= LEAF else [(s, (s + e) // 2), ((s + e) // 2, e)]
            stack += [(*u, *v) for u in halves(i, m) for v in halves(j, n)]


class Forest:
    """Components of numbered nodes; of the edges added, those that joined two components are returned."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        used = []
        while True:
            p, q = self.label[x], self.label[y]
            new = p != q
            x, y, p, q = x[new], y[new], p[new], q[new]
            if not len(x):
                return used
            # one edge for each component on the left at a time; the others are looked at again with new labels
            _, first = np.unique(p, return_index=True)
            joined: dict[int, int] = {}
            for i in first.tolist():
                r, s = int(p[i]), int(q[i])
                while r in joined:
                    r = joined[r]
                while s in joined:
                    s = joined[s]
                if r != s:
                    joined[max(r, s)] = min(r, s)
                    used.append((int(x[i]), int(y[i])))
            for k in sorted(joined):
                joined[k] = joined.get(joined[k], joined[k])
            to = np.arange(len(self.label))
            to[list(joined)] = list(joined.values())
            self.label = to[self.label]


def _classes(rows: DataFrame, dim: int, turn: np.ndarray, eps: float) -> DataFrame:
    """A row for each distinct vector: number, rep (its smallest id), n (its rows), embedding, cell (sorts by its cells on the leading axes)."""
    lead = turn[:, :AXES]

    def cells(batches):
        for batch in batches:
            if batch.num_rows:
                c = np.floor(unit(matrix(batch.column("embedding"), dim)) @ lead / eps) + (1 << 15)
                c = np.clip(c, 0, (1 << 16) - 1).astype(">u2")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in c], pa.binary())], names=[*batch.schema.names, "cell"])

    distinct = rows.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    distinct = distinct.select(F.monotonically_increasing_id().alias("number"), "rep", "n", "embedding")
    kind = distinct.schema["embedding"].dataType.simpleString()
    return distinct.mapInArrow(cells, f"number long, rep long, n long, embedding {kind}, cell binary")


def _blocks(classes: DataFrame, dim: int, turn: np.ndarray) -> DataFrame:
    """The sorted sequence cut into blocks of BLOCK classes: block, low, high (its box on the leading axes), numbers, reps, copies, data (packed)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark, lead = classes.sparkSession, turn[:, :AXES]
    kind = classes.schema["embedding"].dataType.simpleString()

    def count(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n))], names=[*batch.schema.names, "part", "at"])
            at += n

    ordered = classes.withColumn("salt", F.xxhash64("number")).repartitionByRange("cell", "salt").sortWithinPartitions("cell", "salt").select("number", "rep", "n", "embedding")
    ordered = materialise(ordered.mapInArrow(count, f"number long, rep long, n long, embedding {kind}, part long, at long"), "ordered")
    # one row for each partition of the sort: where its part of the sequence begins
    sizes = sorted(ordered.groupBy("part").agg((F.max("at") + 1).alias("n")).collect())
    starts = itertools.accumulate((r["n"] for r in sizes), initial=0)
    begin = spark.createDataFrame([(r["part"], s) for r, s in zip(sizes, starts, strict=False)], "part long, begin long")
    numbered = ordered.join(F.broadcast(begin), "part").withColumn("seq", F.col("begin") + F.col("at"))
    numbered = numbered.select(F.floor(F.col("seq") / BLOCK).cast("long").alias("block"), "seq", "number", "rep", "n", "embedding")

    def pack(key, table):
        table = table.sort_by("seq")
        x = table.column("embedding").combine_chunks()
        u = unit(matrix(x, dim)) @ lead
        own = x.flatten().to_numpy(zero_copy_only=False)
        row = {"block": key[0].as_py(), "low": u.min(0).tolist(), "high": u.max(0).tolist(), "data": own.tobytes()}
        row |= {to: table.column(c).to_numpy().astype(np.int64).tobytes() for to, c in (("numbers", "number"), ("reps", "rep"), ("copies", "n"))}
        return pa.Table.from_pylist([row], schema=arrow)

    schema = "block long, low array<double>, high array<double>, numbers binary, reps binary, copies binary, data binary"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    blocks = materialise(numbered.groupBy("block").applyInArrow(pack, schema), "blocks")
    discard(ordered)
    return blocks


def meetings(boxes: DataFrame, blocks: int, eps: float, axes: int) -> DataFrame:
    """(block, other), block <= other: pairs of blocks whose boxes are at most eps apart, by a recursive join of intervals of the sequence.

    boxes: (block, low, high), numbered from 0 without gaps.
    """
    depth = 1
    while FAN**depth < blocks:
        depth += 1
    gap = F.aggregate(F.zip_with(F.zip_with("low", "high2", lambda x, y: x - y), F.zip_with("low2", "high", lambda x, y: x - y), lambda x, y: F.greatest(F.lit(0.0), x, y)), F.lit(0.0), lambda s, g: s + g * g)
    pairs = boxes.sparkSession.range(1).select(F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("other"))
    for level in reversed(range(depth)):
        node = F.floor(F.col("block") / FAN**level).cast("long").alias("block")
        at = boxes
        if level:
            ends = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(axes)]).alias(c)
            at = boxes.groupBy(node).agg(ends(F.min, "low"), ends(F.max, "high"))
        parts = lambda c: F.explode(F.sequence(F.col(c) * FAN, F.col(c) * FAN + FAN - 1))
        pairs = pairs.withColumn("block", parts("block")).withColumn("other", parts("other"))
        pairs = pairs.filter("block <= other").join(at, "block").join(at.select(F.col("block").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2")), "other")
        pairs = pairs.filter(gap <= (eps + SLACK) ** 2).select("block", "other")
    return pairs


def links(vectors: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """(vec_id, n_links) of each row, and (a, b): edges enough to connect what is linked.

    vectors: (vec_id long, embedding), valid rows only.
    """
    parts = [_links_of(vectors, d, cosine) for d in dimensions(vectors)]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "vec_id long, n_links long"), vectors.sparkSession.createDataFrame([], "a long, b long")
    out = parts[0]
    for c, e in parts[1:]:
        out = out[0].unionByName(c), out[1].unionByName(e)
    return out


def _links_of(vectors: DataFrame, dim: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    spark, eps = vectors.sparkSession, float(np.sqrt(2 - 2 * cosine))
    rows = vectors.filter(F.size("embedding") == dim)
    turn = axes(rows, dim)
    stored = np.float32 if "float" in rows.schema["embedding"].dataType.simpleString() else np.float64
    classes = materialise(_classes(rows, dim, turn, eps), "classes")
    blocks = _blocks(classes, dim, turn)
    boxes = blocks.select("block", "low", "high")
    pairs = materialise(meetings(boxes, boxes.count(), eps, min(AXES, dim)), "meetings")
    payload = blocks.select("block", "numbers", "reps", "copies", "data")
    second = payload.select(*[F.col(c).alias(to) for c, to in (("block", "other"), ("numbers", "numbers2"), ("reps", "reps2"), ("copies", "copies2"), ("data", "data2"))])
    # a row of pairs is a megabyte or more to come: many small tasks, dealt out by pair
    dealt = pairs.repartition(max(64, spark.sparkContext.defaultParallelism * 4), "block", "other")
    joined = dealt.join(payload, "block").join(second, "other")

    def compare(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, t=np.int64: np.frombuffer(batch.column(c)[r].as_buffer(), t)  # noqa: B023, E731
                a, b = (get(c, stored).reshape(-1, dim).astype(np.float64) for c in ("data", "data2"))
                same = batch.column("block")[r] == batch.column("other")[r]
                ua, ub = ((unit(x) @ turn).astype(np.float32) for x in (a, b))
                na, nb = get("copies"), get("copies2")
                count_a, count_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
                forest = Forest(len(a) + len(b))
                shift = 0 if same else len(a)
                kept = []
                ra, rb = get("reps"), get("reps2")
                for x, y in near_pairs(ua, ub, cosine, same):
                    ok = cosines(a[x], b[y]) >= cosine
                    x, y = x[ok], y[ok]
                    np.add.at(count_a, x, nb[y])
                    np.add.at(count_a if same else count_b, y, na[x])
                    kept += [(int(ra[u]), int(rb[v - shift])) for u, v in forest.add(x, y + shift)]
                out = [(int(i), int(n), None, None) for i, n in zip(get("numbers"), count_a, strict=True) if n]
                if not same:
                    out += [(int(i), int(n), None, None) for i, n in zip(get("numbers2"), count_b, strict=True) if n]
                out += [(None, None, u, v) for u, v in kept]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["number", "links", "a", "b"])

    found = materialise(joined.mapInArrow(compare, "number long, links long, a long, b long"), "links")
    discard(pairs)
    discard(blocks)
    direct = found.filter("number is not null").groupBy("number").agg(F.sum("links").alias("links"))
    known = classes.select("number", "rep", "n", "embedding").join(direct, "number", "left").select("rep", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    # each copy has its class's links; a hot class joins as one row on the right
    members = materialise(rows.join(known, "embedding").select("vec_id", "rep", "n_links"), "members")
    discard(classes)
    edges = found.filter("a is not null").select("a", "b").unionByName(members.filter("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    return members.select("vec_id", "n_links"), edges


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors that are null, zero or hold null or non-finite components link with
    nothing and are kept; so are vectors of a size that no other has. Rows that
    share an id are one node of the graph, and each of them counts as a vector.
    An empty table gives an empty result; other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", valid(F.col("embedding")).alias("ok"))
    counts, edges = links(rows.filter("ok").select("vec_id", "embedding"), cosine)
    comp = components(edges)
    base = counts.unionByName(rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links")))
    out = base.join(comp.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_near_dup_vectors(spark, sf_dir: str) -> DataFrame:
    """All embeddings at cosine 0.9, whatever their labels."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP5_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT v.vec_id, (SELECT count(*) FROM pairs p WHERE p.a = v.vec_id) AS n_links,
  least(v.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = v.vec_id), v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = v.vec_id), v.vec_id)) AS kept
FROM v
"""
