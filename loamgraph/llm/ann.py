"""Nearest vectors by randomly rotated one-bit codes.

Unit vectors are taken relative to a centre, turned by TURNS random rotations
and reduced to the signs of all those coordinates. For a vector u with residual
r = u - centre and a rotation with direction o = r / |r| and code x (signs over
the root of the dimension), the index keeps the packed signs, |r| / <o, x> and
<centre, u>. A query's inner product with o is estimated by that with x over
<o, x>, and the mean over the rotations is taken; its error spreads like

    |query's residual| * |r| * sqrt((1 - <o, x>^2) / <o, x>^2) / sqrt((dimension - 1) * TURNS),

and BOUND times that is what an estimate may be wrong by: one neighbour in
about 160 is expected to lie outside (the upper side of 2.5 standard
deviations), which bounds the loss of recall.

Two passes. The first reads codes alone and gives each query its best guesses
over all vectors; their exact cosines set the query's floor, which the k-th
nearest can't be below. The second ranks exactly, in double precision, the
vectors whose upper bound reaches the floor. Queries go to the index in blocks
of their vectors, each of which meets each block of the index, so neither side
is ever held whole anywhere, and every vector is in the index. Blocks of the
index are dealt into groups of some tens of thousands of vectors, and there is a
copy of the queries for each group: these copies go through a shuffle, since
they would fill the driver if they were broadcast.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .vectors import cosines, dimensions, matrix, sample_of, unit, valid

NEAREST, BLOCK, QUERIES, SAMPLE, TURNS, BOUND, SEED = 5, 8192, 512, 20_000, 2, 2.5, 7
#: Groups: one a block up to GROUPS of them, then no more until each has BLOCKS blocks.
GROUPS, BLOCKS = 32, 4


class Coder:
    """Rotations and centre; the centre comes from a bounded sample of about SAMPLE vectors."""

    def __init__(self, sample: np.ndarray, dim: int, turns: int = TURNS):
        r = np.random.default_rng(SEED)
        made = [np.linalg.qr(r.normal(size=(dim, dim))) for _ in range(turns)]
        self.turn, self.dim, self.turns = np.concatenate([q * np.sign(np.diag(t)) for q, t in made], axis=1), dim, turns
        self.centre = unit(sample).mean(axis=0) if len(sample) else np.zeros(dim)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed signs (n, bytes) and scalars (n, 2 + turns): <centre, u>, spread of the error, |r| / <o, x> of each rotation."""
        u = unit(x)
        r = u - self.centre
        size = np.sqrt((r * r).sum(axis=1))
        z = (r / np.maximum(size, 1e-300)[:, None]) @ self.turn
        fit = np.maximum(np.abs(z).reshape(len(x), self.turns, self.dim).sum(axis=2) / np.sqrt(self.dim), 1e-9)
        spread = size * np.sqrt(np.maximum(0, 1 / (fit * fit) - 1).mean(axis=1) / (max(1, self.dim - 1) * self.turns))
        return np.packbits(z > 0, axis=1), np.column_stack([u @ self.centre, spread, size[:, None] / fit]).astype(np.float32)

    def bounds(self, queries: np.ndarray, codes: np.ndarray, scalars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines (queries x vectors) and what they may be wrong by."""
        q = unit(queries)
        rest = q - self.centre
        near = np.zeros((len(q), len(codes)), np.float32)
        turned = (rest @ self.turn / (np.sqrt(self.dim) * self.turns)).astype(np.float32)
        signs = np.unpackbits(codes, axis=1, count=self.dim * self.turns)
        for t in range(self.turns):
            at = slice(t * self.dim, (t + 1) * self.dim)
            plus = signs[:, at].astype(np.float32) * (2 * scalars[:, 2 + t, None]) - scalars[:, 2 + t, None]
            near += turned[:, at] @ plus.T
        guess = near + scalars[:, 0] + (q @ self.centre - self.centre @ self.centre).astype(np.float32)[:, None]
        return guess, BOUND * np.sqrt((rest * rest).sum(axis=1)).astype(np.float32)[:, None] * scalars[:, 1] + 1e-5


def first(order: tuple[np.ndarray, ...], query: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each query's entries; order: what to sort by within a query, the last key counts most."""
    at = np.lexsort((*order, query))
    q = query[at]
    starts = np.flatnonzero(np.diff(q, prepend=q[0] - 1)) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return at[place < k]


def guesses(coder: Coder, qid, q, vid, codes, scalars, k: int):
    """(query, vector, guess) of the k best guesses of this block for each query."""
    guess, _ = coder.bounds(q, codes, scalars)
    guess[qid[:, None] == vid[None, :]] = -np.inf
    some = np.argpartition(-guess, k - 1, axis=1)[:, :k] if len(vid) > k else np.broadcast_to(np.arange(len(vid)), guess.shape)
    value = np.take_along_axis(guess, some, axis=1)
    fine = np.isfinite(value)
    return np.repeat(qid, some.shape[1])[fine.ravel()], vid[some][fine], value[fine].astype(np.float64)


#: Vectors a time that are ranked exactly.
RANKED = 65_536


def ranked(coder: Coder, qid, q, floor, vid, v, codes, scalars, k: int):
    """(query, vector, score) of the k nearest of this block for each query, among those that may reach its floor; ties to the smaller id."""
    guess, error = coder.bounds(q, codes, scalars)
    may = (guess + error >= (floor - 1e-9)[:, None]) & (qid[:, None] != vid[None, :])
    i, j = np.nonzero(may)
    out = []
    for s in range(0, len(i), RANKED):
        a, b = i[s : s + RANKED], j[s : s + RANKED]
        score = cosines(q[a], v[b])
        keep = score >= floor[a] - 1e-9
        out.append((a[keep], b[keep], score[keep]))
    if not out:
        return qid[:0], vid[:0], np.zeros(0)
    a, b, score = (np.concatenate(x) for x in zip(*out, strict=True))
    at = first((vid[b], -score), a, k)
    return qid[a[at]], vid[b[at]], score[at]


def _packed(rows: DataFrame, dim: int, size: int, coder: Coder | None) -> DataFrame:
    """Rows packed into blocks: ids, data and, with a coder, codes and scalars; without one, floors."""

    def pack(batches):
        from pyspark import TaskContext

        number = itertools.count(TaskContext.get().partitionId() << 32)

        def made(held):
            t = pa.Table.from_batches(held)
            x = t.column("embedding").combine_chunks()
            codes, scalars = coder.encode(matrix(x, dim)) if coder else (np.zeros(0), t.column("floor").to_numpy())
            row = [next(number), t.column("vec_id").to_numpy().astype(np.int64).tobytes(), x.flatten().to_numpy(zero_copy_only=False).tobytes(), codes.tobytes(), scalars.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array(row[:1], pa.int64()), *(pa.array([c], pa.binary()) for c in row[1:])], names=["block", "ids", "data", "codes", "scalars"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(batch.num_rows - at, size - sum(b.num_rows for b in held))
                held.append(batch.slice(at, take))
                at += take
                if sum(b.num_rows for b in held) == size:
                    yield made(held)
                    held = []
        if held:
            yield made(held)

    return rows.select("vec_id", "embedding", *([] if coder else ["floor"])).mapInArrow(pack, "block long, ids binary, data binary, codes binary, scalars binary")


def _met(index: DataFrame, asked: DataFrame, dim: int, stored, groups: int, each) -> DataFrame:
    """(query_id, vec_id, score) from each(query ids, queries, floors, row of the index) over all blocks of queries and of the index."""
    total = asked.count()
    ask = _packed(asked.repartition(max(1, -(-total // QUERIES))), dim, QUERIES, None)
    ask = ask.select(F.col("ids").alias("qids"), F.col("data").alias("qdata"), F.col("scalars").alias("floors"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))

    def search(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                read = lambda c, t=np.int64: np.frombuffer(batch.column(c)[r].as_buffer(), t)  # noqa: B023, E731
                got = each(read("qids"), read("qdata", stored).reshape(-1, dim).astype(np.float64), read("floors", np.float64), read)
                if len(got[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["query_id", "vec_id", "score"])

    return index.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups))).join(ask.hint("merge"), "g").mapInArrow(search, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _cosine(a: str, b: str):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = NEAREST) -> DataFrame:
    """(query_id, rank int, vec_id, score): each query's k nearest of vectors with another id, by cosine.

    Equal cosines rank by the smaller id. Vectors that are null, zero or hold
    null or non-finite components take no part, on either side; vectors of
    another size than the query's aren't compared with it. Of query rows that
    share an id the smallest vector asks; vectors that repeat an id count each.
    Without candidates a query has no row; empty tables give an empty result;
    other columns are ignored.
    """
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(valid(F.col("embedding")) & F.col("vec_id").isNotNull())
    asked, rows = clean(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), clean(vectors)
    parts = []
    for dim in dimensions(rows):
        own, some = rows.filter(F.size("embedding") == dim), asked.filter(F.size("embedding") == dim)
        stored = np.float32 if "float" in own.schema["embedding"].dataType.simpleString() else np.float64
        total = own.count()
        coder = Coder(sample_of(own, SAMPLE, "centre"), dim)
        blocks = -(-total // BLOCK)
        groups = max(1, min(blocks, GROUPS), -(-blocks // BLOCKS))
        index = materialise(_packed(own, dim, BLOCK, coder), "codes")

        def guess(qids, q, floors, read, coder=coder):
            ids = read("ids")
            return guesses(coder, qids, q, ids, read("codes", np.uint8).reshape(len(ids), -1), read("scalars", np.float32).reshape(len(ids), -1), k)

        def rank(qids, q, floors, read, coder=coder, dim=dim, stored=stored):
            ids = read("ids")
            v = read("data", stored).reshape(-1, dim).astype(np.float64)
            return ranked(coder, qids, q, floors, ids, v, read("codes", np.uint8).reshape(len(ids), -1), read("scalars", np.float32).reshape(len(ids), -1), k)

        without = some.withColumn("floor", F.lit(-2.0))
        top = _best(_met(index.select("block", "ids", "codes", "scalars"), without, dim, stored, groups, guess), k).select("query_id", "vec_id")
        # k vectors a query: their exact cosines, the k-th of which is the floor
        pairs = top.join(own.withColumnRenamed("embedding", "v"), "vec_id").join(some.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")
        exact = pairs.groupBy("query_id").agg(F.sort_array(F.collect_list(_cosine("q", "v")), asc=False).alias("c"))
        exact = exact.select(F.col("query_id").alias("vec_id"), F.coalesce(F.get("c", F.lit(k - 1)), F.lit(-2.0)).alias("floor"))
        floors = materialise(some.join(exact, "vec_id", "left").select("vec_id", "embedding", F.coalesce("floor", F.lit(-2.0)).alias("floor")), "floors")
        parts.append(_met(index, floors, dim, stored, groups, rank))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return _best(found, k)


def op6_nearest_vectors(spark, sf_dir: str) -> DataFrame:
    """The five nearest of all embeddings for those whose id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows.filter(F.col("vec_id") % 50 == 0), rows)


#: Brute force; the score's products are added in the same order.
OP6_SQL = r"""
WITH c AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM c)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 5
"""
