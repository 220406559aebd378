"""Duplicate stretches: equal windows of tokens, kept where they start and extended to the right."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..session import discard, materialise

WINDOW, LEAST_LINES, BUCKET, RESULTS = 50, 5, 64, 20_000


_STEP = np.uint64(0x9E3779B97F4A7C15)


def windows(tokens: DataFrame, size: int = WINDOW, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """(file_id, toks array) -> file_id, pos (from 0), h: a hash of each run of `size` tokens, prev: the hash of the token before it.

    part (k, n): the k-th of n shares of all windows, by their hashes.

    The hash rolls: sums of token hashes times powers of an odd number, from
    differences of running sums, so that its price doesn't grow with `size`.
    """
    inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
    kind = tokens.schema["file_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column("hs")
            held, count = [], 0
            for r in range(batch.num_rows):
                t = lists[r].values.to_numpy().view(np.uint64)
                n = len(t) - size + 1
                up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(t) - 1, _STEP)]), dtype=np.uint64)
                down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse)]), dtype=np.uint64)
                total = np.concatenate([[np.uint64(0)], np.cumsum(t * up, dtype=np.uint64)])
                h = (total[size:] - total[:-size]) * down
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
                at = np.flatnonzero(h % np.uint64(part[1]) == np.uint64(part[0])) if part[1] > 1 else np.arange(n)
                held.append((r, len(at), h[at].view(np.int64), pa.array(t[at - 1].view(np.int64), mask=at == 0), at.astype(np.int32)))
                count += len(at)
                if count >= 500_000 or r == batch.num_rows - 1:
                    prev = [x[3] for x in held]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("file_id").take(pa.array(np.repeat([x[0] for x in held], [x[1] for x in held]))),
                            pa.array(np.concatenate([x[4] for x in held])),
                            pa.array(np.concatenate([x[2] for x in held])),
                            pa.concat_arrays(prev),
                        ],
                        names=["file_id", "pos", "h", "prev"],
                    )
                    held, count = [], 0

    some = tokens.filter(F.size("toks") >= size).select("file_id", F.transform("toks", lambda x: F.xxhash64(x)).alias("hs"))
    return some.mapInArrow(run, f"file_id {kind}, pos int, h long, prev long")


def buckets(wins: DataFrame, most: int | None = BUCKET) -> DataFrame:
    """Windows that share a hash, the first `most` of each in order of (file, position).

    The bound is part of the result's meaning; None keeps all of them.
    """
    by = Window.partitionBy("h")
    ranked = wins if most is None else wins.withColumn("rank", F.row_number().over(by.orderBy("file_id", "pos"))).filter(F.col("rank") <= most)
    return ranked.withColumn("n", F.count(F.lit(1)).over(by)).filter("n > 1").select("file_id", "pos", "h", "prev")


#: Windows are dealt out by hash in shares of about SHARE, and at most SHARES of them, one after the other.
SHARE, SHARES = 10_000_000, 8


def shared_windows(tokens: DataFrame, size: int = WINDOW, most: int | None = BUCKET) -> DataFrame:
    """buckets() of all windows as a table, made share by share: windows that no other equals are never on disk all at once."""
    total = tokens.agg(F.sum(F.greatest(F.size("toks") - (size - 1), F.lit(0)))).first()[0] or 0
    n = max(1, min(SHARES, -(-total // SHARE)))
    return reduce(DataFrame.unionByName, [materialise(buckets(windows(tokens, size, (k, n)), most), "windows") for k in range(n)])


def clones(tokens: DataFrame, size: int = WINDOW, least_lines: int = LEAST_LINES, bucket: int | None = BUCKET, most: int | None = RESULTS) -> DataFrame:
    """located(pairs(...)) of the files of tokens(file_id, toks, rows).

    The first `most` results in order of files are the first files' ones, so
    runs are compared for a growing share of the files with shared windows, as
    the first side, until there are as many; every run of such a file is found,
    whatever file the other side is.
    """
    shared = shared_windows(tokens, size, bucket)
    count = shared.count() if most is not None and isinstance(tokens.schema["file_id"].dataType, IntegralType) else 0
    share = most * STARTS / count if count else 1.0
    while share < 1:
        upto = shared.agg(F.percentile_approx("file_id", F.lit(share), F.lit(10_000))).first()[0]
        some = materialise(located(pairs(shared, tokens, size, upto), tokens, least_lines, most), "clones")
        if some.count() == most:
            return some
        discard(some)
        share *= 8
    return located(pairs(shared, tokens, size), tokens, least_lines, most)


#: Shared windows that are looked at first for each result that is wanted.
STARTS = 20


def pairs(bucketed: DataFrame, tokens: DataFrame, size: int = WINDOW, upto=None) -> DataFrame:
    """(fa, pa, fb, pb, n): maximal equal runs, n tokens long; a run in one file doesn't overlap itself. upto: those with fa up to that file only."""
    a = (bucketed if upto is None else bucketed.filter(F.col("file_id") <= upto)).select("h", F.col("file_id").alias("fa"), F.col("pos").alias("pa"), F.col("prev").alias("va"))
    b = bucketed.select("h", F.col("file_id").alias("fb"), F.col("pos").alias("pb"), F.col("prev").alias("vb"))
    both = a.join(b, "h").filter((F.col("fa") < F.col("fb")) | ((F.col("fa") == F.col("fb")) & (F.col("pa") < F.col("pb"))))
    # only runs that can't be extended to the left get their tokens
    both = both.filter((F.col("pa") == 0) | (F.col("pb") == 0) | (F.col("va") != F.col("vb"))).select("fa", "pa", "fb", "pb")
    ta = tokens.select(F.col("file_id").alias("fa"), F.col("toks").alias("ta"))
    tb = tokens.select(F.col("file_id").alias("fb"), F.col("toks").alias("tb"))
    both = both.join(ta, "fa").join(tb, "fb")
    n = F.least(F.size("ta") - F.col("pa"), F.size("tb") - F.col("pb"))
    rest = lambda t, p: F.slice(t, F.col(p) + 1, n)
    differs = F.array_position(F.zip_with(rest("ta", "pa"), rest("tb", "pb"), lambda x, y: x == y), False)
    length = F.when(differs == 0, n).otherwise(differs - 1).cast("int")
    length = F.when(F.col("fa") == F.col("fb"), F.least(length, F.col("pb") - F.col("pa"))).otherwise(length)
    return both.select("fa", "pa", "fb", "pb", length.alias("n")).filter(F.col("n") >= size)


def located(found: DataFrame, tokens: DataFrame, least_lines: int = LEAST_LINES, most: int | None = RESULTS) -> DataFrame:
    """Runs as lines: a, a_line, a_end, b, b_line, b_end, where both sides span `least_lines`; tokens also has rows, the line of each token.

    The first `most` of them in that order are part of the result's meaning; None keeps all.
    """
    rows_a = tokens.select(F.col("file_id").alias("fa"), F.col("rows").alias("ra"))
    rows_b = tokens.select(F.col("file_id").alias("fb"), F.col("rows").alias("rb"))
    at = lambda r, p: F.get(r, p)
    out = found.join(rows_a, "fa").join(rows_b, "fb").select(
        F.col("fa").alias("a"), at("ra", F.col("pa")).alias("a_line"), at("ra", F.col("pa") + F.col("n") - 1).alias("a_end"),
        F.col("fb").alias("b"), at("rb", F.col("pb")).alias("b_line"), at("rb", F.col("pb") + F.col("n") - 1).alias("b_end"))
    out = out.filter((F.col("a_end") - F.col("a_line") + 1 >= least_lines) & (F.col("b_end") - F.col("b_line") + 1 >= least_lines))
    return out if most is None else out.orderBy("a", "a_line", "b", "b_line", "a_end", "b_end").limit(most)


def merged_stretches(clones: DataFrame) -> DataFrame:
    """Clones -> file_id, line, stop, places: overlapping copied stretches of each file made one, with the number of other places."""
    side = lambda f, s, e, o, os: clones.select(F.col(f).alias("file_id"), F.col(s).alias("line"), F.col(e).alias("stop"), F.struct(F.col(o).alias("file"), F.col(os).alias("line")).alias("other"))
    both = side("a", "a_line", "a_end", "b", "b_line").unionByName(side("b", "b_line", "b_end", "a", "a_line"))
    order = Window.partitionBy("file_id").orderBy("line", "stop", "other")
    high = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("new", F.when(high.isNull() | (F.col("line") > high), 1).otherwise(0)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return both.groupBy("file_id", "island").agg(F.min("line").alias("line"), F.max("stop").alias("stop"), F.countDistinct("other").alias("places")).drop("island")
