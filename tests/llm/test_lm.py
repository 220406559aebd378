"""Deleted interpolation against a plain version."""

import math
import re
from collections import Counter

import numpy as np
import pyspark.sql.functions as F
import pytest

from loamgraph.llm import lm
from loamgraph.llm.common import fold_of


def plain(rows, train, held):
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w] + [None]
    docs = [(i, split(t)) for i, t in rows]

    def counts(use):
        uni, bi = Counter(), Counter()
        for i, t in docs:
            if use(i):
                uni.update(t)
                bi.update(zip([None, *t[:-1]], t, strict=True))
        return uni, bi

    uni, bi = counts(train)
    own, own_bi = counts(lambda i: train(i) and not held(i))
    n, v, n_own, v_own = sum(uni.values()), len(uni), sum(own.values()), len(own)

    def parts(u, b, m, h, w):
        c = u[h]  # a start is counted by ends
        return int(lm.context_bucket(np.array([c]))[0]), b[h, w] / c if c else 0.0, u[w] / m if m else 0.0

    seen = Counter(parts(own, own_bi, n_own, h, w) for i, t in docs if train(i) and held(i) for h, w in zip([None, *t[:-1]], t, strict=True))
    cells = list(seen)
    weights = lm.Weights.learn(*(np.array([c[k] for c in cells], float if k else int) for k in range(3)), np.array([seen[c] for c in cells]), 1 / (v_own + 1))
    out = {}
    for i, t in docs:
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        own_score = 0.0
        for h, w in zip([None, *t[:-1]], t, strict=True):
            b, p2, p1 = parts(uni, bi, n, h, w)
            own_score += math.log10(weights.probability(np.array([b]), np.array([p2]), np.array([p1]), 1 / (v + 1))[0])
        out.setdefault(i, []).append((len(t), sum(uni[w] > 0 for w in t), n, base, own_score))
    return out


@pytest.mark.parametrize("chunk", [lm.CHUNK, 4000])
def test_against_plain(spark, chunk):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(80)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(900, None), (901, ""), (902, "A a\x0bb c"), (902, "A a\x0bb c")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    f = lm.fold(F.col("doc_id"))
    want = plain(rows, lambda i: fold_of(i) != 1, lambda i: fold_of(i) == 2)
    got = lm.score(df, f != 1, f == 2, chunk).collect()
    assert len(got) == len(rows)
    for r in got:
        n_tokens, n_known, n, base, own = want[r.doc_id][0]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert abs(r.score - own) < 0.02 * abs(own)  # the weights are learned on a grid


def test_by_way_of_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", (F.col("doc_id") % 3).cast("int").alias("role"))
    parts = 37
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("long"))

    def read(counts):
        rows = counts.collect()
        whole = {c: sum(lm.unpacked(bytes(r[c])) for r in rows if r.chunk < 0).tolist() for c in ("own", "total")}
        chunks = {(c, level): [np.concatenate([lm.unpacked(bytes(r[x])) for r in sorted(rows, key=lambda r: r.part) if (r.chunk, r.level) == (c, level)]).tolist() for x in ("own", "total")] for c in range(parts) for level in (1, 2) if any(r.chunk == c for r in rows)}
        return whole, chunks, len([r for r in rows if r.chunk >= 0])

    straight, groups = read(lm._counts(dealt, parts)), read(lm._counts(dealt, parts, 1))
    assert straight[:2] == groups[:2] and straight[0]["total"][0] > 0 and groups[2] < straight[2] / 3


def test_normalised():
    w = lm.Weights(np.tile(np.array([0.1, 0.3, 0.6]), (lm.BUCKETS, 1)))
    b = np.full(4, 3)
    assert abs(w.probability(b, np.array([0.5, 0.5, 0, 0]), np.array([0.4, 0.3, 0.3, 0]), 0.25).sum() - 1) < 1e-9
    assert abs(w.probability(b * 0, np.zeros(4), np.array([0.4, 0.3, 0.3, 0]), 0.25).sum() - 1) < 1e-9
    assert list(lm.unpacked(lm.packed(np.array([0, 300, 2])))) == [0, 300, 2]
    big = np.array([0, 254, 255, 256, 10**12, 3])
    assert list(lm.unpacked(lm.packed(big))) == list(big) and len(lm.unpacked(lm.packed(big[:0]))) == 0
    keys = np.sort(np.random.default_rng(0).integers(0, 2**64 - 1, 100, np.uint64))
    assert list(lm.widened(lm.narrow(keys))) == list(keys) and len(lm.widened(lm.narrow(keys[:0]))) == 0
    assert lm.cuts(keys, 7)[0] == 0 and lm.cuts(keys, 7)[-1] == 100


def test_better_than_words_alone(spark):
    t = lm.op10_lm_score(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert t[1] > t[0]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(none, F.lit(True), F.lit(False)).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm.score(one, F.lit(False), F.lit(False)).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and math.isfinite(r.score)
