"""Vector joins and searches against brute force."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from loamgraph.llm import ann, neardup
from loamgraph.llm.components import components


def brute_components(ids, pairs):
    label = {i: i for i in ids}
    while True:
        old = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if old == label:
            return label


def data():
    r = np.random.default_rng(4)
    base = r.normal(size=(40, 16))
    x = np.concatenate([base[r.integers(0, 40, 260)] + r.normal(scale=0.28, size=(260, 16)), r.normal(size=(60, 16)), np.repeat(base[:1], 30, axis=0)])
    rows = [(i, [float(v) for v in row], "c") for i, row in enumerate(x)]
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [], [1.0, 2.0]]
    return rows + [(1000 + 50 * k, v, "o") for k, v in enumerate(odd)] + [(5, rows[5][1], "again")]


SCHEMA = "vec_id long, embedding array<double>, n_links string"


@pytest.mark.parametrize("block", [neardup.BLOCK, 37])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "LEAF", 16)
    rows = data()
    fine = [(i, np.array(v)) for i, v, _ in rows if v and len(v) == 16 and None not in v and all(map(math.isfinite, v)) and any(v)]
    links, pairs = {i: 0 for i, _, _ in rows}, []
    for k, (i, a) in enumerate(fine):
        for j, b in fine[:k]:
            if a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.9:
                pairs.append((i, j))
    count = np.zeros(len(fine), int)
    for k, (_, a) in enumerate(fine):
        for m, (_, b) in enumerate(fine):
            count[k] += k != m and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.9
    label = brute_components(links, pairs)
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    want = sorted([(i, int(c)) for (i, _), c in zip(fine, count, strict=True)] + [(i, 0) for i, v, _ in rows if i >= 1000])
    assert sorted((r.vec_id, r.n_links) for r in got) == want
    assert all(r.component_id == label[r.vec_id] and r.kept == (r.vec_id == r.component_id) for r in got)


def test_clusters(spark, monkeypatch):
    """Thousands of links in clusters near a sphere of three dimensions, over dozens of blocks: all of them found, and most pairs of blocks never meet."""
    monkeypatch.setattr(neardup, "BLOCK", 64)
    monkeypatch.setattr(neardup, "LEAF", 16)
    r = np.random.default_rng(9)
    centres = r.normal(size=(400, 3)) @ np.linalg.qr(r.normal(size=(16, 3)))[0].T
    x = centres[r.integers(0, 400, 3000)]
    x = x / np.linalg.norm(x, axis=1)[:, None] + r.normal(scale=0.04, size=x.shape)
    met = []

    def spy(boxes, blocks, eps, axes, f=neardup.meetings):
        out = f(boxes, blocks, eps, axes)
        met.append((out.count(), blocks * (blocks + 1) // 2))
        return out

    monkeypatch.setattr(neardup, "meetings", spy)
    got = {v.vec_id: v for v in neardup.near_duplicates(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert [got[i].n_links for i in range(3000)] == near.sum(1).tolist() and near.sum() > 10_000
    label = brute_components(range(3000), list(zip(*map(np.ndarray.tolist, np.nonzero(np.triu(near))), strict=True)))
    assert all(got[i].component_id == label[i] for i in range(3000))
    assert met[0][1] > 500 and met[0][0] < met[0][1] / 2, met


def test_near_duplicates_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert neardup.near_duplicates(spark.createDataFrame([(1, None, "")], SCHEMA)).collect()[0].kept


def test_threshold_and_shared_ids(spark):
    # whole numbers with squares that add up to 100 or whose cosine with (10, 0, 0, 0) is 0.9 exactly
    lead = [(10, 0, 0, 0)] + [(9, *rest) for rest in {(a, b, c) for a in range(-4, 5) for b in range(-4, 5) for c in range(-4, 5) if a * a + b * b + c * c == 19}]
    rows = [(i, [float(k * x) for x in v]) for k in (1, 3) for i, v in enumerate(lead, 100 * k)]
    rows.append((rows[4][0], rows[9][1][::-1]))
    x = np.array([v for _, v in rows])

    def cosine(a, b):
        dot = lambda p, q: sum(u * v for u, v in zip(p, q, strict=True))
        return dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))

    hit = np.array([[i != j and cosine(a, b) >= 0.9 for j, b in enumerate(x)] for i, a in enumerate(x)])
    assert sum(cosine(x[0], b) == 0.9 for b in x) > 20
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links) for r in got) == sorted((i, int(n)) for (i, _), n in zip(rows, hit.sum(axis=1), strict=True))


def test_meetings(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FAN", 3)
    r = np.random.default_rng(2)
    low = np.sort(r.normal(scale=3, size=(40, 2)), axis=0)
    high = low + r.random((40, 2)) * 0.5
    boxes = spark.createDataFrame([(i, low[i].tolist(), high[i].tolist()) for i in range(40)], "block long, low array<double>, high array<double>")
    got = {(p.block, p.other) for p in neardup.meetings(boxes, 40, 0.4, 2).collect()}
    gap = lambda i, j: (np.maximum(0, np.maximum(low[i] - high[j], low[j] - high[i])) ** 2).sum()
    assert got == {(i, j) for i in range(40) for j in range(i, 40) if gap(i, j) <= (0.4 + neardup.SLACK) ** 2} and len(got) < 500


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in brute_components({x for p in pairs for x in p}, pairs).items()}


@pytest.mark.parametrize("block", [ann.BLOCK, 50])
def test_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    monkeypatch.setattr(ann, "QUERIES", 7)
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in ann.nearest(df.filter("vec_id % 10 = 0"), df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    fine = [(i, np.array(v)) for i, v, _ in rows if v and len(v) == 16 and None not in v and all(map(math.isfinite, v)) and any(v)]
    hit = total = 0
    for i, a in fine:
        if i % 10 == 0:
            want = sorted((-(a @ b) / math.sqrt((a @ a) * (b @ b)), j) for j, b in fine if j != i)[:5]
            mine = sorted(got[i])
            assert [x[0] for x in mine] == [1, 2, 3, 4, 5] and i not in [x[1] for x in mine]
            own = sorted((-s, j) for _, j, s in mine)
            hit += sum(any(abs(w[0] - o[0]) < 1e-12 for o in own) for w in want)
            total += 5
    assert hit / total >= 0.99
    assert all(k < 1000 for k in got)


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    t = df.toPandas()
    x = np.vstack(t.embedding.to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = ann.op6_nearest_vectors(spark, "/root/testdata/sf0.01").collect()
    hit = 0
    asked = np.flatnonzero(t.vec_id % 50 == 0)
    for q in asked:
        s = x @ x[q]
        s[q] = -2
        want = set(t.vec_id.to_numpy()[np.argsort(-s)[:5]])
        hit += len(want & {r.vec_id for r in rows if r.query_id == t.vec_id[q]})
    assert hit / (5 * len(asked)) >= 0.9


def test_codes_prune():
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    x = np.array(t.column("embedding").to_pylist(), float)
    coder = ann.Coder(x, x.shape[1])
    codes, scalars = coder.encode(x)
    guess, error = coder.bounds(x[::50], codes, scalars)
    exact = ann.cosines(np.repeat(x[::50], len(x), axis=0), np.tile(x, (len(x[::50]), 1))).reshape(guess.shape)
    exact[np.arange(len(guess)), np.arange(0, len(x), 50)] = -2
    fifth = np.sort(exact, axis=1)[:, -5]
    near = exact >= fifth[:, None]
    assert ((guess + error) >= exact)[near].mean() > 0.97
    assert (guess + error >= fifth[:, None]).mean() < 0.15
    # the query doesn't know the fifth cosine: its floor is the least exact cosine of its five best guesses
    guess[np.arange(len(guess)), np.arange(0, len(x), 50)] = -2
    floor = np.take_along_axis(exact, np.argsort(-guess, axis=1)[:, :5], axis=1).min(axis=1)
    assert (guess + error >= floor[:, None]).mean() < 0.35


def test_nearest_of_nothing(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_queries_are_not_broadcast(spark, tmp_path):
    """There is a copy of the queries for each part of the index, which a driver can't hold at size: small tables take the same way."""
    r = np.random.default_rng(8)
    spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(400)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = ann.op6_nearest_vectors(spark, str(tmp_path))
    assert found.count() == 8 * 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan, plan
