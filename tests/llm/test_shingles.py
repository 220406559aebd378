"""The shingle join against brute force over all pairs."""

import random

import numpy as np
import pytest

from loamgraph.llm import shingles


def sets_of(rows):
    out = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        w = [x.decode() for x in w]
        out.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def brute(rows):
    sets = sets_of(rows)
    label = {i: i for i, _ in sets}
    pairs = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if a and b and 100 * len(a & b) >= 75 * len(a | b)]
    while True:
        old = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if old == label:
            return sorted((i, len(s), label[i] if s else i) for i, s in sets)


def corpus(seed):
    """Families of texts whose likenesses lie around the threshold, with passages and whole short texts in common."""
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(400)
    boiler = [word() for _ in range(30)]
    rows = []
    for _ in range(25):
        base = [word() for _ in range(r.choice([3, 6, 9, 14, 20, 40, 90, 200]))]
        for _ in range(r.randrange(1, 14)):
            t = list(base)
            for _ in range(r.randrange(0, max(2, len(t) // 12))):
                k = r.randrange(len(t))
                t[k : k + r.randrange(0, 2)] = [word()]
            if r.random() < 0.4:
                t = t + boiler[: r.choice([10, 30])]
            rows.append((r.randrange(10**6), " ".join(x.upper() if r.random() < 0.1 else x for x in t), "x"))
    ids = {}
    return list({i: ids.setdefault(i, (i, t, x)) for i, t, x in rows}.values()) + [(10**6 + k, rows[0][1], "copy") for k in range(20)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(shingles, "HOT", 2)
        monkeypatch.setattr(shingles, "SEEN", 2)
    if seed == 3:
        monkeypatch.setattr(shingles, "choose_boundary", lambda sets: 20)
        monkeypatch.setattr(shingles, "PART", 1)
    rows = corpus(seed) + [(-1, None, ""), (-2, "", ""), (-3, " \n\t", ""), (-4, "one", ""), (-5, "One", "")]
    got = shingles.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, component_id string"))
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()) == brute(rows)


def test_members_that_miss_the_pivot(spark):
    """x and y link with each other but not with their signature group's pivot."""
    base = [f"a{i}" for i in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:80] + [f"b{i}" for i in range(45)])), (3, " ".join(base[:80] + [f"b{i}" for i in range(50)])), (4, " ".join(base[:70] + [f"b{i}" for i in range(60)]))]
    got = shingles.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()) == brute(rows)


def test_odd_rows(spark):
    t = " ".join(f"v{i}" for i in range(30))
    u = " ".join(f"u{i}" for i in range(30))
    rows = [(5, t), (5, t), (5, u), (6, u), (7, t), (None, t), (8, None)]
    got = shingles.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id or 0, x.component_id) for x in got) == [(0, None)] + [(5, 5)] * 3 + [(6, 5), (7, 5), (8, 8)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n int")
    kept = shingles.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id or 0) for x in kept.collect()) == [0, 5, 8]
    assert shingles.jaccard_components(docs.limit(0)).count() == 0


def test_least_cost():
    r = random.Random(3)
    for _ in range(200):
        sizes = {r.randrange(2, 300): r.randrange(1, 50) for _ in range(r.randrange(1, 40))}
        others = r.random() * r.choice([0.1, 5, 500])

        def cost(x):
            total = 0.0
            for n, c in sizes.items():
                p = shingles.prefix_size(n, 2)
                total += c * p * (p - 1) / 2 if n <= x else 0
                if n > x or 100 * n >= 75 * (x + 1):
                    total += c * shingles.prefix_size(n, 1) * (1 + (others * shingles.COMPARE_COST if n > x else 0))
            return total

        got = shingles.least_cost(sizes, others)
        assert got in [1, *sizes] and abs(cost(got) - min(map(cost, [1, *sizes]))) < 1e-6 * cost(got)
    assert shingles.least_cost({}, 1.0) == 1


def test_keep_one_with_clashing_columns(spark):
    t = " ".join(f"v{i}" for i in range(30))
    docs = spark.createDataFrame([(1, t, 7, "a", True, 1.0), (2, t, 8, "b", False, 2.0), (2, t, 9, "c", True, 3.0), (3, " ", 1, "d", True, 4.0), (4, "x " * 300_000, 1, "e", True, 5.0)], "doc_id long, text string, _rows int, _ID string, _words boolean, `a.b` double")
    out = shingles.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r._rows, r._ID, r._words, r["a.b"]) for r in out.collect()) == [(1, 7, "a", True, 1.0), (3, 1, "d", True, 4.0), (4, 1, "e", True, 5.0)]


def test_prefixes():
    for n in range(2, 400):
        for shared in (1, 2):
            assert shingles.prefix_size(n, shared) == min(n, n // 4 + shared)
    s = shingles.shingles("a b c d e f g")
    heavy = (np.sort(s[:1]), np.array([9]))
    assert list(shingles.in_order(s, heavy, 3)) == [s[1], s[2], s[0]]
    assert len(shingles.shingles("x " * 200_000)) == 1
