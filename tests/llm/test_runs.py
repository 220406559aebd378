"""Periodic runs against plain versions: all periods and places of small texts, regular expressions for words."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from loamgraph.llm import runs


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(w):
    """(start, length, period) of all runs, by trying each period at each place."""
    out = set()
    for q in range(1, len(w) // 4 + 1):
        a = 0
        while a + q < len(w):
            b = a
            while b + q < len(w) and w[b] == w[b + q]:
                b += 1
            n = b + q - a
            if n >= max(6, 4 * q):
                out.add((a, n, q))
            a = b + 1
    return sorted(x for x in out if not any(y[:2] == x[:2] and y[2] < x[2] for y in out))


def plain_row(text, doc_id):
    w = words_of(text)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain(w)
    gone = {i for a, m, q in found for i in range(a + q, a + m)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    return (
        doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in found).encode()).hexdigest(),
        hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest(),
    )


def made(r, n):
    """Words from a small alphabet with repeated stretches in them."""
    w = []
    while len(w) < n:
        unit = [r.choice("ab\u00e9c") * r.randrange(1, 3) for _ in range(r.randrange(1, 9))]
        w += unit * r.randrange(1, 9) + unit[: r.randrange(len(unit))]
    return r.choice([" ", "\n", "\t\x0b  "]).join(w[:n])


def test_all_runs():
    r = random.Random(1)
    texts = [made(r, r.randrange(0, 160)) for _ in range(300)] + [None, "", " \n", "a", "a " * 5, "a " * 6, "a b " * 3, "a b " * 4, "A a " * 9 + "\x1c\x85", "a\u00a0 " * 7]
    texts += [" ".join("a" * 400 + "b" + "a" * 399), " ".join("ab" * 200 + "c" + "ab" * 200)]
    got = runs.Report(texts)
    for k, t in enumerate(texts):
        assert got.runs(k) == plain(words_of(t)), t
        gone = {i for a, m, q in got.runs(k) for i in range(a + q, a + m)}
        assert got.collapsed(k).decode() == " ".join(x for i, x in enumerate(words_of(t)) if i not in gone)
    assert sum(len(got.runs(k)) for k in range(len(texts))) > 300


def test_steps_do_not_matter(monkeypatch):
    r = random.Random(2)
    texts = [made(r, 300) for _ in range(20)] + ["x" * 3000 + " " + "y" * 2000 + " x" * 9 + (" " + "z" * 2000) * 7]
    want = [plain(words_of(t)) for t in texts]
    monkeypatch.setattr(runs, "PAIRS", 7)
    monkeypatch.setattr(runs, "STEP", 50)
    got = runs.Report(texts)
    assert [got.runs(k) for k in range(len(texts))] == want


def test_equal_hashes_are_not_enough(monkeypatch):
    """Every word has the same hash: all squares look right, and the words decide."""
    r = random.Random(3)
    texts = [made(r, r.randrange(0, 120)) for _ in range(60)]
    monkeypatch.setattr(runs, "word_hashes", lambda w: np.full(len(w.at) - 1, 12345, np.uint64))
    got = runs.Report(texts)
    assert [got.runs(k) for k in range(len(texts))] == [plain(words_of(t)) for t in texts]
    thue = "a"
    for _ in range(11):  # the known weakness of sums modulo 2^64
        thue += thue.translate({97: "b", 98: "a"})
    monkeypatch.undo()
    t = " ".join(thue)
    assert runs.Report([t]).runs(0) == []


@pytest.mark.parametrize("n", [200_000])
def test_long_text(n):
    t = " ".join(f"w{i % 977}" for i in range(n))
    one = " same" * n
    got = runs.Report([t, one, one + " end"])
    assert got.runs(0) == [(0, n, 977)] and got.runs(1) == [(0, n, 1)] == got.runs(2)
    assert got.collapsed(1) == b"same" and got.collapsed(2) == b"same end"


def test_rows(spark):
    r = random.Random(4)
    rows = [(i, made(r, r.randrange(0, 90)), "z", i) for i in range(200)] + [(None, "a b " * 9, "z", 1), (7, None, "z", 1), (8, "same " * 9, "z", 1), (8, "same " * 9, "z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_runs long")
    want = sorted((plain_row(t, i) for i, t, _, _ in rows), key=repr)
    assert sorted(map(tuple, runs.digests(df).collect()), key=repr) == want
    found = {(x.doc_id, x.collapsed): [tuple(y) for y in x.runs] for x in runs.find_runs(df).collect()}
    assert found[(8, "same")] == [(0, 9, 1)] and found[(7, "")] == []
    assert runs.digests(df.limit(0)).count() == runs.find_runs(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, runs.op13_periodic_runs(spark, sf).collect()))
    assert got == sorted(plain_row(x.text, x.doc_id) for x in rows)
    assert sum(x[1] > 0 for x in got) > 5
