"""Secrets: base spans against plain regular expressions, the network's learning and gradients."""

import hashlib
import random
import re

import numpy as np
import pytest

from loamgraph.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32])


def test_base_spans():
    r = random.Random(3)
    pool = ["password", "API_KEY", "toKen", "secret", "=", ":", " ", '"', "'", "abc", "0123456789abcdef", "AKIA", "ABCD", "Z9", "İ", "ſ", "x-y/z+"]
    for _ in range(5000):
        t = "".join(r.choice(pool) for _ in range(r.randrange(1, 25)))
        assert sorted(secrets.findings(t)) == plain(t), t
    secrets.findings("a" * 300_000), secrets.candidates("a1" * 200_000)


def test_long_candidates_are_read_to_their_end():
    class Sees:
        threshold = 0.5

        def marks(self, x):
            return (x[:, secrets.CONTEXT : secrets.CONTEXT + secrets.BODY] == ord("K") - 31).any(axis=1)

    for n in (0, 39, 40, 41, 59, 60, 61, 100, 511, 5000, 200_000):
        for tail in ("K", "Kb2", "b2"):
            run = "services/a1/" + "x" * n + tail
            assert secrets.candidates(f"see {run}, then") == [(4, 4 + len(run))]
            base, more = secrets.spans_of([f"see {run}, then"], Sees())
            want = len(run) >= secrets.SHORTEST and "K" in run
            assert base == [[]] and more == [[(4, 3, 4 + len(run))] if want else []], (n, tail)
    # training sees what follows the first characters as well, under the label of that part
    key = "0123456789abcdef" * 3
    seen = list(secrets.examples(f"at {'z' * 100}/{key} end"))
    assert [x[1] for x in seen][0] == 0 and seen[-1][1] == 1 and len(seen) > 3


def test_gradients():
    r = np.random.default_rng(0)
    net, x, y = secrets.Net(), r.integers(0, secrets.CLASSES, (6, secrets.LENGTH)), np.array([0, 1, 0, 1, 1, 0])

    def loss():
        z = net.forward(x)[0]
        return np.mean(np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - z * y)

    z, kept = net.forward(x)
    for k, g in net.gradients(x, z, kept, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        net.w[k][at] += 1e-5
        up = loss()
        net.w[k][at] -= 2e-5
        down = loss()
        net.w[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-3 + 0.05 * abs(g[at]), k


def test_learns(spark):
    r = random.Random(1)
    hexes = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    texts = [f"some words token = {hexes()} more" for _ in range(150)] + [f"order number {r.randrange(10**16, 10**17)} shipped" for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)] + [(900, None, "a"), (901, "", "a"), (902, f"key {hexes().upper()} x", "a"), (902, f"key {hexes().upper()} x", "a")], "doc_id long, text string, spans string")
    net = secrets.fit(docs)
    assert 0 < net.threshold <= 1
    rows = secrets.find(docs, net).collect()
    assert len(rows) == 304 and sum(r.n_hex for r in rows) == 150
    assert not any("net" in r.spans for r in rows if 150 <= r.doc_id < 300)
    assert "[SECRET]" in secrets.redact(texts[0], net)
    assert secrets.find(docs.limit(0), net).count() == 0
    assert secrets.fit(docs.limit(0)).threshold > 1


def test_rare_findings_train(spark):
    r = random.Random(2)
    texts = [f"order number {r.randrange(10**16, 10**17)} shipped" for _ in range(60_000)]
    for i in range(0, 60_000, 2000):
        texts[i] = f"words token = {''.join(r.choice('0123456789abcdef') for _ in range(40))} more"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert secrets.fit(docs).threshold <= 1
    with pytest.warns(UserWarning, match="could not be trained"):
        assert secrets.fit(docs.filter("text like 'order%'").limit(100)).threshold > 1


def test_candidates():
    cases = {"plainwords are not candidates, Sentences. Neither": [], "pwd=Xk29fQ7z": ["pwd=Xk29fQ7z"], "(hunter2abc).": ["hunter2abc"], "ends aGVsbG8gd29ybGQ=.": ["aGVsbG8gd29ybGQ="], "correctHorseBattery": ["correctHorseBattery"], "a1b2": [], "v1.abc.d3f-": ["v1.abc.d3f"], "": []}
    for text, want in cases.items():
        assert [text[a:b] for a, b in secrets.candidates(text)] == want, text


def test_finds_what_patterns_cannot(spark):
    r = random.Random(5)
    key = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    texts = [f"words api_key = {key(r.randrange(20, 40))} end" for _ in range(200)] + [f"call 555-{r.randrange(1000, 9999)} or {r.randrange(10**15, 10**16)} on 2024-0{r.randrange(1, 9)}-11" for _ in range(200)]
    new = [f"the line holds {key(30)} alone" for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts + new)), "doc_id long, text string")
    net = secrets.fit(docs.filter("doc_id < 400"))
    rows = {row.doc_id: row for row in secrets.find(docs, net).collect()}
    assert net.figures["recall"] >= secrets.RECALL and net.figures["marked"] < 0.1
    assert sum("net:15:45" == rows[i].spans for i in range(400, 420)) >= 18
    assert not any("net" in rows[i].spans for i in range(200, 400))


def test_few_findings_train(spark):
    r = random.Random(6)
    texts = [f"words token = {''.join(r.choice('0123456789abcdef') for _ in range(40))} more" for _ in range(3)] + [f"order number {r.randrange(10**16, 10**17)}" for _ in range(50)]
    assert secrets.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).threshold <= 1


def check_rows(rows, docs):
    assert len(rows) == len(docs)
    for d in docs:
        want = plain(d.text or "")
        shown = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        got = rows[d.doc_id]
        assert got.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert (got.n_assign, got.n_access, got.n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
        assert ",".join(s for s in got.spans.split(",") if not s.startswith("net:")) == shown


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    from loamgraph.llm.common import table

    rows = {x.doc_id: x for x in secrets.op3_secrets(spark, f"/root/testdata/{sf}").collect()}
    check_rows(rows, table(spark, f"/root/testdata/{sf}", "documents").collect())
    assert sf == "sf0.001" or sum(r.n_assign + r.n_access + r.n_hex for r in rows.values()) > 20


def test_query_on_made_secrets(spark, tmp_path):
    """Findings of all kinds, harmless candidates, and a few keys without any pattern: base spans as plain expressions give them, and the network's spans counted."""
    r = random.Random(12)
    key = lambda n, pool="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(r.choice(pool) for _ in range(n))
    kinds = [lambda: f"api_key: '{key(32)}'", lambda: f"AKIA{key(16, 'ABCDEFGHIJ0123456789')}", lambda: f"sum {key(40, '0123456789abcdef')}", lambda: f"password={key(24)}", lambda: f"call 555-{r.randrange(1000, 9999)} on 2024-01-{r.randrange(10, 28)}", lambda: f"see www.site{r.randrange(999)}.example.org/page-{r.randrange(99)}"]
    texts = [f"Some words here, {kinds[r.choice([i % 6, 4, 5])]()} and more." for i in range(1200)] + [f"the line holds {key(30)} alone" for _ in range(20)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {x.doc_id: x for x in secrets.op3_secrets(spark, str(tmp_path)).collect()}
    check_rows(rows, spark.read.parquet(f"{tmp_path}/documents.parquet").collect())
    assert all(sum(getattr(x, f"n_{k}") for x in rows.values()) >= 50 for k in secrets.KINDS)
    assert sum(rows[i].spans == "net:15:45" for i in range(1200, 1220)) >= 14  # 15 of 20
    assert sum("net" in rows[i].spans for i in range(1200)) <= 12


def test_many_findings_in_one_text():
    """Work is near linear in the findings of a text."""
    import time

    class Never:
        threshold = 0.5

        def marks(self, x):
            return np.zeros(len(x), bool)

    text = "".join(f"password=Xk29fQ7z{i}\n" for i in range(16_000))
    start = time.perf_counter()
    assert sum(found for _, found, _, _ in secrets.examples(text)) == 16_000
    assert time.perf_counter() - start < 5
    base, more = secrets.spans_of([text], Never())
    assert len(base[0]) == 16_000 and not more[0]
    r = random.Random(3)
    for _ in range(300):
        spans = [(a, 0, a + r.randrange(1, 9)) for a in (r.randrange(60) for _ in range(r.randrange(8)))]
        cover = secrets.Cover(spans)
        for _ in range(20):
            a = r.randrange(70)
            b = a + r.randrange(1, 9)
            assert cover.touches(a, b) == any(x < b and a < y for x, _, y in spans)


def test_order_comes_to_every_window():
    for n in (1, 31, 32, 9_599, 9_600, 9_601, 20_000):
        turns = secrets.order(n, np.random.default_rng(0))
        assert len(turns) == secrets.STEPS and np.array_equal(np.unique(turns), np.arange(n))


def test_learns_from_every_window(spark, monkeypatch):
    """No window is left out of training, calibration or figures, and shares of a table learn together what one would."""
    r = random.Random(8)
    key = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    texts = [f"words api_key = {key(30)} end" for _ in range(3_000)] + [f"order number {r.randrange(10**16, 10**17)} shipped" for _ in range(12_000)]
    new = [f"the line holds {key(30)} alone" for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts + new)), "doc_id long, text string").repartition(4)
    taught = docs.filter("doc_id < 15000")
    want = {found: len({x for t in texts for x, y, _, _ in secrets.examples(t) if y == found}) for found in (0, 1)}
    monkeypatch.setattr(secrets, "SHARE", 2_000)
    monkeypatch.setattr(secrets, "LEAST", 500)
    net = secrets.fit(taught.union(taught.limit(100)))
    for one in (net, net.twin):
        assert (one.figures["other"], one.figures["found"]) == (want[0], want[1])
        assert one.figures["left_recall"] >= 0.9 and one.figures["left_marked"] < 0.1
        assert 0.4 < one.figures["learned"] / sum(want.values()) < 0.6
    many = np.array([[sum(want[y] for y in (0, 1))] * secrets.FOLDS] * 2)
    for side in (0, 1):
        assert (secrets._folds(many, side).sum(axis=0) == 1).all()  # each fold has one use
    seen = secrets._windows(taught)
    uses = [np.ones((3, 2, secrets.FOLDS), bool)] * 2
    rows = secrets._shares(seen, uses, np.array([[want[0]] + [0] * 7, [want[1]] + [0] * 7])).collect()
    assert len(rows) == 2 * -(-want[0] // 2_000)
    for side in (0, 1):
        for name, found in (("other", 0), ("found", 1)):
            assert len({bytes(x) for row in rows if row["side"] == side for x in row[name]}) == want[found]
    assert min(len(row["found"]) for row in rows) > 250
    rows = {row.doc_id: row.spans for row in secrets.find(docs, net).collect()}
    assert sum(rows[15_000 + i] == "net:15:45" for i in range(20)) >= 18
    again = secrets.fit(taught.repartition(3))
    assert np.array_equal(again.state(), net.state()) and again.least == net.least
