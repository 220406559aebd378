"""Chat formatting and source mixing against plain versions."""

import hashlib
from collections import defaultdict

import pyspark.sql.functions as F
import pytest

from loamgraph.llm import chat, mixing


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "### user: x", "<|next|>", "a</turn>\n### b: ", "\\", "\\\\", "", None, "é漢🙂", "</tur", "n>\n", "$1 \\$", "<\\/turn>", "\ufeffmark", "\ufffe"]
    rows = [(c, t, ["user", "assistant", "user: ### x", None][(c * 7 + t) % 4 if c % 2 else t // 2 % 2], hard[(c + t) % len(hard)], "x") for c in range(6) for t in range(13)]
    rows += [(9, 1, "user", "tie b", ""), (9, 1, "user", "tie a", ""), (9, 1, "user", "tie a", ""), (None, 0, "assistant", "no id", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string")
    out = chat.format_conversations(df).select("conv_id", "formatted", "loss", chat.parse_formatted(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("lost")).collect()
    want = defaultdict(list)
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert {r.conv_id for r in out} == set(want)
    for r in out:
        assert [(x.role, x.text) for x in r.back] == want[r.conv_id], r.formatted
        assert r.lost == "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert len(r.loss) == sum(role == "assistant" for role, _ in want[r.conv_id])
        changes = 1 + sum(a[0] != b[0] for a, b in zip(want[r.conv_id], want[r.conv_id][1:], strict=False))
        assert r.formatted.count("</turn>\n") == changes
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_many_and_long_turns(spark):
    n = 20_000  # quadratic work would take minutes
    turns = spark.range(n).select(F.lit(3).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("</turn>\né "), F.col("id").cast("string")).alias("text"))
    long = spark.createDataFrame([(4, 0, "assistant", "### \\é" * 400_000)], "conv_id int, turn long, role string, text string")
    out = chat.format_conversations(turns.unionByName(long)).select("conv_id", "formatted", "loss", chat.parse_formatted(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("lost"))
    got = {r.conv_id: r for r in out.collect()}
    assert [x.text for x in got[3].back] == [f"</turn>\né {i}" for i in range(n)]
    assert got[3].lost == "".join(f"</turn>\né {i}" for i in range(n) if i % 3)
    assert got[4].lost == got[4].back[0].text == "### \\é" * 400_000


def test_chat_query(spark):
    r = chat.op7_chat_format(spark, "/root/testdata/sf0.001").filter("conv_id = -7").collect()[0]
    t = "\\### Assistant: </turn> ok"
    assert r.n_turns == 2 and r.loss_chars == len(t)
    assert r.turns_sha256 == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256(t.encode()).hexdigest()


def filled(sizes, weights=mixing.WEIGHTS, most=3):
    """Targets by sharing the excess again until none is left."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        unit = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * unit > most * sizes[s]}
        if not over:
            return out | {s: w[s] * unit for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i * 7919 % 60)), None if i % 11 == 0 else "big" if i % 3 else f"s{i % 7}", "x") for i in range(3000)]
    rows += [(5, "a b", "big", ""), (5, "a b", "big", ""), (7000, None, "none", ""), (7001, "", "", ""), (None, "one two", "s1", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")
    out = mixing.mix(df, shard_docs=100).collect()
    assert len(out) == len(rows)
    sizes, got = defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r.source] += r.size
        got[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = filled(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s, t in want.items():
        assert abs(got[s] - t) <= 2 * mixing.BLOCK + 0.01 * t, (s, got[s], t)
    again = mixing.mix(df.repartition(7), shard_docs=100).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [mixing.SLICE, 3])
def test_highest_quotients(spark, monkeypatch, size):
    import heapq

    monkeypatch.setattr(mixing, "SLICE", size)
    votes = {f"i{k}": float((k * 37) % 91 + 1) for k in range(40)}
    for seats in (0, 1, 7, 40, 333):
        heap, won = [(-v, k, 0) for k, v in votes.items()], defaultdict(int)
        heapq.heapify(heap)
        for _ in range(seats):
            _, k, n = heapq.heappop(heap)
            won[k] += 1
            heapq.heappush(heap, (-votes[k] / (2 * n + 3), k, n + 1))
        df = spark.createDataFrame([(1, k, v, seats, 10**6) for k, v in votes.items()], "g int, k string, v double, s long, m long")
        assert {r.k: r.quota for r in mixing.highest_quotients(df, ["g"], "k", "v", "s", "m").collect() if r.quota} == dict(won)
