"""Language-model scoring by deleted interpolation.

A token's probability after the word h is

    w2[b] * c(h, token) / c(h)  +  w1[b] * c(token) / N  +  w0[b] / (V + 1),

with the weights of the bucket b of h's frequency (powers of two). They are
learned by expectation-maximisation on the counts of a held-out fold of the
training documents under the counts of the others; the final counts are those
of all training documents.

Nothing that grows with the corpus is broadcast. Documents are dealt into
chunks of about CHUNK bytes. Each chunk sends its distinct words and pairs of
words, packed and cut by hash range, to the tasks that add the counts up; these
send back to each chunk the totals of exactly what it asked for, and the chunk
is scored with that. A key has one entry a chunk at most, however frequent it
is. Each chunk speaks to each hash range, so where there are more than DIRECT
of both they do it by way of groups of chunks and coarse ranges, about as many
as the square root: messages then stay long, and their number is that of the
chunks times the root. Both ways give the same counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import fold, hashed_words, mixed
from .shingles import _P

CHUNK = 16 << 20
#: Chunks that send to as many hash ranges themselves; more of them are gathered in groups first.
DIRECT = 2048
END, START = np.uint64(0x9D5C1A7B3F2E4D61), np.uint64(0x4B7E2F91A3C5D807)
BUCKETS, STEP, ROUNDS, LEAST = 24, 0.1, 40, 1e-5
DEFAULT = (0.05, 0.5, 0.45)


class Chunk:
    """Distinct words and pairs of a chunk's texts, and where each token's are among them."""

    def __init__(self, texts: list[str | None]):
        words, sizes = hashed_words(texts)
        self.sizes = sizes + 1
        last = np.cumsum(self.sizes) - 1
        self.starts = last - sizes
        h = np.empty(len(words) + len(sizes), np.uint64)
        is_word = np.ones(len(h), bool)
        is_word[last] = False
        h[is_word], h[last] = words, END
        self.words, self.word_of = np.unique(h, return_inverse=True)
        # the word before each token; at a text's start it is END, whose count is that of the texts
        self.before = np.empty_like(self.word_of)
        self.before[1:] = self.word_of[:-1]
        self.before[self.starts] = np.searchsorted(self.words, END)
        left = np.empty_like(h)
        left[1:] = h[:-1]
        left[self.starts] = START
        self.pairs, self.pair_of = np.unique(mixed(left * _P[0] + h * _P[1]), return_inverse=True)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts) if len(self.starts) else np.zeros(0, values.dtype)


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the `parts` equal hash ranges within sorted keys."""
    edges = [(i << 64) // parts for i in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]]).astype(int)


def narrow(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys of one hash range: how many there are of each upper 16 bits, and 6 bytes each."""
    top, n = np.unique(keys >> np.uint64(48), return_counts=True)
    low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return np.array([len(top)], "<u4").tobytes() + top.astype("<u2").tobytes() + n.astype("<u4").tobytes() + low.tobytes()


def widened(b: bytes) -> np.ndarray:
    m = int(np.frombuffer(b, "<u4", 1)[0])
    top, n = np.frombuffer(b, "<u2", m, 4).astype(np.uint64), np.frombuffer(b, "<u4", m, 4 + 2 * m)
    low = np.frombuffer(b, np.uint8, offset=4 + 6 * m).reshape(-1, 6)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :6] = low
    return out.view("<u8")[:, 0] | np.repeat(top << np.uint64(48), n)


def packed(a: np.ndarray) -> bytes:
    """Whole numbers in a byte each; those from 255 on apart, as (place, number)."""
    big = np.flatnonzero(a >= 255)
    return np.array([len(a)], "<u4").tobytes() + np.minimum(a, 255).astype(np.uint8).tobytes() + big.astype("<u4").tobytes() + a[big].astype("<i8").tobytes()


def unpacked(b: bytes) -> np.ndarray:
    n = int(np.frombuffer(b, "<u4", 1)[0])
    out = np.frombuffer(b, np.uint8, n, 4).astype(np.int64)
    m = (len(b) - 4 - n) // 12
    if m:
        out[np.frombuffer(b, "<u4", m, 4 + n)] = np.frombuffer(b, "<i8", m, 4 + n + 4 * m)
    return out


def context_bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, 1 + np.minimum(BUCKETS - 2, np.log2(np.maximum(c, 1)).astype(np.int64)), 0)


def ratio(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


class Weights:
    """Mixture weights (uniform, words, pairs) of each context bucket."""

    def __init__(self, w: np.ndarray):
        self.w = w

    @classmethod
    def learn(cls, bucket, p2, p1, n, uniform: float) -> Weights:
        """Expectation-maximisation on held-out tokens: n of them in a bucket whose pair and word estimates are p2 and p1."""
        w = np.tile(np.array(DEFAULT), (BUCKETS, 1))
        p = np.stack([np.full(len(n), uniform), p1, p2], axis=1)
        for b in range(BUCKETS):
            at = bucket == b
            if not at.any():
                continue
            q, m, own = p[at], n[at].astype(float), w[b]
            for _ in range(ROUNDS):
                part = q * own
                part /= part.sum(axis=1, keepdims=True)
                own = (part * m[:, None]).sum(axis=0) / m.sum()
                own = np.maximum(own, LEAST)
                own /= own.sum()
            w[b] = own
        return cls(w)

    def probability(self, bucket, p2, p1, uniform: float) -> np.ndarray:
        w = self.w[bucket]
        # without counts of the context its share goes to the others in proportion
        pair = np.where(bucket > 0, w[:, 2], 0.0)
        rest = w[:, 0] + w[:, 1]
        scale = np.where(bucket > 0, 1.0, 1 / rest)
        return pair * p2 + scale * (w[:, 1] * p1 + w[:, 0] * uniform)


_ASKED = pa.schema([("unit", pa.int64()), ("level", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("own", pa.binary()), ("more", pa.binary())])
_TOLD = pa.schema([("unit", pa.int64()), ("level", pa.int32()), ("part", pa.int32()), ("own", pa.binary()), ("total", pa.binary())])
ASKED = "unit long, level int, part int, keys binary, own binary, more binary"
TOLD = "unit long, level int, part int, own binary, total binary"


def _summed(rows: list[dict], columns: tuple[str, str]):
    """(distinct keys of the rows, where each row's keys are among them, sums of both columns by distinct key)."""
    keys = [widened(r["keys"]) for r in rows]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(at, np.concatenate([unpacked(r[c]) for r in rows]), len(distinct)).astype(np.int64) for c in columns]
    return distinct, np.split(at, np.cumsum([len(k) for k in keys])[:-1]), sums


def _messages(unit: int, level: int, first: int, keys: np.ndarray, edges: np.ndarray, own: np.ndarray, more: np.ndarray) -> list[dict]:
    """A row for each hash range from `first` on that holds keys."""
    cut = [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]
    return [{"unit": unit, "level": level, "part": first + i, "keys": narrow(keys[s]), "own": packed(own[s]), "more": packed(more[s])} for i, s in enumerate(cut) if s.stop > s.start]


def _counts(dealt: DataFrame, parts: int, direct: int | None = None) -> DataFrame:
    """(chunk, level, part, own, total): for each chunk and hash range the counts, without and with the held-out fold, of what it holds.

    Rows of chunk -1 hold the number of tokens (level 1: words) and of distinct
    ones, without and with the fold, in own and total.
    """
    coarse = parts if parts <= (direct or DIRECT) else int(np.ceil(np.sqrt(parts)))
    fine = -(-parts // coarse)  # ranges within a coarse one, and chunks in a group: 1 if each chunk speaks for itself

    def ask(key, table):
        c = Chunk(table.column("text").to_pylist())
        role = np.repeat(table.column("role").to_numpy(), c.sizes)
        out = []
        for level, keys, at in ((1, c.words, c.word_of), (2, c.pairs, c.pair_of)):
            own = np.bincount(at[role == 2], minlength=len(keys))
            more = np.bincount(at[role == 1], minlength=len(keys))
            out += _messages(key[0].as_py(), level, 0, keys, cuts(keys, coarse), own, more)
        return pa.Table.from_pylist(out, schema=_ASKED)

    def add(key, table):
        level, part = key[0].as_py(), key[1].as_py()
        rows = table.select(["unit", "keys", "own", "more"]).to_pylist()
        _, places, (own, more) = _summed(rows, ("own", "more"))
        total = own + more
        out = [{"unit": r["unit"], "own": packed(own[at]), "total": packed(total[at])} for r, at in zip(rows, places, strict=True)]
        if level == 1:
            out.append({"unit": -1, "own": packed(np.array([own.sum(), (own > 0).sum()])), "total": packed(np.array([total.sum(), (total > 0).sum()]))})
        return pa.Table.from_pylist([r | {"level": level, "part": part} for r in out], schema=_TOLD)

    def gather(key, table):
        group, level, part = (k.as_py() for k in key)
        keys, _, (own, more) = _summed(table.select(["keys", "own", "more"]).to_pylist(), ("own", "more"))
        lowest, highest = -(-(part << 64) // coarse), -(-((part + 1) << 64) // coarse)
        inner = np.array([lowest + (highest - lowest) * i // fine for i in range(1, fine)], np.uint64)
        edges = np.concatenate([[0], np.searchsorted(keys, inner), [len(keys)]]).astype(int)
        return pa.Table.from_pylist(_messages(group, level, part * fine, keys, edges, own, more), schema=_ASKED)

    def spread(key, asked, told):
        _, level, part = (k.as_py() for k in key)
        rows = asked.select(["unit", "keys", "own", "more"]).to_pylist()
        if not rows:
            return _TOLD.empty_table()
        _, places, _ = _summed(rows, ("own", "more"))
        got = sorted(told.select(["part", "own", "total"]).to_pylist(), key=lambda r: r["part"])
        own, total = (np.concatenate([unpacked(r[c]) for r in got]) for c in ("own", "total"))
        return pa.Table.from_pylist([{"unit": r["unit"], "level": level, "part": part, "own": packed(own[at]), "total": packed(total[at])} for r, at in zip(rows, places, strict=True)], schema=_TOLD)

    asked = dealt.groupBy("chunk").applyInArrow(ask, ASKED)
    if fine == 1:
        return asked.groupBy("level", "part").applyInArrow(add, TOLD).withColumnRenamed("unit", "chunk")
    asked = materialise(asked, "lm-asked")
    group = F.floor(F.col("unit") / fine).alias("group")
    told = materialise(asked.groupBy(group, "level", "part").applyInArrow(gather, ASKED).groupBy("level", "part").applyInArrow(add, TOLD), "lm-told")
    back = told.filter("unit >= 0").groupBy(F.col("unit").alias("group"), "level", F.floor(F.col("part") / fine).cast("int").alias("part"))
    answers = asked.groupBy(group, "level", "part").cogroup(back).applyInArrow(spread, TOLD)
    return answers.unionByName(told.filter("unit < 0")).withColumnRenamed("unit", "chunk")


def _answers(table: pa.Table, column: str) -> dict[int, np.ndarray]:
    rows = sorted(table.select(["level", "part", column]).to_pylist(), key=lambda r: (r["level"], r["part"]))
    return {level: np.concatenate([unpacked(r[column]) for r in rows if r["level"] == level] or [np.zeros(0, np.int64)]) for level in (1, 2)}


def _estimates(c: Chunk, counts: dict[int, np.ndarray], n: int):
    """For each token: bucket of its context, pair estimate, word estimate, count."""
    word = counts[1][c.word_of]
    context = counts[1][c.before]
    return context_bucket(context), ratio(counts[2][c.pair_of], context), word / max(n, 1), word


def score(docs: DataFrame, train: Column, held: Column, chunk_bytes: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of docs, over whole texts.

    train marks the training rows, held those of them whose counts the weights
    are learned on. A null or empty text is one end token. Without training
    rows every token is unknown. Repeated rows are scored each, and count each
    in training; an empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    role = F.when(~train, 0).when(held, 1).otherwise(2).cast("int")
    rows = docs.select("doc_id", "text", F.coalesce(role, F.lit(0)).alias("role"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    parts = max(-(-int(size) // chunk_bytes), 2 * spark.sparkContext.defaultParallelism)
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("long"))
    counts = materialise(_counts(dealt, parts), "lm-counts")
    whole = {"own": np.zeros(2, np.int64), "total": np.zeros(2, np.int64)}
    sums = counts.filter("chunk = -1").select("own", "total")
    for r in sums.toLocalIterator():  # two numbers for each hash range
        for k in whole:
            whole[k] += unpacked(bytes(r[k]))
    answers = counts.filter("chunk >= 0")
    n_own, v_own = (int(x) for x in whole["own"])
    n, v = (int(x) for x in whole["total"])

    def held_out(key, texts, given):
        schema = pa.schema([("b", pa.int32()), ("q2", pa.int32()), ("q1", pa.int32()), ("n", pa.int64())])
        at = np.flatnonzero(texts.column("role").to_numpy() == 1) if texts.num_rows else []
        if not len(at):
            return schema.empty_table()
        c = Chunk(texts.column("text").to_pylist())
        use = np.repeat(texts.column("role").to_numpy() == 1, c.sizes)
        b, p2, p1, _ = (x[use] for x in _estimates(c, _answers(given, "own"), n_own))
        step = lambda p: np.where(p > 0, 1 + (-np.log10(np.maximum(p, 1e-300)) / STEP).astype(np.int64), 0)
        cells, m = np.unique((b * 4096 + step(p2)) * 4096 + step(p1), return_counts=True)
        return pa.table([pa.array((cells >> 24).astype(np.int32)), pa.array((cells >> 12 & 4095).astype(np.int32)), pa.array((cells & 4095).astype(np.int32)), pa.array(m.astype(np.int64))], schema=schema)

    # a grid of logarithms, of fixed size, is what the weights are learned on
    grid = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(held_out, "b int, q2 int, q1 int, n long")
    grid = materialise(grid.groupBy("b", "q2", "q1").agg(F.sum("n").alias("n")), "lm-grid").toPandas().sort_values(["b", "q2", "q1"])
    middle = lambda q: np.where(q > 0, 10.0 ** (-(q - 0.5) * STEP), 0.0)
    weights = Weights.learn(grid["b"].to_numpy(), middle(grid["q2"].to_numpy()), middle(grid["q1"].to_numpy()), grid["n"].to_numpy(), 1 / (v_own + 1))

    def scored(key, texts, given):
        c = Chunk(texts.column("text").to_pylist())
        b, p2, p1, word = _estimates(c, _answers(given, "total"), n)
        base = np.log10((word + 0.5) / (n + 0.5 * (v + 1)))
        own = np.log10(weights.probability(b, p2, p1, 1 / (v + 1)))
        size = len(c.sizes)
        return pa.table({"doc_id": texts.column("doc_id"), "n_tokens": c.sizes, "n_known": c.per_text((word > 0).astype(np.int64)), "train_tokens": np.full(size, n, np.int64), "base_score": c.per_text(base), "score": c.per_text(own)})

    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    """Score all documents; training rows have another remainder than 1, and those of remainder 2 teach the weights."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    f = fold(F.col("doc_id"))
    out = score(docs, f != 1, f == 2)
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
