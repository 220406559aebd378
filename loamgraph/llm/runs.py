"""Periodic runs of words: a harmonic grid of squares, prefix hashes, extensions by binary search for all pairs at once.

A run of period q has four periods at least, so a square of period q (2q words
whose halves are equal) begins inside it at a multiple of 2q: the grid of
period q is those multiples, n/2q points, and over all periods they number
about n/2 times the logarithm of n. Hashes of both halves of all squares are
compared in one step; from the grid points that are left the stretch is
extended to both sides by binary search. What comes out is a stretch that no
neighbour extends; stretches that are found from several points or under
several periods are one run with the smallest of the periods. Equal hashes only
propose: each run's words are compared, and where they differ, all stretches of
that period in that text are made from the words themselves.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACES, mixed, per_document

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Grid points that are looked at in one step.
PAIRS = 1_000_000
#: Bytes of words that are hashed in one step, and the longest word that is hashed so.
STEP, LONG = 4_000_000, 1024
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """Words of several texts, one after the other."""

    data: bytes  # all words, each followed by one space
    at: np.ndarray  # where each word begins in data; one more entry for the end
    first: np.ndarray  # the first word of each text; one more entry for the end


def split(texts: list[str | None]) -> Words:
    """Words are runs of other characters than space and the characters 9 to 13; a null text has none."""
    raw = b"\n".join([t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]) + b"\n"
    buffer = np.frombuffer(raw, np.uint8)
    inner = ~_SPACES[buffer]
    after = np.flatnonzero(inner[:-1] & ~inner[1:]) + 1 if len(inner) > 1 else np.zeros(0, np.int64)
    keep = inner.copy()
    keep[after] = True  # one white space after each word
    data = buffer[keep].copy()
    data[_SPACES[data]] = 32
    at = np.concatenate([[0], np.flatnonzero(data == 32) + 1]).astype(np.int64)
    # the bytes that end each text: words before them belong to it or to earlier ones
    ends = np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 if t else 1 for t in texts]) if texts else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.searchsorted(after, ends)]).astype(np.int64)
    return Words(data.tobytes(), at, first)


def word_hashes(w: Words) -> np.ndarray:
    """64 bits for each word: bytes times factors by place, mixed with the length, STEP bytes at a time; words beyond LONG bytes by a digest."""
    out = np.empty(len(w.at) - 1, np.uint64)
    buffer = np.frombuffer(w.data, np.uint8)
    factors = mixed(np.arange(1, LONG + 2, dtype=np.uint64) * _BASE)
    start = 0
    while start < len(out):
        stop = max(start + 1, int(np.searchsorted(w.at, w.at[start] + STEP, "right")) - 1)
        lengths = np.diff(w.at[start : stop + 1]) - 1
        if lengths.max() <= LONG or stop > start + 1:
            place = np.arange(w.at[stop] - w.at[start]) - np.repeat(w.at[start:stop] - w.at[start], lengths + 1)
            product = (buffer[w.at[start] : w.at[stop]].astype(np.uint64) + np.uint64(1)) * factors[np.minimum(place, LONG)]
            out[start:stop] = mixed(np.add.reduceat(product, w.at[start:stop] - w.at[start]) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for k in np.flatnonzero(lengths > LONG).tolist():
            digest = hashlib.blake2b(w.data[w.at[start + k] : w.at[start + k + 1] - 1], digest_size=8).digest()
            out[start + k] = int.from_bytes(digest, "little")
        start = stop
    return out


class Prefixes:
    """Hash of any stretch of words from running sums, modulo 2^64."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(words * self.power[:n], dtype=np.uint64)])

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from a and from b >= a hash alike."""
        t = self.total
        return (t[a + n] - t[a]) * self.power[b - a] == t[b + n] - t[b]

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The number of equal words from a and b on, up to `most`."""
        got = np.zeros(len(a), np.int64)
        for step in _steps(most):
            more = np.flatnonzero(got + step <= most)
            more = more[self.same(a[more] + got[more], b[more] + got[more], np.int64(step))]
            got[more] += step
        return got

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The number of equal words before a and b, up to `most`."""
        got = np.zeros(len(a), np.int64)
        for step in _steps(most):
            more = np.flatnonzero(got + step <= most)
            more = more[self.same(a[more] - got[more] - step, b[more] - got[more] - step, np.int64(step))]
            got[more] += step
        return got


def _steps(most: np.ndarray) -> list[int]:
    top = int(most.max()) if len(most) else 0
    return [1 << k for k in range(top.bit_length() - 1, -1, -1)]


def _grid(first: np.ndarray, low: int, high: int):
    """(text, period, place) arrays of all grid points of periods low..high-1, PAIRS or so at a time; places count over all texts."""
    sizes = np.diff(first)
    for_text = np.flatnonzero(sizes >= np.maximum(LEAST_PERIODS * low, LEAST_WORDS))
    top = np.minimum(sizes[for_text] // LEAST_PERIODS, high - 1)
    count = top - low + 1
    text = np.repeat(for_text, count)
    period = low + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    points = (sizes[text] - 2 * period) // (2 * period) + 1  # a square has room at each of them
    upto = np.cumsum(points)
    start = 0
    while start < len(text):
        stop = max(start + 1, int(np.searchsorted(upto, upto[start] - points[start] + PAIRS, "right")))
        if stop == start + 1 and points[start] > PAIRS:  # one text, one period
            for k in range(0, int(points[start]), PAIRS):
                ks = np.arange(k, min(k + PAIRS, int(points[start])))
                yield np.full(len(ks), text[start]), np.full(len(ks), period[start]), first[text[start]] + ks * 2 * period[start]
        else:
            n = points[start:stop]
            t, q = np.repeat(text[start:stop], n), np.repeat(period[start:stop], n)
            k = np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)
            yield t, q, first[t] + k * 2 * q
        start = stop


def _stretches(w: Words, q: int, text: int, cache: dict) -> list[tuple[int, int]]:
    """All stretches of period q in one text that no neighbour extends, long enough for a run, from the words themselves."""
    lo, hi = int(w.first[text]), int(w.first[text + 1])
    ids = cache.get(text)
    if ids is None:
        cache.clear()
        known: dict[bytes, int] = {}
        words = w.data[w.at[lo] : w.at[hi]].split(b" ")[:-1]
        ids = cache[text] = np.array([known.setdefault(x, len(known)) for x in words])
    differs = np.flatnonzero(ids[:-q] != ids[q:])
    edges = np.concatenate([[-1], differs, [len(ids) - q]])
    out = []
    for a, b in zip(edges[:-1] + 1, edges[1:], strict=True):  # words a..b-1 equal those q further on
        if b - a + q >= max(LEAST_WORDS, LEAST_PERIODS * q):
            out.append((lo + int(a), lo + int(b) + q))
    return out


def runs_of(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, stop, period) of all runs, by text, start, then period; places count over all texts, stop is exclusive."""
    sizes = np.diff(w.first)
    hashes = word_hashes(w)
    prefixes = Prefixes(hashes)
    found: dict[tuple[int, int], tuple[int, int]] = {}  # (start, stop) -> period, text
    # the longest run known over each word, by its end and period: a square inside it, of a multiple of its period, gives that run again
    over = np.zeros(len(hashes), np.int64)
    under = np.ones(len(hashes), np.int64)
    cache: dict[int, np.ndarray] = {}
    redone: set[tuple[int, int]] = set()
    low, longest = 1, int(sizes.max()) if len(sizes) else 0
    while LEAST_PERIODS * low <= longest:
        for text, q, i in _grid(w.first, low, 2 * low):
            s = np.flatnonzero(hashes[i] == hashes[i + q])
            text, q, i = text[s], q[s], i[s]
            s = np.flatnonzero(~((over[i] >= i + 2 * q) & (q % under[i] == 0)))
            text, q, i = text[s], q[s], i[s]
            s = np.flatnonzero(prefixes.same(i, i + q, q))
            text, q, i = text[s], q[s], i[s]
            if not len(i):
                continue
            stop = i + 2 * q + prefixes.forward(i + q, i + 2 * q, w.first[text + 1] - i - 2 * q)
            start = i - prefixes.backward(i, i + q, i - w.first[text])
            s = np.flatnonzero(stop - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q))
            for t, a, b, p in np.unique(np.stack([text[s], start[s], stop[s], q[s]], 1), axis=0).tolist():
                if w.data[w.at[a] : w.at[b - p]] == w.data[w.at[a + p] : w.at[b]]:
                    right = [(a, b)]
                elif (t, p) in redone:
                    continue
                else:
                    redone.add((t, p))
                    right = _stretches(w, p, t, cache)
                for a, b in right:
                    if found.get((a, b), (p, t))[0] >= p:
                        found[(a, b)] = (p, t)
                        part = slice(a, b)
                        longer = over[part] < b
                        over[part][longer], under[part][longer] = b, p
        low *= 2
    rows = np.array(sorted((t, a, p, b) for (a, b), (p, t) in found.items()), np.int64).reshape(-1, 4)
    return rows[:, 0], rows[:, 1], rows[:, 3], rows[:, 2]


def planted(text: str | None, doc_id: int | None) -> str:
    """The text; for a tenth of the ids, its words joined by spaces, those from a on repeating p of them, by the contract's rule."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    words = (text or "").encode("utf-8", "surrogatepass").split() if h % 10 == 0 else []
    if not words:
        return text or ""
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    words[a:] = (words[a : a + p] * (-(-(n - a) // p)))[: n - a]
    return b" ".join(words).decode("utf-8", "surrogatepass")


class Report:
    """What is told of each text: runs, the longest of them, digests, and the text without repetitions."""

    def __init__(self, texts: list[str | None]):
        self.w = split(texts)
        text, start, stop, period = runs_of(self.w)
        self.start, self.stop, self.period = start, stop, period
        self.upto = np.searchsorted(text, np.arange(len(texts) + 1))

    def runs(self, k: int) -> list[tuple[int, int, int]]:
        """(start, length, period) by start, then period."""
        s = slice(self.upto[k], self.upto[k + 1])
        return list(zip((self.start[s] - self.w.first[k]).tolist(), (self.stop[s] - self.start[s]).tolist(), self.period[s].tolist(), strict=True))

    def collapsed(self, k: int) -> bytes:
        """The text's words joined by spaces, without those that any run contains after its first period."""
        lo, hi = int(self.w.first[k]), int(self.w.first[k + 1])
        s = slice(self.upto[k], self.upto[k + 1])
        gone = np.stack([self.start[s] + self.period[s], self.stop[s]], 1)
        out, here = [], lo
        for a, b in gone[np.argsort(gone[:, 0], kind="stable")].tolist():
            if a > here:
                out.append(self.w.data[self.w.at[here] : self.w.at[a]])
            here = max(here, b)
        out.append(self.w.data[self.w.at[here] : self.w.at[hi]])
        return b"".join(out)[:-1]


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs array<struct<start, length, period>> (words, from 0; by start, then period), collapsed string: one row per row of docs.

    A run is a stretch of at least six words and four periods, its smallest
    period, that neither neighbour extends; `collapsed` is the text's words
    joined by one space, without what a run repeats after its first period. A
    null or empty text, or one of white space, has no runs and collapses to the
    empty text. Repeated rows give repeated rows, an empty table an empty
    result; other columns are ignored, whatever they are called. A text has to
    fit in a worker's memory some ten times over; nothing is shuffled.
    """

    def make():
        def each(rows):
            r = Report(rows["text"])
            n = range(len(rows["text"]))
            keys = ("start", "length", "period")
            return {"doc_id": rows["doc_id"], "runs": [[dict(zip(keys, x, strict=True)) for x in r.runs(k)] for k in n], "collapsed": [r.collapsed(k).decode("utf-8", "replace") for k in n]}

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return per_document(docs, ["doc_id", "text"], f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string", make)


def digests(docs: DataFrame) -> DataFrame:
    """The contract's row for each document, its text changed by planted() first; treats rows as find_runs() does, and a null id as the empty text."""

    def make():
        def each(rows):
            r = Report([planted(t, i) for t, i in zip(rows["text"], rows["doc_id"], strict=True)])
            out = {c: [] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
            for k in range(len(rows["text"])):
                runs = r.runs(k)
                best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
                out["n_runs"].append(len(runs))
                for place, c in enumerate(("start", "length", "period")):
                    out[c].append(best[place] if best else None)
                out["exponent_milli"].append(1000 * best[1] // best[2] if best else None)
                out["runs_sha256"].append(hashlib.sha256("".join(f"{a},{n},{p}\n" for a, n, p in runs).encode()).hexdigest())
                out["collapsed_sha256"].append(hashlib.sha256(r.collapsed(k)).hexdigest())
            return {"doc_id": rows["doc_id"], **out}

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return per_document(docs, ["doc_id", "text"], schema, make)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Periodic runs of all whole texts of documents."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), F.col("text")))
