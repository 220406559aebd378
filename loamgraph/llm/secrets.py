"""Secrets: patterns, and a small character network over every other candidate.

A candidate is a run of SHORTEST or more key-like characters that no plain word
is: one with a digit, a capital behind its first letter, or one of + / _ =. The
network reads CONTEXT characters before it, BODY characters of it and CONTEXT
after it: embedding, one convolution, maximum over positions, one hidden layer.
Longer candidates are read in overlapping windows of BODY characters, to their
end, and the highest output counts. It is trained with numpy on every different
window of all texts, labelled by whether a pattern found it; what no pattern
found is not known to be harmless, so such windows weigh UNLABELLED. Windows are
dealt into shares by hash; each share trains its own copy of the network for
some steps at a time, and the copies are averaged in between. In half of the
examples the surroundings are hidden, so that the value itself has to tell. A
candidate is judged with and without its surroundings, and the higher output
counts: what has taught the network stands behind known words, what it is to
find need not. So calibration counts the outputs of all findings without their surroundings and
of all other windows as they are judged, of folds left out of training, and the
threshold is the highest calibrated one that keeps RECALL of the secrets among
them; the recall reported as left_recall is that of another fold. There are two
networks, each trained on half of the candidates' values and used for the other
half: one that was taught that no pattern finds a key would remember it.
"""

from __future__ import annotations

import re
import warnings
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, scratch
from .common import per_document, release
from .spans import digest, joined, replaced

KINDS = ["assign", "access", "hex"]
ALL_KINDS = [*KINDS, "net"]
#: Windows of a label that STEPS steps take, BATCH each, and so about the most in a share; LEAST of the rarer label, which shares have in common if it has fewer.
BATCH, STEPS, LEAST = 32, 300, 1_024
SHARE = BATCH * STEPS
#: Times that the shares' networks are averaged; sums of so many are made in one task.
ROUNDS, GATHERED = 10, 64
#: Folds of candidates, by a hash of their characters: equal ones are in one fold.
FOLDS = 8
CONTEXT, BODY, SHORTEST, UNLABELLED = 20, 40, 8, 0.5
EMBED, FILTERS, WIDTH, HIDDEN, RECALL, SEED = 8, 16, 5, 16, 0.98, 11

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_HINTS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{%d,}+" % SHORTEST)
_ODD = re.compile(r"[0-9+/_=]|[A-Za-z.-][A-Z]")
_DIGIT = re.compile(r"[0-9]")


def findings(text: str) -> list[tuple[int, int, int]]:
    """Base spans (start, kind's place, stop): leftmost, non-overlapping for each kind."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _DIGIT.search(text) or re.search("[a-f]{32}", text):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Key-like runs in their whole length, without dots and dashes at their ends."""
    out = []
    for m in _RUN.finditer(text):
        run = m.group()
        if _ODD.search(run):
            start = m.start() + len(run) - len(run.lstrip(".-"))
            run = run.strip(".-")
            if len(run) >= SHORTEST and _ODD.search(run):
                out.append((start, start + len(run)))
    return out


LENGTH = CONTEXT + BODY + CONTEXT


def windows(start: int, stop: int) -> list[int]:
    """Where the windows of a candidate begin: half a window apart, the last one ends with the candidate."""
    last = max(start, stop - BODY)
    return [*range(start, last, BODY // 2), last]


def encode(text: str, start: int, stop: int, at: int) -> bytes:
    """LENGTH character classes of the candidate's window from `at` and what surrounds the candidate; 0 where there is nothing."""
    before, body, after = text[max(0, start - CONTEXT) : start], text[at : min(stop, at + BODY)], text[stop : stop + CONTEXT]
    shown = before.rjust(CONTEXT, "\0") + body.ljust(BODY, "\0") + after.ljust(CONTEXT, "\0")
    return bytes(0 if c == "\0" else ord(c) - 31 if " " <= c <= "~" else 96 if c in "\n\r\t" else 97 for c in shown)


CLASSES = 98


def alone(x: np.ndarray) -> np.ndarray:
    """Windows without what surrounds the candidate."""
    x = x.copy()
    x[:, :CONTEXT] = x[:, CONTEXT + BODY :] = 0
    return x


#: Outputs are rounded down to these, so that counts of them are exact and of a bounded number.
OUTPUTS = np.arange(-40 * 256, 40 * 256 + 1) / 256


def on_grid(z: np.ndarray) -> np.ndarray:
    """The place of each output among OUTPUTS."""
    return np.clip(np.floor(z * 256).astype(np.int64) + 40 * 256, 0, len(OUTPUTS) - 1)


def order(n: int, r: np.random.Generator) -> np.ndarray:
    """Which of n windows each of STEPS steps takes: BATCH each, or as many as it takes to come to all of them."""
    if not n:
        return np.zeros((STEPS, 0), np.int64)
    each = max(BATCH, -(-n // STEPS))
    return np.concatenate([r.permutation(n) for _ in range(-(-STEPS * each // n))])[: STEPS * each].reshape(STEPS, each)


class Net:
    """The network; after fit() also its calibration, threshold and figures. Without examples of either label it marks nothing."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        n = lambda *s: r.normal(0, (2 / np.prod(s[:-1])) ** 0.5, s)
        self.w = {"e": r.normal(0, 0.5, (CLASSES, EMBED)), "k": n(WIDTH * (EMBED + 1), FILTERS), "kb": np.zeros(FILTERS), "h": n(FILTERS * 2, HIDDEN), "hb": np.zeros(HIDDEN), "o": n(HIDDEN, 1)[:, 0], "ob": np.zeros(1)}
        self.scale, self.shift, self.threshold, self.least = 1.0, 0.0, 2.0, np.inf
        self.figures: dict[str, float] = {}
        self.twin: Net | None = None
        self.inside = np.zeros(LENGTH)
        self.inside[CONTEXT : CONTEXT + BODY] = 1

    def forward(self, x: np.ndarray):
        """x: (n, LENGTH) classes. Maxima are taken over the candidate and over its surroundings apart."""
        w, n = self.w, len(x)
        emb = np.concatenate([w["e"][x], np.broadcast_to(self.inside[None, :, None], (n, LENGTH, 1))], axis=2)
        cols = np.lib.stride_tricks.sliding_window_view(emb, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, LENGTH - WIDTH + 1, -1)
        conv = np.maximum(cols @ w["k"] + w["kb"], 0)
        mid = slice(CONTEXT - WIDTH // 2, CONTEXT + BODY - WIDTH // 2)
        body, around = conv[:, mid], conv.copy()
        around[:, mid] = -1
        ib, ia = body.argmax(1), around.argmax(1)
        rows, cells = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        pooled = np.concatenate([body[rows, ib, cells], around[rows, ia, cells]], axis=1)
        hid = np.maximum(pooled @ w["h"] + w["hb"], 0)
        return hid @ w["o"] + w["ob"][0], (cols, conv, ib + mid.start, ia, pooled, hid)

    def gradients(self, x, z, kept, y, weight=1.0):
        w, n = self.w, len(x)
        cols, conv, ib, ia, pooled, hid = kept
        g = {}
        dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n * weight
        g["o"], g["ob"] = hid.T @ dz, np.array([dz.sum()])
        dh = dz[:, None] * w["o"] * (hid > 0)
        g["h"], g["hb"] = pooled.T @ dh, dh.sum(0)
        dp = dh @ w["h"].T
        dconv = np.zeros_like(conv)
        rows, cells = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        dconv[rows, ib, cells] += dp[:, :FILTERS]
        dconv[rows, ia, cells] += dp[:, FILTERS:]
        dconv *= conv > 0
        flat = dconv.reshape(-1, FILTERS)
        g["k"], g["kb"] = cols.reshape(len(flat), -1).T @ flat, flat.sum(0)
        dcols = (flat @ w["k"].T).reshape(n, LENGTH - WIDTH + 1, WIDTH, EMBED + 1)[..., :EMBED]
        demb = np.zeros((n, LENGTH, EMBED))
        for j in range(WIDTH):
            demb[:, j : j + LENGTH - WIDTH + 1] += dcols[:, :, j]
        g["e"] = np.zeros_like(w["e"])
        np.add.at(g["e"], x.ravel(), demb.reshape(-1, EMBED))
        return g

    def state(self) -> np.ndarray:
        """All weights in a row, behind each other by name."""
        return np.concatenate([self.w[k].ravel() for k in sorted(self.w)])

    def load(self, state: np.ndarray) -> None:
        at = 0
        for k in sorted(self.w):
            self.w[k] = state[at : at + self.w[k].size].reshape(self.w[k].shape).copy()
            at += self.w[k].size

    def train(self, shown: list[np.ndarray], moments: np.ndarray, seed: int, steps: range) -> np.ndarray:
        """Some of the STEPS steps over a share's windows without and with a finding; the moments of the weights behind them.

        All STEPS together take each window once at least, and as often as the others of its label or once less.
        """
        r = np.random.default_rng(seed)
        x = [np.where((r.random(len(s)) < 0.5)[:, None], alone(s), s) for s in shown]
        turns = [order(len(s), r) for s in shown]
        mean, square = moments
        for t in steps:
            at = [x[y][turns[y][t]] for y in (0, 1)]
            both, y = np.concatenate(at).astype(np.int64), np.repeat([0, 1], [len(a) for a in at])
            # either label counts as half of the examples, however many there are of it
            weight = np.where(y == 1, 1.0, UNLABELLED) * (len(y) / 2 / np.maximum(np.bincount(y, minlength=2), 1))[y]
            z, kept = self.forward(both)
            got = self.gradients(both, z, kept, y, weight)
            g = np.concatenate([got[k].ravel() for k in sorted(got)])
            mean = 0.9 * mean + 0.1 * g
            square = 0.999 * square + 0.001 * g * g
            self.load(self.state() - 0.01 * (mean / (1 - 0.9 ** (t + 1))) / (np.sqrt(square / (1 - 0.999 ** (t + 1))) + 1e-8))
        return np.stack([mean, square])

    def calibrate(self, held: tuple[np.ndarray, np.ndarray], last: tuple[np.ndarray, np.ndarray]) -> None:
        """Calibration, threshold and figures from the counts of every output on the grid, of other windows and of findings, in the folds that set them and in the one left for `left_recall` and `left_marked` (absent where it is empty)."""
        z, (other, found) = OUTPUTS, held
        many, rest = found.sum(), other.sum()
        high, low = (many + 1) / (many + 2), 1 / (rest + 2)
        a, b = 1.0, 0.0
        for _ in range(30):  # Newton's method on the two calibration parameters
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            s = (p * (1 - p) + 1e-9) * (found + other)
            off = (p - high) * found + (p - low) * other
            hess = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
            step = np.linalg.solve(hess, np.array([(off * z).sum() + 1e-3 * (a - 1), off.sum()]))
            a, b = float(np.clip(a - np.clip(step[0], -0.2, 0.2), 0.05, 5)), float(b - np.clip(step[1], -0.5, 0.5))
        self.scale, self.shift = a, b
        place = int(np.searchsorted(np.cumsum(found), int((1 - RECALL) * many), side="right"))
        self.least = float(z[place])
        self.threshold = float(self.probability(z[place : place + 1])[0])
        self.figures |= {"recall": float(found[place:].sum() / many), "marked": float(other[place:].sum() / rest)}
        for name, counts in (("left_recall", last[1]), ("left_marked", last[0])):
            if counts.any():
                self.figures[name] = float(counts[place:].sum() / counts.sum())

    def by_itself(self, x: np.ndarray) -> np.ndarray:
        """Places on the grid of the outputs without the surroundings."""
        return np.concatenate([on_grid(self.forward(alone(p))[0]) for p in np.array_split(x, len(x) // 256 + 1)])

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))

    def marks(self, x: np.ndarray) -> np.ndarray:
        return OUTPUTS[self.judged(x)] >= self.least

    def judged(self, x: np.ndarray) -> np.ndarray:
        """Places on the grid of the higher output, with and without the surroundings."""
        return np.concatenate([on_grid(np.maximum(self.forward(p)[0], self.forward(alone(p))[0])) for p in np.array_split(x, len(x) // 256 + 1)])


class Cover:
    """Stretches that spans cover, for asking in the logarithm of their number whether another one touches them."""

    def __init__(self, spans):
        self.start, self.stop = [], []
        for a, _, b in sorted(spans):
            if self.stop and a <= self.stop[-1]:
                self.stop[-1] = max(self.stop[-1], b)
            else:
                self.start.append(a)
                self.stop.append(b)

    def touches(self, start: int, stop: int) -> bool:
        k = bisect_left(self.start, stop)
        return k > 0 and self.stop[k - 1] > start


def fold_of(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "replace")) % FOLDS


def examples(text: str) -> Iterator[tuple[bytes, int, int, int]]:
    """(what is shown, whether a pattern found it, where it begins, the candidate's fold) of each window."""
    if runs := candidates(text):
        cover = Cover(findings(text))
        for a, b in runs:
            of = fold_of(text[a:b])
            for at in windows(a, b):
                yield encode(text, a, b, at), int(cover.touches(at, min(b, at + BODY))), at, of


def _windows(docs: DataFrame) -> DataFrame:
    """shown, found, fold: every different window of all texts, once for each label."""

    def make():
        def each(rows):
            got: dict[tuple[bytes, int], int] = {}
            for t in rows["text"]:
                for shown, found, _, of in examples(t or ""):
                    got[shown, found] = min(of, got.get((shown, found), FOLDS))
            return {"shown": [k[0] for k in got], "found": [k[1] for k in got], "fold": list(got.values())}

        return each

    # equal windows are one example, so neither their number nor that of the tasks decides
    return per_document(docs, ["text"], "shown binary, found int, fold int", make).groupBy("shown", "found").agg(F.min("fold").alias("fold"))


def _folds(many: np.ndarray, side: int) -> np.ndarray:
    """[use, label, fold]: whether a network learns from it (0), sets calibration and threshold by it (1), or takes it for the figures (2).

    The network of a side learns from the folds of the other parity; one fold
    of its own is for the figures, the rest sets calibration and threshold.
    """
    fold = np.arange(FOLDS)
    out = np.zeros((3, 2, FOLDS), bool)
    for label in (0, 1):
        last = fold == FOLDS - 2 + side
        held = (fold % 2 == side) & ~last
        if not many[label][~(held | last)].any():  # too few to train on less
            held, last = fold < 0, fold < 0
        out[0, label] = ~(held | last)
        out[1, label] = held if many[label][held].any() else True  # too few to leave any out
        out[2, label] = last
    return out


def _array(shown: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(shown), np.uint8).reshape(-1, LENGTH)


def _shares(seen: DataFrame, uses: list[np.ndarray], many: np.ndarray) -> DataFrame:
    """side, share, other, found: all windows that a network learns from, in shares of some SHARE of the commoner label."""
    parts, count = None, 0
    for side, use in enumerate(uses):
        sizes = [int(many[label][use[0, label]].sum()) for label in (0, 1)]
        total = -(-max(sizes) // SHARE)
        of = [max(1, min(total, n // LEAST)) for n in sizes]
        learned = F.lit(False)
        for label in (0, 1):
            learned = learned | ((F.col("found") == label) & F.col("fold").isin(np.flatnonzero(use[0, label]).tolist()))
        step = F.when(F.col("found") == 1, of[1]).otherwise(of[0]).cast("long")
        share = F.explode(F.sequence(F.pmod(F.xxhash64("shown"), step), F.lit(total - 1).cast("long"), step))
        rows = seen.filter(learned).select(F.lit(side).alias("side"), share.alias("share"), "found", "shown")
        parts, count = rows if parts is None else parts.union(rows), count + total
    listed = lambda label: F.array_sort(F.collect_list(F.when(F.col("found") == label, F.col("shown"))))
    return parts.repartition(min(count, 512), "side", "share").groupBy("side", "share").agg(listed(0).alias("other"), listed(1).alias("found"))


def _round(shares: DataFrame, nets: list[Net], moments: list[np.ndarray], steps: range) -> None:
    """Each share goes on from the common networks for some steps; weights and moments are averaged over the shares."""
    begun = [(net.state(), held) for net, held in zip(nets, moments, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                state, held = begun[row["side"]]
                net.load(state)
                held = net.train([_array(row["other"]), _array(row["found"])], held, SEED + 1 + row["share"], steps)
                yield pa.RecordBatch.from_pydict({"side": pa.array([row["side"]], pa.int32()), "share": pa.array([row["share"]], pa.int64()), "state": pa.array([np.concatenate([net.state(), held.ravel()]).tobytes()], pa.binary())})
        release()

    def add(rows):
        import pandas as pd

        rows = rows.sort_values("share")
        total = np.sum([np.frombuffer(b) for b in rows["state"]], axis=0)
        return pd.DataFrame({"side": rows["side"].iloc[:1], "first": rows["share"].iloc[:1], "n": [len(rows)], "state": [total.tobytes()]})

    group = F.floor(F.col("share") / GATHERED).alias("group")
    ended = shares.mapInArrow(run, "side int, share long, state binary").groupBy("side", group).applyInPandas(add, "side int, first long, n long, state binary")
    got = sorted(ended.collect(), key=lambda r: (r["side"], r["first"]))
    for side, net in enumerate(nets):
        mine = [r for r in got if r["side"] == side]
        mean = np.sum([np.frombuffer(bytes(r["state"])) for r in mine], axis=0) / sum(r["n"] for r in mine)
        size = len(mean) // 3
        net.load(mean[:size])
        moments[side] = mean[size:].reshape(2, size)


def _outputs(seen: DataFrame, nets: list[Net], uses: list[np.ndarray]) -> np.ndarray:
    """[side, use - 1, label, place]: how many windows of the folds that were left out have each output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, 2, len(OUTPUTS)), np.int64)
        for batch in batches:
            x = _array(batch.column("shown").to_pylist())
            label, of = (batch.column(c).to_numpy() for c in ("found", "fold"))
            for side, (net, use) in enumerate(zip(nets, uses, strict=True)):
                for y in (0, 1):
                    some = np.flatnonzero((label == y) & use[1:, y].any(axis=0)[of])
                    if len(some):
                        # what a finding gives by itself, and the most that another window gives, as marks() takes it
                        place = net.by_itself(x[some].astype(np.int64)) if y else net.judged(x[some].astype(np.int64))
                        for k in (1, 2):
                            total[side, k - 1, y] += np.bincount(place[use[k, y][of[some]]], minlength=len(OUTPUTS))
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "n": pa.array(flat[at], pa.int64())})
        release()

    out = np.zeros((2, 2, 2, len(OUTPUTS)), np.int64)
    for r in seen.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out.ravel()[r["at"]] = r["n"]
    return out


def fit(docs: DataFrame) -> Net:
    """Train on every different window of all texts; the shares go by a hash of what is shown, so every run gives the same network.

    The driver holds the weights, sums of them and counts of outputs, a share's windows are in one task.
    """
    nets = [Net(), Net(SEED + 7)]
    many = np.zeros((2, FOLDS), np.int64)
    with scratch(docs.sparkSession):
        seen = materialise(_windows(docs), "secret-windows")
        for r in seen.groupBy("found", "fold").agg(F.count(F.lit(1)).alias("n")).collect():
            many[r["found"], r["fold"]] = r["n"]
        if many.any(axis=1).all():
            uses = [_folds(many, side) for side in (0, 1)]
            shares = materialise(_shares(seen, uses, many), "secret-shares")
            moments = [np.zeros((2, len(net.state()))) for net in nets]
            for k in range(ROUNDS):
                _round(shares, nets, moments, range(k * STEPS // ROUNDS, (k + 1) * STEPS // ROUNDS))
            counts = _outputs(seen, nets, uses)
            for net, use, mine in zip(nets, uses, counts, strict=True):
                net.figures = {"found": int(many[1].sum()), "other": int(many[0].sum()), "learned": int(many[use[0]].sum()), "held": int(mine[0].sum())}
                net.calibrate(tuple(mine[0]), tuple(mine[1]))
    net, net.twin = nets
    if net.threshold > 1:
        warnings.warn(f"secrets: the network could not be trained and adds no spans; {many[1].sum()} windows with a finding, {many[0].sum()} without", stacklevel=2)
    return net


def spans_of(texts: list[str], net: Net) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """Base spans and those the network adds, for each text."""
    base = [findings(t) for t in texts]
    covers = [Cover(b) for b in base]
    # every candidate is judged; what lies in a base span adds no span of its own
    more: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if net.threshold <= 1:
        todo = ((i, a, b, at) for i, t in enumerate(texts) for a, b in candidates(t) for at in windows(a, b))
        while part := list(islice(todo, 4096)):
            x = np.array([np.frombuffer(encode(texts[i], a, b, at), np.uint8) for i, a, b, at in part]).astype(np.int64)
            hits = net.marks(x)
            if twin := getattr(net, "twin", None):  # no candidate is judged by the network that has learned it
                odd = np.array([fold_of(texts[i][a:b]) % 2 == 1 for i, a, b, _ in part])
                if odd.any():
                    hits[odd] = twin.marks(x[odd])
            for (i, a, b, _), hit in zip(part, hits, strict=True):
                if hit and more[i][-1:] != [(a, len(KINDS), b)] and not covers[i].touches(a, b):
                    more[i].append((a, len(KINDS), b))
    return base, more


def find(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per row of docs, over whole texts.

    A null text is empty and has no spans. Repeated rows give repeated rows, an
    empty table an empty result; other columns are ignored.
    """
    known = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers

    def make():
        def each(rows):
            base, more = spans_of([t or "" for t in rows["text"]], known.value)
            out = {"doc_id": rows["doc_id"], "base_sha256": [digest(joined(b, ALL_KINDS)) for b in base], "spans": [joined(b + m, ALL_KINDS) for b, m in zip(base, more, strict=True)]}
            for k, name in enumerate(KINDS):
                out[f"n_{name}"] = [sum(s[1] == k for s in b) for b in base]
            return out

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return per_document(docs, ["doc_id", "text"], f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make)


def redact(text: str, net: Net) -> str:
    """One text with everything found replaced."""
    base, more = spans_of([text], net)
    return replaced(text, base[0] + more[0], ["[SECRET]"] * len(ALL_KINDS))


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs, fit(docs))
