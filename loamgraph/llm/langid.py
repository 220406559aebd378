"""Language identification by mixture inference.

A document's character trigrams are taken as draws from a mixture of the
learned languages' trigram distributions. Expectation-maximisation estimates
the mixture's proportions; the set of languages is the one with the largest
log-likelihood less PENALTY * log(number of trigrams) for each language beyond
the first, tried by adding languages in the order of their proportions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, per_document, release

#: Labelled documents a language that the trigram model is fitted on, about (a fraction by hash of the id): the bound of the sample.
TRAIN_DOCS = 2_000
CELLS, SMOOTH, PENALTY, ROUNDS = 1 << 16, 0.05, 3.0, 12
#: The pipeline keeps a document if its main language holds this share of it at least.
KEEP = 0.5


def _letters() -> np.ndarray:
    """Whether each code point of the first plane is a letter; characters beyond it count as letters."""
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


_table: list[np.ndarray] = []


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def trigrams(text: str) -> np.ndarray:
    """Cells of the character trigrams of the lower-cased text, runs of other characters than letters made one space."""
    if not _table:
        _table.append(_letters())
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = np.where((codes >= 1 << 16) | _table[0][np.minimum(codes, (1 << 16) - 1)], codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    c = codes[keep].astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    h = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(48)).astype(np.int64)


class Model:
    """Languages in order and the probability of each trigram cell in each."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        c = counts.astype(np.float64) + SMOOTH
        self.p = np.ascontiguousarray((c / c.sum(axis=1, keepdims=True)).T.astype(np.float32)) if langs else np.zeros((CELLS, 0), np.float32)

    def em(self, p: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        """Mixture proportions and the log-likelihood with them."""
        pi = start
        for _ in range(rounds):
            w = p @ pi
            new = pi * (p.T @ (1 / w)) / len(p)
            done = np.abs(new - pi).max() < 1e-3
            pi = new
            if done:
                break
        return pi, float(np.log(p @ pi).sum())

    def predict(self, text: str | None) -> tuple[str, float, list[str], list[float]]:
        """(language, score, languages of the document, their proportions); of equals the one that sorts first."""
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0, [], []
        cells = trigrams(text)
        if not len(cells):
            return "und", 0.0, [], []
        p = self.p[cells]
        n = len(self.langs)
        alone = np.log(p).sum(axis=0, dtype=np.float64)
        full, _ = self.em(p, np.full(n, 1 / n, np.float32), ROUNDS)
        order = np.argsort(-full, kind="stable")
        first = int(np.argmax(alone))
        chosen, pi, best = [first], np.ones(1), float(alone[first])
        price = PENALTY * np.log(len(cells) + 1)
        for k in (int(x) for x in order if x != first):
            trial = [*chosen, k]
            q, ll = self.em(p[:, trial], (full[trial] / full[trial].sum()).astype(np.float32), ROUNDS)
            if ll - best <= price:
                break
            chosen, pi, best = trial, q, ll
        top = int(np.argmax(pi))
        # how sure the document is of that language against each other one that it doesn't hold
        rest = np.delete(alone, [x for x in chosen if x != chosen[top]])
        sure = 1 / np.exp(np.minimum(rest - alone[chosen[top]], 50)).sum()
        rank = np.argsort(-pi, kind="stable")
        score = float(min(1.0, max(0.0, pi[top] / pi.sum() * min(1.0, sure))))
        return self.langs[chosen[top]], score, [self.langs[chosen[i]] for i in rank], [float(pi[i]) for i in rank]


def fit(docs: DataFrame, train: Column, per_lang: int = TRAIN_DOCS) -> Model:
    """Trigram counts of whole texts of a bounded sample of the labelled rows where `train` holds.

    The fraction of each language's rows comes from its count over all rows,
    the rows from a hash of the id; what reaches the driver is at most CELLS
    counts a language. No labelled rows: a model without languages.
    """
    spark = docs.sparkSession
    rows = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, CELLS)))
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / sizes[k]))]), F.col("lang"))
    place = F.xxhash64(F.col("doc_id"), F.lit("langid")).bitwiseAND(F.lit((1 << 63) - 1))
    sample = rows.filter(place <= share * F.lit(float(1 << 63)))
    number = F.array_position(F.lit(langs), F.col("lang")) - 1

    def make():
        def each(part):
            out = {"lang": [], "cell": [], "n": []}
            total: dict[int, np.ndarray] = {}
            for k, t in zip(part["number"], part["text"], strict=True):
                total.setdefault(k, np.zeros(CELLS, np.int64))
                total[k] += np.bincount(trigrams(t), minlength=CELLS)
            for k, c in total.items():
                at = np.flatnonzero(c)
                out["lang"] += [k] * len(at)
                out["cell"] += at.tolist()
                out["n"] += c[at].tolist()
            return out

        return each

    got = per_document(sample.select(number.cast("int").alias("number"), "text"), ["number", "text"], "lang int, cell int, n long", make)
    got = got.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), CELLS))
    counts[got["lang"].to_numpy(), got["cell"].to_numpy()] = got["n"].to_numpy()
    return Model(langs, counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, langs array, shares array: one row per row of docs, over whole texts.

    A text that is null or has no letter gets `und`, score 0 and empty arrays;
    so does every text under a model without languages. Repeated rows give
    repeated rows, an empty table an empty result; other columns, also lang and
    source, are not read.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)  # CELLS floats a language

    def make():
        m = known.value

        def each(rows):
            got = [m.predict(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "lang_pred": [x[0] for x in got], "score": [x[1] for x in got], "langs": [x[2] for x in got], "shares": [x[3] for x in got]}

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return per_document(docs, ["doc_id", "text"], f"doc_id {kind}, lang_pred string, score double, langs array<string>, shares array<double>", make)


def keep_identified(docs: DataFrame, model: Model, least: float = KEEP) -> DataFrame:
    """The rows of docs, all columns unchanged, whose text has letters and a language that holds `least` of it.

    Null and empty texts and those without letters go, and under a model
    without languages all do; repeated rows stay or go together; an empty table
    stays empty; columns may have any names.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def kept(text):
        import pandas as pd

        m = known.value
        found = (m.predict(t) for t in text)
        out = pd.Series([lang != "und" and bool(shares) and shares[0] >= least for lang, _, _, shares in found], dtype=bool)
        release()
        return out

    return docs.filter(kept(F.col("text")))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents; learned from those whose fold isn't 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs, fold(F.col("doc_id")) != 0)
    out = identify(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "langs", "shares")
