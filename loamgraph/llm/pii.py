"""Personal data: patterns, and terms that give the entities away.

Patterns find the protected entities. For each of them corpus co-occurrence
says how strongly a term of the same text reveals it: with N documents, df the
number of documents that hold something and c the number of documents in which
term and entity stand together, wherever in them,

    pmi = log(c * N / (df(term) * df(entity))),   information = log(N / df(entity)).

A term with pmi >= GENERALISE * information discloses the entity and is
generalised to its class (NUMBER, CODE, NAME or WORD, by its characters); from
REMOVE * information on it is removed, at each of its places in the texts that
hold the entity. Entities are the values themselves and the groups that they
belong to: an address's domain, a network, the issuer of a card, a telephone
exchange. Terms are words that touch no entity, numbers too. Every row is a
document in all three counts, copies included. Pairs in fewer than SUPPORT
different texts are no evidence, so that copies of one document alone don't make
its words disclosing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import own, per_document, release, unused
from .spans import digest, joined, replaced

KINDS = ["email", "ip", "card", "phone"]
ALL_KINDS = [*KINDS, "term", "termdel"]
LABELS = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[WORD]", "", "[NUMBER]", "[CODE]", "[NAME]"]
SUPPORT, GENERALISE, REMOVE = 3, 0.7, 0.9

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# chains match from their first digit on, whatever follows, so that no digit is looked at twice
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_SPACED = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def entities(text: str) -> list[tuple[int, int, int]]:
    """Base spans (start, kind's place, stop): leftmost, non-overlapping for each kind; linear in the text."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            if m.group().count(".") >= 3:
                start, parts = m.start(), m.group().split(".")
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    stop = start + sum(map(len, four)) + 3
                    # leading zeros don't count, and a long part needs no number made of it
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                        out.append((start, 1, stop))
                    start = stop + 1
        for m in _SPACED.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return out


def term_of(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) - (1 << 63)


def entities_of(text: str, kind: int) -> list[int]:
    """What a base span stands for: its value and the group that the value belongs to."""
    value = text.lower() if kind == 0 else text if kind == 1 else "".join(filter(str.isdigit, text))
    group = value.rpartition("@")[2] if kind == 0 else value.rpartition(".")[0] if kind == 1 else value[:6] if kind == 2 else value[:-4]
    return [term_of(f"{KINDS[kind]}\0{value}"), term_of(f"{KINDS[kind]} group\0{group}")]


def generalised(text: str, start: int, kind: int, stop: int) -> tuple[int, int, int]:
    """The span with the place in LABELS of what it is replaced by."""
    if kind == ALL_KINDS.index("term"):
        word = text[start:stop]
        if any(map(str.isdigit, word)):
            kind = LABELS.index("[NUMBER]" if word.isdigit() else "[CODE]")
        elif word[0].isupper():
            kind = LABELS.index("[NAME]")
    return start, kind, stop


def words(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(word in lower case, start, stop) of each word that touches no span; linear in the text."""
    cover, at, reach = sorted((a, b) for a, _, b in spans), 0, -1
    for m in _WORD.finditer(text):
        while at < len(cover) and cover[at][0] < m.end():
            reach = max(reach, cover[at][1])
            at += 1
        if m.start() >= reach:
            yield m.group().lower(), m.start(), m.end()


def places(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[int], bytes]:
    """Different terms of the text, and where they are: for each word its term's place in that list, the gap before it and its length, packed."""
    known: dict[str, int] = {}
    rows = [(known.setdefault(w, len(known)), a, b) for w, a, b in words(text, spans)]
    p = np.array(rows, "<u4").reshape(-1, 3).T.copy()
    p[2] -= p[1]
    p[1] = np.diff(p[1], prepend=np.zeros(1, "<u4"))
    return list(map(term_of, known)), zlib.compress(p.view(np.uint8).reshape(3, -1, 4).transpose(0, 2, 1).tobytes(), 1)


def placed(packed: bytes) -> np.ndarray:
    """(term's place, start, stop) of each word, from what places() packed."""
    p = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(3, 4, -1).transpose(0, 2, 1).copy().view("<u4")[:, :, 0].astype(np.int64)
    p[1] = np.cumsum(p[1])
    p[2] += p[1]
    return p.T


_BASE = "array<struct<start:int,kind:int,stop:int>>"


def _scan(docs: DataFrame) -> DataFrame:
    """doc_id, content (a hash of the text), base spans, different entities and terms, and the terms' places; no terms without base spans."""

    def make():
        def each(rows):
            out = {"doc_id": rows["doc_id"], "content": [], "base": [], "entities": [], "terms": [], "places": []}
            for t in rows["text"]:
                t = t or ""
                spans = entities(t)
                terms, packed = places(t, spans) if spans else ([], None)
                out["content"].append(term_of(t) if spans else 0)
                out["base"].append([{"start": a, "kind": k, "stop": b} for a, k, b in spans])
                out["entities"].append(sorted({e for a, k, b in spans for e in entities_of(t[a:b], k)}))
                out["terms"].append(terms)
                out["places"].append(packed)
            return out

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return per_document(docs, ["doc_id", "text"], f"doc_id {kind}, content long, base {_BASE}, entities array<long>, terms array<long>, places binary", make)


def _word_counts(docs: DataFrame) -> DataFrame:
    """(term, n): documents that hold the word outside entities, summed over each slice of rows."""

    def make():
        def each(rows):
            total: dict[str, int] = {}
            for t in rows["text"]:
                t = t or ""
                spans = entities(t)
                found = {w for w, _, _ in words(t, spans)} if spans else {w.lower() for w in set(_WORD.findall(t))}
                for w in found:
                    total[w] = total.get(w, 0) + 1
            return {"term": list(map(term_of, total)), "n": list(total.values())}

        return each

    return per_document(docs, ["text"], "term long, n long", make)


def _totals(rows: DataFrame, key: str, *what: Column) -> DataFrame:
    """Aggregates by a long key, grouped by another form of it: a join on the key deals both sides out anew, and only then can adaptive execution split its hot keys."""
    return rows.groupBy(F.bitwise_not(key).alias("_key")).agg(*what).withColumn(key, F.bitwise_not("_key")).drop("_key")


def disclosures(docs: DataFrame, scanned: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(content, term, ratio): the terms of each text that disclose an entity in it, with the highest ratio; evidence is `support` different texts, 1 at least.

    Pairs aren't made of terms and entities that cannot reach SUPPORT or
    GENERALISE: with c <= df(entity), the ratio needs
    df(term) <= N^(1 - GENERALISE) * df(entity)^GENERALISE.
    """
    total = docs.count()
    held = scanned.filter(F.size("base") > 0)
    holders = held.select("content", F.explode("entities").alias("entity")).groupBy("entity", "content").agg(F.count(F.lit(1)).alias("copies"))
    df_entity = _totals(holders, "entity", F.sum("copies").alias("df_entity"), F.count(F.lit(1)).alias("support"))
    df_entity = df_entity.filter((F.col("support") >= support) & (F.col("df_entity") < total)).select("entity", "df_entity")
    most = F.lit(1 + 1e-9) * F.pow(F.lit(float(max(1, total))), F.lit(1 - GENERALISE)) * F.pow(F.col("df_entity").cast("double"), F.lit(GENERALISE))
    holders = materialise(holders.join(df_entity, "entity").withColumn("most", most), "pii-entities")
    bounds = holders.groupBy("content").agg(F.max("most").alias("most_here"))
    # copies of a text are one row from here on
    terms = held.select("content", F.explode("terms").alias("term")).distinct().join(bounds, "content")
    df_term = _totals(_word_counts(docs), "term", F.sum("n").alias("df_term")).filter(F.col("df_term") >= support)
    terms = materialise(terms.join(df_term, "term").filter(F.col("df_term") <= F.col("most_here")).select("content", "term", "df_term"), "pii-terms")
    pairs = terms.join(holders, "content").filter(F.col("df_term") <= F.col("most"))
    told = pairs.groupBy("entity", "term").agg(F.sum("copies").alias("c"), F.count(F.lit(1)).alias("support"), F.first("df_term").alias("df_term"), F.first("df_entity").alias("df_entity")).filter(F.col("support") >= support)
    ratio = F.log(F.col("c") * F.lit(float(total)) / (F.col("df_term").cast("double") * F.col("df_entity"))) / F.log(F.lit(float(total)) / F.col("df_entity"))
    told = materialise(told.select("entity", "term", ratio.alias("ratio")).filter(F.col("ratio") >= GENERALISE), "pii-told")
    return terms.select("content", "term").join(told, "term").join(holders.select("content", "entity"), ["content", "entity"]).groupBy("content", "term").agg(F.max("ratio").alias("ratio"))


def _marked(rows: DataFrame) -> DataFrame:
    """doc_id, content, base, more of rows that also have `told`, the text's disclosing terms and their kinds."""

    def make():
        def each(rows):
            out = {k: rows[k] for k in ("doc_id", "content", "base")} | {"more": []}
            for told, terms, packed in zip(rows["told"], rows["terms"], rows["places"], strict=True):
                known = {x["term"]: x["kind"] for x in told}
                kinds = np.array([known.get(t, -1) for t in terms], np.int64)
                p = placed(packed)
                p = p[kinds[p[:, 0]] >= 0]
                out["more"].append([{"start": a, "kind": k, "stop": b} for a, k, b in zip(p[:, 1].tolist(), kinds[p[:, 0]].tolist(), p[:, 2].tolist(), strict=True)])
            return out

        return each

    kind = rows.schema["doc_id"].dataType.simpleString()
    return per_document(rows, ["doc_id", "content", "base", "told", "terms", "places"], f"doc_id {kind}, content long, base {_BASE}, more {_BASE}", make)


def find(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """doc_id, content, base, more: one row per row of docs; base and more are arrays of spans (start, kind, stop).

    A term is told to disclose an entity by `support` different texts that hold
    both; 1 leaves no pair out.
    A null text is empty and has no spans. Rows that repeat id and text repeat
    the result; rows of one id with different texts are told apart by content,
    a hash of the text (0 without base spans). An empty table gives an empty
    result; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    scanned = materialise(_scan(docs), "pii-scan")
    told = disclosures(docs, scanned, support)
    kind = F.when(F.col("ratio") >= REMOVE, ALL_KINDS.index("termdel")).otherwise(ALL_KINDS.index("term"))
    told = told.groupBy("content").agg(F.collect_list(F.struct("term", kind.alias("kind"))).alias("told"))
    rows = scanned.filter(F.size("base") > 0).join(told, "content", "left")
    none = F.array().cast(_BASE)
    plain = rows.filter(F.col("told").isNull()).unionByName(scanned.filter(F.size("base") == 0), allowMissingColumns=True)
    return _marked(rows.filter(F.col("told").isNotNull())).unionByName(plain.select("doc_id", "content", "base", none.alias("more")))


def sanitise(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """docs with entities and disclosing terms replaced in `text` (and n_chars, where there is one, counted anew).

    Other columns are unchanged, whatever they are called. Null and empty texts
    stay as they are, repeated rows stay repeated (rows of one id with
    different texts are told apart), an empty table stays empty.
    """
    mark, at, which, spans = unused(docs, "_content", "_id", "_hash", "_more")
    found = find(docs, support).filter(F.size("more") > 0).select(F.col("doc_id").alias(at), F.col("content").alias(which), F.col("more").alias(spans)).distinct()

    @F.pandas_udf("long")
    def content(text):
        import pandas as pd

        out = pd.Series([term_of(t) if t and entities(t) else 0 for t in text], dtype="int64")
        release()
        return out

    @F.pandas_udf("string")
    def clean(text, more):
        import pandas as pd

        out = []
        for t, m in zip(text, more, strict=True):
            spans = entities(t) if t else []
            if m is not None:
                spans = spans + [generalised(t, x["start"], x["kind"], x["stop"]) for x in m]
            out.append(replaced(t, spans, LABELS) if spans else t)
        release()
        return pd.Series(out, dtype=object)

    rows = docs.withColumn(mark, content(F.col("text")))
    # most rows have no such terms: only ids and spans of those that do are joined
    rows = rows.join(found, rows["doc_id"].eqNullSafe(found[at]) & (rows[mark] == found[which]), "left")
    rows = rows.withColumn("text", clean(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*own(docs))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    out = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.array_sort(F.concat("base", "more"))
    kinds = F.lit(ALL_KINDS)
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["stop"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return out.select("doc_id", *map(count, range(4)), F.sha2(shown(F.array_sort("base")).cast("binary"), 256).alias("base_sha256"), shown(spans).alias("spans"))
