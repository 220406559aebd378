"""Token counts by looking up the lengths of pre-tokens in two tiers, on the map side only.

First tier: a compact table of the corpus's frequent pre-tokens with their
numbers of tokens, broadcast. It comes from frequency summaries of bounded size
that each task makes of all its texts and that are merged a few dozen at a
time, so pre-tokens themselves are never shuffled. Second tier: a cache in each
worker, filled by the tokenizer's library, many misses in one call. The table
decides how many misses there are, never what is counted.
"""

from __future__ import annotations

import itertools
import os
import struct
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise
from .common import per_document, release, slices

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Entries of a frequency summary, and so of the table: whatever makes up more than 1/SUMMARY of all pre-tokens is in it.
SUMMARY = 16_384
#: Summaries that are merged into one in one step.
FAN = 64
#: Pre-tokens of more characters are counted each time; shorter ones are kept in a worker's cache of up to twice CACHE entries.
LONGEST_KEPT, CACHE = 64, 200_000
#: Pre-tokens that are looked up in one step.
STEP = 200_000


def summarised(counts: dict[str, int], most: int = SUMMARY) -> dict[str, int]:
    """The most frequent entries, each count lowered by that of the first one left out: a summary of Misra and Gries, which can be merged."""
    if len(counts) <= most:
        return dict(counts)
    cut = sorted(counts.values(), reverse=True)[most]
    return {p: n - cut for p, n in counts.items() if n > cut}


def pack(counts: dict[str, int]) -> bytes:
    out = bytearray()
    for p, n in counts.items():
        b = p.encode()
        out += struct.pack("<HQ", len(b), n) + b
    return bytes(out)


def unpack(data: bytes) -> Iterator[tuple[str, int]]:
    at = 0
    while at < len(data):
        size, n = struct.unpack_from("<HQ", data, at)
        at += 10
        yield data[at : at + size].decode(), n
        at += size


class Lengths:
    """Numbers of tokens of whole texts under one tokenizer of the library, whose pre-tokenizer is byte-level with its pattern and no prefix space."""

    def __init__(self, definition: str, table: dict[str, int] | None = None):
        import json

        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        plan = json.loads(definition)
        pre = plan["pre_tokenizer"] or {}
        #: Whether pre-tokens can be counted one by one; otherwise the library gets whole texts.
        self.apart = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not plan.get("normalizer") and not plan.get("post_processor")
        self.apart = self.apart and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in plan["added_tokens"])
        plan["truncation"] = plan["padding"] = None
        self.library = Tokenizer.from_str(json.dumps(plan))
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(plan["added_tokens"], key=lambda t: -len(t["content"]))) or r"(?!)")
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.kinds = regex.compile(r"(\p{L})|(\p{N})|(\s)")
        self.table = table or {}
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.alike: set[str] = set()  # characters that both engines class alike
        self.odd: set[str] = set()

    def known(self, text: str) -> bool:
        """Whether this process's pattern splits the text as the library's does: the two may follow other versions of Unicode."""
        if text.isascii():
            return True
        fresh = set(text) - self.alike
        for c in fresh - self.odd:
            split = self.library.pre_tokenizer.pre_tokenize_str
            found = self.kinds.match(c)
            mine = found.lastindex if found else None
            theirs = 1 if len(split(f"a{c}a")) == 1 else 2 if len(split(f"1{c}1")) == 1 else None if len(split(f"!{c}!")) == 1 else 3
            (self.alike if mine == theirs else self.odd).add(c)
        return self.odd.isdisjoint(fresh)

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        """The text's pre-tokens, STEP or so at a time; special strings and texts that the pattern may split otherwise aside."""
        if not self.apart or not self.known(text):
            return
        for part in self.special.split(text) if self.special.search(text) else (text,):
            if len(part) <= STEP:
                yield self.pieces.findall(part)
            else:
                found = (m.group() for m in self.pieces.finditer(part))
                while some := list(itertools.islice(found, STEP)):
                    yield some

    def misses(self, pieces: Iterable[str]) -> dict[str, int]:
        """Lengths of pieces that aren't in the table, from the cache or the library."""
        out, ask = {}, []
        for p in set(pieces):
            n = self.young.get(p) or self.old.get(p)
            if n is None:
                ask.append(p)
            else:
                out[p] = n
        for p, e in zip(ask, self.library.encode_batch(ask, add_special_tokens=False) if ask else (), strict=True):
            out[p] = len(e.ids)
        for p, n in out.items():
            if len(p) <= LONGEST_KEPT:
                if len(self.young) >= CACHE:
                    self.young, self.old = {}, self.young
                self.young[p] = n
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """Numbers of tokens of the texts. Misses of several texts go to the library together."""
        total, open_, held = [0] * len(texts), [], 0
        get = self.table.get

        def settle():
            n = self.misses(p for _, pieces in open_ for p in pieces)
            for k, pieces in open_:
                total[k] += sum(map(n.__getitem__, pieces))
            open_.clear()

        for k, text in enumerate(texts):
            if not self.apart or not self.known(text):
                total[k] = self.whole(text)
                continue
            total[k] = len(self.special.findall(text))
            for pieces in self.pre_tokens(text):
                found = list(map(get, pieces))
                if None in found:
                    missing = [p for p, n in zip(pieces, found, strict=True) if n is None]
                    found = filter(None, found)
                    open_.append((k, missing))
                    held += len(missing)
                total[k] += sum(found)
                if held > STEP:
                    settle()
                    held = 0
        settle()
        return total


_lengths: dict[int, Lengths] = {}


def _worker(definition: str, packed: bytes) -> Lengths:
    """One set of lengths a worker process, which later tasks use again."""
    key = hash((definition, packed))
    if key not in _lengths:
        _lengths.clear()
        _lengths[key] = Lengths(definition, dict(unpack(packed)))
    return _lengths[key]


def frequent(docs: DataFrame, definition: str, most: int = SUMMARY) -> dict[str, int]:
    """Frequent pre-tokens of all texts with counts that are too low by 1/most of all pre-tokens at most.

    One summary a task, merged FAN at a time into one; each step is written,
    so that a lost executor costs that step. The result has up to `most`
    entries, whatever the size of docs.
    """

    def summarise(batches):
        lengths, held = _worker(definition, b""), Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    for pieces in lengths.pre_tokens(text or ""):
                        held.update(pieces)
                        if len(held) > 8 * most:
                            held = Counter(summarised(held, most))
        release()
        kept = summarised({p: n for p, n in held.items() if len(p) <= LONGEST_KEPT}, most)
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([pack(kept)], pa.binary())], names=["summary"])

    def merge(batches):
        held: Counter = Counter()
        for batch in batches:
            for data in batch.column("summary").to_pylist():
                held.update(dict(unpack(data)))
                held = Counter(summarised(held, most))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pack(held)], pa.binary())], names=["summary"])

    now = materialise(docs.select("text").mapInArrow(summarise, "summary binary"), "frequent")
    while (n := now.count()) > 1:
        fewer = materialise(now.repartition(-(-n // FAN)).mapInArrow(merge, "summary binary"), "frequent")
        discard(now)
        now = fewer
    row = now.first()
    discard(now)
    return dict(unpack(row[0])) if row else {}


def lookup_table(docs: DataFrame, definition: str, most: int = SUMMARY) -> dict[str, int]:
    """The broadcast tier: numbers of tokens of the frequent pre-tokens, SUMMARY at most."""
    pieces = sorted(frequent(docs, definition, most))
    return Lengths(definition).misses(pieces) if pieces else {}


def count_tokens(docs: DataFrame, definition: str, limit: int = LIMIT, most: int = SUMMARY) -> DataFrame:
    """doc_id, n_bytes, n_tokens long, over_limit boolean: one row per row of docs, over whole texts.

    `definition` is a tokenizer file of the tokenizers library as a string. The
    numbers are the library's own without added special tokens; a special
    string inside a text is the one token that the library makes of it. A null
    text is empty: no bytes, no tokens. Repeated rows give repeated rows, an
    empty table an empty result; other columns are ignored, whatever they are
    called. Nothing is shuffled but summaries of SUMMARY entries a task.
    """
    packed = docs.sparkSession.sparkContext.broadcast((definition, pack(lookup_table(docs, definition, most))))

    def make():
        lengths = _worker(*packed.value)

        def each(rows):
            texts = [t or "" for t in rows["text"]]
            n = lengths.counts(texts)
            return {"doc_id": rows["doc_id"], "n_bytes": [len(t) if t.isascii() else len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return per_document(docs, ["doc_id", "text"], f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", make)


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all whole texts of documents."""
    import public_tokenizers

    with open(public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        definition = f.read()
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), F.col("text")), definition)
