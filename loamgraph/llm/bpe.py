"""Byte-level BPE by backtracking over longest matches.

The bytes of a piece are mapped to Latin-1, so that pyahocorasick's string
automaton sees one character a byte. From each position the longest token is
tried first, then its shorter prefixes that are tokens; a token may follow
another only if BPE leaves the two as they are when it gets their bytes alone.
A sequence in which all neighbours are compatible in that sense is the one that
merging by rank gives. Compatibility of a pair is memoised, and so is each
position from which no sequence reaches the end, which bounds the work on a
piece by its length times the length of the longest token.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, per_document

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Entries of a memo's younger half: when it is full it becomes the older half, and what was in that one and isn't used goes. It only saves time.
MEMO = 200_000
LONGEST_KEPT = 64
NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes and decodes with one vocabulary and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.shown = {i: str(i) for i in ranks.values()}
        self.pieces = regex.compile(pattern)
        self.tree = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.tree.add_word(b.decode("latin-1"), i)
        self.tree.make_automaton()
        # each memo has a younger and an older half
        self.fits: dict[tuple[int, int], bool] = {}
        self.old_fits: dict[tuple[int, int], bool] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.shorter: dict[int, int] = {}
        self.firsts: dict[tuple[int, int], int] = {}
        self.old_firsts: dict[tuple[int, int], int] = {}
        self.memo: dict[str, bytes] = {}
        self.old_memo: dict[str, bytes] = {}

    def merged(self, data: bytes, trace: list | None = None) -> list[int]:
        """Plain merging by rank, for the bytes of one or two tokens; trace gets the pair of each merge."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(x + y, NEVER) for x, y in zip(parts, parts[1:], strict=False)]
        while pairs and (best := min(pairs)) < NEVER:
            i = pairs.index(best)
            if trace is not None:
                trace.append((parts[i], parts[i + 1]))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
        return [ranks[x] for x in parts]

    def last_merge(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None if merging its bytes doesn't give it, or makes tokens of higher rank on the way."""
        if token not in self.parts:
            trace: list[tuple[bytes, bytes]] = []
            whole = self.merged(self.token[token], trace) == [token]
            odd = not trace or any(self.ranks[x + y] > token for x, y in trace)
            self.parts[token] = None if odd or not whole else tuple(self.ranks[x] for x in trace[-1])
        return self.parts[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens as they are, given their bytes alone.

        Goes back in time over the tokens that touch the boundary: before the
        later of the two was made, its part at the boundary stood there. A
        merge across the boundary that comes before that (among equal ranks:
        further left) would have been made instead.
        """
        key = (left, right)
        found = self.fits.get(key)
        if found is not None:
            return found
        if len(self.fits) > MEMO:
            self.fits, self.old_fits = {}, self.fits
        token, rank, a, b, limit, found = self.token, self.ranks.get, left, right, NEVER, self.old_fits.get(key)
        while found is None:
            across = rank(token[a] + token[b])
            if across is not None and across < limit:
                found = False
                break
            made_a, made_b = a if len(token[a]) > 1 else -1, b if len(token[b]) > 1 else -1
            if made_a < 0 and made_b < 0:
                found = True
            elif made_a > made_b:
                pair = self.last_merge(a)
                limit, a = (a, pair[1]) if pair else (a, None)
            else:
                pair = self.last_merge(b)
                limit, b = (b + 1, pair[0]) if pair else (b, None)
            if a is None or b is None:  # a token that is not made in the order of ranks
                found = self.merged(token[left] + token[right]) == [left, right]
        self.fits[key] = found
        return found

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 if there is none."""
        found = self.shorter.get(token)
        if found is None:
            b = self.token[token]
            found = self.shorter[token] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), -1)
        return found

    def first_fit(self, before: int, token: int) -> int:
        """Of the token and its shorter prefixes that are tokens, the longest that may follow `before`; -1 if none may."""
        key, shorter = (before, token), self.shorter
        known = self.old_firsts.get(key)
        if known is not None:
            token = known
        else:
            while token >= 0 and not self.compatible(before, token):
                token = shorter[token] if token in shorter else self.prefix(token)
        if len(self.firsts) > MEMO:
            self.firsts, self.old_firsts = {}, self.firsts
        self.firsts[key] = token
        return token

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece: the longest match at each place, or a shorter one where that doesn't fit what stands before it."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        text, end = data.decode("latin-1"), len(data)
        size, longest, firsts = self.size, self.tree.iter_long, self.firsts.get
        match: dict[int, int] = {}  # longest tokens by place, as far as they have been asked for
        here = 0
        for stop, token in longest(text):
            match[here] = token
            here = stop + 1
        dead: set[tuple[int, int]] = set()  # (place, token before it) from which the end is out of reach
        token = match[0]
        out, at, before = [token], size[token], token
        while at < end:
            token = match.get(at)
            if token is None:
                here = at
                for stop, found in longest(text, at):
                    if here in match:  # the same tokens follow as before
                        break
                    match[here] = found
                    here = stop + 1
                token = match[at]
            fit = firsts((before, token))
            token = self.first_fit(before, token) if fit is None else fit
            while token < 0 or (dead and (at + size[token], token) in dead):
                if token < 0:  # back to the token before, and on to its next shorter prefix
                    dead.add((at, before))
                    token = out.pop()
                    at -= size[token]
                    before = out[-1] if out else -1
                token = self.prefix(token)
                if token >= 0 and before >= 0:
                    token = self.first_fit(before, token)
            out.append(token)
            at += size[token]
            before = token
        return out

    def packed(self, piece: str) -> bytes:
        """Ids of a piece, four bytes each, by way of the memo."""
        got = self.old_memo.get(piece)
        if got is None:
            got = array("i", self.piece(piece.encode("utf-8", "replace"))).tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self.memo) > MEMO:
                self.memo, self.old_memo = {}, self.memo
            self.memo[piece] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        """Ids of the text."""
        get, packed = self.memo.get, self.packed  # an outdated younger half costs calls, no more
        return np.frombuffer(b"".join([get(p) or packed(p) for p in self.pieces.findall(text)]), np.int32)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def codec(ranks: dict[bytes, int], pattern: str) -> Codec:
    """One codec a worker process: Python workers are used again by later tasks."""
    return kept(("codec", hash(frozenset(ranks.items())), pattern), lambda: Codec(ranks, pattern))


def _shared(docs: DataFrame, path: str):
    """The vocabulary, whose size the file fixes, sent to the executors once."""
    return docs.sparkSession.sparkContext.broadcast(read_ranks(path))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>, n_tokens long: one row per row of docs, over whole texts.

    A null text is empty and gives no ids. Repeated rows give repeated rows,
    an empty table an empty result; other columns are ignored.
    """
    ranks = _shared(docs, path)

    def make():
        c = codec(ranks.value, pattern)

        def each(rows):
            ids = [c.encode(t or "") for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "ids": ids, "n_tokens": [len(x) for x in ids]}

        return each

    return per_document(docs, ["doc_id", "text"], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_tokens long", make)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, data binary: the bytes behind column ids of encoded, one row per row.

    Null ids are empty. Repeated rows give repeated rows, an empty table an
    empty result; other columns are ignored. An id that the vocabulary doesn't
    have is an error that names it.
    """
    ranks = _shared(encoded, path)

    def make():
        token = {i: b for b, i in ranks.value.items()}

        def each(rows):
            data = []
            for doc, ids in zip(rows["doc_id"], rows["ids"], strict=True):
                try:
                    data.append(b"".join([token[i] for i in ids or ()]))
                except KeyError as e:
                    raise ValueError(f"document {doc} has id {e.args[0]}, which the vocabulary doesn't have") from None
            return {"doc_id": rows["doc_id"], "data": data}

        return each

    flat = encoded.select("doc_id", "ids")
    return per_document(flat.withColumn("_size", F.lit("")), ["doc_id", "ids", "_size"], f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, data binary", make)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 in one pass, so that ids never leave the worker."""
    ranks = _shared(docs, path)

    def make():
        c = codec(ranks.value, pattern)

        def each(rows):
            out = {"doc_id": rows["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for t in rows["text"]:
                ids = c.encode(t or "").tolist()
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(c.shown.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(c.decode(ids)).hexdigest())
            return out

        return each

    return per_document(docs, ["doc_id", "text"], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
