"""Byte-level BPE against tiktoken and a round trip."""

import gc
import random
import tracemalloc

import public_tokenizers as P
import pytest
import tiktoken

from loamgraph.llm import bpe

CASES = ["", " ", "a", "aaaaaaaaaaaaaaaaa" * 50, "  \n\n\t x", "don't they'll I'VE", "Ünïcödé 漢字 🙂🙂 \u0000�", "1234567890" * 30, "=" * 3000, "ab" * 4000, "\\### <|endoftext|>"]


@pytest.fixture(scope="module")
def both():
    ranks = bpe.read_ranks(P.path(bpe.VOCABULARY))
    return bpe.Codec(ranks, P.PATTERN), tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("text", CASES)
def test_cases(both, text):
    own, ref = both
    ids = own.encode(text).tolist()
    assert ids == ref.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_random(both):
    own, ref = both
    r = random.Random(5)
    for _ in range(400):
        kind = r.randrange(4)
        pool = ["abcdefghij", "aàâbéèêç ", "".join(chr(r.randrange(32, 0x3000)) for _ in range(30)), "xyzXYZ09.,-_ \n"][kind]
        text = "".join(r.choice(pool) for _ in range(r.randrange(1, 400)))
        assert own.encode(text).tolist() == ref.encode_ordinary(text)


def test_compatible_pairs(both):
    own, _ = both
    r = random.Random(1)
    for _ in range(20000):
        a, b = r.randrange(len(own.ranks)), r.randrange(len(own.ranks))
        assert own.compatible(a, b) == (own.merged(own.token[a] + own.token[b]) == [a, b])


def test_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "hello world", 9), (3, "hello world", 9), (None, "x", 9)], "doc_id long, text string, n_tokens int")
    path = P.path(bpe.VOCABULARY)
    rows = bpe.digests(docs, path, P.PATTERN).collect()
    n = len(tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={}).encode_ordinary("hello world"))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in rows) == [(False, 1, 0), (False, 2, 0), (False, 3, n), (False, 3, n), (True, 0, 1)]
    back = bpe.decode_documents(bpe.encode_documents(docs, path, P.PATTERN), path).collect()
    assert sorted(bytes(r.data) for r in back) == [b"", b"", b"hello world", b"hello world", b"x"]
    assert bpe.digests(docs.limit(0), path, P.PATTERN).count() == 0


def test_workers_drop_the_codec(spark):
    """A codec and its memos stay in a worker for tasks that use them, and go when another task starts there."""
    from loamgraph.llm import common

    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string").repartition(4)

    def held():
        return lambda rows: {"n": [sum(isinstance(x, bpe.Codec) for x in gc.get_objects()) for _ in rows["text"]]}

    for _ in range(2):
        assert bpe.encode_documents(docs, P.path(bpe.VOCABULARY), P.PATTERN).count() == 40
    assert common.per_document(docs, ["text"], "n int", held).agg({"n": "max"}).first()[0] == 0
    a, b = common.kept("a", list), common.kept("a", list)
    assert a is b
    with common.starting():
        assert common.kept("a", list) is a
    with common.starting():
        pass
    assert common.kept("a", list) is not a


def test_memory_of_hashing():
    """Words of a slice are hashed with some tens of megabytes, however long the slice is."""
    from loamgraph.llm import common

    texts = ["lorem ipsum dolor sit amet " * 4000] * 70
    tracemalloc.start()
    h, sizes = common.hashed_words(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes.tolist() == [20_000] * 70 and len(set(h.tolist())) == 5
    assert peak - 2 * h.nbytes < 80e6, peak
