"""Token counts against the library itself."""

import random
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loamgraph.llm import tokencount

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def definition():
    with open(public_tokenizers.path(tokencount.VOCABULARY), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(definition):
    return Tokenizer.from_str(definition)


def expected(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


HARD = [
    "", " ", "  \n\n  x", "it's we'll I'd'", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|> ", "<|endoftext|", "é漢🙂 ٣٤ ² Ⅷ   x　", "\x1c\x1d \x85​﻿᠎",
    "tab\t\tx\r\n\r\n", "a" * 3000, " " * 3000, "?!" * 2000, "1234567890" * 50, "\U0001e030\U00016d40ꟜᲉ\U00010d40", "x́yͅ", "''s 'S 'LL",
]


def test_same_as_library(definition, library, monkeypatch):
    r = random.Random(5)
    pool = "ab  \n\t'sdltrve.,!?0123éß漢字🙂  ̀٠\x1c\x85"
    texts = HARD + ["".join(r.choice(pool) for _ in range(r.randrange(200))) for _ in range(300)]
    want = [expected(library, t) for t in texts]
    assert tokencount.Lengths(definition).counts(texts) == want
    assert tokencount.Lengths(definition, {"a": 1, " a": 1, "it": 1}).counts(texts) == want
    monkeypatch.setattr(tokencount, "STEP", 5)
    monkeypatch.setattr(tokencount, "CACHE", 3)
    small = tokencount.Lengths(definition)
    assert small.counts(texts) == want and len(small.young) <= 3 >= len(small.old)


def test_every_character(definition, library):
    """Characters that the two engines class apart are counted by the library."""
    lengths = tokencount.Lengths(definition)
    chars = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and (i < 0x3400 or i % 97 == 0 or 0x1E000 <= i < 0x1F000)]
    texts = [f"a{c}a 1{c}1 {c} !{c}{c}" for c in chars]
    assert lengths.counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_other_definitions(library, definition):
    import json

    plan = json.loads(definition)
    plan["pre_tokenizer"]["add_prefix_space"] = True
    other = json.dumps(plan)
    lib = Tokenizer.from_str(other)
    assert tokencount.Lengths(other).counts(HARD) == [expected(lib, t) for t in HARD]


def test_summaries():
    r = random.Random(6)
    seen = [min(int(r.paretovariate(0.7)), 5000) for _ in range(40_000)]
    parts, most = [seen[k::10] for k in range(10)], 50
    merged: dict[str, int] = {}
    for part in parts:
        one: dict[str, int] = {}
        for x in part:
            one[str(x)] = one.get(str(x), 0) + 1
        one = tokencount.summarised(one, most)
        assert dict(tokencount.unpack(tokencount.pack(one))) == one and len(one) <= most
        for p, n in one.items():
            merged[p] = merged.get(p, 0) + n
        merged = tokencount.summarised(merged, most)
    for x in set(seen):
        n = seen.count(x) if x < 100 else 0
        if n > len(seen) / most:
            assert n - len(seen) / most <= merged.get(str(x), 0) <= n


def test_rows(spark, definition, library, monkeypatch):
    rows = [(i, t, 1, "x") for i, t in enumerate(HARD)] + [(None, "no id", 1, "x"), (3, None, 1, "x"), (4, "twice", 1, "x"), (4, "twice", 1, "x"), (9, "long words " * 200_000, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_tokens int, summary string").repartition(7)
    monkeypatch.setattr(tokencount, "FAN", 2)
    got = sorted(map(tuple, tokencount.count_tokens(df, definition, limit=3).collect()), key=repr)
    want = [(i, len((t or "").encode()), expected(library, t)) for i, t, _, _ in rows]
    assert got == sorted(((*w, w[2] > 3) for w in want), key=repr)
    assert tokencount.frequent(df, definition)[" words"] == 200_000
    assert len(tokencount.frequent(df, definition, 5)) <= 5
    assert tokencount.count_tokens(df.limit(0), definition).count() == 0


def test_query(spark, library):
    want = {x.doc_id: x.text for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = tokencount.op11_token_counts(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        n = expected(library, want[r.doc_id])
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((want[r.doc_id] or "").encode()), n > 1024)
