"""The pipeline against a plain version on a small table."""

from collections import Counter

import public_tokenizers as P
import pyspark.sql.functions as F
import tiktoken

import corpus_pipeline
from loamgraph.llm import bpe, langid, mixing, pii

from .test_shingles import brute

SF = "/root/testdata/sf0.001"


def test_against_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**7, "123 456 !!", "en", "src1", 10), (10**7 + 1, None, "en", None, 0)], docs.schema)
    docs = docs.unionByName(extra)
    after = [docs]
    for _, stage in corpus_pipeline.STAGES:
        after.append(stage(spark, after[-1], SF).persist())
    rows = {r.doc_id: r for r in docs.collect()}
    # languages
    model = langid.fit(docs, F.lit(True))
    want = {i for i, r in rows.items() if (p := model.predict(r.text))[0] != "und" and p[3][0] >= langid.KEEP}
    assert {r.doc_id for r in after[1].collect()} == want and not {10**7, 10**7 + 1} & want and len(want) > 150
    # near-duplicates
    want = {i for i, _, c in brute([(i, rows[i].text) for i in want]) if i == c}
    assert {r.doc_id for r in after[2].collect()} == want
    # personal data: no base span is left, texts without one keep all but disclosing terms
    clean = {r.doc_id: r for r in after[3].collect()}
    assert clean.keys() == want and not any(pii.entities(r.text) for r in clean.values())
    spans = {r.doc_id: len(r.more) for r in pii.find(after[2]).collect()}
    for i, r in clean.items():
        assert r.n_chars == len(r.text)
        assert (r.text == rows[i].text) == (not pii.entities(rows[i].text) and not spans[i])
    # mix
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(after[3]).collect()}
    copies = Counter(r.doc_id for r in after[4].collect())
    assert copies == {i: n for i, (t, z) in taken.items() if z and (n := int(t / z + 0.5))} and max(copies.values()) <= 3
    assert all(a.columns == docs.columns for a in after[1:5])
    # token ids
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(bpe.VOCABULARY)), special_tokens={})
    out = after[5].collect()
    assert Counter(r.doc_id for r in out) == copies
    assert all(list(r.ids) == enc.encode_ordinary(clean[r.doc_id].text) and r.n_tokens == len(r.ids) for r in out)
    for a in after[1:]:
        a.unpersist()


def test_run_and_empty(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "ids", "n_tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_odd_tables(spark):
    """Repeated rows, rows of one id, nulls in every column, a very long text, and further columns with names that stages use: defined, and every stage keeps the columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = docs.filter("lang = 'en'").limit(40).agg(F.array_join(F.collect_list("text"), " ").alias("t")).first().t * 12
    some = docs.limit(60)
    first = some.first()
    odd = [(10**7, long, "en", "src1", len(long)), (10**7 + 1, None, None, None, None), (None, "Mail me at jo@example.org or else, please, as soon as you can today.", "en", None, 7), (10**7 + 2, "", "en", "src1", 0), tuple(first), tuple(first), (first.doc_id, "another text of words that stand under one id with the first one", "en", "src2", 3)]
    more = ["id", "base", "_words", "_rows", "_id", "_content", "_more", "size", "taken", "source_size", "lang_pred", "n_", "Rep"]
    table = some.unionByName(spark.createDataFrame(odd, docs.schema)).select("*", *[F.lit(c).alias(c) for c in more])
    now = table
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).persist()
        assert now.columns == table.columns and all(r[c] == c for r in now.limit(3).collect() for c in more)
        counts.append(now.count())
    assert counts[0] >= counts[1] > 10 and counts[1] == counts[2]
    out = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert out.columns == ["doc_id", "ids", "n_tokens"] and out.count() == counts[3]
