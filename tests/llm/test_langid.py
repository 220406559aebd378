"""Language ID: held-out accuracy and odd inputs."""

import numpy as np
import pyspark.sql.functions as F

from loamgraph.llm import langid

EN = "the quick brown fox jumps over the lazy dog and the people of this town think that it was good "
DE = "der schnelle braune fuchs springt über den faulen hund und die leute der stadt denken dass es gut war "


def model():
    counts = np.stack([np.bincount(langid.trigrams(t * 20), minlength=langid.CELLS) for t in (DE, EN)])
    return langid.Model(["de", "en"], counts)


def test_single_and_mixed():
    m = model()
    assert m.predict(EN)[0] == "en" and m.predict(EN)[2] == ["en"]
    assert m.predict(DE)[0] == "de"
    lang, score, langs, shares = m.predict(EN * 3 + DE)
    assert lang == "en" and langs == ["en", "de"] and 0.6 < shares[0] < 0.9 and score < 1
    assert m.predict(EN * 2000)[0] == "en"


def test_em_matches_plain_em():
    m = model()
    p = m.p[langid.trigrams(EN + DE)]
    pi, _ = m.em(p, np.full(2, 0.5, np.float32), 200)
    own = np.full(2, 0.5)
    for _ in range(200):
        own = np.mean([own * row / (own * row).sum() for row in p.astype(float)], axis=0)
    assert np.allclose(pi, own, atol=0.02)


def test_set_against_brute_force(spark):
    """The registered model's sets against all sets of languages up to two, by a plain penalised likelihood."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = langid.fit(docs, F.lit(True))
    texts = [r.text for r in docs.filter("text is not null").orderBy("doc_id").limit(60).collect()]
    by_lang = {r.lang: r.text for r in docs.filter("lang is not null and text is not null").collect()}
    texts += [a + " " + b for a in by_lang.values() for b in by_lang.values() if a != b]
    found = []
    for t in texts:
        _, _, langs, shares = m.predict(t)
        p = m.p[langid.trigrams(t)].astype(float)
        price = langid.PENALTY * np.log(len(p) + 1)

        def value(a, b, p=p, price=price):
            pi = np.full(2, 0.5)
            for _ in range(100):
                w = p[:, [a, b]] * pi
                pi = (w / w.sum(axis=1, keepdims=True)).mean(axis=0)
            return np.log(p[:, [a, b]] @ pi).sum() - price

        single = {(k,): np.log(p[:, k]).sum() for k in range(len(m.langs))}
        double = {(a, b): value(a, b) for a in range(len(m.langs)) for b in range(a)}
        best = max(single | double, key=(single | double).get)
        if len(langs) <= 2:
            found.append(set(langs) == {m.langs[k] for k in best})
        assert abs(sum(shares) - 1) < 1e-3
    assert len(found) > 60 and np.mean(found) > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !? 3", "x"), (4, EN, "x"), (4, EN, "x"), (None, DE, "x"), (5, "漢字", None)], "doc_id long, text string, lang_pred string")
    rows = langid.identify(docs, model()).collect()
    got = sorted((r.doc_id or 0, r.lang_pred) for r in rows)
    assert got[:1] == [(0, "de")] and got[1:6] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")] and got[6][1] in ("de", "en")
    assert {r.lang_pred for r in langid.identify(docs, langid.Model([], np.zeros((0, langid.CELLS)))).collect()} == {"und"}
    kept = langid.keep_identified(docs, model())
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) in ([0, 4, 4], [0, 4, 4, 5])
    assert langid.fit(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).langs == []


def test_held_out(spark):
    rows = langid.op1_language_id(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
