"""Personal data: base spans against plain regular expressions, disclosure against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from loamgraph.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(t):
    digits = lambda m: re.sub(r"\D", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def test_base_spans():
    r = random.Random(3)
    pool = ["0", "1", "9", "25", "4111111111111111", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "é"]
    for _ in range(5000):
        t = "".join(r.choice(pool) for _ in range(r.randrange(1, 40)))
        assert sorted(pii.entities(t)) == plain(t), t


def test_long_texts_stay_linear():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" + "(" * 300_000, "@" * 300_000, "1 " * 150_000):
        pii.entities(t)


def test_disclosure(spark):
    texts = {}
    for i in range(60):
        texts[i] = f"plain filler words number{i} about nothing at all w{chr(97 + i % 26)} end"
    for i in range(60, 66):
        texts[i] = f"zebra{'abcdef'[i - 60]} says zanzibar reach ann.lee@mail.example.com today or not {'abcdef'[i - 60] * 5}"
    docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()] + [(70, None, 1), (71, "", 1), (60, texts[60], 1)], "doc_id long, text string, content int")
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    assert len(rows) == 68
    words = {texts[60][s.start : s.stop] for s in rows[60].more}
    # brute force over the rows: which terms near the address pass the thresholds
    n, e = 69, [t for t in [*texts.values(), texts[60]] if "@" in t]
    want = set()
    for w in set(re.findall(r"[^\W_]+", texts[60].replace("ann.lee@mail.example.com", " "))):
        near = lambda t: w in re.findall(r"[^\W_]+", t.split("ann.lee")[0])[-6:] + re.findall(r"[^\W_]+", t.split(".com")[1])[:6]  # noqa: B023, E731
        c = len({t for t in e if near(t)})
        df = sum(w in re.findall(r"[^\W_]+", t.lower()) for t in [*texts.values(), texts[60]])
        if c >= pii.SUPPORT and math.log(c * n / (df * len(e))) / math.log(n / len(e)) >= pii.GENERALISE:
            want.add(w)
    assert words == want and "zanzibar" in want
    assert rows[70].base == [] and rows[71].more == []
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "[EMAIL]" in clean[60] and "zanzibar" not in clean[60] and clean[0] == texts[0] and clean[70] is None


def test_copies_and_boilerplate(spark):
    texts = [f"plain filler about nothing {'ab'[i % 2]}" for i in range(1000)]
    texts += [f"{w} asks zanzibar at ann.lee@mail.example.com" for w in ("one", "two", "three", "four", "five") for _ in range(40)]
    texts += [f"story {i} of its own " + "and so on " * 5 + "contact quuxhelp at desk@corp.example.com" for i in range(50)]
    texts += ["lonely xylophone at only.copies@mail.example.com"] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    # a term that always stands with the entity discloses it, however often the texts are copied or the line is repeated
    assert not any("zanzibar" in clean[i] for i in range(1000, 1200)) and not any("quuxhelp" in clean[i] for i in range(1200, 1250))
    # copies of one text are no evidence
    assert all("xylophone" in clean[i] for i in range(1250, 1280))


def test_whole_texts(spark):
    texts = [f"plain filler about nothing {'ab'[i % 2]}" for i in range(1000)]
    long = "verylongwordmadeofthirtyfourletters"
    far = " ".join(["and so on"] * 10)
    texts += [f"Zanzibar {'abcdef'[i]} {far} jsmith84 4711 {' ' * 300} {long} {long} {long} {long} {long} ann.lee@mail.example.com {far} zanzibar {i} 😀 ZANZIBAR" for i in range(6)]
    texts += ["zanzibar without it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    assert len(rows) == len(texts) and rows[1006].more == []
    for i in range(1000, 1006):
        shown = sorted(texts[i][s.start : s.stop] for s in rows[i].more)
        assert shown == sorted(["Zanzibar", "zanzibar", "ZANZIBAR", "jsmith84", "4711", *[long] * 5, *["and", "so", "on"] * 20])


def test_generalised():
    labels = [pii.LABELS[pii.generalised("Anna x9 4711 word", a, 4, b)[1]] for a, b in ((0, 4), (5, 7), (8, 12), (13, 17))]
    assert labels == ["[NAME]", "[CODE]", "[NUMBER]", "[WORD]"] and pii.generalised("Anna", 0, 5, 4) == (0, 5, 4)


def test_groups_of_entities(spark):
    # every address occurs once; their domain is what the term discloses
    texts = [f"plain filler about nothing {'ab'[i % 2]}" for i in range(1000)] + [f"story {i} by Zanzibar staff: u{i}@zan.example.org" for i in range(8)]
    docs = spark.createDataFrame([(i, t, "x", "y", 3) for i, t in enumerate(texts)], "doc_id long, text string, _content string, _ID string, n_chars long")
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert all("Zanzibar" not in rows[i].text and "[EMAIL]" in rows[i].text and rows[i]._content == "x" and rows[i]._ID == "y" and rows[i].n_chars == len(rows[i].text) for i in range(1000, 1008))


def test_places():
    r = random.Random(5)
    for _ in range(500):
        t = "".join(r.choice(["ab", "AB", " ", "7", "İ", ".", "@", "c.de", "x@y.z", "  "]) for _ in range(r.randrange(30)))
        spans = pii.entities(t)
        want = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t) if not any(a < m.end() and m.start() < b for a, _, b in spans)]
        assert list(pii.words(t, spans)) == want
        terms, packed = pii.places(t, spans)
        assert [(terms[k], a, b) for k, a, b in pii.placed(packed).tolist()] == [(pii.term_of(w), a, b) for w, a, b in want]


def test_query_digest(spark):
    from loamgraph.llm.common import table

    rows = {r.doc_id: r for r in pii.op2_pii(spark, "/root/testdata/sf0.001").collect()}
    for d in table(spark, "/root/testdata/sf0.001", "documents").collect():
        want = plain(d.text or "")
        shown = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert rows[d.doc_id].base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert set(filter(None, shown.split(","))) <= set(rows[d.doc_id].spans.split(","))
        assert rows[d.doc_id].n_email == sum(k == 0 for _, k, _ in want)


def brute(docs, support):
    """{(id, text): spans} by the rule as it is told: all counts of documents, whole texts, values and their groups, evidence of different texts."""
    found = {(i, t): pii.entities(t) for i, t in docs}
    entities = {k: {e for a, kind, b in spans for e in pii.entities_of(k[1][a:b], kind)} for k, spans in found.items()}
    terms = {k: {w for w, _, _ in pii.words(k[1], spans)} for k, spans in found.items()}
    n, df_t, df_e, both = len(docs), Counter(), Counter(), Counter()
    texts_e, texts_both = defaultdict(set), defaultdict(set)
    for k in docs:
        df_t.update(terms[k])
        df_e.update(entities[k])
        for e in entities[k]:
            texts_e[e].add(k[1])
            for w in terms[k]:
                both[e, w] += 1
                texts_both[e, w].add(k[1])
    told = defaultdict(float)
    for (e, w), c in both.items():
        if len(texts_e[e]) >= support and len(texts_both[e, w]) >= support and df_t[w] >= support and df_e[e] < n:
            told[e, w] = math.log(c * n / (df_t[w] * df_e[e])) / math.log(n / df_e[e])
    out = {}
    for k, spans in found.items():
        ratio = {w: max((told.get((e, w), 0.0) for e in entities[k]), default=0.0) for w in terms[k]}
        out[k] = sorted((a, 5 if ratio[w] >= pii.REMOVE else 4, b) for w, a, b in pii.words(k[1], spans) if ratio[w] >= pii.GENERALISE)
    return out


@pytest.mark.parametrize("support", [1, 3])
def test_against_brute_force(spark, support):
    r = random.Random(21)
    people = [(f"u{i}@d{i % 5}.example.org", f"name{i}", f"place{i % 5}") for i in range(12)]
    words = ["the"] * 30 + [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(257):
        t = [r.choice(words) for _ in range(r.randrange(3, 12))]
        for mail, name, place in r.sample(people, r.choice([0, 0, 0, 0, 1, 1, 2])):
            t += [x for x, p in ((mail, 1), (name, 0.9), (place.upper(), 0.8), ("+49 30 1234567", 0.1), ("10.1.2.3", 0.1)) if r.random() < p]
        if r.random() < 0.2:  # names stand elsewhere as well
            t.append(f"name{r.randrange(12)}")
        r.shuffle(t)
        texts.append(" ".join(t))
    texts += texts[:30] * 2  # copies are documents, and no evidence of their own
    docs = list(enumerate(texts))
    want = brute(docs, support)
    got = pii.find(spark.createDataFrame(docs, "doc_id long, text string"), support).collect()
    assert {(x.doc_id, texts[x.doc_id]): sorted(map(tuple, x.more)) for x in got} == want
    assert sum(map(bool, want.values())) > 40 and len({k for v in want.values() for _, k, _ in v}) == 2


def test_empty(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
