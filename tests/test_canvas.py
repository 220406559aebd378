"""Boxes of any size, search by trigrams, and checks of diagrams."""

import random

import pytest
from pyspark.sql import functions as F

from loamgraph.operators import canvas

BOX = "canvas string, ord int, id string, type string, x double, y double, w double, h double"


def meet(a, b):
    return a[4] < b[4] + b[6] and b[4] < a[4] + a[6] and a[5] < b[5] + b[7] and b[5] < a[5] + a[7]


@pytest.mark.parametrize("cell", [64.0, 3.0])
def test_sizes(spark, cell):
    """From specks to a box of ten million by ten million, negative places, empty sizes, shared edges: as by comparing all pairs."""
    r = random.Random(13)
    rows = []
    for i in range(400):
        size = 10 ** r.uniform(-2, 6)
        place = lambda size=size: r.choice([r.uniform(-3, 3) * 10 ** r.uniform(0, 5), r.randrange(-4, 4) * 64.0])
        rows.append((f"c{i % 3}", i, f"b{i}", r.choice(["group", "text", "file"]), place(), place(), r.choice([size, 64.0, 0.0]), r.choice([size, 128.0])))
    rows += [("c0", 900, "huge", "text", -5e6, -5e6, 1e7, 1e7), ("c0", 901, "all", "group", -5e6, -5e6, 1e7, 1e7), ("c9", 902, "alone", "text", 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, BOX)
    boxes, groups = [b for b in rows if b[3] != "group"], [b for b in rows if b[3] == "group"]
    want = sorted((a[0], a[2], b[2]) for a in boxes for b in boxes if a[0] == b[0] and a[1] < b[1] and meet(a, b))
    assert sorted(map(tuple, canvas.overlaps(df, cell).collect())) == want and len(want) > 300
    inside = lambda b, g: b[4] >= g[4] and b[5] >= g[5] and b[4] + b[6] <= g[4] + g[6] and b[5] + b[7] <= g[5] + g[7]
    want = sorted((b[0], b[2], g[2]) for b in boxes for g in groups if b[0] == g[0] and meet(b, g) and not inside(b, g))
    assert sorted(map(tuple, canvas.straddles(df, cell).collect())) == want and len(want) > 100
    around = lambda b, g: g[4] <= b[4] + b[6] / 2 <= g[4] + g[6] and g[5] <= b[5] + b[7] / 2 <= g[5] + g[7]
    want = sorted(((b[0], b[2], min(((g[6] * g[7], g[1], g[2]) for g in groups if g[0] == b[0] and around(b, g)), default=(None,) * 3)[2]) for b in boxes), key=repr)
    assert sorted(map(tuple, canvas.containing_group(df, cell).collect()), key=repr) == want
    # rows are bounded by levels, whatever the sizes are
    named = canvas._named(df, "true", "s").withColumn("level", canvas._level("s_w", "s_h", cell))
    levels = named.select("canvas", "level").distinct().count()
    assert canvas._in_cells(named, "s_x", "s_y", "s_w", "s_h", cell).count() <= 9 * len(rows)
    assert canvas._in_cells(canvas._at_levels(named.drop("level"), named, canvas._level("s_w", "s_h", cell)), "s_x", "s_y", "s_w", "s_h", cell).count() <= 9 * len(rows) * levels


def test_large_groups_meet_what_is_left(spark, monkeypatch):
    """Centres in a small group never meet the many large ones around it; equal groups and centres are one."""
    groups = [("c", i, f"g{i}", "group", -float(i), -float(i), 2.0 * i + 1, 2.0 * i + 1) for i in range(1, 401)]
    groups += [("c", 500 + i, f"again{i}", "group", -float(i), -float(i), 2.0 * i + 1, 2.0 * i + 1) for i in range(1, 401)]
    boxes = [("c", 1000 + i, f"b{i}", "text", float(i % 30), 0.0, 0.0, 0.0) for i in range(300)] + [("d", 2000, "alone", "text", 0.0, 0.0, 1.0, 1.0)]
    tried, plain = [], canvas._at_levels
    monkeypatch.setattr(canvas, "_at_levels", lambda rows, of, own: (tried.append((rows.count(), of.count())), plain(rows, of, own))[1])
    got = {r.id: r.group_id for r in canvas.containing_group(spark.createDataFrame(groups + boxes, BOX)).collect()}
    assert got == {f"b{i}": f"g{max(1, i % 30 - 1)}" for i in range(300)} | {"alone": None}
    assert tried == [(31, 64), (1, 128), (1, 208)]


FIELDS = "canvas string, ord int, id string, type string, text string, file string, subpath string, url string, label string"


def test_search(spark, tmp_path):
    r = random.Random(14)
    word = lambda: "".join(r.choice("abAB .é") for _ in range(r.randrange(12)))
    rows = [(f"c{i % 5}", i, f"n{i}", r.choice(["text", "file", "link", "group"]), *[r.choice([None, word(), word() + ".canvas"]) for _ in range(2)], r.choice([None, "#x", "#"]), r.choice([None, word()]), r.choice([None, word()])) for i in range(300)]
    field = {"text": 4, "file": 5, "link": 7, "group": 8}
    low = canvas.ascii_lower
    weak = lambda x: x[3] == "file" and x[5] and low(x[5]).endswith(".canvas") and x[6] and x[6].startswith("#") and len(x[6]) > 1
    rows_df = canvas.entries(spark.createDataFrame(rows, FIELDS))
    index = canvas.SearchIndex.build(rows_df, str(tmp_path / "index"), 4)
    for words in ["aba", "AB", "a", "bb.", "abab", ".canvas", "É", "é a", "zzz", "aaaaaaaa", "b.canvas", "a" * 40, ""]:
        want = sorted((x[0], x[1], x[2]) for x in rows if words and not weak(x) and low(words) in low(x[field[x[3]]] or ""))
        for most in (None, 3):
            for found in (canvas.search(rows_df, words, most), index.search(words, most)):
                assert [(h.canvas, h.ord, h.id) for h in found.collect()] == want[:most], words
        if len(words) >= 3:
            assert index.candidates(words).count() < 200 or words == ".canvas"
    plan = index._of("grams", "canvas string, ord int, gram string, folder int", ["aba"])._jdf.queryExecution().executedPlan().toString()
    assert "folder" in plan.split("PartitionFilters")[1].split("]")[0], plan
    assert canvas.SearchIndex.build(rows_df.limit(0), str(tmp_path / "none"), 4).search("aba").isEmpty()


def test_more_checks(spark):
    nodes = spark.createDataFrame([("/m/a.canvas", 0, "t", "text", 0.0, 0.0, 1.0, 1.0, None, "  ", None, None, None, None), ("/m/a.canvas", 1, "f", "file", 9.0, 0.0, 1.0, 1.0, None, None, "gone.canvas", None, None, None)], f"{BOX}, color string, text string, file string, subpath string, url string, label string")
    edges = spark.createDataFrame([("/m/a.canvas", 0, None, "t", "f", None, None, None, None, "")], "canvas string, ord int, id string, from_node string, to_node string, from_side string, to_side string, from_end string, to_end string, label string")
    got = {(x.severity, x.message) for x in canvas.validate(nodes, edges, "/m/a.canvas").select("severity", F.col("message")).collect()}
    assert got == {("warning", "the text is empty"), ("warning", "a connection without a label"), ("error", "a connection without an id"), ("error", "link to a missing diagram")}
