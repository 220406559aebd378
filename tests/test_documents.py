"""Documents kept beside a project: read, changed and written."""

import json

from loamgraph.functions.cost import CostParams
from loamgraph.operators import canvas
from loamgraph.plans import export
from loamgraph.sources import documents, gitlog


def test_notes(spark, tmp_path):
    text = "# Notes\n\nfree text\n"
    text, a = documents.add_note(text, "first\nline", path="src/a.c", line=7, hash_="ab", at="2026-01-01T00:00:00Z")
    text, b = documents.add_note(text, "about two", group_paths=["a.c", "b.c"], at="2026-01-02T00:00:00Z")
    assert (a, b) == ("n1", "g2") and text.startswith("# Notes\n\nfree text\n")
    text = documents.update_note(text, "n1", "changed", at="2026-02-01T00:00:00Z")
    (tmp_path / "n.md").write_text(text)
    got = {r.id: r for r in documents.read_notes(spark, str(tmp_path / "n.md")).collect()}
    assert (got["n1"].path, got["n1"].line, got["n1"].hash, got["n1"].body, got["n1"].updated) == ("src/a.c", 7, "ab", "changed", "2026-02-01T00:00:00Z")
    assert got["g2"].group_paths == ["a.c", "b.c"] and got["g2"].line is None
    left = documents.note_blocks(documents.delete_note(text, "n1"))
    assert [n["id"] for *_, n in left] == ["g2"]


def test_project():
    p = documents.parse_project(json.dumps({"root": "r.canvas", "title": "T", "cost": {"salary": -1, "ai_share": 0.5, "mode": "embedded", "overhead": 0, "token_price": "x"}}))
    assert p.cost == CostParams(ai_share=0.5, mode="embedded")
    assert documents.parse_project(documents.project_text(p)) == p


CANVAS = {
    "/m/root.canvas": {"nodes": [{"id": "g", "type": "group", "label": "All", "x": 0, "y": 0, "width": 400, "height": 400}, {"id": "a", "type": "text", "text": "# Api\nserves [[sub.canvas|it]] and [[/src/api]]", "x": 10, "y": 10, "width": 50, "height": 50}, {"id": "b", "text": "Db", "x": 20, "y": 20}, {"type": "file", "file": "sub.canvas", "subpath": "#s", "x": 900, "y": 0}], "edges": [{"id": "e", "fromNode": "a", "toNode": "b", "label": "reads"}, {"id": "x", "fromNode": "a", "toNode": "zz"}]},
    "/m/sub.canvas": {"nodes": [{"id": "s", "type": "text", "text": "Sub [[root.canvas]]"}]},
    "/m/lost.canvas": {"nodes": []},
}


def test_diagrams(spark):
    texts = spark.createDataFrame([(k, json.dumps(v)) for k, v in CANVAS.items()], "canvas string, text string")
    nodes, edges = documents.parse_canvases(texts)
    nodes, edges = nodes.cache(), edges.cache()
    b = {r.id: r for r in nodes.collect()}
    assert b["b"].type == "text" and (b["b"].w, b["b"].h) == (250.0, 60.0) and len(b) == 5
    links = canvas.links_of(nodes)
    assert {(r.canvas, r.target) for r in links.collect()} == {("/m/root.canvas", "/m/sub.canvas"), ("/m/sub.canvas", "/m/root.canvas")}
    every = texts.select("canvas")
    seen = canvas.reachable(every.filter("canvas = '/m/root.canvas'"), links, every)
    assert {(r.canvas, r.level) for r in seen.collect()} == {("/m/root.canvas", 0), ("/m/sub.canvas", 1)}
    issues = {(r.severity, r.message) for r in canvas.validate(nodes, edges, "/m/root.canvas", spark.createDataFrame([("/src/api",), ("/src/ui",)], "folder string")).collect()}
    assert ("error", "edge to a missing node") in issues and ("warning", "overlaps another box") in issues and ("warning", "no box links to or into this folder") in issues
    more = canvas.with_weak_link(nodes, "/m/sub.canvas", "/m/root.canvas", "a", (1.0, 2.0))
    assert more.count() == nodes.count() + 1 and canvas.with_weak_link(more, "/m/sub.canvas", "/m/root.canvas", "a", (1.0, 2.0)).count() == more.count()
    stats = spark.createDataFrame([(0, "/src/api/x.py", "python", 120, 10, 10, 4000, 12), (1, "/src/api/y.py", "python", 20, 0, 0, 400, 2)], "id long, path string, language string, lines int, blank_lines int, comment_lines int, chars int, complexity int")
    deps = spark.createDataFrame([(1, 0, "import")], "source long, target long, kind string")
    none = spark.createDataFrame([("n1", "/src/api/x.py", None, 3, "look here")], "id string, path string, group_paths array<string>, line int, body string")
    for style in (export.MANUAL, export.BRIEF):
        text = export.export_project(documents.Project("Map", "root.canvas", "All of it"), "/m/root.canvas", nodes, edges, stats, deps, none, style, "2026-01-01")
        for part in ("Estimated cost", "120 lines in 2 files", "Api -> Db: reads", "2 files, 1 dependencies.", "Note on /src/api/x.py:3: look here", "Reference: Sub root.canvas"):
            assert part in text, (style, part)


def test_git_log(spark):
    lines = ["\x015\tx@y", "", "a.c", "b.c", "\x017\tz@y", "", "a.c", ""]
    got = gitlog.parse(spark.createDataFrame([("/r", i, v) for i, v in enumerate(lines)], "root string, n long, value string"))
    assert sorted(map(tuple, got.collect())) == [("/r/a.c", "x@y", 5), ("/r/a.c", "z@y", 7), ("/r/b.c", "x@y", 5)]


def test_cache_name():
    assert documents.cache_name(["/tmp/"]).startswith("tmp-") and "-and-1-" in documents.cache_name(["/tmp", "/"])
