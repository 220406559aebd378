"""Graph documents: written in parts, read from any bytes."""

import io
import json
import os
import random

import pytest

from loamgraph.sources import graphjson


def whole(data, cut, step, monkeypatch):
    """Members by stretches of `cut` bytes, states by the summaries of all of them."""
    monkeypatch.setattr(graphjson, "STEP", step)
    f = io.BytesIO(data)
    at = sorted({graphjson.boundary(f, k, len(data)) for k in range(0, len(data), cut)} | {len(data)})
    told = [graphjson.summary(f, a, b) for a, b in zip(at, at[1:], strict=False)]
    out = []
    for t, s in zip(told, graphjson.states(told), strict=True):
        out += graphjson.members(f, t["start"], t["stop"], len(data), s)
    return [(section, json.loads(v)) for section, _, v in sorted(out, key=lambda x: x[1])]


def document(r):
    odd = ['"', "\\", "{", "}]", '\\"', "é漢🙂", ',"links":[{', "\n", "a" * 30, "\\\\\\"]
    text = lambda: "".join(r.choice(odd) for _ in range(r.randrange(5)))
    nodes = [{"path": text(), "hot_functions": [{"name": text(), "line": i}] * r.randrange(3), "deep": {"x": [[text()]]}} for i in range(r.randrange(9))]
    links = [{"source": i, "kind": text()} for i in range(r.randrange(9))]
    doc = {"directed": True, "graph": {"nodes": [{"not": 1}], "n": text()}, text() + "x": [1, "2", [{"no": 1}]], "nodes": nodes, "note": text(), "links": links, "clones": [{}]}
    return doc, [("nodes", n) for n in nodes] + [("links", x) for x in links] + [("clones", {})]


def test_any_cut(monkeypatch):
    r = random.Random(11)
    for k in range(120):
        doc, want = document(r)
        data = json.dumps(doc, indent=r.choice([None, 2]), ensure_ascii=r.random() < 0.5).encode()
        got = whole(data, r.choice([1, 2, 7, 40, 10_000]), r.choice([3, 17, 5000]), monkeypatch)
        assert got == [(s, v) for s, v in want], k
    assert whole(b"{}", 1, 1, monkeypatch) == [] == whole(b'{"nodes":[]}', 3, 2, monkeypatch)


def test_bounded_memory(monkeypatch):
    """A document of 300 MB of small members is passed on without being held."""
    import tracemalloc

    member = b'{"path":"' + b"x" * 1000 + b'"}'
    n = 60_000

    class Many(io.RawIOBase):
        """Bytes of the document, made when they are read."""

        head, tail = b'{"nodes":[', b"{}]}"
        size = len(b'{"nodes":[') + n * (len(member) + 1) + len(b"{}]}")
        at = 0

        def seek(self, at):
            self.at = at

        def read(self, k):
            k = min(k, self.size - self.at)
            unit = member + b","
            start = self.at - len(self.head)
            if start < 0:
                out = self.head[self.at :]
                start = 0
            else:
                out = b""
            if len(out) < k:
                skip = start % len(unit)
                left = max(0, n * len(unit) - start)
                body = (unit * ((k + skip) // len(unit) + 1))[skip : skip + min(k - len(out), left)]
                out += body
                if len(out) < k:
                    tail_at = max(0, start - n * len(unit))
                    out += self.tail[tail_at:]
            self.at += k
            return out[:k]

    monkeypatch.setattr(graphjson, "STEP", 1 << 20)
    tracemalloc.start()
    count = sum(1 for _ in graphjson.members(Many(), 0, Many.size, Many.size, graphjson.State()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == n + 1 and peak < 60 << 20


@pytest.fixture
def graph(spark):
    nodes = spark.createDataFrame([(0, "/a\"\\é", "c", 5, None, 7, [(3, 11, "f")]), (1, "/b", "go", None, None, 0, []), (2, "/c", "go", -1, 4, None, None)], "id long, path string, language string, lines long, complexity long, git_last_commit long, hot array<struct<line:int,complexity:int,name:string>>")
    edges = spark.createDataFrame([(0, 1, "import"), (0, 1, "require"), (2, 0, "import")], "source long, target long, kind string")
    clones = spark.createDataFrame([(0, 1, 5, 1, 2, 6), (0, 2, 5, 9, 2, 6)], "a long, a_line int, a_end int, b long, b_line int, b_end int")
    return nodes, edges, clones


def test_round_trip(spark, graph, tmp_path):
    at, one = str(tmp_path / "g"), str(tmp_path / "g.json")
    graphjson.write_graph(at, *graph, parts=3)
    graphjson.write_graph(at, *graph, parts=2)  # in place of the first
    files = set(os.listdir(at))
    named = {p["file"] for p in json.load(open(f"{at}/manifest.json"))["parts"]}
    assert files == named | {"manifest.json"}
    graphjson.assemble(at, one)
    doc = json.load(open(one))
    assert doc["directed"] and doc["nodes"][0] == {"id": 0, "path": "/a\"\\é", "language": "c", "lines": 5, "git_last_commit": 7, "hot_functions": [{"line": 3, "complexity": 11, "name": "f"}]}
    assert doc["nodes"][2] == {"id": 2, "path": "/c", "language": "go", "complexity": 4} and [x["kind"] for x in doc["links"]] == ["import", "require", "import"]
    for path, stretch in ((at, 64), (one, 50), (one, 1 << 20)):
        n, e, c = graphjson.read_graph(spark, path, stretch)
        got = [(r.id, r.path, r.lines, r.complexity, r.git_last_commit) for r in n.orderBy("id").collect()]
        assert got == [(0, "/a\"\\é", 5, None, 7), (1, "/b", None, None, None), (2, "/c", None, None, None)]
        assert sorted(map(tuple, e.collect())) == [(0, 1, "import"), (0, 1, "require"), (2, 0, "import")]
        assert list(map(tuple, c.collect())) == [(0, 1, 5, 1, 2, 6)]


def test_parts_count_once_named(spark, graph, tmp_path):
    """Parts of failed or repeated tasks are never read; a failed job leaves the document as it was."""
    at = str(tmp_path / "g")
    graphjson.write_graph(at, *graph)
    (tmp_path / "g" / "part-lost.json").write_text('{"path":"no"}')
    broken = graph[0].selectExpr("id", "path", "language", "cast(raise_error('stop') as long) as lines")
    with pytest.raises(Exception, match="stop"):
        graphjson.write_graph(at, broken, graph[1])
    assert graphjson.read_graph(spark, at)[0].count() == 3
    empty = graph[0].limit(0), graph[1].limit(0)
    graphjson.write_graph(at, *empty)
    assert [x.count() for x in graphjson.read_graph(spark, at)] == [0, 0, 0]
    graphjson.assemble(at, str(tmp_path / "e.json"))
    assert json.load(open(tmp_path / "e.json"))["nodes"] == []


def test_foreign_document(spark, tmp_path):
    """Links without an end and clones out of range go, ids are places, unknown keys are passed over."""
    doc = {"links": [{"source": 0}, {"source": 1, "target": 0, "kind": "import", "more": {}}], "nodes": [{"id": 7, "path": "/x", "lines": 2, "z": [1]}, {"id": 3}], "other": {"nodes": [{}]}, "clones": [{"a": 0, "b": 1, "a_line": 1}, {"a": 0, "b": 2}]}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    n, e, c = graphjson.read_graph(spark, str(tmp_path / "d.json"), 31)
    assert [(r.id, r.path, r.lines) for r in n.orderBy("id").collect()] == [(0, "/x", 2), (1, None, None)]
    assert [tuple(r) for r in e.collect()] == [(1, 0, "import")] and [(r.a, r.b) for r in c.collect()] == [(0, 1)]
