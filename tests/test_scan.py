"""Scanners end to end: small projects of each language, with the edges and unresolved references they must give."""

import textwrap

import pytest

from loamgraph import sql
from loamgraph.operators.resolve import LABEL
from loamgraph.plans import build
from loamgraph.scan import base, registry
from loamgraph.scan import facts as scans
from loamgraph.sources import files as sources

#: project -> ({file: text}, {(source, target, kind)}, unresolved)
PROJECTS = {
    "c": ({"main.c": '#include "lib/a.h"\n#include <stdio.h>\n/* #include "no.h" */\nint main(void) { return 0; }\n', "lib/a.h": '#include "b.h"\n#include "gone.h"\n', "lib/b.h": "int b;\n"}, {("main.c", "lib/a.h", "import"), ("lib/a.h", "lib/b.h", "import")}, 1),
    "cs": ({"A.cs": "using Lib.Core;\nnamespace App;\nclass A : Base, IThing<int> { }\n", "B.cs": "namespace Lib.Core { public class Base { public enum Kind { X } } interface IThing<T> : Lib.Core.Base { } }\n"}, {("A.cs", "B.cs", "type_reference")}, 1),
    "py": ({"app.py": "import pkg.core\nfrom pkg import tools as t\nimport os\nfrom __future__ import annotations\n", "pkg/__init__.py": "", "pkg/core.py": "from .tools import run\nfrom . import tools\n", "pkg/tools.py": "def run():\n    return 1\n"}, {("app.py", "pkg/core.py", "import"), ("app.py", "pkg/__init__.py", "import"), ("app.py", "pkg/tools.py", "import"), ("pkg/core.py", "pkg/tools.py", "import"), ("pkg/core.py", "pkg/__init__.py", "import")}, 2),
    "go": ({"main.go": 'package main\nimport (\n  "fmt"\n  x "example.com/mod/inner/calc"\n)\n', "inner/calc/calc.go": "package calc\n"}, {("main.go", "inner/calc/calc.go", "import")}, 1),
    "lisp": ({"a.lisp": '(defpackage :app (:use :cl-tools "EXTRA"))\n(in-package :app)\n(require :missing)\n', "b.lsp": "(in-package :cl-tools)\n", "c.cl": '(in-package "EXTRA") ; (require :none)\n'}, {("a.lisp", "b.lsp", "import"), ("a.lisp", "c.cl", "import")}, 1),
    "php": ({"src/P.php": "<?php\nnamespace App;\nuse Lib\\{One, Two as Z};\nrequire_once 'help.php';\nclass P extends One implements \\Lib\\Two { use T; }\n", "src/help.php": "<?php\n", "lib.php": "<?php\nnamespace Lib { class One {} interface Two {} }\n"}, {("src/P.php", "lib.php", "import"), ("src/P.php", "lib.php", "type_reference"), ("src/P.php", "src/help.php", "require")}, 0),
    "vb": ({"A.vb": "Imports System\nNamespace N\n  Public Class A\n    Inherits B\n  End Class\nEnd Namespace\n", "B.vb": "Namespace N\n  Class B\n  End Class\nEnd Namespace\n"}, set(), 1),
    "js": ({"a.js": "const b = require('./b');\nimport c from \"./c.mjs\";\nimport('./d/');\nconst s = 'require(\"./no\")'; require('left-pad');\n", "b.jsx": "export * from './c.mjs'", "c.mjs": "", "d/index.js": ""}, {("a.js", "b.jsx", "require"), ("a.js", "c.mjs", "import"), ("a.js", "d/index.js", "import"), ("b.jsx", "c.mjs", "import")}, 1),
    "ts": ({"tsconfig.json": '{ // own\n "extends": "./base.json", }', "base.json": '{"compilerOptions": {"baseUrl": "src", "paths": {"@lib/*": ["lib/*"]}}}', "src/a.ts": 'import type { X } from "@lib/x.js";\nimport y = require("util/y");\nimport "react";\n', "src/lib/x.ts": "", "src/util/y.tsx": ""}, {("tsconfig.json", "base.json", "import"), ("src/a.ts", "src/lib/x.ts", "import"), ("src/a.ts", "src/util/y.tsx", "import")}, 1),
    "json": ({"api.json": '{"a": {"$ref": "types.json#/x"}, "b": {"$ref": "#/y"}, "c": {"$ref": "https://x.y/z.json"}}', "types.json": "{}"}, {("api.json", "types.json", "import")}, 0),
    "sh": ({"run.sh": '#!/bin/bash\nsource "$(dirname "$0")/env.sh"\n. lib/x.bash # no\nbash tools/t.sh && ./go.sh arg\nsource "$CONF"\nsource gone.sh\n', "env.sh": "", "lib/x.bash": "", "tools/t.sh": "", "go.sh": ""}, {("run.sh", "env.sh", "import"), ("run.sh", "lib/x.bash", "import"), ("run.sh", "tools/t.sh", "require"), ("run.sh", "go.sh", "require")}, 1),
    "proto": ({"api/v1/a.proto": 'syntax = "proto3";\nimport public "v1/b.proto";\nimport "google/x.proto";\n', "api/v1/b.proto": "// import \"no.proto\";\n"}, {("api/v1/a.proto", "api/v1/b.proto", "import")}, 1),
    "sql": ({"1.sql": "CREATE TABLE shop.orders (id INT PRIMARY KEY, note VARCHAR(20));", "2.sql": "CREATE VIEW big AS SELECT o.id FROM shop.orders o JOIN gone g ON g.id = o.id; -- FROM nothing", "3.sql": "SELECT f_total(id) FROM BIG WHERE note = 'FROM x';", "4.sql": "CREATE OR REPLACE FUNCTION f_total(x INT) RETURNS INT AS $$ SELECT 1 FROM y $$ LANGUAGE sql;"}, {("2.sql", "1.sql", "type_reference"), ("3.sql", "2.sql", "type_reference"), ("3.sql", "4.sql", "type_reference")}, 1),
    "ps": ({"main.ps1": '. "$PSScriptRoot\\lib\\c.ps1"  # dot\nImport-Module Tools\nImport-Module Az.None\n& .\\go.ps1 -Fast\ncmd /c old.bat\n', "lib/c.ps1": "using module ..\\mods\\T.psm1\n", "go.ps1": "", "old.bat": "", "mods/Tools.psm1": "", "mods/T.psm1": "", "mods/M.psd1": "@{\n RootModule = 'T.psm1'\n NestedModules = @('.\\Tools.psm1')\n}\n"}, {("main.ps1", "lib/c.ps1", "import"), ("main.ps1", "mods/Tools.psm1", "require"), ("main.ps1", "go.ps1", "require"), ("main.ps1", "old.bat", "require"), ("lib/c.ps1", "mods/T.psm1", "import"), ("mods/M.psd1", "mods/T.psm1", "require"), ("mods/M.psd1", "mods/Tools.psm1", "require")}, 1),
    "bat": ({"b.bat": '@echo off\nREM call no.bat\ncall lib\\e.cmd\ncall :label\n"%~dp0t.bat" x\npowershell -File "%~dp0p.ps1"\n:label\n', "lib/e.cmd": "", "t.bat": "", "p.ps1": ""}, {("b.bat", "lib/e.cmd", "require"), ("b.bat", "t.bat", "require"), ("b.bat", "p.ps1", "require")}, 0),
    "web": ({"index.html": '<a href="/about?x=1#y">a</a><link href="css/m.css"><img src="p.png"><a href="https://x.y">o</a><a href="gone.html">g</a>', "about/index.html": '<script src="../app.js"></script><a href="/">here</a><a href="/css/m.css">up</a>', "css/m.css": '@import "n"; a { background: url(data:xx) }', "css/n.css": "", "app.js": ""}, {("index.html", "about/index.html", "import"), ("index.html", "css/m.css", "import"), ("about/index.html", "app.js", "import"), ("about/index.html", "css/m.css", "import"), ("css/m.css", "css/n.css", "import")}, 1),
    "md": ({"README.md": "[g](docs/guide.md \"t\") [[Log]] `[[guide]]`\n```\n[x](no.md)\n```\n[r]: ./s/run.sh\n", "docs/guide.md": "![[README]] [m](missing.md) [self](guide.md)\n", "Log.md": "a stray ` tick\n\nthen `[[README]]`\n", "s/run.sh": ""}, {("README.md", "docs/guide.md", "import"), ("README.md", "Log.md", "import"), ("README.md", "s/run.sh", "import"), ("docs/guide.md", "README.md", "import")}, 1),
}


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("trees")
    for name, (texts, _, _) in PROJECTS.items():
        for path, text in {**texts, "node_modules/x.js": "", "package-lock.json": "{}", "y.min.js": ""}.items():
            f = top / name / path
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_text(text)
    f = sources.read_tree(spark, [str(top)]).cache()
    place = {r.file_id: tuple(r.path[len(str(top)) + 1 :].split("/", 1)) for r in f.collect()}
    facts = scans.scan_files(f).cache()
    got = build.resolved_references(f, facts).collect()
    return place, got, facts.filter("error is not null").count(), f, facts


@pytest.mark.parametrize("name", PROJECTS)
def test_project(scanned, name):
    texts, edges, unresolved = PROJECTS[name]
    place, got, errors, *_ = scanned
    assert not errors and {p for n, p in place.values() if n == name} == set(texts)
    assert sorted(place) == list(range(len(place)))
    own = [r for r in got if place[r.file_id][0] == name]
    assert {(place[r.file_id][1], "/".join(place[r.target]).removeprefix(name + "/"), LABEL[r.kind]) for r in own if r.target is not None and r.target != r.file_id} == edges
    assert sum(r.target is None for r in own) == unresolved


def test_sql(spark, scanned):
    """One SQL text from files to edges, and the views, give what the build gives; the table functions what the scanners do."""
    _, got, _, f, facts = scanned
    want = sorted({(r.file_id, r.target, LABEL[r.kind]) for r in got if r.target is not None and r.target != r.file_id})
    made = sql.views(spark, f, "t_")
    assert {"t_files", "t_refs", "t_candidates", "t_resolved", "t_edges", "t_fan", "t_stats", "t_lines"} <= set(made)
    text = """
        WITH d AS (SELECT f.file_id, d.seq, d.key FROM t_files f, LATERAL scan_decls(f.language, f.path, f.text) d),
             s AS (SELECT key, max_by(file_id, struct(file_id, seq)) AS target FROM d GROUP BY key),
             hit AS (SELECT r.file_id, r.seq, r.kind, min_by(s.target, c.pos) AS target FROM (SELECT f.file_id, r.* FROM t_files f, LATERAL scan_refs(f.language, f.path, f.text) r) r
                     JOIN t_candidates c ON c.file_id = r.file_id AND c.seq = r.seq JOIN s ON s.key = c.key GROUP BY ALL)
        SELECT DISTINCT file_id, target, CASE kind WHEN 'TYPE_NAME' THEN 'type_reference' WHEN 'IMPORT_PATH' THEN 'import' ELSE 'require' END FROM hit WHERE target <> file_id"""
    assert sorted(map(tuple, spark.sql(text).collect())) == want
    assert sorted(map(tuple, spark.table("t_edges").collect())) == want
    bad = {r.file_id: r.n for r in spark.sql("SELECT file_id, unresolved AS n FROM t_unresolved").collect()}
    assert sum(bad.values()) == sum(r.target is None for r in got) and len(bad) == f.count()
    stats = spark.sql("SELECT * FROM t_stats ORDER BY file_id").collect()
    assert [tuple(r) for r in stats] == [tuple(r) for r in scans.stats_of(facts).drop("hash", "error").orderBy("file_id").collect()]
    tokens = {r.file_id: r.n for r in spark.sql("SELECT file_id, count(*) AS n FROM t_files f, LATERAL scan_tokens(f.language, f.path, f.text) GROUP BY file_id").collect()}
    assert tokens == {r.file_id: len(r.toks) for r in scans.tokens_of(facts).collect()}
    odd = spark.sql("SELECT * FROM VALUES ('c', '/a.c', cast(NULL AS string)), ('none', '/b', 'x') AS f(language, path, text), LATERAL scan_refs(f.language, f.path, f.text)")
    assert odd.isEmpty()


def stats(language, text, path="/x/f"):
    text = textwrap.dedent(text)
    return base.statistics(text, registry.scan(language, path, text))


def test_statistics():
    s = stats("python", "# head\n\ndef f(a):\n    if a and a > 1:  # why\n        return [x for x in a if x]\n    return 0\n")
    assert (s["lines"], s["blank_lines"], s["comment_lines"], s["functions"], s["complexity"], s["max_function_complexity"], s["max_indent"]) == (6, 1, 2, 1, 5, 5, 2)
    s = stats("c", "/* a\n b */\nint f(int x) {\n  if (x && x > 2) { return 1; }\n  return x ? 2 : 3; // c\n}\n")
    assert (s["comment_lines"], s["functions"], s["complexity"], s["max_function_complexity"]) == (3, 1, 4, 4)
    s = stats("javascript", "function f() { if (a) {} const g = () => { for (;;) {} }; }\n")
    assert (s["functions"], s["complexity"], s["max_function_complexity"]) == (2, 3, 2)
    assert stats("json", "{}")["complexity"] is None and stats("json", "{")["parse_errors"] == 1
    s = stats("go", "func f() {\n" + "if a { }\n" * 12 + "}\n")
    assert s["hot"] == [{"line": 1, "complexity": 13, "name": "f"}]
    assert stats("bash", "")["lines"] == 0 and stats("bash", "a\nb")["lines"] == 2
    s = stats("batch", "if a b\nfor %%x in (y) do z\n")
    assert s["complexity"] == 3 and s["functions"] is None


def test_any_text_scans():
    for language in registry.SCANNERS:
        for text in ("", "\x00", "{[(\"'`", "a" * 5000, "))))}}}}", "/* \n", "<" * 200, "é漢🙂" * 50, "'" * 301):
            f = registry.scan(language, "/p/x.y", text)
            base.statistics(text, f)
            base.tokens(text, f)


def test_build(spark, tmp_path):
    body = "".join(f"    total_{i} = combine(total_{i}, other[{i}], {i})\n" for i in range(12))
    (tmp_path / "a.py").write_text("import b\ndef f(other):\n" + body)
    (tmp_path / "b.py").write_text("import c\ndef g(other):\n" + body)
    (tmp_path / "c.py").write_text("import a\n")
    (tmp_path / "d.py").write_text("import a\n")
    f = sources.read_tree(spark, [str(tmp_path)])
    path = {r.path.rsplit("/", 1)[1]: r.path for r in f.collect()}
    commits = spark.createDataFrame([(path["a.py"], "x", 5), (path["a.py"], "y", 9), (path["c.py"], "x", 7)], "path string, author string, ts long")
    b = build.build(f, commits, spark.createDataFrame([(str(tmp_path),)], "root string"))
    n = {r.path.rsplit("/", 1)[1]: r for r in b.nodes.collect()}
    assert [(n[k].fan_in, n[k].fan_out, n[k].blast_radius, n[k].cycle_size) for k in ("a.py", "b.py", "c.py", "d.py")] == [(2, 1, 3, 3), (1, 1, 3, 3), (1, 1, 3, 3), (0, 1, 0, 0)]
    assert (n["a.py"].git_commits, n["a.py"].git_authors, n["a.py"].git_last_commit, n["b.py"].git_commits, n["a.py"].hotspot_rank) == (2, 2, 9, 0, 1)
    c = b.clones.collect()
    assert len(c) == 1 and (c[0].a_line, c[0].b_line) == (2, 2) or (c[0].a_line, c[0].b_line) == (3, 3)
