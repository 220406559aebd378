"""What must hold however large, deep or late the input is."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from loamgraph.functions import links
from loamgraph.operators import canvas, clones, graph
from loamgraph.operators.history import file_history
from loamgraph.scan import braces, scripts
from loamgraph.scan.base import HOT_LEAST, Facts, statistics, weblink
from loamgraph.session import shared_dir
from loamgraph.streaming import commits


def test_deep_canvases(spark):
    n = 67
    step = spark.createDataFrame([(f"c{i}", 0, "x", f"c{i + 1}") for i in range(n)], "canvas string, ord int, id string, target string")
    every = spark.createDataFrame([(f"c{i}",) for i in range(n + 1)] + [("alone",)], "canvas string")
    seen = canvas.reachable(every.filter("canvas = 'c0'"), step, every)
    assert {(r.canvas, r.parent, r.level) for r in seen.collect()} == {(f"c{i}", f"c{i - 1}" if i else None, i) for i in range(n + 1)}
    trails = {r.canvas: r.trail for r in canvas.breadcrumbs(seen).collect()}
    assert trails == {f"c{i}": " > ".join(f"c{k}" for k in range(i + 1)) for i in range(n + 1)}


def test_late_commits(spark, tmp_path):
    first = [("a", "x", 2_000_000_000), ("a", "x", 2_000_000_000), ("a", "y", 1_999_999_999)]
    late = [("a", "z", 5), ("b", "x", 7)]
    for k, rows in enumerate((first, late)):
        spark.createDataFrame(rows, "path string, author string, ts long").write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema("path string, author string, ts long").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        commits.append_history(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    want = file_history(spark.createDataFrame(first + late, "path string, author string, ts long")).collect()
    assert sorted(commits.history_of(spark, f"{tmp_path}/out").collect()) == sorted(want) and len(want) == 2


def test_both_cleaners_of_links_agree(spark):
    r = random.Random(4)
    pool = ['"', "'", "<", ">", "a", "/b.html", " ", "?q", "#p", "%41", "%zz", "+", "http:", "//", ".png", "\n"]
    raws = ["".join(r.choice(pool) for _ in range(r.randrange(9))) for _ in range(1500)] + ["<" * 7 + "x" + ">" * 7, "\"'" * 5 + "y" + "'\"" * 5]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raws)], "i int, raw string")
    got = {x.i: x.link for x in df.select("i", links.weblink(F.col("raw")).alias("link")).collect()}
    assert {i: weblink(x) for i, x in enumerate(raws)} == got
    assert got[1500] == "x" and got[1501] == "y"


def test_budget(spark, monkeypatch):
    nodes = spark.range(6)
    edges = spark.createDataFrame([(0, 1, "k"), (1, 2, "k"), (2, 0, "k"), (2, 3, "k"), (4, 3, "k")], "source long, target long, kind string")
    blast, cycle = (sorted(x.collect()) for x in graph.blast_and_cycles(nodes, edges))
    monkeypatch.setattr(graph, "BUDGET", 24)  # six nodes in four components
    again = [sorted(x.collect()) for x in graph.blast_and_cycles(nodes, edges)]
    assert again == [blast, cycle] and [x.blast_radius for x in blast] == [2, 2, 2, 4, 0, 0]
    monkeypatch.setattr(graph, "BUDGET", 23)
    none, still = graph.blast_and_cycles(nodes, edges)
    assert all(x.blast_radius is None for x in none.collect()) and sorted(still.collect()) == cycle


def test_folder_must_be_shared():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "yarn"

            class _conf:
                get = staticmethod(lambda *_: None)

            getConf = staticmethod(lambda: Session.sparkContext._conf)

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared_dir(Session)


def test_stock_session(tmp_path):
    """Without any configuration: tables are written, nested blocks drop theirs, threads leave the setting alone, the rest goes with the application."""
    code = """
import os, threading
from pyspark.sql import SparkSession
from loamgraph import session
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
folder = session.shared_dir(spark).removeprefix("file://")
assert folder == session.shared_dir(spark).removeprefix("file://")
left = session.materialise(spark.range(3), "left")
with session.scratch(spark):
    a = session.materialise(spark.range(5), "a")
    with session.scratch(spark):
        b = session.materialise(a, "b")
        assert b.count() == 5
    assert a.count() == 5 and len(os.listdir(folder)) == 2
assert os.listdir(folder) == [os.path.basename(left._loam_path)] and left.count() == 3
ts = [threading.Thread(target=lambda: [session.discard(session.materialise(spark.range(9), "t")) for _ in range(4)]) for _ in range(3)]
[t.start() for t in ts]; [t.join() for t in ts]
assert spark.conf.get(session.CLEANUP, "false") == "false" and len(os.listdir(folder)) == 1
spark.stop()
print(folder)
"""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, timeout=300)
    assert out.returncode == 0, out.stderr
    folder = out.stdout.split()[-1]
    assert not os.path.isdir(folder) or not os.listdir(folder)


def test_innermost_functions():
    r = random.Random(8)
    for _ in range(200):
        spans, stack = [], [(0, 400)]
        while stack:  # nested and adjacent spans
            a, b = stack.pop()
            while b - a > 8 and r.random() < 0.7:
                m = r.randrange(a + 1, b)
                spans.append((a, m, f"f{a}"))
                stack.append((a + 1, m - 1))
                a = m
        branches = [r.randrange(400) for _ in range(120)]
        f = Facts()
        f.branches, f.functions = branches, spans
        count = {s: 1 for s in spans}
        for p in branches:
            inside = [s for s in spans if s[0] <= p < s[1]]
            if inside:
                count[min(inside, key=lambda s: s[1] - s[0])] += 1
        got = statistics("\n" * 400, f)
        assert got["max_function_complexity"] == max(count.values(), default=0)
        assert [h["complexity"] for h in got["hot"]] == sorted((c for c in count.values() if c >= HOT_LEAST), reverse=True)[: len(got["hot"])]


def test_branch_lists():
    bash = 'f() {\n  if true; then\n    echo x\n  fi\n  case $1 in\n    a) echo a;;\n    "b"|c) echo b;;\n  esac\n}\n'
    got = statistics(bash, scripts.bash("a.sh", bash))
    assert (got["functions"], got["complexity"], got["max_function_complexity"]) == (1, 4, 4)
    line = "case $x in a) y;; *) z;; esac\nfor i in $(ls); do (cd x); done\na && b || c\n"
    assert statistics(line, scripts.bash("a.sh", line))["complexity"] == 6
    cs = "class A {\n  int F() => x switch { 1 => 2, _ => 3 };\n  int G(int a) {\n    switch (a) { case 1: return 2; default: return 3; }\n  }\n}\n"
    got = statistics(cs, braces.csharp("a.cs", cs))
    assert (got["functions"], got["complexity"], got["max_function_complexity"]) == (2, 5, 3)


def test_window_hashes(spark):
    r = random.Random(1)
    rows = [(i, [r.choice("abc") for _ in range(r.choice([0, 3, 5, 9, 40]))]) for i in range(60)]
    got = clones.windows(spark.createDataFrame(rows, "file_id long, toks array<string>"), 5).collect()
    runs = {(i, p): tuple(t[p : p + 5]) for i, t in rows for p in range(len(t) - 4)}
    assert {(x.file_id, x.pos) for x in got} == set(runs)
    by_hash, by_prev = {}, {}
    for x in got:
        by_hash.setdefault(x.h, set()).add(runs[x.file_id, x.pos])
        if x.pos:
            by_prev.setdefault(x.prev, set()).add(rows[x.file_id][1][x.pos - 1])
        else:
            assert x.prev is None
    assert all(len(s) == 1 for s in by_hash.values()) and len(by_hash) == len(set(runs.values())) and len(by_prev) == 3 and all(len(s) == 1 for s in by_prev.values())


def test_clones_share_by_share(spark, monkeypatch):
    """Windows dealt out in shares, and the first files' runs alone, give what all windows at once give."""
    r = random.Random(4)
    base = [[f"w{r.randrange(400)}" for _ in range(200)] for _ in range(12)]
    rows = []
    for i in range(60):
        k = r.randrange(100)
        toks = base[i % 12][k : k + 90] + [f"x{i}"] * r.randrange(3) + base[r.randrange(12)][:60]
        rows.append((i, toks, [j // 8 + 1 for j in range(len(toks))]))
    df = spark.createDataFrame(rows, "file_id long, toks array<string>, rows array<int>")
    whole = clones.buckets(clones.windows(df, 20), 5)
    assert whole.count() > 500
    monkeypatch.setattr(clones, "SHARE", 2000)
    monkeypatch.setattr(clones, "STARTS", 1)
    assert sorted(clones.shared_windows(df, 20, 5).collect()) == sorted(whole.collect())
    assert max(clones.windows(df, 20, (k, 4)).count() for k in range(4)) < 0.4 * clones.windows(df, 20).count()
    for most in (1, 40, 100_000, None):
        want = clones.located(clones.pairs(whole, df, 20), df, 2, most)
        assert sorted(clones.clones(df, 20, 2, 5, most).collect()) == sorted(want.collect()), most
    assert clones.clones(df.limit(0), 20, 2).count() == 0
