"""Trees and git logs as data sources."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from loamgraph.operators.history import file_history
from loamgraph.sources import files, gitlog, trees
from loamgraph.streaming import commits as feed


@pytest.fixture
def tree(tmp_path):
    texts = {
        "a/main.py": "import x\n", "a/__init__.py": "", "a/.hidden.py": "1", "a/b/c/d/deep.go": "package d\n", "a/b/x.PY": "no", "a/b/package-lock.json": "{}", "a/b/q.json": "{}", "a/b/z.min.js": "no", "a/b/.min.js": "yes",
        "a/node_modules/m.js": "no", "a/node_modules/pkg/in.js": "linked", "b/one.md": "# é", "b/bad.md": b"\xff\xfe", "b/none": "no", "out/far.ts": "", "out/more/near.ts": "let x",
    }
    for name, text in texts.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(text if isinstance(text, bytes) else text.encode())
    links = {"a/loop": "a", "a/twin": "a/b", "a/pkg": "a/node_modules/pkg", "a/far": "out", "a/gone.py": "nowhere", "out/back": "out", "a/same.py": "a/main.py"}
    for name, to in links.items():
        os.symlink(tmp_path / to, tmp_path / name)
    return tmp_path


WANT = {"a/main.py", "a/__init__.py", "a/.hidden.py", "a/b/c/d/deep.go", "a/b/q.json", "a/b/.min.js", "b/one.md", "b/bad.md", "a/pkg/in.js", "a/far/far.ts", "a/far/more/near.ts", "a/same.py"}


@pytest.mark.parametrize("tasks", [1, 3, 64])
def test_tree(spark, tree, tasks):
    roots = [str(tree / "a"), str(tree / "b"), str(tree / "a/b"), str(tree / "b/")]
    got = {r.path: r for r in files.read_tree(spark, roots, tasks=tasks).collect()}
    assert set(got) == {str(tree / p) for p in WANT}
    assert sorted(r.file_id for r in got.values()) == list(range(len(WANT)))
    assert [p for p in sorted(got, key=lambda p: got[p].file_id)] == sorted(got)
    assert got[str(tree / "b/bad.md")].text == "��" and got[str(tree / "b/one.md")].n_bytes == 4


def test_tree_conditions(spark, tree, monkeypatch):
    """Conditions are answered by the listing: Spark keeps no filter for them, and folders beside the way aren't opened."""
    rows = trees.read(spark, [str(tree / "a"), str(tree / "b")])
    some = rows.filter((F.col("language") == "go") & F.col("path").startswith(str(tree / "a/b/c")))
    assert [os.path.basename(r.path) for r in some.collect()] == ["deep.go"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert " Filter (" not in plan, plan
    assert {os.path.basename(r.path) for r in rows.filter(F.col("extension").isin(".md", ".json")).collect()} == {"one.md", "bad.md", "q.json"}
    assert [r.path for r in rows.filter(F.col("path") == str(tree / "b/one.md")).collect()] == [str(tree / "b/one.md")]
    assert rows.filter((F.col("language") == "go") & (F.length("text") > 3)).count() == 1 and rows.filter((F.col("language") == "go") & (F.col("extension") == ".md")).isEmpty()
    assert trees.read(spark, [str(tree / "b")], text="false").filter("text is not null").isEmpty()
    opened = []
    monkeypatch.setattr(os, "scandir", lambda p, f=os.scandir: opened.append(str(p)) or f(p))
    narrow = trees.NarrowedTreeReader({"path": str(tree / "a"), "tasks": "2"})
    assert list(narrow.pushFilters([trees.StringStartsWith(("path",), str(tree / "a/b/c")), trees.In(("n_bytes",), (1,))])) == [trees.In(("n_bytes",), (1,))]
    parts = narrow.partitions()
    assert len(opened) <= 2 and [os.path.basename(p) for b in map(narrow.read, parts) for x in b for p in x["path"].to_pylist()] == ["deep.go"]
    assert str(tree / "a/far") not in opened
    spark.conf.set(trees.PUSHDOWN, "false")
    try:
        assert trees.read(spark, [str(tree / "b")]).filter("extension = '.md'").count() == 2
    finally:
        spark.conf.set(trees.PUSHDOWN, "true")


def test_tree_empty(spark, tmp_path):
    assert files.read_tree(spark, [str(tmp_path)]).isEmpty() and files.read_tree(spark, [str(tmp_path / "no")]).isEmpty()


def git(folder, *args, when=0, author="a@x"):
    env = os.environ | {"GIT_AUTHOR_DATE": f"@{when} +0000", "GIT_COMMITTER_DATE": f"@{when} +0000", "GIT_AUTHOR_EMAIL": author, "GIT_AUTHOR_NAME": "n", "GIT_COMMITTER_EMAIL": "c@x", "GIT_COMMITTER_NAME": "n", "GIT_CONFIG_GLOBAL": "/dev/null"}
    return subprocess.run(["git", "-C", str(folder), *args], check=True, capture_output=True, text=True, env=env).stdout.strip()


def commit(folder, names, when, author):
    for n in names:
        (folder / n).parent.mkdir(parents=True, exist_ok=True)
        (folder / n).write_text(f"{when}{author}")
        git(folder, "add", n)
    git(folder, "commit", "-qm", "x\n\nmore", when=when, author=author)


@pytest.fixture
def repos(tmp_path):
    one, two, empty = tmp_path / "one", tmp_path / "two", tmp_path / "empty"
    for r in (one, two, empty):
        r.mkdir()
        git(r, "init", "-q", "-b", "main")
    for k in range(7):
        commit(one, ["a.py", f"d/{k % 3} é.py"], 1000 + 10 * k, f"u{k % 2}@x")
    git(one, "checkout", "-qb", "side", "HEAD~2")
    commit(one, ["side.py"], 2000, "s@x")
    git(one, "checkout", "-q", "main")
    git(one, "merge", "-q", "--no-ff", "-m", "m", "side", when=2100)
    commit(two, ["b.go"], 50, "v@x")
    return one, two, empty


def expected(repo):
    out = git(repo, "-c", "core.quotePath=false", *gitlog.COMMAND)
    rows, head = [], None
    for line in out.split("\n"):
        if line.startswith(gitlog.HEAD):
            head = line[1:].split("\t")
        elif line:
            rows.append((f"{repo}/{line}", head[1], int(head[0])))
    return rows


@pytest.mark.parametrize("size", [1, 3, 2000])
def test_git_log(spark, repos, tmp_path, size):
    one, two, empty = repos
    rows, roots = gitlog.read(spark, [str(one / "d"), str(one), str(two), str(empty), str(tmp_path)], commits=size)
    assert sorted(map(tuple, rows.collect())) == sorted(expected(one) + expected(two))
    assert rows.rdd.getNumPartitions() == {1: 9, 3: 4, 2000: 2}[size]
    assert [r.root for r in roots.collect()] == [str(empty), str(one), str(two)]
    lines = spark.createDataFrame([(str(one), i, v) for i, v in enumerate(git(one, "-c", "core.quotePath=false", *gitlog.COMMAND).split("\n"))], "root string, n long, value string")
    assert sorted(map(tuple, gitlog.parse(lines).collect())) == sorted(expected(one))
    assert gitlog.read(spark, [str(tmp_path)])[0].isEmpty()


def test_git_stream(spark, repos, tmp_path):
    """Batches hold what heads have added since the last one, also after history was rewritten."""
    one, two, _ = repos
    at = [str(tmp_path / x) for x in ("table", "state")]

    def run():
        feed.append_history(gitlog.read_stream(spark, [str(one), str(two)], commits=2), *at).awaitTermination()
        return sorted((r.path, r.author, r.ts) for r in spark.read.parquet(at[0]).collect())

    seen = expected(one) + expected(two)
    assert run() == sorted(seen) == run()
    commit(two, ["b.go", "c.go"], 60, "w@x")
    seen += [(f"{two}/b.go", "w@x", 60), (f"{two}/c.go", "w@x", 60)]
    assert run() == sorted(seen)
    git(two, "reset", "-q", "--hard", "HEAD~1")
    commit(two, ["other.go"], 70, "w@x")
    seen.append((f"{two}/other.go", "w@x", 70))
    assert run() == sorted(seen)
    assert {r.path: r.git_commits for r in feed.history_of(spark, at[0]).collect()}[f"{two}/b.go"] == 2
    assert file_history(gitlog.read(spark, [str(two)])[0]).count() == 2 and json.dumps(at)


def test_kept_history(spark, tmp_path):
    """A batch writes the paths and authors it touches and no others; late, equal and null ones count; versions can be put together."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    rows = []

    def add(name, some):
        rows.extend(some)
        (folder / name).write_text("".join(json.dumps(dict(zip(("path", "author", "ts"), x, strict=True))) + "\n" for x in some))
        stream = spark.readStream.schema("path string, author string, ts long").json(str(folder))
        feed.keep_history(stream, out, str(tmp_path / "state")).awaitTermination()

    def check():
        got = sorted(map(tuple, feed.kept_history(spark, out).collect()))
        assert got == sorted(map(tuple, file_history(spark.createDataFrame(rows, "path string, author string, ts long")).collect()))

    add("1.json", [("a", "x", 5), ("a", "x", 5), ("a", "y", 9), ("b", "x", 1), ("c", None, 3)])
    check()
    add("2.json", [("a", "y", 2), ("d", "z", 7)])
    check()
    newest = max(int(v.split("=")[1]) for v in os.listdir(out))
    assert sorted(map(tuple, spark.read.parquet(f"{out}/version={newest}").collect())) == [("a", "y", 2, 9), ("d", "z", 1, 7)]
    feed.compact(spark, out)
    assert len(os.listdir(out)) == 1
    check()
    feed.compact(spark, out)
    add("3.json", [("a", "x", 90)])
    check()
    assert len(os.listdir(out)) == 2
