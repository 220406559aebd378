"""Every query with SQL gives the rows that DuckDB gives; properties of graph and cost operators."""

import math
import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
from loamgraph import queries as core
from loamgraph.functions import paths, values
from loamgraph.functions.cost import CostParams
from loamgraph.operators import graph, layout, totals

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def norm(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(norm(r[i]) for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    c = duck.execute(core.ORACLES[name])
    names = [d[0] for d in c.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, c.fetchall())


@pytest.mark.parametrize("rows_of", ["SELECT * FROM c WHERE false", "SELECT * FROM c WHERE c_custkey <> 1", "SELECT * FROM c UNION ALL SELECT * FROM c", "SELECT * REPLACE (CASE WHEN c_custkey % 15 <> 7 THEN c_custkey END AS c_custkey) FROM c"], ids=["empty", "no-root", "twice", "no-key"])
def test_odd_customers(spark, tmp_path, rows_of):
    """The index of diagrams without a root, with all of them twice, and with customers that have no key."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW c AS SELECT * FROM '{SF}/customer.parquet'")
    con.execute(f"COPY ({rows_of}) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    for name in ("canvas_index", "breadcrumbs", "unreachable"):
        df, c = core.QUERIES[name](spark, str(tmp_path)), con.execute(core.ORACLES[name])
        assert rows(df.columns, df.collect()) == rows([d[0] for d in c.description], c.fetchall()), name


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_paths(spark):
    cases = {"/a/./b//c/../d": "/a/b/d", "/../a": "/a", "../x/../y": "../y", "a/..": ".", "/": "/", "../../z": "../../z", "": "."}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: r.c for r in df.select("p", paths.clean(df.p).alias("c")).collect()}
    assert got == cases
    again = {r.p: r.c for r in df.select("p", paths.clean(paths.clean(df.p)).alias("c")).collect()}
    assert again == got
    r = spark.createDataFrame([("/a/b/c", "/a/x"), ("/a", "/a"), ("/q", "/a/b")], "t string, s string")
    assert [x.w for x in r.select(paths.relative(r.t, r.s).alias("w")).collect()] == ["../b/c", ".", "../../q"]
    assert f"{values.fnv1a(b'hello'):016x}" == "a430d84680aabd0b"


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (2, 3, "a"), (3, 1, "a"), (3, 4, "a"), (5, 5, "a"), (6, 7, "a"), (7, 6, "a"), (7, 4, "a")], "source long, target long, kind string")
    nodes = spark.createDataFrame([(i,) for i in range(1, 9)], "id long")
    reach = graph.closure(edges)
    small = sorted(map(tuple, graph.cycles(nodes, reach).collect()))
    assert small == sorted(map(tuple, graph.cycles_large(nodes, edges).collect()))
    assert small[:4] == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, None, 0)] and small[5] == (6, 6, 2)
    blast = {r.id: r.blast_radius for r in graph.blast_radius(nodes, reach).collect()}
    assert blast == {1: 2, 2: 2, 3: 2, 4: 5, 5: 0, 6: 1, 7: 1, 8: 0}
    fan = graph.fan(nodes, edges).collect()
    assert sum(r.fan_in for r in fan) == sum(r.fan_out for r in fan) == graph.pairs(edges).count()
    assert graph.closure(edges, 3) is None


def test_blast_over_condensation(spark, monkeypatch):
    """Bits over levels of components count what the closure counts: cycles of several sizes, long ways, nodes without edges, ids with gaps, edges out of the graph."""
    r = random.Random(2)
    monkeypatch.setattr(graph, "WORDS", 1)
    ids = r.sample(range(1000), 220)
    edges = {(ids[a], ids[b]) for a, b in ((r.randrange(200), r.randrange(200)) for _ in range(150)) if a < b or r.random() < 0.1}
    edges |= {(ids[i], ids[i + 1]) for i in range(100, 104)} | {(ids[0], ids[150])} | {(ids[i], ids[10 + i * 7 % 10]) for i in range(10, 20)}
    rows = [(a, b, k) for a, b in sorted(edges) for k in "xy"[: r.randrange(1, 3)]]
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    e = spark.createDataFrame(rows + [(ids[3], ids[3], "x"), (ids[3], 5000, "x"), (5000, ids[7], "x")], "source long, target long, kind string")
    reach = graph.closure(spark.createDataFrame(rows, "source long, target long, kind string"))
    blast, cycle = graph.blast_and_cycles(nodes, e)
    assert sorted(blast.collect()) == sorted(graph.blast_radius(nodes, reach).collect())
    assert sorted(cycle.collect()) == sorted(graph.cycles(nodes, reach).collect())
    parts, links = graph.condensation(cycle, spark.createDataFrame(rows, "source long, target long, kind string"))
    level = {x.part: x.level for x in graph.levels(parts, links).collect()}
    ways = [(x.source, x.target) for x in links.collect()]
    assert all(level[a] < level[b] for a, b in ways) and all(level[b] == max(level[a] for a, c in ways if c == b) + 1 for _, b in ways)
    assert 4 < max(level.values()) < 12 and cycle.filter('cycle_size > 2').count()


def test_blast_of_nothing(spark):
    nodes, none = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([], "source long, target long, kind string")
    blast, cycle = graph.blast_and_cycles(nodes, none)
    assert sorted(map(tuple, blast.collect())) == [(1, 0), (2, 0)] and sorted(map(tuple, cycle.collect())) == [(1, None, 0), (2, None, 0)]
    assert [x.count() for x in graph.blast_and_cycles(nodes.limit(0), none)] == [0, 0]


def test_cost_by_hand(spark):
    df = spark.createDataFrame([("python", 1200, 150, 50, 32000, None), ("markdown", 900, 0, 0, 100, None)], "language string, lines int, blank_lines int, comment_lines int, chars int, complexity int")
    r = totals.estimated(totals.code_totals(df)).first()
    assert r.sloc == 1000 and round(r.effort_months, 6) == 2.4 and round(r.schedule_months, 6) == 3.486746 and round(r.people, 6) == 0.688321 and round(r.cost, 2) == 27017.28
    assert (r.tokens_kept, r.multiplier, r.tokens_spent, r.ai_cost) == (8000, 300, 2400000, 24)
    assert totals.estimated(totals.code_totals(df), CostParams(ai_share=1.0)).first().value == 24


def test_layout_rules():
    assert (layout.iterations(10), layout.iterations(3000), layout.iterations(10**6)) == (300, 150, 60)
