"""Linked diagram documents: index, search, geometry, roll-up, validation.

canvas_nodes(canvas, ord, id, type, x, y, w, h, color, text, file, subpath,
url, label); canvas_edges(canvas, ord, id, from_node, to_node, from_side,
to_side, from_end, to_end, label).
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import links, paths
from ..functions.values import node_title
from ..session import discard, materialise
from ..sources.files import with_ids

SIDES, ENDS = ["top", "right", "bottom", "left"], ["none", "arrow"]
ROW_GAP, CELL, SEARCH, DEPTH = 40.0, 64.0, 200, 64


def links_of(nodes: DataFrame) -> DataFrame:
    """(canvas, ord, id, target): canvases that nodes link to, as clean paths; weak links aside."""
    names = links.canvas_links(F.col("type"), F.col("file"), F.col("subpath"), F.col("text"))
    rows = nodes.select("canvas", "ord", "id", F.posexplode(names).alias("k", "name"))
    return rows.select("canvas", "ord", "id", "k", links.project_path(F.col("canvas"), F.col("name")).alias("target"))


def reachable(root: DataFrame, links_: DataFrame, canvases: DataFrame) -> DataFrame:
    """Breadth first from root(canvas): canvas, parent, level. Each canvas once, by its shortest trail, then the smallest parent and node.

    Only existing canvases are entered, however far below the root. Levels are
    written one by one, and now and then put together.
    """
    step = links_.join(canvases.select(F.col("canvas").alias("target")), "target", "left_semi").select("canvas", "target").distinct()
    seen = front = materialise(root.select("canvas", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level")).distinct(), "trail")
    tables = [front]
    for level in itertools.count(1):
        new = step.join(front.select("canvas"), "canvas").groupBy(F.col("target").alias("to")).agg(F.min("canvas").alias("parent"))
        new = new.withColumnRenamed("to", "canvas").join(seen, "canvas", "left_anti").select("canvas", "parent", F.lit(level).alias("level"))
        front = materialise(new, "trail")
        tables.append(front)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if level % 16 == 0:
            seen = materialise(seen, "trail")
            tables.append(seen)
    out = materialise(seen, "trails")
    for t in tables:
        discard(t)
    return out


def breadcrumbs(index: DataFrame) -> DataFrame:
    """(canvas, parent) -> canvas, trail: from the root to the canvas. Trails double in length each round, so their number is the logarithm of the depth."""
    now = materialise(index.select("canvas", F.col("parent").alias("top"), F.col("canvas").alias("trail")), "crumbs")
    while not now.filter("top is not null").isEmpty():
        above = now.select(F.col("canvas").alias("top"), F.col("top").alias("next"), F.col("trail").alias("head"))
        longer = now.join(above, "top", "left").select("canvas", F.col("next").alias("top"), F.concat_ws(" > ", "head", "trail").alias("trail"))
        new = materialise(longer, "crumbs")
        discard(now)
        now = new
    return now.select("canvas", "trail")


def entries(nodes: DataFrame) -> DataFrame:
    """What search reads: canvas, ord, id, title, weak, body (the field of the node's type, in lower case; empty without one)."""
    body = F.when(F.col("type") == "text", F.col("text")).when(F.col("type") == "file", F.col("file")).when(F.col("type") == "link", F.col("url")).otherwise(F.col("label"))
    return nodes.select("canvas", "ord", "id", node_title(F.col("type"), F.col("text"), F.col("file"), F.col("url"), F.col("label")).alias("title"), links.is_weak(F.col("type"), F.col("file"), F.col("subpath")).alias("weak"), paths.ascii_lower(F.coalesce(body, F.lit(""))).alias("body"))


def _hits(rows: DataFrame, words: str, most: int | None) -> DataFrame:
    hit = rows.filter(F.contains("body", F.lit(ascii_lower(words))) & ~F.col("weak") & F.lit(bool(words))).orderBy("canvas", "ord")
    return (hit if most is None else hit.limit(most)).select("canvas", "ord", "id", "title")


def search(rows: DataFrame, words: str, most: int | None = SEARCH) -> DataFrame:
    """Entries whose text holds `words` in either case, the first `most` in index order (None: all of them); none for an empty search. Reads all entries; see SearchIndex."""
    return _hits(rows, words, most)


def ascii_lower(words: str) -> str:
    return words.translate({c: c + 32 for c in range(65, 91)})


class SearchIndex:
    """Trigrams of entries and where they stand, as tables in a folder: a search reads the postings of a few grams and verifies what has them all.

    Postings (gram, canvas, ord) lie in folders by a hash of the gram and are
    sorted by it there, so that a search opens a folder for each gram it uses
    and skips most of that; a frequent gram is many rows, never one. How often
    each gram stands is kept beside them, and the rarest of the searched ones
    are used. Words of fewer than three characters are looked for in all entries.
    """

    GRAM, USED = 3, 4

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.entries = spark.read.parquet(f"{self.path}/entries")

    @classmethod
    def build(cls, rows: DataFrame, path: str, folders: int = 64) -> SearchIndex:
        """Write the index of entries() to the folder `path`, in place of what is there. (canvas, ord) should name an entry."""
        path = path.rstrip("/")
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{path}/entries")
        kept = spark.read.schema(rows.schema).parquet(f"{path}/entries").filter(~F.col("weak"))
        at = F.sequence(F.lit(1), F.length("body") - cls.GRAM + 1)
        grams = F.array_distinct(F.transform(at, lambda i: F.substring(F.col("body"), i, F.lit(cls.GRAM))))
        posted = kept.filter(F.length("body") >= cls.GRAM).select("canvas", "ord", F.explode(grams).alias("gram")).withColumn("folder", cls._folder(F.col("gram"), folders))
        posted = posted.repartition("folder", (F.xxhash64("canvas", "ord") % 16).alias("part")) if folders > 1 else posted
        posted.sortWithinPartitions("folder", "gram", "canvas", "ord").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/grams")
        found = spark.read.schema(posted.schema).parquet(f"{path}/grams").groupBy("folder", "gram").agg(F.count(F.lit(1)).alias("n"))
        found.repartition("folder").sortWithinPartitions("folder", "gram").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/counts")
        spark.createDataFrame([(folders,)], "folders int").write.mode("overwrite").parquet(f"{path}/folders")
        return cls(spark, path)

    @staticmethod
    def _folder(gram: Column, folders: int) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(folders)).cast("int")

    def _of(self, table: str, schema: str, grams: list[str]) -> DataFrame:
        folders = self.spark.read.schema("folders int").parquet(f"{self.path}/folders").first()[0]
        places = [r[0] for r in self.spark.createDataFrame([(g,) for g in grams], "gram string").select(self._folder(F.col("gram"), folders)).distinct().collect()]
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        return rows.filter(F.col("folder").isin(places) & F.col("gram").isin(grams))

    def candidates(self, words: str) -> DataFrame:
        """(canvas, ord) of entries that have the rarest grams of `words`, of three characters at least: all that hold the words, and few others."""
        low = ascii_lower(words)
        grams = sorted({low[i : i + self.GRAM] for i in range(len(low) - self.GRAM + 1)})
        known = {r.gram: r.n for r in self._of("counts", "gram string, n long, folder int", grams).select("gram", "n").collect()}  # a row a searched gram
        kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.entries.schema if f.name in ("canvas", "ord"))
        if len(known) < len(grams):
            return self.entries.select("canvas", "ord").limit(0)
        used = sorted(grams, key=lambda g: (known[g], g))[: self.USED]
        posted = self._of("grams", f"{kind}, gram string, folder int", used)
        return posted.groupBy("canvas", "ord").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(used)).select("canvas", "ord")

    def search(self, words: str, most: int | None = SEARCH) -> DataFrame:
        """What search() gives over the entries."""
        rows = self.entries if len(words) < self.GRAM else self.entries.join(self.candidates(words), ["canvas", "ord"], "left_semi")
        return _hits(rows, words, most)


def _level(w: str, h: str, cell: float) -> Column:
    """The level of a box: cells of level k are cell * 2^k wide, and those of its own level about as wide as it is."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col(w), F.col(h), F.lit(cell)) / cell))).cast("int")


def _size(level: str, cell: float) -> Column:
    return F.pow(F.lit(2.0), F.col(level)) * cell


def _in_cells(rows: DataFrame, x: str, y: str, w: str, h: str, cell: float) -> DataFrame:
    """Each box once for every cell of column `level` that it touches: two by two of its own level, fewer above."""
    size = _size("level", cell)
    along = lambda p, n: F.explode(F.sequence(F.floor(F.col(p) / size), F.floor((F.col(p) + F.col(n)) / size)))
    return rows.withColumn("cx", along(x, w)).withColumn("cy", along(y, h))


def _at_levels(rows: DataFrame, of: DataFrame, own: Column) -> DataFrame:
    """rows with column `level`: each level of its canvas in of(canvas, level), from the row's own up. A canvas has as many as its boxes' sizes have doublings, at most."""
    there = of.groupBy("canvas").agg(F.collect_set("level").alias("levels"))
    return rows.withColumn("own_", own).join(there, "canvas").withColumn("level", F.explode(F.filter("levels", lambda x: x >= F.col("own_")))).drop("own_", "levels")


#: Groups of a canvas that are tried first, the smallest ones; each further round tries twice as many.
FIRST = 64


def _rounds(groups: DataFrame) -> DataFrame:
    """groups with column `round`, by their place in order of (area, ord) on their canvas: no group of a later round is smaller."""
    numbered = materialise(with_ids(groups, "number", ["canvas", "area", "g_ord"]), "groups")
    first = numbered.groupBy("canvas").agg(F.min("number").alias("least"))
    place = F.col("number") - F.col("least")
    return materialise(numbered.join(first, "canvas").withColumn("round", F.floor(F.log2(place / FIRST + 1)).cast("int")).drop("number", "least"), "rounds")


def containing_group(nodes: DataFrame, cell: float = CELL) -> DataFrame:
    """canvas, id, group_id: the smallest group around the box's centre, ties to the first; NULL without one.

    Groups are listed in the cells they touch of the level of their size, a
    centre lies in one cell of each level that the canvas has groups on: an
    equi-join on level and cell, then the exact test. Groups of one place and
    size are one, as are equal centres. Groups are tried in rounds, the smallest
    first, and a centre that has found one is done, so that the large groups
    around everything meet only what lies in no smaller one.
    """
    place = ["canvas", "gx", "gy", "gw", "gh"]
    groups = nodes.filter("type = 'group'").select("canvas", F.col("ord").alias("g_ord"), F.col("id").alias("group_id"), F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("w").alias("gw"), F.col("h").alias("gh"))
    groups = groups.groupBy(*place).agg(F.min(F.struct("g_ord", "group_id")).alias("first")).select(*place, "first.*")
    groups = _rounds(groups.withColumns({"level": _level("gw", "gh", cell), "area": F.col("gw") * F.col("gh")}))
    boxes = nodes.filter("type <> 'group'").select("canvas", "id", (F.col("x") + F.col("w") / 2).alias("mx"), (F.col("y") + F.col("h") / 2).alias("my"))
    left = materialise(boxes.select("canvas", "mx", "my").filter("mx is not null and my is not null").distinct(), "centres")
    inside = (F.col("mx") >= F.col("gx")) & (F.col("mx") <= F.col("gx") + F.col("gw")) & (F.col("my") >= F.col("gy")) & (F.col("my") <= F.col("gy") + F.col("gh"))
    found = []
    for n in range((groups.agg(F.max("round")).first()[0] or 0) + 1):
        tried = groups.filter(F.col("round") == n)
        probes = _at_levels(left, tried, F.lit(0))
        probes = probes.withColumns({"cx": F.floor(F.col("mx") / _size("level", cell)), "cy": F.floor(F.col("my") / _size("level", cell))})
        met = probes.join(_in_cells(tried, "gx", "gy", "gw", "gh", cell), ["canvas", "level", "cx", "cy"]).filter(inside)
        found.append(materialise(met.groupBy("canvas", "mx", "my").agg(F.min_by("group_id", F.struct("area", "g_ord")).alias("group_id")), "found"))
        rest = materialise(left.join(found[-1], ["canvas", "mx", "my"], "left_anti"), "centres")
        discard(left)
        left = rest
        if left.isEmpty():
            break
    return boxes.join(reduce(DataFrame.unionByName, found), ["canvas", "mx", "my"], "left").select("canvas", "id", "group_id")


def reading_order(nodes: DataFrame, gap: float = ROW_GAP) -> DataFrame:
    """canvas, id, place: rows are runs of boxes whose tops follow each other within `gap`; left to right in a row."""
    by = Window.partitionBy("canvas").orderBy("y", "x", "ord")
    rows = nodes.withColumn("new", F.when(F.col("y") - F.lag("y").over(by) > gap, 1).otherwise(0)).withColumn("row", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("canvas", "id", F.row_number().over(Window.partitionBy("canvas").orderBy("row", "x", "y", "ord")).cast("long").alias("place"))


def _meetings(small: DataFrame, large: DataFrame, cell: float) -> DataFrame:
    """Pairs of boxes of one canvas, small(s_x, ...) and large(l_x, ...), whose areas overlap, where the second's level is the first's or higher; each once.

    The large one is listed in the cells of its own level, the small one in
    those of each level from its own up that the canvas has. A pair counts in
    the first cell of its common area.
    """
    large = large.withColumn("level", _level("l_w", "l_h", cell))
    small = _at_levels(small, large, _level("s_w", "s_h", cell))
    touch = (F.col("s_x") < F.col("l_x") + F.col("l_w")) & (F.col("l_x") < F.col("s_x") + F.col("s_w")) & (F.col("s_y") < F.col("l_y") + F.col("l_h")) & (F.col("l_y") < F.col("s_y") + F.col("s_h"))
    size = _size("level", cell)
    first = (F.col("cx") == F.floor(F.greatest("s_x", "l_x") / size)) & (F.col("cy") == F.floor(F.greatest("s_y", "l_y") / size))
    listed = _in_cells(small, "s_x", "s_y", "s_w", "s_h", cell)
    return listed.join(_in_cells(large, "l_x", "l_y", "l_w", "l_h", cell), ["canvas", "level", "cx", "cy"]).filter(touch & first)


def _named(nodes: DataFrame, which: str, prefix: str) -> DataFrame:
    return nodes.filter(which).select("canvas", *[F.col(c).alias(f"{prefix}_{c}") for c in ("ord", "id", "x", "y", "w", "h")])


def overlaps(nodes: DataFrame, cell: float = CELL) -> DataFrame:
    """(canvas, a, b): boxes, groups aside, that overlap; a before b. Boxes of any size meet in cells of the larger one's level."""
    met = _meetings(_named(nodes, "type <> 'group'", "s"), _named(nodes, "type <> 'group'", "l"), cell)
    # of two boxes of one level each meets the other: once is enough
    met = met.filter((_level("s_w", "s_h", cell) < F.col("level")) | (F.col("s_ord") < F.col("l_ord")))
    before = F.col("s_ord") < F.col("l_ord")
    return met.select("canvas", F.when(before, F.col("s_id")).otherwise(F.col("l_id")).alias("a"), F.when(before, F.col("l_id")).otherwise(F.col("s_id")).alias("b"))


def straddles(nodes: DataFrame, cell: float = CELL) -> DataFrame:
    """(canvas, id, group_id): boxes that cross a group's edge."""
    within = (F.col("b_x") >= F.col("g_x")) & (F.col("b_y") >= F.col("g_y")) & (F.col("b_x") + F.col("b_w") <= F.col("g_x") + F.col("g_w")) & (F.col("b_y") + F.col("b_h") <= F.col("g_y") + F.col("g_h"))
    box, group = "type <> 'group'", "type = 'group'"
    rename = lambda df, s, to: df.withColumnsRenamed({f"{s}_{c}": f"{to}_{c}" for c in ("ord", "id", "x", "y", "w", "h")})
    smaller = _meetings(_named(nodes, box, "s"), _named(nodes, group, "l"), cell)
    larger = _meetings(_named(nodes, group, "s"), _named(nodes, box, "l"), cell).filter(_level("s_w", "s_h", cell) < F.col("level"))
    met = rename(rename(smaller, "s", "b"), "l", "g").unionByName(rename(rename(larger, "s", "g"), "l", "b"))
    return met.filter(~within).select("canvas", F.col("b_id").alias("id"), F.col("g_id").alias("group_id"))


def connections(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """canvas, ord, from_title, arrow, to_title, label of edges with both ends."""
    titles = nodes.select("canvas", "id", node_title(F.col("type"), F.col("text"), F.col("file"), F.col("url"), F.col("label")).alias("title"))
    start, stop = F.coalesce("from_end", F.lit("none")) == "arrow", F.coalesce("to_end", F.lit("arrow")) == "arrow"
    arrow = F.when(start & stop, "<->").when(stop, "->").when(start, "<-").otherwise("--")
    e = edges.join(titles.withColumnsRenamed({"id": "from_node", "title": "from_title"}), ["canvas", "from_node"]).join(titles.withColumnsRenamed({"id": "to_node", "title": "to_title"}), ["canvas", "to_node"])
    return e.select("canvas", "ord", "from_title", arrow.alias("arrow"), "to_title", F.coalesce("label", F.lit("")).alias("label"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(canvas, id, missing): edge ends that name no node."""
    ends = edges.select("canvas", "id", F.explode(F.array("from_node", "to_node")).alias("missing"))
    return ends.join(nodes.select("canvas", F.col("id").alias("missing")), ["canvas", "missing"], "left_anti").select("canvas", "id", "missing").distinct()


def weak_targets(nodes: DataFrame) -> DataFrame:
    """canvas, id, target_canvas, target_id, title (NULL if the target is missing) of weak links."""
    weak = nodes.filter(links.is_weak(F.col("type"), F.col("file"), F.col("subpath")))
    weak = weak.select("canvas", "id", links.project_path(F.col("canvas"), F.col("file")).alias("target_canvas"), F.substring("subpath", F.lit(2), F.length("subpath")).alias("target_id"))
    titles = nodes.select(F.col("canvas").alias("target_canvas"), F.col("id").alias("target_id"), node_title(F.col("type"), F.col("text"), F.col("file"), F.col("url"), F.col("label")).alias("title"))
    return weak.join(titles, ["target_canvas", "target_id"], "left").select("canvas", "id", "target_canvas", "target_id", "title")


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those in gone(canvas, id), and edges without those that touch them."""
    left = nodes.join(gone, ["canvas", "id"], "left_anti")
    for end in ("from_node", "to_node"):
        edges = edges.join(gone.withColumnRenamed("id", end), ["canvas", end], "left_anti")
    return left, edges


def with_weak_link(nodes: DataFrame, canvas: str, target_canvas: str, target_id: str, at: tuple[float, float]) -> DataFrame:
    """nodes plus a weak link from canvas to a node of another one, unless it is there."""
    spark = nodes.sparkSession
    base = spark.range(1).select(F.lit(canvas).alias("canvas"), paths.relative(F.lit(target_canvas), paths.dirname(F.lit(canvas))).alias("file"), F.lit("#" + target_id).alias("subpath"))
    new = base.join(nodes.select("canvas", "file", "subpath"), ["canvas", "file", "subpath"], "left_anti")
    last = nodes.filter(F.col("canvas") == canvas).agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    new = new.join(F.broadcast(last))  # one row
    made = {"ord": F.col("last") + 1, "id": F.substring(F.sha2(F.concat_ws("\x01", "canvas", "file", "subpath"), 256), 1, 16), "type": F.lit("file"), "x": F.lit(at[0]), "y": F.lit(at[1]), "w": F.lit(250.0), "h": F.lit(60.0)}
    row = [made.get(f.name, F.col(f.name) if f.name in ("canvas", "file", "subpath") else F.lit(None)).cast(f.dataType).alias(f.name) for f in nodes.schema]
    return nodes.unionByName(new.select(*row))


def rollup(starts: DataFrame, links_: DataFrame, folders: DataFrame, stats: DataFrame, depth: int | None = DEPTH) -> DataFrame:
    """Totals of all code below each start, each file once.

    Links are followed `depth` steps (None: to the end).

    starts(start, canvas); links_(canvas, target); folders(canvas, folder);
    stats has path and what code_totals() reads. A start's canvas and those it
    reaches over links contribute the files below their folders.
    """
    from .totals import code_totals

    seen = front = materialise(starts.select("start", "canvas").distinct(), "rollup")
    step = links_.select("canvas", "target").distinct()
    for _ in itertools.count() if depth is None else range(depth):
        new = front.join(step, "canvas").select("start", F.col("target").alias("canvas")).distinct().join(seen, ["start", "canvas"], "left_anti")
        front = materialise(new, "rollup")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    wanted = seen.join(folders, "canvas").select("start", "folder").distinct()
    below = stats.withColumn("folder", F.explode(paths.ancestors(paths.dirname(F.col("path")))))
    files = below.join(wanted, "folder").drop("folder").dropDuplicates(["start", "path"])
    return code_totals(files, "start")


def validate(nodes: DataFrame, edges: DataFrame, root: str, folders: DataFrame | None = None) -> DataFrame:
    """issues(severity, place, message): fields, ids, ends, geometry, reachability; with folders(folder) also what no box covers."""
    place = lambda c="id": F.concat_ws("#", "canvas", c)

    def issue(rows: DataFrame, severity: str, where: Column, message: str) -> DataFrame:
        return rows.select(F.lit(severity).alias("severity"), where.alias("place"), F.lit(message).alias("message"))

    geometry = F.greatest(*[F.col(c).isNull().cast("int") for c in "xywh"]) == 1
    content = {"text": "text", "file": "file", "link": "url"}
    lacks = F.lit(False)
    for kind, column in content.items():
        lacks = lacks | ((F.col("type") == kind) & F.col(column).isNull())
    out = [
        issue(nodes.filter(F.col("id").isNull() | geometry), "error", place(), "a required field is missing"),
        issue(nodes.filter(~F.col("type").isin("text", "file", "link", "group")), "error", place(), "unknown type"),
        issue(nodes.filter(lacks), "error", place(), "the type's content is missing"),
        issue(nodes.filter(~F.col("color").rlike(r"^([1-6]|#[0-9A-Fa-f]{6})$")), "error", place(), "unknown colour"),
        issue(edges.filter(~F.coalesce("from_side", F.lit("top")).isin(SIDES) | ~F.coalesce("to_side", F.lit("top")).isin(SIDES)), "error", place(), "unknown side"),
        issue(nodes.groupBy("canvas", "id").count().filter("count > 1"), "error", place(), "duplicate node id"),
        issue(edges.groupBy("canvas", "id").count().filter("count > 1"), "error", place(), "duplicate edge id"),
        issue(dangling(nodes, edges), "error", place(), "edge to a missing node"),
        issue(weak_targets(nodes).filter("title is null"), "error", place(), "weak link to a missing node"),
        issue(overlaps(nodes), "warning", place("a"), "overlaps another box"),
        issue(straddles(nodes), "warning", place(), "crosses a group's edge"),
        issue(nodes.filter((F.col("type") == "text") & (F.trim("text") == "")), "warning", place(), "the text is empty"),
        issue(edges.filter(F.coalesce("label", F.lit("")) == ""), "warning", place(), "a connection without a label"),
        issue(edges.filter(F.coalesce("id", F.lit("")) == ""), "error", F.col("canvas"), "a connection without an id"),
        issue(links_of(nodes).join(nodes.select(F.col("canvas").alias("target")).distinct(), "target", "left_anti"), "error", place(), "link to a missing diagram"),
    ]
    canvases = nodes.select("canvas").distinct()
    seen = reachable(canvases.filter(F.col("canvas") == root), links_of(nodes), canvases)
    out.append(issue(canvases.join(seen, "canvas", "left_anti"), "error", F.col("canvas"), "not reachable from the root"))
    if folders is not None:
        named = nodes.select(F.explode(F.transform(links.folder_links(F.col("type"), F.col("file"), F.col("text")), lambda x: links.project_path(F.col("canvas"), x))).alias("target"))
        covered = named.select(F.explode(paths.ancestors(F.col("target"))).alias("folder"))
        out.append(issue(folders.join(covered, "folder", "left_anti"), "warning", F.col("folder"), "no box links to or into this folder"))
    rows = out[0]
    for r in out[1:]:
        rows = rows.unionByName(r)
    return rows
