"""graph.json, one node-link document of any size, as a Spark data source.

Written, it is a folder: parts that hold the members of one section each, in
order, and a manifest that names them; put between the section's brackets one
after the other they are the document, which assemble() does without holding
it. Parts count only once the manifest names them, so tasks may fail, run twice
or be given up.

Read, it is such a folder, or a document of any origin that is cut into
stretches of bytes. Where a stretch begins, inside which string, how deep and
in which section, follows from what all stretches before it do: a first job
tells for each what it does if it begins inside a string and if it doesn't,
and sums over the stretches decide. A task passes on each member that begins in
its stretch as soon as it has read it to its end, so it holds some megabytes
and one member.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .files import with_ids

MANIFEST = "manifest.json"
#: Sections of the document and the fields of their members, in the order in which they are written.
SECTIONS = ["nodes", "links", "clones"]
STATS = ["lines", "blank_lines", "comment_lines", "chars", "max_indent", "parse_errors", "complexity", "functions", "max_function_complexity", "fan_in", "fan_out", "blast_radius", "cycle_id", "cycle_size", "unresolved", "git_commits", "git_authors", "hotspot_rank"]
LINK, CLONE = ["source", "target", "kind"], ["a", "a_line", "a_end", "b", "b_line", "b_end"]
SCHEMA = "section string, offset long, value string"
#: Bytes of a stretch, bytes that are read in one step, and how far before a bracket its key is looked for.
STRETCH, STEP, CONTEXT = 64 << 20, 4 << 20, 4096
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


# --- the structure of bytes ----------------------------------------------------------


def _quotes(data: np.ndarray) -> np.ndarray:
    """Whether each byte is a quote that begins or ends a string; data doesn't begin with an escaped byte."""
    out = data == 34
    slash = np.flatnonzero(data == 92)
    if len(slash):
        first = np.concatenate([[True], np.diff(slash) > 1])
        start = slash[first]
        length = np.diff(np.concatenate([np.flatnonzero(first), [len(slash)]]))
        after = start + length
        after = after[(length % 2 == 1) & (after < len(data))]
        out[after] = False
    return out


def _brackets(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(places of brackets outside strings, +1 or -1 for each, whether a string is open at the end)."""
    quotes = _quotes(data)
    open_ = (np.cumsum(quotes) + inside) % 2 == 1
    place = np.flatnonzero(((data == 123) | (data == 91) | (data == 125) | (data == 93)) & ~open_)
    return place, np.where((data[place] == 123) | (data[place] == 91), 1, -1), bool(open_[-1]) if len(data) else inside


def _key(before: bytes) -> str | None:
    """The key that `before` ends with, up to its colon."""
    found = _KEY.search(before)
    try:
        return json.loads(b'"' + found[1] + b'"', strict=False) if found else None
    except ValueError:  # not a key after all: the other way to begin is the right one
        return None


@dataclass
class State:
    """Where a place in the document is: inside a string, how many brackets deep, in which section."""

    inside: bool = False
    depth: int = 0
    section: str | None = None


def boundary(f, at: int, size: int) -> int:
    """The first place from `at` on whose byte isn't escaped."""
    while 0 < at < size:
        f.seek(at - 1)
        if f.read(1) != b"\\":
            break
        at += 1
    return min(at, size)


def _steps(f, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of a stretch, STEP or so at a time, never cut before an escaped byte."""
    f.seek(start)
    while start < stop:
        data = f.read(min(STEP, stop - start))
        while data.endswith(b"\\") and (more := f.read(1)):
            data += more
        if not data:
            return
        yield start, data
        start += len(data)


def summary(f, start: int, stop: int) -> dict:
    """What a stretch does: for both ways to begin, whether it ends inside a string, how much deeper, and the last key opened at each depth, counted from the start."""
    f.seek(max(0, start - CONTEXT))
    context = f.read(start - max(0, start - CONTEXT))
    told = [{"inside": bool(h), "depth": 0, "keys": {}} for h in (0, 1)]
    for _, data in _steps(f, start, stop):
        array = np.frombuffer(data, np.uint8)
        for t in told:
            place, way, ends = _brackets(array, t["inside"])
            depth = t["depth"] + np.cumsum(way) - (way > 0)  # before an opening bracket, after a closing one
            opens = np.flatnonzero(way > 0)
            last, where = np.unique(depth[opens][::-1], return_index=True)
            for d, k in zip(last.tolist(), opens[::-1][where].tolist(), strict=True):
                at = int(place[k])
                t["keys"][d] = [_key((context + data[max(0, at - CONTEXT) : at])[-CONTEXT:] if at < CONTEXT else data[at - CONTEXT : at]), chr(data[at])]
            t["depth"] += int(way.sum())
            t["inside"] = ends
        context = (context + data)[-CONTEXT:]
    return {"start": start, "stop": stop, "told": told}


def states(summaries: list[dict]) -> list[State]:
    """The state each stretch begins in; summaries in order."""
    out, now = [], State()
    for s in summaries:
        out.append(State(now.inside, now.depth, now.section))
        t = s["told"][int(now.inside)]
        opened = t["keys"].get(1 - now.depth)
        section = (opened[0] if opened[1] == "[" else None) if opened else now.section
        now = State(t["inside"], now.depth + t["depth"], section)
    return out


def members(f, start: int, stop: int, size: int, state: State) -> Iterator[tuple[str, int, bytes]]:
    """(section, place, bytes) of the objects in a section's array that begin in the stretch, also if they end behind it."""
    inside, depth, section = state.inside, state.depth, state.section
    f.seek(max(0, start - CONTEXT))
    context = f.read(start - max(0, start - CONTEXT))
    held, held_at = [], -1  # bytes of a member that isn't at its end yet
    for at, data in _steps(f, start, size):
        array = np.frombuffer(data, np.uint8)
        place, way, inside = _brackets(array, inside)
        after = depth + np.cumsum(way)
        before = after - way
        # only the brackets of the document's second level and of members matter
        for k in np.flatnonzero(np.minimum(before, after) <= 2).tolist():
            p, low = int(place[k]), int(min(before[k], after[k]))
            if way[k] > 0 and low == 1:
                section = _key((context + data[:p])[-CONTEXT:]) if data[p] == 91 else None
            elif way[k] > 0 and low == 2 and section is not None and data[p] == 123:
                if at + p >= stop:
                    return
                held, held_at, from_ = [], at + p, p
            elif way[k] < 0 and low == 2 and held_at >= 0:
                held.append(data[from_ if not held else 0 : p + 1])
                yield section, held_at, b"".join(held)
                held, held_at = [], -1
        if held_at >= 0:
            held.append(data[from_ if not held else 0 :])
        elif at + len(data) >= stop:
            return
        depth += int(way.sum())
        context = (context + data)[-CONTEXT:]


# --- the source ------------------------------------------------------------------------


class Stretch(InputPartition):
    def __init__(self, path: str, start: int, stop: int, state: State, section: str | None = None):
        self.path, self.start, self.stop, self.state, self.section = path, start, stop, state, section


class GraphJsonReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.cuts = json.loads(options["stretches"]) if "stretches" in options else None

    def partitions(self) -> list[Stretch]:
        system, at = _open(self.path)
        if system.get_file_info(at).type == fs.FileType.Directory:
            with system.open_input_stream(f"{at}/{MANIFEST}") as f:
                parts = json.loads(f.read())["parts"]
            upto, out = 0, []
            for p in parts:  # places go on over the parts
                out.append(Stretch(f"{self.path}/{p['file']}", upto, p["bytes"], State(False, 2, p["section"]), p["section"]))
                upto += p["bytes"] + 1
            return out
        size = system.get_file_info(at).size
        cuts = self.cuts or [[0, size, False, 0, None]]
        return [Stretch(self.path, a, b, State(inside, depth, section)) for a, b, inside, depth, section in cuts]

    def read(self, part: Stretch | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # a folder without parts
            return
        system, at = _open(part.path)
        size = system.get_file_info(at).size
        start, stop, shift = (0, size, part.start) if part.section else (part.start, part.stop, 0)
        rows, held = [], 0
        with system.open_input_file(at) as f:
            for section, place, data in members(f, start, stop, size, part.state):
                rows.append((section, place + shift, data.decode("utf-8", "replace")))
                held += len(data)
                if held > STEP:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    section, offset, value = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(section, pa.string()), pa.array(offset, pa.int64()), pa.array(value, pa.string())], names=["section", "offset", "value"])


@dataclass
class Written(WriterCommitMessage):
    parts: list[dict]


class GraphJsonWriter(DataSourceArrowWriter):
    """Rows (section, k1, k2, value), dealt out and sorted by them, become parts of the document."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = _open(self.path)
        system.create_dir(at, recursive=True)
        parts, out, now = [], None, None
        try:
            for batch in iterator:
                for section, k1, k2, value in zip(*[batch.column(c).to_pylist() for c in ("section", "k1", "k2", "value")], strict=True):
                    data = value.encode("utf-8", "replace")
                    if section != now:
                        if out:
                            out.close()
                        now = section
                        parts.append({"section": SECTIONS[section], "first": [section, k1, k2, value[:200]], "rows": 0, "bytes": 0, "file": f"part-{uuid.uuid4().hex}.json"})
                        out = system.open_output_stream(f"{at}/{parts[-1]['file']}")
                    p = parts[-1]
                    data = (b",\n" if p["rows"] else b"") + data
                    out.write(data)
                    p["rows"] += 1
                    p["bytes"] += len(data)
        finally:
            if out:
                out.close()
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = _open(self.path)
        system.create_dir(at, recursive=True)
        target = f"{at}/{MANIFEST}"
        old = []
        if system.get_file_info(target).type == fs.FileType.File:
            with system.open_input_stream(target) as f:
                old = json.loads(f.read())["parts"]
        if old and not self.overwrite:
            raise ValueError("a document can't be appended to")
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: p["first"])
        made = f"{target}.{uuid.uuid4().hex}"
        with system.open_output_stream(made) as f:
            f.write(json.dumps({"parts": [{k: v for k, v in p.items() if k != "first"} for p in parts]}).encode())
        system.move(made, target)
        for p in old:
            system.delete_file(f"{at}/{p['file']}")

    def abort(self, messages: list[Written | None]) -> None:
        system, at = _open(self.path)
        for p in (p for m in messages if m for p in m.parts):
            system.delete_file(f"{at}/{p['file']}")


class GraphJsonSource(DataSource):
    """Members of a graph document's sections: section, offset (their order), value (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "graph_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GraphJsonReader:
        return GraphJsonReader(self.options)

    def writer(self, schema, overwrite: bool) -> GraphJsonWriter:
        return GraphJsonWriter(self.options, overwrite)


# --- graphs ------------------------------------------------------------------------------


def write_graph(path: str, nodes: DataFrame, edges: DataFrame, clones: DataFrame | None = None, parts: int | None = None) -> None:
    """Write a graph as the folder `path`, in place of what is there. Nodes are sorted by id, which should be dense, links by their ends and kind.

    Statistics that don't apply (NULL or negative) are left out, as is a commit
    time that isn't positive and an empty list of hot functions.
    """
    spark = nodes.sparkSession
    fields: list[Column] = [F.col("id"), F.col("path"), F.col("language"), *[F.when(F.col(c) >= 0, F.col(c)).alias(c) for c in STATS if c in nodes.columns]]
    if "git_last_commit" in nodes.columns:
        fields.append(F.when(F.col("git_last_commit") > 0, F.col("git_last_commit")).alias("git_last_commit"))
    if "hot" in nodes.columns:
        fields.append(F.when(F.size("hot") > 0, F.col("hot")).alias("hot_functions"))
    rows = nodes.select(F.lit(0).alias("section"), F.col("id").cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.to_json(F.struct(*fields)).alias("value"))
    rows = rows.unionByName(edges.select(F.lit(1).alias("section"), F.col("source").cast("long").alias("k1"), F.col("target").cast("long").alias("k2"), F.to_json(F.struct(*LINK)).alias("value")))
    if clones is not None:
        rows = rows.unionByName(clones.select(F.lit(2).alias("section"), F.col("a").cast("long").alias("k1"), F.col("a_line").cast("long").alias("k2"), F.to_json(F.struct(*CLONE)).alias("value")))
    order = ["section", "k1", "k2", "value"]
    dealt = rows.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    spark.dataSource.register(GraphJsonSource)
    dealt.write.format("graph_json").option("path", path).mode("overwrite").save()


def assemble(path: str, target: str) -> None:
    """Copy a written folder into one document, some megabytes at a time."""
    system, at = _open(path.rstrip("/"))
    out_system, out_at = _open(target)
    with system.open_input_stream(f"{at}/{MANIFEST}") as f:
        parts = json.loads(f.read())["parts"]
    made = f"{out_at}.{uuid.uuid4().hex}"
    with out_system.open_output_stream(made) as out:
        out.write(b'{"directed":true,"graph":{}')
        for section in SECTIONS:
            own = [p for p in parts if p["section"] == section]
            if section == "clones" and not own:
                continue
            out.write(f',\n"{section}":['.encode())
            for k, p in enumerate(own):
                out.write(b",\n" if k else b"\n")
                with system.open_input_stream(f"{at}/{p['file']}") as f:
                    while data := f.read(STEP):
                        out.write(data)
            out.write(b"\n]")
        out.write(b"}\n")
    out_system.move(made, out_at)


def _members(spark: SparkSession, path: str, stretch: int) -> DataFrame:
    spark.dataSource.register(GraphJsonSource)
    rows = spark.read.format("graph_json").option("path", path)
    system, at = _open(path.rstrip("/"))
    info = system.get_file_info(at)
    if info.type == fs.FileType.File and info.size > stretch:
        with system.open_input_file(at) as f:
            cuts = sorted({boundary(f, k, info.size) for k in range(0, info.size, stretch)} | {info.size})

        def tell(batches):
            for batch in batches:
                own, place = _open(path)
                with own.open_input_file(place) as g:
                    told = [json.dumps(summary(g, a, b)) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(told, pa.string())], names=["told"])

        pairs = list(zip(cuts, cuts[1:], strict=False))
        told = [json.loads(r[0]) for r in spark.createDataFrame(pairs, "a long, b long").repartition(len(pairs)).mapInArrow(tell, "told string").collect()]  # a row of a few numbers for each stretch
        told.sort(key=lambda t: t["start"])
        for t in told:
            for h in t["told"]:
                h["keys"] = {int(d): k for d, k in h["keys"].items()}
        rows = rows.option("stretches", json.dumps([[t["start"], t["stop"], s.inside, s.depth, s.section] for t, s in zip(told, states(told), strict=True)]))
    return rows.load()


def read_graph(spark: SparkSession, path: str, stretch: int = STRETCH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, clones) of a document or of a written folder: ids are positions; links without an end and clones out of range go; no `lines` means no statistics."""
    rows = _members(spark, path, stretch)
    node = "path string, language string, " + ", ".join(f"{s} long" for s in STATS) + ", git_last_commit long, hot_functions array<struct<line:int,complexity:int,name:string>>"
    of = lambda section, schema: rows.filter(F.col("section") == section).select("offset", F.from_json("value", schema).alias("m"))
    placed = with_ids(of("nodes", node), "id", "offset")
    n = placed.count()
    stats = [F.when(F.col("m.lines").isNotNull(), F.col(f"m.{c}")).alias(c) for c in STATS]
    nodes = placed.select("id", "m.path", "m.language", *stats, "m.git_last_commit", F.col("m.hot_functions").alias("hot"))
    edges = of("links", "source long, target long, kind string").select("m.*").filter("source is not null and target is not null")
    clones = of("clones", "a long, a_line int, a_end int, b long, b_line int, b_end int").select("m.*").filter(F.col("a").between(0, n - 1) & F.col("b").between(0, n - 1))
    return nodes, edges, clones
