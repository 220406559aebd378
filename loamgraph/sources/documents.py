"""Small documents kept beside a project: diagrams, project.json, notes, positions. graph.json: graphjson.py."""

from __future__ import annotations

import datetime
import json
import os
import re
import secrets
import tempfile
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cost import COCOMO, CostParams
from ..functions.values import fnv1a

def write_atomic(path: str, text: str) -> None:
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        f.write(text)
    os.replace(f.name, path)


# --- diagrams --------------------------------------------------------------------

#: Fields of a box and of a connection.
_BOX = "id:string,type:string,text:string,file:string,subpath:string,url:string,label:string,x:double,y:double,width:double,height:double,color:string"
_LINE = "id:string,fromNode:string,toNode:string,fromSide:string,toSide:string,fromEnd:string,toEnd:string,color:string,label:string"


def parse_canvases(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts(canvas, text) -> nodes, edges with defaults filled in; a missing id becomes one made of the place in the file."""
    doc = texts.select("canvas", F.from_json("text", f"nodes array<struct<{_BOX}>>, edges array<struct<{_LINE}>>").alias("d"))
    made = lambda c: F.coalesce(c, F.substring(F.sha2(F.concat_ws("\x01", "canvas", F.col("ord").cast("string")), 256), 1, 16))
    n = doc.select("canvas", F.posexplode("d.nodes").alias("ord", "n"))
    kind = F.when(F.col("n.type").isin("text", "file", "link", "group"), F.col("n.type")).otherwise("text")
    nodes = n.select("canvas", "ord", made(F.col("n.id")).alias("id"), kind.alias("type"), *[F.coalesce(F.col(f"n.{c}"), F.lit(v)).alias(a) for c, v, a in (("x", 0.0, "x"), ("y", 0.0, "y"), ("width", 250.0, "w"), ("height", 60.0, "h"))], *[F.col(f"n.{c}").alias(c) for c in ("color", "text", "file", "subpath", "url", "label")])
    e = doc.select("canvas", F.posexplode("d.edges").alias("ord", "e"))
    names = {"fromNode": "from_node", "toNode": "to_node", "fromSide": "from_side", "toSide": "to_side", "fromEnd": "from_end", "toEnd": "to_end"}
    edges = e.select("canvas", "ord", made(F.col("e.id")).alias("id"), *[F.col(f"e.{k}").alias(v) for k, v in names.items()], F.col("e.label").alias("label"))
    return nodes, edges


def read_canvases(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.canvas")
    return parse_canvases(rows.select(F.regexp_replace(F.input_file_name(), r"^file:/+", "/").alias("canvas"), F.col("value").alias("text")))


def canvas_text(nodes: list[dict], edges: list[dict]) -> str:
    """The file of one diagram; coordinates are rounded, empty values left out."""
    keep = lambda d: {k: v for k, v in d.items() if v is not None}
    box = lambda n: keep({"id": n["id"], "type": n["type"], **{c: n.get(c) for c in ("text", "file", "subpath", "url", "label")}, **{a: round(n[c]) for a, c in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))}, "color": n.get("color")})
    line = lambda e: keep({"id": e["id"], "fromNode": e["from_node"], "fromSide": e.get("from_side"), "fromEnd": e.get("from_end"), "toNode": e["to_node"], "toSide": e.get("to_side"), "toEnd": e.get("to_end"), "label": e.get("label")})
    return json.dumps({"nodes": [box(n) for n in nodes], "edges": [line(e) for e in edges]}, indent=2, ensure_ascii=False) + "\n"


def write_canvas(path: str, nodes: DataFrame, edges: DataFrame) -> None:
    """Write the rows of one diagram; a diagram is small."""
    pick = lambda df: [r.asDict() for r in df.filter(F.col("canvas") == path).orderBy("ord").collect()]
    write_atomic(path, canvas_text(pick(nodes), pick(edges)))


def new_id() -> str:
    return secrets.token_hex(8)


# --- project.json ----------------------------------------------------------------


@dataclass(frozen=True)
class Project:
    title: str
    root: str
    description: str = ""
    created: str = ""
    cost: CostParams = field(default_factory=CostParams)


def parse_project(text: str, default_title: str = "") -> Project:
    """A root is required; cost values out of range keep their defaults."""
    doc = json.loads(text)
    if not isinstance(doc.get("root"), str):
        raise ValueError("project.json needs a root")
    got, cost = doc.get("cost") or {}, CostParams()
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    fits = {"salary": lambda v: v >= 0, "overhead": lambda v: v > 0, "ai_share": lambda v: 0 <= v <= 1, "token_price": lambda v: v >= 0, "reasoning_multiplier": lambda v: v > 0, "chars_per_token": lambda v: v > 0}
    for key, ok in fits.items():
        if number(got.get(key)) and ok(got[key]):
            cost = cost.having(**{key: float(got[key])})
    if got.get("mode") in COCOMO:
        cost = cost.having(mode=got["mode"])
    if isinstance(got.get("currency"), str):
        cost = cost.having(currency=got["currency"])
    return Project(doc.get("title") or default_title, doc["root"], doc.get("description") or "", doc.get("created") or "", cost)


def project_text(p: Project) -> str:
    doc = {"title": p.title, "description": p.description, "root": p.root, "created": p.created, "cost": p.cost.__dict__}
    return json.dumps(doc, indent=2, ensure_ascii=False) + "\n"


def create_project(folder: str, title: str) -> Project:
    """A new project with an empty root diagram."""
    p = Project(title, "root.canvas", created=now())
    write_atomic(os.path.join(folder, "root.canvas"), canvas_text([], []))
    write_atomic(os.path.join(folder, "project.json"), project_text(p))
    return p


# --- notes: Markdown blocks between lines that are exactly --- -----------------------

_MARK = re.compile(r"<!--\s*[\w-]*?(note|group)\s+(.*?)-->", re.S)
_ATTRIBUTE = re.compile(r'(\w+)=(?:"((?:\\.|[^"\\])*)"|(\S+))')


def now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def note_blocks(text: str) -> list[tuple[int, int, dict]]:
    """(start, stop, note) of the blocks that hold a note; stop is where the separator after the block starts."""
    cuts = [m.span() for m in re.finditer(r"(?m)^---$", text)]
    out = []
    for (_, a), (b, _) in zip(cuts, cuts[1:], strict=False):
        m = _MARK.search(text, a, b)
        if m:
            got = {k: (quoted if quoted or not bare else bare).replace('\\"', '"') for k, quoted, bare in _ATTRIBUTE.findall(m[2])}
            out.append((a, b, {"id": got.get("id"), "path": got.get("path") if m[1] == "note" else None, "group_paths": got["paths"].split("|") if m[1] == "group" and "paths" in got else None, "line": int(got["line"]) if got.get("line", "").isdigit() else None, "hash": got.get("hash"), "created": got.get("created"), "updated": got.get("updated"), "body": text[m.end() : b].strip("\n")}))
    return out


NOTES = "id string, path string, group_paths array<string>, line int, hash string, created string, updated string, body string"


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes of one or many files: id, path, group_paths, line, hash, created, updated, body."""
    order = [c.split()[0] for c in NOTES.split(", ")]

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [n for t in b["value"] for _, _, n in note_blocks(t)]
            yield pd.DataFrame(rows, columns=order).astype({"line": "Int32"})

    return spark.read.text(path, wholetext=True).mapInPandas(run, NOTES)


def _block(note: dict) -> str:
    quote = lambda v: '"' + v.replace('"', '\\"') + '"'
    if note.get("group_paths"):
        head, mark = f"## Group: {len(note['group_paths'])} files", f"loamgraph-group id={note['id']} paths={quote('|'.join(note['group_paths']))}"
    else:
        head, mark = f"## {note['path']}" + (f":{note['line']}" if note.get("line") else ""), f"loamgraph-note id={note['id']} path={quote(note['path'])}"
    mark += "".join(f" {k}={note[k]}" for k in ("hash", "line", "created", "updated") if note.get(k) is not None)
    return f"\n{head}\n\n<!-- {mark} -->\n\n{note['body']}\n\n"


def add_note(text: str, body: str, path: str | None = None, group_paths: list[str] | None = None, line: int | None = None, hash_: str | None = None, at: str | None = None) -> tuple[str, str]:
    """(new text, id): a block is appended, everything else stays as it is. Ids of notes and groups count together."""
    last = max((int(n["id"][1:]) for _, _, n in note_blocks(text) if n["id"] and n["id"][1:].isdigit()), default=0)
    note_id = ("g" if group_paths else "n") + str(last + 1)
    at = at or now()
    note = {"id": note_id, "path": path, "group_paths": group_paths, "line": line, "hash": hash_, "created": at, "updated": at, "body": body}
    ends = re.search(r"(?m)^---\n?\Z", text)
    base = text if ends else text + ("" if not text or text.endswith("\n") else "\n") + "---\n"
    base = base if base.endswith("\n") else base + "\n"
    return base + _block(note) + "---\n", note_id


def update_note(text: str, note_id: str, body: str, at: str | None = None) -> str:
    for a, b, n in note_blocks(text):
        if n["id"] == note_id:
            return text[:a] + "\n" + _block(n | {"body": body, "updated": at or now()}) + text[b:]
    return text


def delete_note(text: str, note_id: str) -> str:
    for a, b, n in note_blocks(text):
        if n["id"] == note_id:
            return text[:a] + text[b + 3 :]
    return text


# --- positions -------------------------------------------------------------------


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema("version int, positions array<struct<path:string,hash:string,x:float,y:float,z:float>>").json(path, multiLine=True)
    return doc.select(F.explode("positions").alias("p")).select("p.*")


def positions_text(rows: list[dict]) -> str:
    return json.dumps({"version": 1, "positions": rows}, indent=1) + "\n"


def cache_name(folders: list[str]) -> str:
    """Name of the build folder of a set of roots: the first one's name and a hash of all of them."""
    dirs = sorted(os.path.realpath(d.rstrip("/\\") or "/") for d in folders)
    mark = f"{fnv1a(chr(10).join(dirs).encode()) & 0xFFFFFFFF:08x}"
    base = os.path.basename(dirs[0])
    return f"{base}-{mark}" if len(dirs) == 1 else f"{base}-and-{len(dirs) - 1}-{mark}"
