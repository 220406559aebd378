"""A project as one Markdown text: depth first over its diagrams. Small frames are collected, as the text is one file."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import links
from ..functions.values import node_title, short_number
from ..operators import canvas, graph, notes, totals
from ..sources.documents import Project

MANUAL, BRIEF = "manual", "llm"


def _money(spark, values: dict[str, float], currency: str) -> dict[str, str]:
    row = spark.range(1).select(*[short_number(F.lit(float(v)), currency).alias(k) for k, v in values.items()]).first()
    return row.asDict()


def code_summary(stats: DataFrame, edges: DataFrame, all_notes: DataFrame, project: Project) -> list[str]:
    """Lines about the code behind a box: size, languages, cost, most used files, notes."""
    spark = stats.sparkSession
    t = totals.estimated(totals.code_totals(stats), project.cost).first()
    n, links_n = stats.count(), edges.count()
    out = [f"{n} files, {links_n} dependencies."]
    langs = graph.language_histogram(stats).collect()
    if langs:
        out.append("- Languages: " + ", ".join(f"{r['language']} ({r['n']})" for r in langs))
    if t["sloc"]:
        m = _money(spark, {"value": t["value"], "cost": t["cost"]}, project.cost.currency)
        out.append(f"- Value: ~{m['value']} ({t['sloc']} lines; ~{m['cost']} by hand)")
    top = graph.top_depended(edges).join(stats.select("id", "path"), "id").orderBy(F.desc("uses"), "id").collect()
    if top:
        out.append("- Most used: " + ", ".join(f"{r['path']} ({r['uses']})" for r in top))
    about = notes.for_paths(all_notes, stats.select("path")).join(all_notes.select("id", "line", "body"), "id").orderBy("path", "id").collect()
    out += [f"- Note on {r['path']}{':' + str(r['line']) if r['line'] else ''}: {r['body']}" for r in about]
    return out


def export_project(project: Project, root: str, nodes: DataFrame, edges: DataFrame, stats: DataFrame, deps: DataFrame, all_notes: DataFrame, style: str = MANUAL, today: str | None = None) -> str:
    """nodes and edges of all diagrams, stats and deps of the code, notes -> the text."""
    spark = nodes.sparkSession
    boxes = canvas.reading_order(nodes).join(nodes, ["canvas", "id"]).join(canvas.containing_group(nodes), ["canvas", "id"], "left")
    title = node_title(F.col("type"), F.col("text"), F.col("file"), F.col("url"), F.col("label"))
    children = F.transform(links.canvas_links(F.col("type"), F.col("file"), F.col("subpath"), F.col("text")), lambda x: links.project_path(F.col("canvas"), x))
    folders = F.transform(links.folder_links(F.col("type"), F.col("file"), F.col("text")), lambda x: links.project_path(F.col("canvas"), x))
    weak = links.is_weak(F.col("type"), F.col("file"), F.col("subpath"))
    rows = boxes.select("canvas", "id", "type", "text", "place", "group_id", title.alias("title"), children.alias("children"), folders.alias("folders"), weak.alias("weak")).orderBy("canvas", "place").collect()
    wires = canvas.connections(nodes, edges).orderBy("canvas", "ord").collect()
    targets = {(r["canvas"], r["id"]): r for r in canvas.weak_targets(nodes).collect()}
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["canvas"], []).append(r)
    out: list[str] = []
    heading = lambda level, text: out.extend([f"{'#' * min(level, 6)} {text}", ""])
    if style == BRIEF:
        out += [f"# System brief: {project.title}", "", "> Context for an assistant: nested diagrams of a system. A section is a diagram, a heading inside it a component with its path from the top. Connections say how components talk; Code sums up the sources behind one.", ""]
    else:
        out += [f"# {project.title}", ""]
    if project.description:
        out += [project.description, ""]
    if style == MANUAL:
        out += [f"_Generated on {today or datetime.date.today().isoformat()}._", ""]
    start = spark.createDataFrame([(0, root)], "start int, canvas string")
    exploded = nodes.select("canvas", F.explode(F.transform(links.folder_links(F.col("type"), F.col("file"), F.col("text")), lambda x: links.project_path(F.col("canvas"), x))).alias("folder"))
    size = totals.estimated(canvas.rollup(start, canvas.links_of(nodes), exploded, stats), project.cost).first()
    if size and size["sloc"]:
        m = _money(spark, {"value": size["value"], "hand": size["cost"], "ai": size["ai_cost"]}, project.cost.currency)
        heading(2, "Estimated cost")
        out += [f"All code linked from this map: {size['sloc']} lines in {size['files']} {'file' if size['files'] == 1 else 'files'}.", "", f"- **Value: ~{m['value']}** ({project.cost.ai_share * 100:.0f}% written by AI)", f"- Written by hand: ~{m['hand']}, {size['effort_months']:.1f} person-months", f"- Written by AI: ~{m['ai']}", ""]
    seen: set[str] = set()

    def box(r, trail: list[str], level: int) -> None:
        if r["weak"]:
            hit = targets.get((r["canvas"], r["id"]))
            heading(level, f"Reference: {hit['title'] if hit and hit['title'] else r['title']}")
            return
        heading(level, " > ".join([*trail, r["title"]]) if style == BRIEF else r["title"] or "Untitled")
        rest = "\n".join((r["text"] or "").strip().split("\n")[1:]).strip()
        if rest:
            out.extend([rest, ""])
        for f in r["folders"]:
            inside = stats.filter((F.col("path") == f) | F.startswith("path", F.lit(f.rstrip("/") + "/")))
            if not inside.isEmpty():
                own = deps.join(inside.select(F.col("id").alias("source")), "source", "left_semi").join(inside.select(F.col("id").alias("target")), "target", "left_semi")
                out.extend([f"Code in `{f}`: " + code_summary(inside, own, all_notes, project)[0], *code_summary(inside, own, all_notes, project)[1:], ""])

    def section(path: str, name: str, trail: list[str], depth: int) -> None:
        seen.add(path)
        own = by.get(path, [])
        heading(2 + depth, " > ".join([*trail, name]) if style == BRIEF and trail else name)
        here = [*trail, name]
        for g in (r for r in own if r["type"] == "group"):
            heading(3 + depth, f"{g['title']} (group)")
            for r in own:
                if r["type"] != "group" and r["group_id"] == g["id"]:
                    box(r, here, 4 + depth)
        for r in own:
            if r["type"] != "group" and r["group_id"] is None:
                box(r, here, 3 + depth)
        lines = [w for w in wires if w["canvas"] == path]
        if lines:
            heading(3 + depth, "Connections")
            out.extend([f"- {w['from_title']} {w['arrow']} {w['to_title']}" + (f": {w['label']}" if w["label"] else "") for w in lines] + [""])
        for r in own:
            for child in r["children"]:
                if child in by and child not in seen:
                    section(child, r["title"], here, depth + 1)

    section(root, "Top level" if style == BRIEF else "Overview", [], 0)
    return "\n".join(out) + "\n"
