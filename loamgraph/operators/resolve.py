"""References to files: an ordered probe of candidate keys as one equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import links, paths

#: Kinds of edges, and what a link's or a module's name may lack, in the order in which it is tried.
LABEL = {"TYPE_NAME": "type_reference", "IMPORT_PATH": "import", "MODULE_REQUIRE": "require"}
SUFFIXES = {"html": ["/index.html", "/index.htm", ".html"], "css": [".css"], "markdown": [".md", ".markdown"]}
JS_EXTENSIONS = [".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".json"]
JS_INDEX = ["/index.ts", "/index.tsx", "/index.d.ts", "/index.js", "/index.jsx", "/index.mjs"]
JS_SOURCE = {".js": [".ts", ".tsx"], ".jsx": [".tsx"], ".mjs": [".mts"], ".cjs": [".cts"]}
SCRIPT_EXTENSIONS = ["", ".ps1", ".psm1", ".psd1", ".bat", ".cmd"]


def symbols(decls: DataFrame) -> DataFrame:
    """(file_id, seq, key) -> (key, file_id): the last declaration in file order has the key."""
    return decls.groupBy("key").agg(F.max_by("file_id", F.struct("file_id", "seq")).alias("file_id"))


def ordered_probe(refs: DataFrame, table: DataFrame) -> DataFrame:
    """refs with column candidates array<string> -> adds target: the file of the first candidate that is declared, NULL if none is.

    Candidates are one row each, joined on the key; refs are kept apart by
    (file_id, seq).
    """
    probes = refs.select("file_id", "seq", F.posexplode("candidates").alias("pos", "key"))
    hits = probes.join(table.select("key", F.col("file_id").alias("target")), "key")
    first = hits.groupBy("file_id", "seq").agg(F.min_by("target", "pos").alias("target"))
    return refs.drop("candidates").join(first, ["file_id", "seq"], "left")


def edges(resolved: DataFrame) -> DataFrame:
    """(source, target, kind) without self-edges, each once. A hit on the file itself has ended the probe before."""
    kind = F.create_map(*[F.lit(x) for kv in LABEL.items() for x in kv])[F.col("kind")]
    return resolved.filter(F.col("target").isNotNull() & (F.col("target") != F.col("file_id"))).select(F.col("file_id").alias("source"), "target", kind.alias("kind")).distinct()


def unresolved(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """file_id, unresolved: every occurrence counts."""
    n = resolved.filter(F.col("target").isNull()).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return files.select("file_id").join(n, "file_id", "left").select("file_id", F.coalesce("n", F.lit(0)).cast("long").alias("unresolved"))


def imports_of(refs: DataFrame) -> DataFrame:
    """file_id, imports: raw texts of imports and requires in order."""
    some = refs.filter(F.col("kind").isin("IMPORT_PATH", "MODULE_REQUIRE"))
    return some.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "raw"))), lambda x: x["raw"]).alias("imports"))


def _none() -> Column:
    return F.array().cast("array<string>")


def _each(base: Column, endings: list[str]) -> Column:
    return F.array(*[F.concat(base, F.lit(e)) for e in endings])


def in_folder(path: Column, raw: Column) -> Column:
    return paths.clean(paths.join(paths.dirname(path), raw))


def weblink(path: Column, link: Column, endings: list[str]) -> Column:
    """Relative: from the page's folder. From `/` on: as it is, then below each folder above the page, nearest first."""
    tries = [*[""], *endings]
    each = lambda base: paths.let(base, lambda b: _each(b, tries))
    relative = each(in_folder(path, link))
    rest = F.substring(link, F.lit(2), F.length(link))
    below = F.flatten(F.transform(paths.ancestors(paths.dirname(path)), lambda d: each(paths.clean(paths.join(d, rest)))))
    return F.when(F.startswith(link, F.lit("/")), F.concat(each(paths.clean(link)), below)).otherwise(relative)


def wiki(path: Column, target: Column) -> Column:
    at = weblink(path, F.concat(F.lit("/"), target), SUFFIXES["markdown"])
    return F.concat(at, F.array(links.note_key(target)))


def dotted(raw: Column, scope: Column, imports: Column) -> Column:
    """The name itself, within its scope, within each import."""
    own = F.when(F.coalesce(scope, F.lit("")) != "", F.array(F.concat_ws(".", scope, raw))).otherwise(_none())
    return F.concat(F.array(raw), own, F.transform(F.coalesce(imports, _none()), lambda i: F.concat_ws(".", i, raw)))


def python(path: Column, raw: Column) -> Column:
    """Absolute: the dotted name. Relative: up a folder for each dot after the first, then the module's four places."""
    dots = F.regexp_extract(raw, r"^(\.*)", 1)
    rest = F.replace(F.substring(raw, F.length(dots) + 1, F.length(raw)), F.lit("."), F.lit("/"))
    up = F.repeat(F.lit("../"), F.length(dots) - 1)
    base = in_folder(path, F.concat(F.lit("./"), up, rest))
    return F.when(dots == "", F.array(raw)).otherwise(paths.let(base, lambda b: _each(b, [".py", ".pyi", "/__init__.py", "/__init__.pyi"])))


def go(raw: Column) -> Column:
    """The whole path, then without leading parts: the longest suffix first."""
    return F.reverse(paths.suffixes(raw, "/", 1000))


def php(path: Column, raw: Column, scope: Column, imports: Column) -> Column:
    bare = F.regexp_replace(raw, r"^\\", "")
    own = F.regexp_replace(bare, r"^(?i:namespace)\\", "")
    scoped = F.when(F.coalesce(scope, F.lit("")) != "", F.array(F.concat(scope, F.lit("\\"), own))).otherwise(_none())
    matching = F.filter(F.coalesce(imports, _none()), lambda i: F.regexp_extract(i, r"([^\\]*)$", 1) == bare)
    near = in_folder(path, raw)
    by_name = F.when(raw.rlike(r"^(?i:namespace)\\"), F.concat(scoped, F.array(own))).when(F.startswith(raw, F.lit("\\")), F.array(bare)).otherwise(F.concat(F.array(raw), scoped, matching, F.array(near)))
    return F.when(F.contains(raw, F.lit("/")), F.array(near)).otherwise(by_name)


def script_file(base: Column) -> Column:
    """Places of a JavaScript or TypeScript module at a path: as it is, with an extension, as its source, as a folder."""
    return paths.let(base, _script_file)


def _script_file(base: Column) -> Column:
    swapped = _none()
    for old, new in JS_SOURCE.items():
        cut = F.substring(base, F.lit(1), F.length(base) - len(old))
        swapped = F.when(F.endswith(base, F.lit(old)), _each(cut, new)).otherwise(swapped)
    return F.concat(F.array(base), _each(base, JS_EXTENSIONS), swapped, _each(base, JS_INDEX))


def javascript(path: Column, raw: Column, config: Column | None = None) -> Column:
    """Relative or absolute paths; others by the nearest configuration's aliases and base folder.

    config: struct(base_url, paths_base, aliases array<struct<prefix, suffix,
    wildcard, targets>>) of the file, NULL without one.
    """
    return paths.let(F.regexp_extract(raw, r"^([^?#]*)", 1), lambda cut: _javascript(path, cut, config))


def _javascript(path: Column, cut: Column, config: Column | None) -> Column:
    local = script_file(F.when(F.startswith(cut, F.lit("/")), paths.clean(cut)).otherwise(in_folder(path, cut)))
    if config is None:
        return F.when(cut.rlike(r"^(/|\.\.?(/|$))"), local).otherwise(_none())
    fits = F.filter(
        F.coalesce(config["aliases"], F.array().cast("array<struct<prefix:string,suffix:string,wildcard:boolean,targets:array<string>>>")),
        lambda a: F.when(a["wildcard"], F.startswith(cut, a["prefix"]) & F.endswith(cut, a["suffix"]) & (F.length(cut) >= F.length(a["prefix"]) + F.length(a["suffix"]))).otherwise(cut == a["prefix"]),
    )
    ranked = F.array_sort(F.transform(fits, lambda a: F.struct((-(~a["wildcard"]).cast("int")).alias("exact"), (-F.length(a["prefix"])).alias("n"), a.alias("a"))))

    def through(best: Column) -> Column:
        star = F.substring(cut, F.length(best["prefix"]) + 1, F.length(cut) - F.length(best["prefix"]) - F.length(best["suffix"]))
        return F.flatten(F.transform(best["targets"], lambda t: script_file(paths.clean(paths.join(config["paths_base"], F.when(best["wildcard"], F.replace(t, F.lit("*"), star)).otherwise(t))))))

    aliased = paths.let(F.get(ranked, F.lit(0))["a"], through)
    based = F.when(config["base_url"].isNotNull(), script_file(paths.clean(paths.join(config["base_url"], cut)))).otherwise(_none())
    bare = F.concat(F.coalesce(aliased, _none()), F.coalesce(based, _none()))
    return F.when(cut.rlike(r"^(/|\.\.?(/|$))"), local).otherwise(bare)


def shell(path: Column, raw: Column) -> Column:
    return F.array(F.when(F.startswith(raw, F.lit("/")), paths.clean(raw)).otherwise(in_folder(path, raw)), F.concat(F.lit("sh:"), paths.basename(raw)))


def windows_script(path: Column, raw: Column) -> Column:
    """By path with and without extensions, as a module folder, by file name in either case, by module name."""
    slashes = F.replace(raw, F.lit("\\"), F.lit("/"))
    at = F.when(slashes.rlike(r"^(/|[A-Za-z]:)"), paths.clean(slashes)).otherwise(in_folder(path, slashes))
    name = paths.basename(slashes)
    by_path = lambda x: F.concat(_each(x, SCRIPT_EXTENSIONS), _each(F.concat(x, F.lit("/"), paths.basename(x)), [".psd1", ".psm1"]))
    by_name = _each(F.concat(F.lit("winscript:"), paths.ascii_lower(name)), SCRIPT_EXTENSIONS)
    module = F.concat(F.lit("psmod:"), F.regexp_replace(paths.ascii_lower(name), r"\.ps[md]1$", ""))
    return F.concat(paths.let(at, by_path), by_name, F.array(module))


def candidates(refs: DataFrame) -> DataFrame:
    """refs (file_id, seq, language, path, kind, raw, scope, imports, config) -> adds candidates by language."""
    lang, path, raw, scope, imports = (F.col(c) for c in ("language", "path", "raw", "scope", "imports"))
    web = lambda k: weblink(path, raw, SUFFIXES[k])
    rules = [
        (["c"], F.array(in_folder(path, raw))),
        (["csharp", "vbnet"], dotted(raw, scope, imports)),
        (["lisp"], F.array(raw)),
        (["python"], python(path, raw)),
        (["go"], go(raw)),
        (["php"], php(path, raw, scope, imports)),
        (["javascript", "typescript", "tsx"], javascript(path, raw, F.col("config"))),
        (["json"], F.array(in_folder(path, raw), F.concat(in_folder(path, raw), F.lit(".json")))),
        (["bash"], shell(path, raw)),
        (["proto"], F.array(F.concat(F.lit("proto:"), F.replace(raw, F.lit("\\"), F.lit("/"))))),
        (["sql"], F.array(F.concat(F.lit("sql:"), raw), F.concat(F.lit("sql:"), F.regexp_extract(raw, r"([^.]*)$", 1)))),
        (["powershell", "batch"], windows_script(path, raw)),
        (["html"], web("html")),
        (["css"], web("css")),
        (["markdown"], F.when(F.startswith(raw, F.lit("wiki:")), wiki(path, F.substring(raw, F.lit(6), F.length(raw)))).otherwise(web("markdown"))),
    ]
    out = _none()
    for langs, c in rules:
        out = F.when(lang.isin(langs), c).otherwise(out)
    return refs.withColumn("candidates", out)
