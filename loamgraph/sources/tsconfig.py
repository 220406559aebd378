"""tsconfig.json and jsconfig.json: aliases and base folders, inherited over `extends`."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths

ALIASES = "array<struct<prefix:string,suffix:string,wildcard:boolean,targets:array<string>>>"
DEPTH = 5


def loose_json(text: str):
    """JSON with comments and trailing commas."""
    plain = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*(?s:.*?)\*/', lambda m: m[1] or " ", text)
    return json.loads(re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", plain))


def parse(text: str) -> dict:
    try:
        doc = loose_json(text)
        options = doc.get("compilerOptions") or {}
        aliases = None
        if isinstance(options.get("paths"), dict):
            aliases = []
            for key, targets in options["paths"].items():
                before, star, after = key.partition("*")
                aliases.append({"prefix": before, "suffix": after, "wildcard": bool(star), "targets": [t for t in targets if isinstance(t, str)]})
        up = doc.get("extends")
        return {"base": options.get("baseUrl"), "aliases": aliases, "up": up if isinstance(up, str) and up.startswith(".") else None}
    except (ValueError, AttributeError, TypeError):
        return {"base": None, "aliases": None, "up": None}


def configs(files: DataFrame) -> DataFrame:
    """files(path, text) -> dir, config struct(base_url, paths_base, aliases) of each configuration; tsconfig.json before jsconfig.json."""

    def run(batches):
        for b in batches:
            got = [parse(t or "") for t in b["text"]]
            yield pd.DataFrame({"path": b["path"], "base": [g["base"] for g in got], "aliases": [g["aliases"] for g in got], "up": [g["up"] for g in got]})

    # what is extended may have any name
    some = files.filter(F.endswith("path", F.lit(".json")) & (F.contains("text", F.lit('"compilerOptions"')) | F.contains("text", F.lit('"extends"')))).select("path", "text")
    raw = some.mapInPandas(run, f"path string, base string, aliases {ALIASES}, up string")
    d = paths.dirname(F.col("path"))
    base = F.when(F.col("base").isNotNull(), paths.clean(paths.join(d, F.col("base"))))
    up = F.when(F.col("up").isNotNull(), paths.clean(paths.join(d, F.when(F.endswith("up", F.lit(".json")), F.col("up")).otherwise(F.concat("up", F.lit(".json"))))))
    own = raw.select("path", base.alias("base_url"), F.when(F.col("aliases").isNotNull(), F.coalesce(base, d)).alias("paths_base"), "aliases", up.alias("up"))
    out = own
    for _ in range(DEPTH):
        parent = own.select(F.col("path").alias("up"), F.col("base_url").alias("b"), F.col("paths_base").alias("p"), F.col("aliases").alias("a"), F.col("up").alias("u"))
        out = out.join(parent, "up", "left").select("path", F.coalesce("base_url", "b").alias("base_url"), F.coalesce("paths_base", "p").alias("paths_base"), F.coalesce("aliases", "a").alias("aliases"), F.col("u").alias("up"))
    named = out.filter(paths.basename(F.col("path")).isin("tsconfig.json", "jsconfig.json"))
    return named.groupBy(d.alias("dir")).agg(F.max_by(F.struct("base_url", "paths_base", "aliases"), "path").alias("config"))


def nearest(files: DataFrame, found: DataFrame) -> DataFrame:
    """path, config of the nearest folder above each file that has one."""
    up = files.select("path", F.explode(paths.ancestors(paths.dirname(F.col("path")))).alias("dir"))
    return up.join(found, "dir").groupBy("path").agg(F.max_by("config", F.length("dir")).alias("config"))
