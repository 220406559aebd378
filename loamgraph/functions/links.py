"""Cleaning of link texts found in documents and scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import ascii_lower, clean, dirname, extension, join

#: Extensions of files that are shown, not read.
ASSETS = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".avif", ".ico", ".bmp", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".mp4", ".webm", ".ogg", ".mp3", ".wav", ".pdf"]


def percent_decoded(c: Column) -> Column:
    """%XX only: `+` stays, and a % without two hex digits after it is itself."""
    safe = F.replace(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.try_url_decode(safe)


def weblink(raw: Column) -> Column:
    """A local link's path: trimmed, unquoted, cut at ? or #, decoded; NULL for empty ones, other sites and assets."""
    c = F.regexp_replace(raw, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")
    # a round for each quote that it begins with
    rounds = F.sequence(F.lit(1), F.greatest(F.length(F.regexp_extract(c, r"""^(["'<]*)""", 1)), F.lit(1)))
    c = F.aggregate(rounds, c, lambda s, _: F.regexp_replace(s, r"""(?s)^(?:"(.*)"|'(.*)'|<(.*)>)$""", "$1$2$3"))
    c = percent_decoded(F.regexp_extract(c, r"(?s)^([^?#]*)", 1))
    bad = (c == "") | c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]+:") | c.startswith("//") | ascii_lower(extension(c)).isin(ASSETS)
    return F.when(~bad, c)


def script_path(raw: Column) -> Column:
    """A script's path in a shell or batch file: a leading variable that names a folder is `.`; other expansions give NULL."""
    c = F.regexp_replace(raw, r"^[ \t]+|[ \t]+$", "")
    c = F.regexp_replace(c, r"""^(["'])(.*)\1$""", "$2")
    own = F.regexp_extract(c, r"^(%~dp0|%[^%]*%(?=[\\/])|\$\{[^}]*\}(?=[\\/])|\$[A-Za-z0-9_:]*(?=[\\/]))", 1)
    rest = F.substring(c, F.length(own) + 1, F.length(c))
    led = F.when(rest.rlike(r"^[\\/]"), F.concat(F.lit("."), rest)).otherwise(F.concat(F.lit("./"), rest))
    return F.when((c == "") | rest.rlike(r"[$%(]"), None).when(own != "", led).otherwise(c)


def has_extension(name: Column, extensions: list[str]) -> Column:
    low = ascii_lower(name)
    out = F.lit(False)
    for e in extensions:
        out = out | F.endswith(low, F.lit(e))
    return out


def wiki_targets(text: Column) -> Column:
    """Targets of [[target|alias#part]]."""
    inner = F.regexp_extract_all(text, F.lit(r"(?s)\[\[(.*?)\]\]"), 1)
    return F.transform(inner, lambda x: F.regexp_extract(x, r"(?s)^([^|#]*)", 1))


def is_weak(kind: Column, file: Column, subpath: Column) -> Column:
    """A file node that points at a node of another canvas."""
    return F.coalesce((kind == "file") & F.endswith(ascii_lower(file), F.lit(".canvas")) & subpath.rlike(r"^#."), F.lit(False))


def canvas_links(kind: Column, file: Column, subpath: Column, text: Column) -> Column:
    """Names of the canvases a node links to, weak links aside."""
    ends = lambda x: F.endswith(ascii_lower(x), F.lit(".canvas"))
    none = F.array().cast("array<string>")
    of_file = F.when(ends(file) & ~is_weak(kind, file, subpath), F.array(file)).otherwise(none)
    return F.coalesce(F.when(kind == "file", of_file).when(kind == "text", F.filter(wiki_targets(text), ends)), none)


def folder_links(kind: Column, file: Column, text: Column) -> Column:
    """Names of other things than canvases that a node links to."""
    ends = lambda x: F.endswith(ascii_lower(x), F.lit(".canvas"))
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(kind == "file", F.filter(F.array(file), lambda x: (x != "") & ~ends(x))).when(kind == "text", F.filter(wiki_targets(text), lambda x: (x != "") & ~ends(x))), none)


def project_path(document: Column, target: Column) -> Column:
    """A link of a document as a clean path."""
    absolute = target.rlike(r"^([/\\]|[A-Za-z]:)")
    return clean(F.when(absolute, target).otherwise(join(dirname(document), target)))


def note_key(target: Column) -> Column:
    """Key of a Markdown note: lower-case name without its extension."""
    return F.concat(F.lit("mdnote:"), F.regexp_replace(ascii_lower(F.regexp_extract(target, r"([^/\\]*)$", 1)), r"\.(md|markdown)$", ""))
