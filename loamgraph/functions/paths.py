"""Path expressions: Column -> Column, no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders whose first level below stands for another project.
WRAPPER_DIRS = ["vendor", "vendored", "third_party", "thirdparty", "node_modules", "deps", "external", "extern", "libs", ".deps"]


def ascii_lower(c: Column) -> Column:
    """A-Z only; lower() would fold other letters too."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: expressions that use an argument many times would double at each level of nesting."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def basename(p: Column) -> Column:
    return F.regexp_extract(p, r"([^/]*)$", 1)


def dirname(p: Column) -> Column:
    """Without a slash `.`; a slash in front only: `/`."""
    return let(p, lambda x: F.when(F.instr(x, "/") == 0, ".").otherwise(F.coalesce(F.nullif(F.regexp_replace(x, r"/[^/]*$", ""), F.lit("")), F.lit("/"))))


def extension(p: Column) -> Column:
    """From the last dot of the name on; empty without one."""
    return F.regexp_extract(basename(p), r"(\.[^.]*)$", 1)


def stem(p: Column) -> Column:
    return F.regexp_replace(basename(p), r"\.[^.]*$", "")


def join(a: Column, b: Column) -> Column:
    return F.when(F.endswith(a, F.lit("/")), F.concat(a, b)).otherwise(F.concat(a, F.lit("/"), b))


def _clean(p: Column) -> Column:
    absolute = F.startswith(p, F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")
    last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(".."))
    step = lambda acc, x: (
        F.when(x != "..", F.concat(acc, F.array(x)))
        .when(last(acc) != "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(absolute, acc)
        .otherwise(F.concat(acc, F.array(x)))
    )
    body = F.array_join(F.aggregate(parts, empty, step), "/")
    return let(body, lambda x: F.when(absolute, F.concat(F.lit("/"), x)).when(x == "", ".").otherwise(x))


def clean(p: Column) -> Column:
    """Lexical `.` and `..`: `..` above the root goes, leading ones of a relative path stay; nothing left is `.`."""
    return let(p, _clean)


def relative(target: Column, start: Column) -> Column:
    """The way from folder `start` to `target`, both clean and absolute; `.` if they are the same."""
    t, s = (F.filter(F.split(x, "/"), lambda y: y != "") for x in (target, start))
    # length of the common front: first place where the two differ
    differs = F.array_position(F.zip_with(t, s, lambda x, y: x.eqNullSafe(y)), False)
    common = F.when(differs == 0, F.least(F.size(t), F.size(s))).otherwise(differs - 1).cast("int")
    up = F.array_repeat(F.lit(".."), F.size(s) - common)
    down = F.slice(t, common + 1, F.greatest(F.size(t) - common, F.lit(0)))
    out = F.array_join(F.concat(up, down), "/")
    return F.when(out == "", ".").otherwise(out)


def suffixes(p: Column, sep: str = "/", most: int = 8) -> Column:
    """Trailing parts of a path, the shortest first: c, b/c, a/b/c, joined by sep; `most` of them at most."""
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    n = F.least(F.size(parts), F.lit(most))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), sep))).otherwise(F.array().cast("array<string>"))


def ancestors(folder: Column) -> Column:
    """The folder and those above it, nearest first, down to `/` (or `.` for a relative path)."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    absolute = F.startswith(folder, F.lit("/"))
    up = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.array_join(F.slice(parts, 1, i), "/")))
    top = F.array(F.when(absolute, F.lit("/")).otherwise(F.lit(".")))
    return F.when(F.size(parts) > 0, F.concat(up, top)).otherwise(top)


def common_prefix(least: Column, most: Column) -> Column:
    """Longest common front of all strings between the smallest and the largest, cut back to a separator."""
    both = F.zip_with(F.split(least, ""), F.split(most, ""), lambda x, y: x.eqNullSafe(y))
    at = F.array_position(both, False)
    n = F.when(at == 0, F.least(F.length(least), F.length(most))).otherwise(at - 1).cast("int")
    return F.regexp_extract(F.substring(least, F.lit(1), n), r"^(.*[/\\])", 1)


def group_key(p: Column, prefix: Column) -> Column:
    """First folder below the prefix, and the second as well if the first is a wrapper; empty for a file right there."""
    dirs = F.filter(F.split(F.substring(p, F.length(prefix) + 1, F.length(p)), "/"), lambda x: x != "")
    dirs = F.slice(dirs, 1, F.greatest(F.size(dirs) - 1, F.lit(0)))
    first, second = F.get(dirs, F.lit(0)), F.get(dirs, F.lit(1))
    wrapped = ascii_lower(first).isin(WRAPPER_DIRS) & second.isNotNull()
    return F.when(first.isNull(), "").when(wrapped, F.concat_ws("/", first, second)).otherwise(first)

