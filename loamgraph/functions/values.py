"""Number formats, sizes, titles, hashes, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def short_number(v: Column, prefix: str = "") -> Column:
    a, p = F.abs(v), F.lit(prefix)
    f = lambda form, x: F.concat(p, F.format_string(form, x))
    return F.when(a >= 1e9, f("%.2fB", v / 1e9)).when(a >= 1e6, f("%.2fM", v / 1e6)).when(a >= 1e3, f("%.1fk", v / 1e3)).when((a >= 10) | (a == 0), f("%.0f", v)).otherwise(f("%.2f", v))


def node_size(lines: Column) -> Column:
    """5 to 16 on a logarithmic scale up to 5,000 lines; 9 without statistics."""
    return F.when(lines.isNull(), 9.0).otherwise(5.0 + 11.0 * F.least(F.lit(1.0), F.log10(F.greatest(lines.cast("double"), F.lit(1.0))) / F.log10(F.lit(5000.0))))


def text_title(text: Column) -> Column:
    """First line that isn't blank, without heading marks, bullet and inline marks."""
    line = F.regexp_extract(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t\r\n]+", ""), r"^([^\n]*)", 1)
    return F.regexp_replace(F.regexp_replace(line, r"^#*(?:[-*] )? *", ""), r"[*`\[\]\r]", "")


def node_title(kind: Column, text: Column, file: Column, url: Column, label: Column) -> Column:
    return F.when(kind == "text", text_title(text)).when(kind == "file", F.regexp_extract(F.coalesce(file, F.lit("")), r"([^/]*)$", 1)).when(kind == "link", url).otherwise(label)


def sql_name(raw: Column) -> Column:
    """Unquoted lower-case SQL identifier."""
    from .paths import ascii_lower

    return ascii_lower(F.translate(raw, "\"`[]", ""))


FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a: for cache names and stored file hashes; inside plans xxhash64 does."""
    h = FNV_START
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


@F.pandas_udf(StringType())
def fnv1a_hex(text):
    """fnv1a() of a string column, 16 hex digits."""
    return text.map(lambda t: None if t is None else f"{fnv1a(t.encode()):016x}")


@F.pandas_udf(StringType())
def folder_colour(key):
    """#rrggbb of a folder: the hue is its hash, so that a name has one colour everywhere."""
    import colorsys

    def of(k):
        if k is None:
            return None
        return "#" + "".join(f"{round(255 * x):02x}" for x in colorsys.hls_to_rgb(fnv1a(k.encode()) % 360 / 360, 0.6, 0.55))

    return key.map(of)


def iso_utc(seconds: Column) -> Column:
    """Unix seconds as ISO 8601 text."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
