"""What scanners share: results, masking, functions in braces, cleaned links."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from ..functions.links import ASSETS

TYPE, NAMESPACE, PACKAGE = "TYPE", "NAMESPACE", "PACKAGE"
NAME, IMPORT, REQUIRE = "TYPE_NAME", "IMPORT_PATH", "MODULE_REQUIRE"
HOT_LEAST, HOT_MOST, NAME_BYTES = 10, 5, 47


@dataclass
class Facts:
    """What a scanner finds. Places are character offsets."""

    decls: list[tuple[str, str]] = field(default_factory=list)
    refs: list[tuple[str, str, str]] = field(default_factory=list)
    comments: list[tuple[int, int]] = field(default_factory=list)
    #: (start, stop, name) of functions, and places of decisions; None where the language has none
    functions: list[tuple[int, int, str]] | None = None
    branches: list[int] | None = None
    errors: int = 0
    #: text in which tokens are looked for: comments blanked
    code: str = ""

    def declare(self, key: str, kind: str = PACKAGE) -> None:
        if key:
            self.decls.append((kind, key))

    def refer(self, raw: str | None, kind: str = IMPORT, scope: str = "") -> None:
        if raw:
            self.refs.append((kind, raw, scope))


Scanner = Callable[[str, str], Facts]


@dataclass(frozen=True)
class Syntax:
    """Comment and string forms of a language, as one regular expression."""

    line: tuple[str, ...] = ()
    block: tuple[tuple[str, str], ...] = ()
    strings: tuple[str, ...] = (r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?")

    def pattern(self) -> re.Pattern:
        comments = [rf"{re.escape(a)}[^\n]*" if a[-1] != "\b" else a for a in self.line]
        comments += [rf"{re.escape(a)}(?s:.*?)(?:{re.escape(b)}|\Z)" for a, b in self.block]
        return re.compile("(?P<comment>" + "|".join(comments or ["(?!)"]) + ")|(?P<string>" + "|".join(self.strings or ["(?!)"]) + ")")


def blank(s: str) -> str:
    return re.sub(r"[^\n]", " ", s)


@dataclass
class Masked:
    """text with comments blanked (code), and with strings blanked as well (bare); all three have one length."""

    code: str
    bare: str
    comments: list[tuple[int, int]]
    strings: list[tuple[int, int]]
    open_ends: int


def mask(text: str, pattern: re.Pattern, closes: Iterable[str] = ()) -> Masked:
    code, bare, comments, strings, last, bad = [], [], [], [], 0, 0
    for m in pattern.finditer(text):
        piece = m.group()
        if not piece:
            continue
        code.append(text[last : m.start()])
        bare.append(text[last : m.start()])
        hidden = blank(piece)
        if m.lastgroup == "comment":
            comments.append(m.span())
            code.append(hidden)
            bad += any(piece.startswith(a) and not piece.endswith(b) for a, b in closes)
        else:
            strings.append(m.span())
            code.append(piece)
            bad += len(piece) < 2 or piece[-1] not in "\"'`)"
        bare.append(hidden)
        last = m.end()
    code.append(text[last:])
    bare.append(text[last:])
    return Masked("".join(code), "".join(bare), comments, strings, bad)


def closing(bare: str) -> dict[int, int]:
    """Place of each opening brace -> place of its closing one (the text's end for those left open)."""
    out, stack = {}, []
    for m in re.finditer(r"[{}]", bare):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out | dict.fromkeys(stack, len(bare))


def unbalanced(bare: str) -> int:
    return sum(abs(bare.count(a) - bare.count(b)) for a, b in ("()", "[]", "{}"))


def brace_functions(bare: str, heads: re.Pattern, not_names: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """Functions whose head matches and goes on to a brace; the head's group `name` is the name."""
    ends, out = closing(bare), []
    for m in heads.finditer(bare):
        name = (m.groupdict().get("name") or "").strip()
        if name in not_names:
            continue
        at = m.end() - 1 if bare[m.end() - 1 : m.end()] == "{" else None
        stop = ends.get(at, m.end()) if at is not None else m.end()
        out.append((m.start() + len(m.group()) - len(m.group().lstrip()), stop, name))
    return out


def places(bare: str, pattern: re.Pattern) -> list[int]:
    return [m.start() for m in pattern.finditer(bare)]


def trailing(parts: list[str], sep: str, most: int = 8) -> list[str]:
    return [sep.join(parts[-n:]) for n in range(1, min(most, len(parts)) + 1)]


def weblink(raw: str) -> str | None:
    """A local link's path; None for empty ones, other sites and assets."""
    s = raw.strip(" \t\n\r\f")
    while len(s) >= 2 and (s[0], s[-1]) in {('"', '"'), ("'", "'"), ("<", ">")}:
        s = s[1:-1]
    s = re.split(r"[?#]", s, maxsplit=1)[0]
    s = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), s.encode("utf-8", "replace")).decode("utf-8", "replace")
    if not s or s.startswith("//") or re.match(r"[A-Za-z][A-Za-z0-9+.\-]+:", s):
        return None
    name = s.rsplit("/", 1)[-1]
    return None if "." in name and "." + name.rsplit(".", 1)[1].lower() in ASSETS else s


def script_path(raw: str) -> str | None:
    """A script's path in a batch or PowerShell file; None if an expansion other than a leading folder is in it."""
    s = raw.strip(" \t")
    if len(s) >= 2 and s[0] == s[-1] and s[0] in "\"'":
        s = s[1:-1]
    m = re.match(r"%~dp0|%[^%]*%(?=[\\/])|\$\{[^}]*\}(?=[\\/])|\$[A-Za-z0-9_:]*(?=[\\/])", s)
    rest = s[m.end() :] if m else s
    if not s or re.search(r"[$%(]", rest):
        return None
    return ("." if rest[:1] in ("\\", "/") else "./") + rest if m else s


TOKEN = re.compile(r"""[^\W\d]\w*|\d[\w.]*|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?|&&|\|\||[-+*/%=!<>&|^]=|=>|->|::|\+\+|--|<<|>>|\?\?|[^\s\w]""")


def statistics(text: str, f: Facts) -> dict:
    """Line and function statistics of a scanned text."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    if starts[-1] == len(text):
        starts.pop()  # a last line end opens no line, and an empty text has none
    row = lambda at: max(0, bisect.bisect_right(starts, at) - 1)
    touched, led = set(), set()
    for a, b in f.comments:
        first, last = row(a), row(max(a, b - 1))
        touched.update(range(first, last + 1))
        led.update(range(first + 1, last + 1))
        if not text[starts[first] : a].strip(" \t\r\f"):
            led.add(first)
    ends = [*starts[1:], len(text)][: len(starts)]
    blank_lines, widest, before, ups = 0, 0, -1, [0] * 9
    for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
        line = text[a:b]
        if not line.strip(" \t\r\n\f"):
            blank_lines += 1
            continue
        if i in led:
            continue
        lead = line[: len(line) - len(line.lstrip(" \t"))]
        w = len(lead) + 3 * lead.count("\t")
        widest = max(widest, w)
        if before >= 0 and 0 < w - before <= 8:
            ups[w - before] += 1
        before = w
    step = max(range(1, 9), key=lambda d: (ups[d], -d))
    out = {"lines": len(starts), "blank_lines": blank_lines, "comment_lines": len(touched), "chars": len(text.encode("utf-8", "replace")), "max_indent": widest // step if ups[step] else 0, "parse_errors": f.errors, "complexity": None, "functions": None, "max_function_complexity": None, "hot": []}
    if f.branches is not None:
        out["complexity"] = len(f.branches) + 1
    if f.functions is not None:
        spans = sorted(f.functions, key=lambda s: (s[0], -s[1]))
        count = [1] * len(spans)
        # spans nest, so the innermost open one is the last that began
        at, still = 0, []
        for p in sorted(f.branches or []):
            while at < len(spans) and spans[at][0] <= p:
                while still and spans[still[-1]][1] <= spans[at][0]:
                    still.pop()
                still.append(at)
                at += 1
            while still and spans[still[-1]][1] <= p:
                still.pop()
            if still:
                count[still[-1]] += 1
        out["functions"], out["max_function_complexity"] = len(spans), max(count, default=0)
        # of equals, the function that ends first stays first
        order = sorted((i for i in range(len(spans)) if count[i] >= HOT_LEAST), key=lambda i: (-count[i], spans[i][1]))
        for i in order[:HOT_MOST]:
            name = spans[i][2].encode("utf-8", "replace")[:NAME_BYTES].decode("utf-8", "ignore")
            out["hot"].append({"line": row(spans[i][0]) + 1, "complexity": count[i], "name": name})
    return out


def tokens(text: str, f: Facts) -> tuple[list[str], list[int]]:
    """Token texts, comments aside, and the line of each from 1."""
    toks, rows, at, line = [], [], 0, 1
    for m in TOKEN.finditer(f.code):
        line += f.code.count("\n", at, m.start())
        at = m.start()
        toks.append(m.group())
        rows.append(line)
    return toks, rows
