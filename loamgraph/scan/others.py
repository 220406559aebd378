"""Python, Lisp, Visual Basic, JSON, Protocol Buffers, SQL, HTML, CSS, Markdown."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from html.parser import HTMLParser

from .base import IMPORT, NAME, REQUIRE, TYPE, Facts, Syntax, mask, places, trailing, unbalanced, weblink

#: Whether Visual Basic's Inherits and Implements give references; off, as results that others compare with have none.
VB_BASES = False


def _module_keys(path: str) -> list[str]:
    parts = [p for p in re.sub(r"\.pyi?$", "", path).split("/") if p]
    if parts and parts[-1] == "__init__":
        parts.pop()
    return trailing(parts, ".")


def python(path: str, text: str) -> Facts:
    f = Facts(code=text)
    f.declare(path)
    for key in _module_keys(path):
        f.declare(key)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                f.comments.append((starts[t.start[0] - 1] + t.start[1], starts[t.end[0] - 1] + t.end[1]))
    except (tokenize.TokenError, SyntaxError, IndexError):
        f.comments = [m.span() for m in re.finditer(r"(?m)(?<![\"'\w])#[^\n]*", text)]
    for a, b in reversed(f.comments):
        f.code = f.code[:a] + " " * (b - a) + f.code[b:]
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_lines(f)
    lines = text.split("\n")
    at = lambda line, col: starts[min(line, len(starts)) - 1] + len(lines[line - 1].encode()[:col].decode(errors="ignore")) if line <= len(lines) else len(text)
    f.branches, f.functions = [], []
    found = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            found += [(n.lineno, n.col_offset, a.name) for a in n.names]
        elif isinstance(n, ast.ImportFrom) and n.module != "__future__":
            base = "." * n.level + (n.module or "")
            found.append((n.lineno, n.col_offset, base))
            found += [(n.lineno, n.col_offset, (base if base.endswith(".") else base + ".") + a.name) for a in n.names if a.name != "*"]
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
            f.functions.append((at(n.lineno, n.col_offset), at(n.end_lineno, n.end_col_offset), getattr(n, "name", "")))
        here = at(n.lineno, n.col_offset) if hasattr(n, "lineno") else 0
        if isinstance(n, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp)):
            f.branches.append(here)
        elif isinstance(n, ast.BoolOp):
            f.branches += [here] * (len(n.values) - 1)
        elif isinstance(n, ast.comprehension):
            f.branches += [at(n.target.lineno, n.target.col_offset)] * (1 + len(n.ifs))
        elif isinstance(n, ast.match_case):
            f.branches.append(at(n.pattern.lineno, n.pattern.col_offset))
    for *_, raw in sorted(found, key=lambda x: x[:2]):
        f.refer(raw)
    return f


def _python_lines(f: Facts) -> Facts:
    """Imports and decisions by line shape, for text that doesn't parse; it counts as one error."""
    f.errors = 1
    for m in re.finditer(r"(?m)^[ \t]*(?:import[ \t]+([\w., \t]+)|from[ \t]+([\w.]+)[ \t]+import[ \t]*\(?([\w,\s*]*))", f.code):
        if m[1]:
            for name in m[1].split(","):
                f.refer(name.split(" as ")[0].strip())
        elif m[2] != "__future__":
            f.refer(m[2])
            for name in m[3].split(","):
                name = name.split(" as ")[0].strip()
                if re.fullmatch(r"\w+", name):
                    f.refer((m[2] if m[2].endswith(".") else m[2] + ".") + name)
    f.branches = places(f.code, re.compile(r"\b(?:if|elif|for|while|except|and|or)\b"))
    f.functions = [(m.start(), m.end(), m[1]) for m in re.finditer(r"\bdef[ \t]+(\w+)", f.code)]
    return f


_LISP = Syntax(line=(";",), block=(("#|", "|#"),), strings=(r'"(?:\\(?s:.)|[^"\\])*"?',)).pattern()
_LISP_NAME = r"""[#']*:?["']?([^\s()"']+)["']?"""


def lisp(path: str, text: str) -> Facts:
    m, f = mask(text, _LISP, [("#|", "|#")]), Facts()
    f.comments, f.code, f.errors = m.comments, m.code, abs(m.bare.count("(") - m.bare.count(")"))
    for x in re.finditer(rf"(?im)^\((?:in-package|defpackage)\s+{_LISP_NAME}", m.code):
        f.declare(x[1])
    for x in re.finditer(rf"(?i)\((?:require|load)\s+{_LISP_NAME}", m.code):
        f.refer(x[1], REQUIRE)
    for x in re.finditer(r"(?im)^\(defpackage\b", m.code):
        depth, i = 0, x.start()
        while i < len(m.bare):
            depth += (m.bare[i] == "(") - (m.bare[i] == ")")
            i += 1
            if not depth:
                break
        for use in re.findall(r"(?i)\(:use\s+([^()]*)\)", m.code[x.start() : i]):
            for name in re.findall(_LISP_NAME, use):
                f.refer(name, IMPORT)
    return f


_VB = re.compile(r"""(?P<comment>'[^\n]*|(?im:^)[ \t]*REM\b[^\n]*)|(?P<string>"(?:""|[^"\n])*"?)""")


def vbnet(path: str, text: str) -> Facts:
    m, f = mask(text, _VB), Facts()
    f.comments, f.code = m.comments, m.code
    stack, open_functions = [], []
    f.functions = []
    offset = 0
    for line in m.bare.split("\n"):
        s = line.strip()
        if x := re.match(r"(?i)Imports\s+(?:\w+\s*=\s*)?([\w.]+)", s):
            f.refer(x[1])
        elif re.match(r"(?i)End\s+(Namespace|Class|Interface|Structure|Enum|Module)\b", s):
            if stack:
                stack.pop()
        elif re.match(r"(?i)End\s+(Sub|Function)\b", s):
            if open_functions:
                a, name = open_functions.pop()
                f.functions.append((a, offset + len(line), name))
        elif x := re.match(r"(?i)(?:\w+\s+)*?Namespace\s+([\w.]+)", s):
            stack.append(x[1])
        elif x := re.match(r"(?i)(?:(?:Public|Private|Friend|Protected|MustInherit|NotInheritable|Partial|Shadows)\s+)*(?:Class|Interface|Structure|Enum|Module)\s+(\w+)", s):
            stack.append(x[1])
            f.declare(".".join(stack), TYPE)
        elif VB_BASES and (x := re.match(r"(?i)(?:Inherits|Implements)\s+(.+)", s)):
            for name in x[1].split(","):
                f.refer(re.sub(r"\(Of.*", "", name, flags=re.I).strip(), NAME, ".".join(stack[:-1]))
        elif (x := re.match(r"(?i)(?:\w+\s+)*?(?:Sub|Function)\s+(\w+)", s)) and not re.search(r"(?i)\b(MustOverride|Declare|Exit)\b", s) and not (stack and re.search(r"(?i)\bInterface\b", "")):
            open_functions.append((offset, x[1]))
        offset += len(line) + 1
    f.branches = places(m.bare, re.compile(r"(?im)^[ \t]*(?:If|ElseIf|For|While|Do|Case(?!\s+Else)|Catch)\b|(?<![\w.])If\s*\("))
    return f


def json_(path: str, text: str) -> Facts:
    f = Facts(code=text)
    f.declare(path)
    for key, raw in re.findall(r'"(\$ref|extends)"\s*:\s*"((?:\\.|[^"\\])*)"', text):
        part = raw.split("#", 1)[0]
        if part and not re.match(r"[A-Za-z][\w+.-]+:", part) and (key == "$ref" or raw.startswith(".")):
            f.refer(part)
    f.errors = unbalanced(re.sub(r'"(?:\\.|[^"\\])*"', "", text))
    return f


_PROTO = Syntax(line=("//",), block=(("/*", "*/"),)).pattern()


def proto(path: str, text: str) -> Facts:
    m, f = mask(text, _PROTO, [("/*", "*/")]), Facts()
    for key in trailing([p for p in path.split("/") if p], "/"):
        f.declare("proto:" + key)
    for raw in re.findall(r"""(?m)^\s*import\s+(?:public\s+|weak\s+)?["']([^"'\n]+)["']\s*;""", m.code):
        f.refer(raw)
    f.comments, f.code, f.errors = m.comments, m.code, m.open_ends + unbalanced(m.bare)
    return f


_SQL = Syntax(line=("--",), block=(("/*", "*/"),), strings=(r"'(?:''|[^'])*'?", r"\$(?P<tag>\w*)\$(?s:.*?)\$(?P=tag)\$")).pattern()
_SQL_NAME = r"""((?:[A-Za-z_]\w*|"[^"]+"|`[^`]+`|\[[^\]]+\])(?:\s*\.\s*(?:[A-Za-z_]\w*|"[^"]+"|`[^`]+`|\[[^\]]+\]))*)"""
_SQL_CREATE = re.compile(rf"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:(?:global|local|temp|temporary|unlogged|recursive)\s+)*(?:table|materialized\s+view|view|function|procedure|type|sequence)\s+(?:if\s+not\s+exists\s+)?{_SQL_NAME}")
_SQL_USE = re.compile(rf"(?i)\b(?:from|join|into|update|references|(?:alter|drop|truncate)\s+(?:table|view|materialized\s+view|function|procedure|type|sequence)(?:\s+if\s+exists)?|on(?=\s+[\w.\"]+\s*(?:\(|using\b)))\s+(?:only\s+)?{_SQL_NAME}")
_SQL_CALL = re.compile(rf"(?i)(?<![\w.\"`]){_SQL_NAME}\s*\(")
#: Words before a parenthesis that are no functions.
_SQL_WORDS = frozenset("values in and or not exists as on using key primary unique check references foreign table into over partition by any all some select from where when then else case returns numeric decimal varchar char character timestamp time float bit varbinary set with join limit having group order index default constraint if".split())


def sql(path: str, text: str) -> Facts:
    m, f = mask(text, _SQL, [("/*", "*/")]), Facts()
    plain = lambda s: re.sub(r'["`\[\]\s]', "", s).lower()
    taken = set()
    for x in _SQL_CREATE.finditer(m.bare):
        name = plain(x[1])
        f.declare("sql:" + name.split(".")[-1])
        if "." in name:
            f.declare("sql:" + name)
        taken.add(x.start(1))
    found = {}
    for x in _SQL_USE.finditer(m.bare):
        if plain(x[1]) not in ("select", "lateral", "unnest", "update", "delete", "set", "values") and not re.match(r"(?i)on\b", x[0]):
            found.setdefault(x.start(1), plain(x[1]))
    for x in _SQL_CALL.finditer(m.bare):
        if x.start(1) not in taken and plain(x[1]) not in _SQL_WORDS:
            found.setdefault(x.start(1), plain(x[1]))
    for at in sorted(found):
        if at not in taken:
            f.refer(found[at], NAME)
    f.comments, f.code, f.errors = m.comments, m.code, unbalanced(m.bare)
    return f


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.found += [v for k, v in attrs if k in ("src", "href") and v]

    handle_startendtag = handle_starttag


def html(path: str, text: str) -> Facts:
    f = Facts()
    f.declare(path)
    p = _Links()
    p.feed(text)
    for raw in p.found:
        f.refer(weblink(raw))
    f.comments = [m.span() for m in re.finditer(r"(?s)<!--.*?(?:-->|\Z)", text)]
    f.code = re.sub(r"(?s)<!--.*?(?:-->|\Z)", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    return f


_CSS = Syntax(block=(("/*", "*/"),)).pattern()


def css(path: str, text: str) -> Facts:
    m, f = mask(text, _CSS, [("/*", "*/")]), Facts()
    f.declare(path)
    for x in re.finditer(r"""(?i)@import\s+(?:"([^"\n]*)"|'([^'\n]*)')|\burl\(\s*("[^"\n]*"|'[^'\n]*'|[^)\n]*?)\s*\)""", m.code):
        f.refer(weblink(x[1] or x[2] or x[3] or ""))
    f.comments, f.code, f.errors = m.comments, m.code, unbalanced(m.bare)
    return f


_FENCE = re.compile(r"(?ms)^[ \t]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t]*\1[`~]*[ \t]*$|\Z)")
_SPAN = re.compile(r"(?<!`)(`+)(?!`)((?:[^\n]|\n(?!\s*\n))+?)(?<!`)\1(?!`)")


def markdown(path: str, text: str) -> Facts:
    f = Facts(code=text)
    f.declare(path)
    f.declare("mdnote:" + re.sub(r"\.(md|markdown)$", "", path.rsplit("/", 1)[-1].lower()))
    shown = _FENCE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    shown = _SPAN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), shown)
    found = []
    for m in re.finditer(r"!?\[\[([^\]\n]+)\]\]", shown):
        target = re.split(r"[|#]", m[1], maxsplit=1)[0].strip()
        link = weblink(target)
        if link:
            found.append((m.start(), "wiki:" + link))
    for m in re.finditer(r"""!?\[(?:[^\[\]]|\[[^\[\]]*\])*\]\(\s*(<[^>\n]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?:"[^"]*"|'[^']*'))?\s*\)""", shown):
        found.append((m.start(), weblink(m[1])))
    for m in re.finditer(r"(?m)^ {0,3}\[(?!\^)[^\]\n]+\]:[ \t]*(<[^>\n]*>|\S+)", shown):
        found.append((m.start(), weblink(m[1])))
    for _, raw in sorted(found, key=lambda x: x[0]):
        f.refer(raw)
    f.comments = [m.span() for m in re.finditer(r"(?s)<!--.*?(?:-->|\Z)", shown)]
    return f
