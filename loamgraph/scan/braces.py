"""Languages with braces: C, C#, Go, PHP, JavaScript, TypeScript."""

from __future__ import annotations

import re

from .base import IMPORT, NAME, REQUIRE, TYPE, Facts, Syntax, brace_functions, mask, places, trailing, unbalanced

_C_LIKE = Syntax(line=("//",), block=(("/*", "*/"),))
_WORDS = frozenset("if for while switch catch return sizeof do else foreach using lock fixed match fn function typeof new with".split())


def _finish(f: Facts, m, heads: re.Pattern | None, branch: str) -> Facts:
    f.comments, f.code, f.errors = m.comments, m.code, m.open_ends + unbalanced(m.bare)
    f.branches = places(m.bare, re.compile(branch))
    if heads:
        f.functions = brace_functions(m.bare, heads, _WORDS)
    return f


_C = _C_LIKE.pattern()
_C_HEAD = re.compile(r"(?m)^[ \t]*(?:[A-Za-z_][\w \t*]*?[\s*])(?P<name>[A-Za-z_]\w*)\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*\{")


def c(path: str, text: str) -> Facts:
    m, f = mask(text, _C, [("/*", "*/")]), Facts()
    f.declare(path)
    for x in re.finditer(r'(?m)^[ \t]*#[ \t]*include[ \t]*"([^"\n]+)"', m.code):
        f.refer(x[1])
    return _finish(f, m, _C_HEAD, r"\b(?:if|for|while|case)\b|&&|\|\||\?(?![?.])")


_CS = Syntax(line=("//",), block=(("/*", "*/"),), strings=(r'"""(?s:.*?)"""', r'\$?@\$?"(?:""|[^"])*"?', r'\$?"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?")).pattern()
_CS_HEAD = re.compile(r"(?:(?P<name>[A-Za-z_]\w*)\s*(?:<[^<>{}()]*>)?\s*\((?:[^(){};]|\([^()]*\))*\)\s*(?::\s*(?:base|this)\s*\([^)]*\)\s*)?(?:where\b[^{;]*)?|\b(?:get|set|init|add|remove)\s*|=>\s*)\{")
_CS_PIECE = re.compile(r"\bnamespace\s+([\w.]+)\s*([;{])|\b(?:class|interface|struct|enum)\s+([A-Za-z_]\w*)\s*(?:<[^<>{}]*>)?([^{;]*)\{|[{}]")


_CS_ARROW = re.compile(r"(?m)^[ \t]*(?:(?:public|private|protected|internal|static|override|virtual|sealed|async|unsafe|extern|partial|new)[ \t]+)*(?!(?:return|await|throw|yield|else|case)\b)[A-Za-z_][\w.]*(?:<[^;{}()=]*>)?[?\[\], ]*[ \t]+(?P<name>[A-Za-z_]\w*)\s*(?:<[^<>{}()]*>)?\s*\((?:[^(){};]|\([^()]*\))*\)\s*(?:where\b[^{;=]*)?=>(?!\s*\{)")


def _arms(bare: str) -> list[int]:
    """Places of the arrows of switch expressions' arms: the first one after the brace or after each comma that stands in no inner bracket."""
    out = []
    for m in re.finditer(r"\bswitch\s*\{", bare):
        depth, fresh = 0, True
        for x in re.finditer(r"=>|[(\[{,)\]}]", bare[m.end() :]):
            if x.group() in "([{":
                depth += 1
            elif x.group() in ")]}":
                depth -= 1
                if depth < 0:
                    break
            elif depth == 0:
                if x.group() == "," or not fresh:
                    fresh = x.group() == ","
                else:
                    out.append(m.end() + x.start())
                    fresh = False
    return out


def _arrow_bodies(bare: str) -> list[tuple[int, int, str]]:
    """Methods whose body is an expression: from their head to the semicolon outside brackets."""
    out = []
    for m in _CS_ARROW.finditer(bare):
        depth, stop = 0, len(bare)
        for x in re.finditer(r"[(\[{)\]};]", bare[m.end() :]):
            if x.group() == ";" and depth <= 0:
                stop = m.end() + x.start()
                break
            depth += (x.group() in "([{") - (x.group() in ")]}")
        out.append((m.start() + len(m.group()) - len(m.group().lstrip()), stop, m["name"]))
    return out


def _split_list(s: str) -> list[str]:
    """Names of a comma-separated list, without generics, arguments and constraints."""
    s = re.split(r"\bwhere\b", s)[0]
    for _ in range(6):
        s = re.sub(r"<[^<>]*>|\([^()]*\)", "", s)
    return [x.strip() for x in s.split(",") if x.strip()]


def csharp(path: str, text: str) -> Facts:
    m, f = mask(text, _CS, [("/*", "*/")]), Facts()
    for x in re.finditer(r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)(?:<[^;]*>)?\s*;", m.bare):
        f.refer(x[1], IMPORT)
    depth, file_ns, stack = 0, "", []  # stack: (depth, name, is a namespace)
    for x in _CS_PIECE.finditer(m.bare):
        if x[0] == "}":
            depth -= 1
            while stack and stack[-1][0] > depth:
                stack.pop()
            continue
        if x[1] and x[2] == ";":
            file_ns = x[1]
            continue
        ns = ".".join([*([file_ns] if file_ns else []), *(n for _, n, is_ns in stack if is_ns)])
        if x[3]:
            outer = [n for _, n, is_ns in stack if not is_ns]
            f.declare(".".join([*([ns] if ns else []), *outer, x[3]]), TYPE)
            if ":" in (x[4] or ""):
                for base in _split_list(x[4].split(":", 1)[1]):
                    f.refer(re.sub(r"^global::", "", base), NAME, ns)
        depth += 1
        if x[1] or x[3]:
            stack.append((depth, x[1] or x[3], bool(x[1])))
    f = _finish(f, m, _CS_HEAD, r"\b(?:if|for|foreach|while|catch)\b|\bcase\b|\bdefault\s*:|&&|\|\||\?\?|\?(?=[^?.\[,>)\s][^:;\n]*:)|\?\s(?=[^:;\n]*:)")
    f.branches = sorted(f.branches + _arms(m.bare))
    f.functions = f.functions + _arrow_bodies(m.bare)
    return f


_GO = Syntax(line=("//",), block=(("/*", "*/"),), strings=(r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?", r"`[^`]*`?")).pattern()
_GO_HEAD = re.compile(r"\bfunc\b\s*(?:\([^()]*\)\s*)?(?P<name>[A-Za-z_]\w*)?\s*(?:\[[^\]]*\]\s*)?\((?:[^()]|\([^()]*\))*\)[^{}\n;]*\{")


def go(path: str, text: str) -> Facts:
    m, f = mask(text, _GO, [("/*", "*/")]), Facts()
    for key in trailing([p for p in path.rsplit("/", 1)[0].split("/") if p], "/"):
        f.declare(key)
    for x in re.finditer(r'(?m)^[ \t]*import\s*(?:\(([^)]*)\)|(?:[\w.]+\s+)?"([^"\n]+)")', m.code):
        for raw in re.findall(r'"([^"\n]+)"', x[1]) if x[1] is not None else [x[2]]:
            f.refer(raw)
    return _finish(f, m, _GO_HEAD, r"\b(?:if|for|case)\b|&&|\|\|")


_PHP = Syntax(line=("//",), block=(("/*", "*/"),), strings=(r'"(?:\\(?s:.)|[^"\\])*"?', r"'(?:\\(?s:.)|[^'\\])*'?")).pattern()
_PHP = re.compile(_PHP.pattern.replace("(?P<comment>", r"(?P<comment>#(?!\[)[^\n]*|", 1))
_PHP_HEAD = re.compile(r"\b(?:function\b\s*&?\s*(?P<name>[A-Za-z_]\w*)?\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)[^{};]*\{|fn\s*\((?:[^()]|\([^()]*\))*\)[^=]*=>)")
_PHP_PIECE = re.compile(r"\bnamespace\s+([\w\\]+)\s*([;{])|\bnamespace\s*(\{)|(?<![\\$\w>:])(?:class|interface|trait|enum)\s+([A-Za-z_]\w*)([^{;]*)\{|(?<![\w$\\])use\s+([^;({]+(?:\{[^}]*\})?[^;({]*);|[{}]")


def _use_names(clause: str) -> list[str]:
    clause = re.sub(r"^\s*(?:function|const)\s+", "", clause)
    m = re.match(r"\s*\\?([\w\\]*?)\\?\{([^}]*)\}", clause)
    items = [f"{m[1]}\\{i.strip()}" for i in m[2].split(",") if i.strip()] if m else clause.split(",")
    return [re.sub(r"\s+as\s+\w+\s*$", "", i.strip()).lstrip("\\") for i in items if i.strip()]


def php(path: str, text: str) -> Facts:
    m, f = mask(text, _PHP, [("/*", "*/")]), Facts()
    f.declare(path)
    depth, ns, ns_depth = 0, "", 0
    for x in _PHP_PIECE.finditer(m.bare):
        if x[0] == "}":
            depth -= 1
            if ns_depth and depth < ns_depth:
                ns, ns_depth = "", 0
            continue
        if x[6] is not None:
            if depth == ns_depth:  # not a trait's use inside a class
                for name in _use_names(x[6]):
                    f.refer(name, IMPORT, ns)
            continue
        if x[1] or x[3]:
            ns = x[1] or ""
            if (x[2] or x[3]) == ";":
                continue
            ns_depth = depth + 1
        elif x[4]:
            f.declare(f"{ns}\\{x[4]}" if ns else x[4], TYPE)
            for _, names in re.findall(r"\b(extends|implements)\s+([\w\\,\s]+?)(?=\bextends\b|\bimplements\b|$)", x[5]):
                for name in names.split(","):
                    f.refer(name.strip(), NAME, ns)
        depth += 1
    for x in re.finditer(r"""\b(?:require|include)(?:_once)?\s*\(?\s*(?:"([^"$\n]+)"|'([^'\n]+)')\s*\)?\s*;""", m.code):
        f.refer(x[1] or x[2], REQUIRE)
    return _finish(f, m, _PHP_HEAD, r"\b(?:if|elseif|for|foreach|while|case|catch|and|or)\b|&&|\|\||\?\?|(?<![?<])\?(?![?>\-:\w\\])")


_JS_STRINGS = (r'"(?:\\(?s:.)|[^"\\\n])*"?', r"'(?:\\(?s:.)|[^'\\\n])*'?", r"`(?:\\(?s:.)|[^`\\])*`?", r"(?<=[(,=:\[!&|?{};+*%<>~^\n])[ \t]*/(?![*/ ])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_JS = Syntax(line=("//",), block=(("/*", "*/"),), strings=_JS_STRINGS).pattern()
_JS_HEAD = re.compile(r"\bfunction\b\s*\*?\s*(?P<name>[\w$]*)\s*(?:<[^>{}]*>)?\((?:[^(){}]|\([^()]*\)|\{[^{}]*\})*\)[^{};]*\{|(?<![\w$.])(?:async\s+)?(?:\((?:[^(){};]|\([^()]*\)|\{[^{}]*\})*\)|[A-Za-z_$][\w$]*)\s*(?::\s*[^={};]+)?=>\s*\{?|(?m:^)[ \t]*(?:(?:static|async|get|set|public|private|protected|override|readonly)\s+)*\*?(?:#?[A-Za-z_$][\w$]*)\s*\((?:[^(){};]|\([^()]*\)|\{[^{}]*\})*\)\s*(?::\s*[^{};=]+)?\{")
_JS_REFS = re.compile(
    r"""(?P<eq>\bimport\s+(?:type\s+)?[\w$]+\s*=\s*require\s*\(\s*(["'])(?P<a>[^"'\n]+)\2\s*\))"""
    r"""|(?P<imp>\bimport\s*(?:type\s+)?(?:[\w$*{},\s]+?\bfrom\s*)?(["'])(?P<b>[^"'\n]+)\5)"""
    r"""|(?P<exp>\bexport\s*(?:type\s+)?(?:\*(?:\s*as\s+[\w$]+)?|\{[^}]*\})\s*from\s*(["'])(?P<c>[^"'\n]+)\8)"""
    r"""|(?P<req>(?<![\w$.])require\s*\(\s*(["'])(?P<d>[^"'\n]+)\11\s*\))"""
    r"""|(?P<dyn>(?<![\w$.])import\s*\(\s*(["'])(?P<e>[^"'\n]+)\14\s*\))"""
)


def javascript(path: str, text: str) -> Facts:
    m, f = mask(text, _JS, [("/*", "*/")]), Facts()
    f.declare(path)
    for x in _JS_REFS.finditer(m.code):
        if m.bare[x.start()].strip():  # not inside a string
            f.refer(next(filter(None, (x["a"], x["b"], x["c"], x["d"], x["e"]))), REQUIRE if x["req"] else IMPORT)
    return _finish(f, m, _JS_HEAD, r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?\?(?!=)|(?<![?])\?(?![?.:,)=])")


