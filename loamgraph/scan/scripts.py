"""Shell, PowerShell and batch files."""

from __future__ import annotations

import re

from .base import IMPORT, REQUIRE, Facts, Syntax, brace_functions, mask, places, script_path, unbalanced

WINDOWS = (".ps1", ".psm1", ".psd1", ".bat", ".cmd")


def shell_commands(text: str) -> list[list[str]]:
    """Commands as words, as they are written; quotes and nested $(...) keep a word together; comments are dropped."""
    out, words, word, i, n = [], [], "", 0, len(text)
    depth, quote = 0, ""

    def flush_word():
        nonlocal word
        if word:
            words.append(word)
        word = ""

    def flush():
        nonlocal words
        flush_word()
        if words:
            out.append(words)
        words = []

    while i < n:
        ch = text[i]
        if ch == "\\" and quote != "'" and i + 1 < n:
            if text[i + 1] != "\n":
                word += text[i : i + 2]
            i += 2
            continue
        if quote:
            if quote == '"' and text.startswith("$(", i):
                close = _closing(text, i + 2)
                word += text[i:close]
                i = close
                continue
            word += ch
            quote = "" if ch == quote else quote
        elif text.startswith("$(", i):
            close = _closing(text, i + 2)
            word += text[i:close]
            i = close
            continue
        elif text.startswith("${", i):
            close = text.find("}", i)
            close = n if close < 0 else close + 1
            word += text[i:close]
            i = close
            continue
        elif ch in "\"'":
            word += ch
            quote = ch
        elif ch == "#" and not word:
            end = text.find("\n", i)
            i = n if end < 0 else end
            continue
        elif ch in ";|&\n":
            flush()
        elif ch in "(){}" and not word:
            flush()
        elif ch in " \t\r":
            flush_word()
        else:
            word += ch
        i += 1
    flush()
    return out


def _closing(text: str, at: int) -> int:
    depth = 1
    while at < len(text) and depth:
        depth += (text[at] == "(") - (text[at] == ")")
        at += 1
    return at


def shell_path(word: str) -> str | None:
    """The path an argument names: a leading expansion stands for the script's folder, others are too open to follow."""
    s = word.strip("\"'") if len(word) > 1 and word[0] == word[-1] and word[0] in "\"'" else word.replace('"', "")
    m = re.match(r"\$\((?:[^()]|\([^()]*\))*\)|\$\{[^}]*\}|\$\w+", s)
    rest = s[m.end() :] if m else s
    if m and not rest.startswith("/"):
        return None
    if re.search(r"[$`*?]", rest) or not rest:
        return None
    return "." + rest if m else rest


_SH = Syntax(strings=(r'"(?:\\(?s:.)|\$\((?:[^()]|\([^()]*\))*\)|[^"\\])*"?', r"'[^']*'?")).pattern()
_SH = re.compile(_SH.pattern.replace("(?P<comment>(?!)", r"(?P<comment>(?<![^\s;&|(])\#[^\n]*", 1))
_SH_HEAD = re.compile(r"(?m:^)[ \t]*(?:function[ \t]+(?P<name>[\w:.-]+)[ \t]*(?:\([ \t]*\))?|[\w:.-]+[ \t]*\([ \t]*\))\s*\{")


def bash(path: str, text: str) -> Facts:
    m, f = mask(text, _SH), Facts()
    f.declare(path)
    f.declare("sh:" + path.rsplit("/", 1)[-1])
    script = lambda p: p.endswith((".sh", ".bash"))
    for words in shell_commands(text):
        while words and (re.fullmatch(r"\w+=.*", words[0], re.S) or words[0] in ("if", "then", "else", "elif", "while", "until", "do", "!", "time", "sudo", "env", "command", "nohup")):
            words = words[1:]
        if not words:
            continue
        head, args = words[0], [w for w in words[1:] if not w.startswith("-")]
        if head in ("source", ".") and args:
            f.refer(shell_path(args[0]), IMPORT)
        elif head in ("bash", "sh", "zsh", "exec"):
            p = shell_path(args[0]) if args else None
            if p and script(p):
                f.refer(p, REQUIRE)
        else:
            p = shell_path(head)
            if p and script(p) and "/" in p:
                f.refer(p, REQUIRE)
    f.comments, f.code, f.errors = m.comments, m.code, m.open_ends
    f.branches = places(m.bare, re.compile(r"(?<![\w-])(?:if|elif|for|while|until)(?![\w-])|&&|\|\||(?:(?<![\w-])in(?![\w-])|;;&?|;&)\s*(?!esac\b)\(?[^()\n]*?\)(?!\))"))
    f.functions = brace_functions(m.bare, _SH_HEAD)
    return f


def _declare(f: Facts, path: str) -> None:
    name = path.replace("\\", "/").rsplit("/", 1)[-1].lower()
    f.declare(path)
    f.declare("winscript:" + name)
    if name.endswith((".psm1", ".psd1")):
        f.declare("psmod:" + name[:-5])


_PS = Syntax(line=("#",), block=(("<#", "#>"),), strings=(r'"(?:`(?s:.)|""|[^"`])*"?', r"'(?:''|[^'])*'?")).pattern()
_PS = re.compile(_PS.pattern.replace(r"(?P<comment>\#[^\n]*|<\#(?s:.*?)(?:\#>|\Z)", r"(?P<comment><\#(?s:.*?)(?:\#>|\Z)|(?<![\w`$])\#[^\n]*", 1))
_PS_HEAD = re.compile(r"(?i)\b(?:function|filter)\s+(?P<name>[\w:-]+)\s*(?:\((?:[^()]|\([^()]*\))*\))?\s*\{|(?m:^)[ \t]*(?:static[ \t]+|hidden[ \t]+)*\[[\w.\[\]]+\][ \t]*\w+[ \t]*\([^()]*\)\s*\{")
_PS_WORD = re.compile(r'"(?:`.|[^"`])*"|\'[^\']*\'|[^\s"\';|,(){}\[\]@=]+')
_PS_KEYS = re.compile(r"(?im)^\s*(RootModule|ModuleToProcess|NestedModules|ScriptsToProcess|RequiredModules)\s*=\s*(@\([^)]*\)|[^\n;]+)")


def powershell(path: str, text: str) -> Facts:
    m, f = mask(text, _PS, [("<#", "#>")]), Facts()
    _declare(f, path)
    if path.lower().endswith(".psd1"):
        for x in _PS_KEYS.finditer(m.code):
            for raw in re.findall(r"""["']([^"'\n]+)["']""", x[2]):
                f.refer(script_path(raw), REQUIRE)
    else:
        for line in re.split(r"[\n;|{}]", m.code):
            words = _PS_WORD.findall(line)
            if not words:
                continue
            head, args = words[0], [w for w in words[1:] if not w.startswith("-")]
            first, seen = head.lower(), None
            if head == "." and args:
                seen = args[0]
                f.refer(script_path(seen), IMPORT)
            elif first == "using" and len(args) > 1 and args[0].lower() == "module":
                seen = args[1]
                f.refer(script_path(seen), IMPORT)
            elif first in ("import-module", "ipmo") and args:
                seen = args[0]
                f.refer(script_path(seen), REQUIRE)
            elif head == "&" and args:
                seen = args[0]
                p = script_path(seen)
                f.refer(p if p and p.lower().endswith(WINDOWS) else None, REQUIRE)
            elif first.strip("\"'").endswith(WINDOWS):
                seen = head
                f.refer(script_path(head), REQUIRE)
            for w in args:
                if w is not seen and w.strip("\"'").lower().endswith(WINDOWS):
                    f.refer(script_path(w), REQUIRE)
    f.comments, f.code, f.errors = m.comments, m.code, m.open_ends + unbalanced(m.bare)
    f.branches = places(m.bare, re.compile(r"(?i)(?<![\w-])(?:if|elseif|for|foreach|while|catch)(?![\w-])|(?<!\w)-(?:and|or)\b"))
    f.functions = brace_functions(m.bare, _PS_HEAD)
    return f


_BAT_LINE = re.compile(r"(?im)^[ \t]*@?(?:rem\b|::)[^\n]*")


def batch(path: str, text: str) -> Facts:
    f = Facts()
    _declare(f, path)
    f.comments = [x.span() for x in _BAT_LINE.finditer(text)]
    f.code = _BAT_LINE.sub(lambda x: " " * len(x[0]), text)
    for line in f.code.split("\n"):
        if line.lstrip().startswith(":"):
            continue
        for part in re.split(r"&&|\|\||[&|]", line):
            words = re.findall(r'"[^"]*"|[^\s"=,;()]+', part.strip().lstrip("@"))
            called = bool(words) and words[0].lower() == "call"
            for i, w in enumerate(words):
                bare = w.strip('"')
                if (called and i == 1 and not bare.startswith(":")) or bare.lower().endswith(WINDOWS):
                    if not (i and words[0].lower() in ("echo", "rem", "title")):
                        f.refer(script_path(w), REQUIRE)
    f.branches = places(f.code, re.compile(r"(?i)(?<![\w%-])(?:if|for)(?=\s)|&&|\|\|"))
    return f
