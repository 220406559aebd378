"""Scanners by language; other languages can be added by name."""

from __future__ import annotations

from . import braces, others, scripts
from .base import Facts, Scanner

SCANNERS: dict[str, Scanner] = {
    "c": braces.c, "csharp": braces.csharp, "lisp": others.lisp, "python": others.python, "go": braces.go, "php": braces.php, "vbnet": others.vbnet,
    "javascript": braces.javascript, "typescript": braces.javascript, "tsx": braces.javascript, "json": others.json_, "bash": scripts.bash, "proto": others.proto,
    "sql": others.sql, "powershell": scripts.powershell, "batch": scripts.batch, "html": others.html, "css": others.css, "markdown": others.markdown,
}
#: Languages whose copied stretches are looked for: those with decisions.
CLONED = ["c", "csharp", "python", "go", "php", "vbnet", "javascript", "typescript", "tsx", "bash", "powershell", "batch"]


def register(language: str, scanner: Scanner) -> None:
    SCANNERS[language] = scanner


def scan(language: str, path: str, text: str) -> Facts:
    return SCANNERS[language](path, text)
