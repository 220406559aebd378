"""Spans of text shared by the operators that find things in it: (kind, start, stop), in code points, stop exclusive."""

from __future__ import annotations

import hashlib


def joined(spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    """kind:start:stop by start, then the kind's place in `kinds`, joined by commas; spans are (start, kind's place, stop)."""
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def digest(shown: str) -> str:
    return hashlib.sha256(shown.encode()).hexdigest()


def replaced(text: str, spans: list[tuple[int, int, int]], labels: list[str]) -> str:
    """text with each stretch that spans cover made the label of its first span."""
    out, at = [], 0
    for a, k, b in sorted(spans, key=lambda s: (s[0], -s[2])):
        if a >= at:
            out += [text[at:a], labels[k]]
        at = max(at, b)
    return "".join(out) + text[at:]
