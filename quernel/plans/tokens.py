"""A lexer for SQL text: white space, comments, names, numbers, strings and operators; nothing is lost."""

from __future__ import annotations

import re
from dataclasses import dataclass

_KINDS = [
    ("WHITESPACE", r"\s+"),
    ("COMMENT", r"--[^\n]*|/\*.*?\*/"),
    ("STRING", r"'(?:[^']|'')*'"),
    ("QUOTED_IDENTIFIER", r'"(?:[^"]|"")*"|`[^`]*`|\[[^\]]*\]'),
    ("NUMBER", r"\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?"),
    ("PARAMETER", r":[A-Za-z_]\w*|\?"),
    ("IDENTIFIER", r"[A-Za-z_][\w$#]*"),
    ("OPERATOR", r"<=|>=|<>|!=|\|\||[-+*/%=<>(),.;]"),
]
_TOKEN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _KINDS), re.S)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokens(sql: str) -> list[Token]:
    """The tokens of a text; their texts joined give it back. Characters that begin no token are an error."""
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if m is None:
            raise ValueError(f"no token at {at}: {sql[at : at + 20]!r}")
        out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return out
