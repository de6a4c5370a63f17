"""Lexer: one regular expression, scanned lazily."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

# The reserved words, which are never identifiers.
KEYWORDS = frozenset(
    "SELECT FROM WHERE INSERT INTO VALUES DELETE UPDATE SET CREATE TABLE INDEX ON INT INTEGER VARCHAR FLOAT BOOLEAN AND OR NOT DROP JOIN INNER EXPLAIN TRUE FALSE".split()
)
_TOKEN = re.compile(
    r"""
    (?P<space>[ \t\r\n]+)
  | (?P<float>[0-9]+\.[0-9]*)
  | (?P<integer>[0-9]+)
  | (?P<word>[A-Za-z_][A-Za-z0-9_]*)
  | '(?P<string>[^']*)(?:'|\Z)
  | (?P<symbol><=|>=|<>|!=|[=<>+\-*/(),.;])
  | (?P<illegal>.)
    """,
    re.VERBOSE | re.DOTALL,
)


class Token(NamedTuple):
    """``kind``: keyword, identifier, integer, float, string, symbol, illegal or end."""

    kind: str
    text: str
    line: int
    column: int

    def is_(self, *texts: str) -> bool:
        """Whether it's one of these keywords or symbols."""
        return self.kind in ("keyword", "symbol") and self.text in texts


def tokens(text: str) -> Iterator[Token]:
    """All tokens, the last of kind ``end``. Keywords come in upper case, strings without quotes.

    A string has no escapes and may end with the text.
    """
    line, start = 1, 0
    for m in _TOKEN.finditer(text):
        kind, value, column = m.lastgroup, m[m.lastgroup], m.start() - start + 1
        if kind != "space":
            if kind == "word":
                kind, value = ("keyword", value.upper()) if value.upper() in KEYWORDS else ("identifier", value)
            yield Token(kind, "<>" if value == "!=" and kind == "symbol" else value, line, column)
        if breaks := m[0].count("\n"):
            line += breaks
            start = m.start() + m[0].rindex("\n") + 1
    yield Token("end", "", line, len(text) - start + 1)
