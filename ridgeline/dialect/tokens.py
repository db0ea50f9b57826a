"""Tokens of the dialect: names, numbers, strings, marks; statements split at semicolons outside strings."""

from __future__ import annotations

import re
from dataclasses import dataclass


class SqlError(ValueError):
    """Text that is not a statement of the dialect, or names that don't resolve."""


@dataclass(frozen=True)
class Token:
    kind: str  # name, quoted, int, float, string, mark, end
    value: object
    text: str
    at: int
    end: int


_LEX = re.compile(
    r"""(?P<space>\s+)
    | (?P<float>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)
    | (?P<int>\d+)
    | (?P<name>[A-Za-z_][A-Za-z0-9_$]*)
    | (?P<quoted>`[^`]*`)
    | (?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")
    | (?P<mark><=|>=|<>|!=|&&|\|\||[-+*/%^!=<>(),.;])""",
    re.X | re.S,
)
#: Backslash escapes inside strings; before % and _ the backslash stays, for LIKE.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "0": "\0", "Z": "\x1a"}


def _unquote(text: str) -> str:
    body = text[1:-1].replace(text[0] * 2, text[0])
    return re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_" else ESCAPES.get(m[1], m[1]), body, flags=re.S)


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _LEX.match(sql, at)
        if not m:
            raise SqlError(f"unexpected {sql[at]!r} at {at}")
        kind, text, at = m.lastgroup, m[0], m.end()
        if kind == "space":
            continue
        value = {"int": int, "float": float, "string": _unquote, "quoted": lambda s: s[1:-1]}.get(kind, str)(text)
        out.append(Token(kind, value, text, m.start(), at))
    return [*out, Token("end", None, "", len(sql), len(sql))]


def statements(sql: str) -> list[list[Token]]:
    """The tokens of each statement, an end token behind each."""
    out, held = [], []
    for t in tokens(sql):
        if t.kind == "end" or (t.kind, t.text) == ("mark", ";"):
            if held:
                out.append([*held, Token("end", None, "", t.at, t.at)])
            held = []
        else:
            held.append(t)
    return out
