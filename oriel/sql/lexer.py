"""Tokens of Oracle-dialect SQL and PL/SQL."""

from __future__ import annotations

import re
from dataclasses import dataclass


class UnsupportedSyntax(ValueError):
    """A construct that is not understood; nothing is ever dropped in silence."""

    def __init__(self, message: str, at: int = 0, text: str = ""):
        near = text[max(0, at - 20) : at + 40].replace("\n", " ")
        super().__init__(f"{message} at {at}" + (f": ...{near}..." if near else ""))
        self.at = at


@dataclass(frozen=True)
class Token:
    kind: str  # name, quoted, number, string, bind, op, end
    text: str
    at: int
    stop: int

    @property
    def up(self) -> str:
        return self.text.upper() if self.kind == "name" else self.text


PATTERN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<qstring>[nN]?[qQ]'(?:\[.*?\]|\{.*?\}|\(.*?\)|<.*?>|(?P<qd>[^\s\[\{\(<]).*?(?P=qd))')
    |(?P<string>[nN]?'(?:[^']|'')*')
    |(?P<quoted>"[^"]+")
    |(?P<number>(?:\d+(?:\.(?!\.)\d*)?|\.\d+)(?:[eE][+-]?\d+)?[dDfF]?(?![\w$]))
    |(?P<name>[^\W\d][\w$\#]*)
    |(?P<bind>:(?:[A-Za-z_]\w*|\d+))
    |(?P<op>\(\+\)|\|\||:=|=>|\*\*|<>|!=|\^=|~=|<=|>=|<<|>>|\.\.|[-+*/%(),.;=<>@\[\]{}?:|&])""",
    re.X | re.S,
)


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = PATTERN.match(text, at)
        if m is None:
            raise UnsupportedSyntax(f"unexpected character {text[at]!r}", at, text)
        kind, value = m.lastgroup if m.lastgroup != "qd" else "qstring", m.group()
        if m.group("qstring"):
            kind, value = "string", value[value.index("'") + 2 : -2]
        elif kind == "string":
            value = value[value.index("'") + 1 : -1].replace("''", "'")
        elif kind == "quoted":
            value = value[1:-1]
        elif kind == "bind":
            value = value[1:]
        if kind != "space":
            out.append(Token(kind, value, m.start(), m.end()))
        at = m.end()
    out.append(Token("end", "", len(text), len(text)))
    return out
