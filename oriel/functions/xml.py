"""XML as rows and columns: paths are compiled once into a schema that Spark's XML reader fills, and into expressions on what it read.

A document is parsed once for all its columns, on the JVM.  Elements are arrays, attributes and text are strings, so a value keeps the
digits that it was written with until its column's type is applied.  Row paths are chains of elements, with conditions
``[@a="x"]`` or ``[e="x"]``; column paths end in an element, ``@attribute``, ``text()`` or are ``.``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTRIBUTE, TEXT = "@", "#text"
NAME = r"[A-Za-z_][\w.:-]*"
OPTIONS = {"mode": "FAILFAST", "attributePrefix": ATTRIBUTE, "valueTag": TEXT, "ignoreSurroundingSpaces": "false"}


class BadPath(ValueError):
    """A path beyond those that are compiled."""


@dataclass
class Node:
    """What is read of an element."""

    children: dict[str, Node] = field(default_factory=dict)
    attributes: set[str] = field(default_factory=set)
    text: bool = False

    def at(self, steps: list[str]) -> Node:
        return self.children.setdefault(steps[0], Node()).at(steps[1:]) if steps else self

    def ddl(self, top: bool = False) -> str:
        if not top and not self.children and not self.attributes:
            return "STRING"
        parts = [f"`{ATTRIBUTE}{a}`: STRING" for a in sorted(self.attributes)] + [f"`{c}`: ARRAY<{n.ddl()}>" for c, n in self.children.items()]
        if self.text or not parts:
            parts.append(f"`{TEXT}`: STRING")
        return f"STRUCT<{', '.join(parts)}>"

    @property
    def plain(self) -> bool:
        return not self.children and not self.attributes


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def steps_of(path: str) -> tuple[list[str], str | None]:
    """(elements, attribute or "" for text, None for an element's own text) of a column path."""
    if path in (".", "text()"):
        return [], None
    parts = path.removeprefix("./").split("/")
    last = parts[-1]
    attribute = None
    if last.startswith("@"):
        attribute, parts = last[1:], parts[:-1]
    elif last == "text()":
        parts = parts[:-1]
    if not all(re.fullmatch(NAME, p) for p in [*parts, *([attribute] if attribute else [])]):
        raise BadPath(f"column path {path}")
    return parts, attribute


def row_steps(path: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """(element, conditions) of each step of a row path; conditions are (path, text)."""
    out = []
    for step in re.findall(r"(?:[^/\[]|\[[^\]]*\])+", path.strip().removeprefix("/")):
        m = re.fullmatch(rf"({NAME})((?:\[[^\]]*\])*)", step)
        conditions = re.findall(r"\[([^\]]*)\]", m[2]) if m else []
        tests = [re.fullmatch(rf"\s*(@?{NAME}|\.|text\(\))\s*=\s*(?:\"([^\"]*)\"|'([^']*)')\s*", c) for c in conditions]
        if m is None or not all(tests):
            raise BadPath(f"row path {path}")
        out.append((m[1], [(x[1], x[2] if x[2] is not None else x[3]) for x in tests]))
    if not out or "//" in path or out[0][1]:
        raise BadPath(f"row path {path}")
    return out


def value(row: str, node: Node, path: str) -> str:
    """The one string at a path below ``row``; more than one item raises, none is null."""
    parts, attribute = steps_of(path)
    items, at = row, node
    for i, p in enumerate(parts):
        items = f"{items}.`{p}`" if i == 0 else f"flatten(transform({items}, y -> coalesce(y.`{p}`, array())))"
        at = at.children[p]
    leaf = f".`{ATTRIBUTE}{attribute}`" if attribute else "" if at.plain and parts else f".`{TEXT}`"
    if not parts:
        return f"{items}{leaf}" if attribute or not at.plain else items
    if leaf:
        items = f"filter(transform({items}, y -> y{leaf}), y -> y IS NOT NULL)"
    many = f"cast(raise_error({literal(f'XMLTABLE: more than one item at {path}')}) AS STRING)"
    return f"CASE WHEN size({items}) > 1 THEN {many} ELSE get({items}, 0) END"


@dataclass(frozen=True)
class XmlColumn:
    """A column of an XML row source; without a type it counts the rows of a document from 1."""

    name: str
    type: str | None = "string"
    path: str = ""
    default: str | None = None

    @property
    def at(self) -> str:
        return self.path or self.name


@dataclass(frozen=True)
class RowSource:
    """Compiled: ``rows`` gives the array of row elements of a document, ``columns`` expressions over one of them and its place."""

    rows: str
    columns: list[str]


def compiled(xml: str, path: str, columns: list[XmlColumn], row: str = "r", place: str = "i", cast: Any = None) -> RowSource:
    """``xml`` is a Spark SQL expression; ``cast`` says how a type is written."""
    chain = row_steps(path)
    root = Node()
    inner = [s for s, _ in chain[1:]]
    top = root.at(inner)
    for c in columns:
        if c.type is not None:
            parts, attribute = steps_of(c.at)
            at = top.at(parts)
            if attribute:
                at.attributes.add(attribute)
            else:
                at.text = True
    for i, (_, tests) in enumerate(chain[1:], 1):
        for p, _ in tests:
            parts, attribute = steps_of(p)
            at = root.at(inner[:i]).at(parts)
            if attribute:
                at.attributes.add(attribute)
            else:
                at.text = True
    # a leaf without attributes is read as its text; a row that is the root itself is always a struct
    is_root = not inner
    options = ", ".join(f"{literal(k)}, {literal(v)}" for k, v in OPTIONS.items())
    doc = f"from_xml({xml}, {literal(root.ddl(top=True))}, map({options}))"
    items, at = f"array({doc})", root
    for i, (s, tests) in enumerate(chain[1:]):
        at = at.children[s]
        items = f"{doc}.`{s}`" if i == 0 else f"flatten(transform({items}, y -> coalesce(y.`{s}`, array())))"
        for p, text in tests:
            items = f"filter({items}, z -> {value('z', at, p)} = {literal(text)})"
    opening = rf"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<{re.escape(chain[0][0])}[\s/>]"
    cells = []
    for c in columns:
        if c.type is None:
            cells.append(f"cast({place} + 1 AS INT)")
            continue
        text = f"{row}.`{TEXT}`" if is_root and c.at in (".", "text()") else value(row, top, c.at)
        cell = f"cast({text} AS {cast(c.type) if cast else c.type})"
        cells.append(cell if c.default is None else f"coalesce({cell}, {c.default})")
    return RowSource(f"CASE WHEN regexp_like({xml}, {literal(opening)}) THEN {items} END", cells)


def xml_table(df: DataFrame, xml: str, path: str, columns: list[XmlColumn], outer: bool = False) -> DataFrame:
    """``df`` with a row for each element at ``path`` of the documents in column ``xml``, and its values as further columns.

    A null document, one with another root or without such elements gives no rows, or with ``outer`` one of nulls.  Text that is not XML raises.
    """
    if clash := {c.name.lower() for c in columns} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns named {', '.join(sorted(clash))} are there already")
    made = compiled(f"`{xml}`", path, columns, "__r", "__i")
    explode = "posexplode_outer" if outer else "posexplode"
    opened = df.selectExpr("*", f"{explode}({made.rows}) AS (__i, __r)")
    return opened.selectExpr(*[f"`{c}`" for c in df.columns], *[f"{e} AS `{c.name}`" for c, e in zip(columns, made.columns)])


# making XML


def escaped(text: Column, attribute: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if attribute else out


def element(name: str, *content: Column, attributes: dict[str, Column] | None = None) -> Column:
    """An element of markup columns; null content and null attributes are left out.  Give text through ``escaped``."""
    if not re.fullmatch(NAME, name):
        raise ValueError(f"{name} is no element name")
    marks = [F.coalesce(F.concat(F.lit(f' {a}="'), escaped(v, True), F.lit('"')), F.lit("")) for a, v in (attributes or {}).items()]
    return F.concat(F.lit(f"<{name}"), *marks, F.lit(">"), *[F.coalesce(c.cast("string"), F.lit("")) for c in content], F.lit(f"</{name}>"))


def forest(**values: Column) -> Column:
    """An element for each value that is not null."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"<{n}>"), escaped(v), F.lit(f"</{n}>")), F.lit("")) for n, v in values.items()])
