"""The syntax tree.  Every node is plain data; the writer gives it a Spark form."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Lit:
    value: Any
    kind: str  # number, string, null, bool, date, timestamp


@dataclass
class Bind:
    name: str


@dataclass
class Name:
    """A dotted name: column, sequence value, collection attribute or a call without parentheses."""

    parts: list[str]
    outer: bool = False  # marked (+)


@dataclass
class Star:
    table: list[str] = field(default_factory=list)


@dataclass
class Call:
    parts: list[str]
    args: list[Any]
    distinct: bool = False
    order: list[Order] = field(default_factory=list)  # WITHIN GROUP, or inside the arguments
    nulls: str = ""  # IGNORE or RESPECT
    over: Over | None = None
    keep: tuple[str, list[Order]] | None = None
    named: dict[str, Any] = field(default_factory=dict)


@dataclass
class Field:
    """Attribute of an expression that is not a plain name: ``f(x).y``."""

    base: Any
    name: str
    args: list[Any] | None = None


@dataclass
class Unary:
    op: str
    arg: Any


@dataclass
class Binary:
    op: str
    left: Any
    right: Any


@dataclass
class Is:
    arg: Any
    what: str
    negated: bool


@dataclass
class In:
    arg: Any
    items: Any  # list or Query
    negated: bool


@dataclass
class Between:
    arg: Any
    low: Any
    high: Any
    negated: bool


@dataclass
class Like:
    arg: Any
    pattern: Any
    escape: Any
    negated: bool
    fold: bool = False


@dataclass
class Quantified:
    op: str
    left: Any
    how: str  # ANY or ALL
    right: Any  # list or Query


@dataclass
class Exists:
    query: Any


@dataclass
class Sub:
    query: Any


@dataclass
class Tuple:
    items: list[Any]


@dataclass
class Case:
    subject: Any
    whens: list[tuple[Any, Any]]
    other: Any


@dataclass
class Cast:
    arg: Any
    type: str
    default: Any = None
    multiset: bool = False


@dataclass
class Interval:
    text: Any
    unit: str


@dataclass
class Order:
    expr: Any
    desc: bool = False
    nulls: str = ""


@dataclass
class Over:
    partition: list[Any]
    order: list[Order]
    frame: str
    bounds: list[tuple[str, Any]] = field(default_factory=list)


# relations


@dataclass
class Table:
    name: list[str]
    alias: str = ""
    sample: float | None = None
    seed: int | None = None
    #: AS OF or VERSIONS BETWEEN: SCN or TIMESTAMP, alone or with RANGE, and its bounds.
    versions: tuple[str, Any, Any] | None = None


@dataclass
class Derived:
    query: Any
    alias: str = ""
    lateral: bool = False
    columns: list[str] = field(default_factory=list)


@dataclass
class Unnest:
    expr: Any
    alias: str = ""


@dataclass
class JsonTable:
    expr: Any
    path: str
    columns: list[tuple[str, str, str]]  # name, type ("ordinality" for a counter), path
    alias: str = ""


@dataclass
class XmlTable:
    expr: Any
    path: str
    columns: list[tuple[str, str, str, Any]]  # name, type ("ordinality" for a counter), path, default
    alias: str = ""


@dataclass
class Join:
    left: Any
    right: Any
    kind: str  # INNER, LEFT, RIGHT, FULL, CROSS, APPLY, OUTER APPLY
    on: Any = None
    using: list[str] = field(default_factory=list)
    natural: bool = False
    partition: list[Any] = field(default_factory=list)


@dataclass
class Pivot:
    source: Any
    aggregates: list[tuple[Any, str]]
    columns: list[Any]
    values: list[tuple[Any, str]]
    alias: str = ""


@dataclass
class Unpivot:
    source: Any
    nulls: bool
    values: list[str]
    name: str
    columns: list[tuple[list[str], str]]
    alias: str = ""


# queries


@dataclass
class Item:
    expr: Any
    alias: str = ""


@dataclass
class Block:
    items: list[Item]
    distinct: bool = False
    tables: list[Any] = field(default_factory=list)
    where: Any = None
    start: Any = None
    connect: Any = None
    nocycle: bool = False
    group: list[Any] = field(default_factory=list)
    having: Any = None
    into: list[Any] = field(default_factory=list)
    bulk: bool = False


@dataclass
class GroupingSets:
    kind: str  # ROLLUP, CUBE, SETS
    items: list[Any]


@dataclass
class SetOp:
    op: str
    left: Any
    right: Any


@dataclass
class Cte:
    name: str
    columns: list[str]
    query: Any
    search: tuple[str, list[Order], str] | None = None
    cycle: tuple[list[str], str, str, str] | None = None


@dataclass
class Query:
    body: Any
    ctes: list[Cte] = field(default_factory=list)
    functions: list[Any] = field(default_factory=list)
    order: list[Order] = field(default_factory=list)
    siblings: bool = False
    offset: Any = None
    fetch: Any = None
    percent: bool = False
    ties: bool = False


# statements


@dataclass
class Insert:
    table: list[str]
    columns: list[str]
    rows: list[list[Any]] | None
    query: Query | None
    when: Any = None
    returning: list[Item] = field(default_factory=list)


@dataclass
class InsertAll:
    inserts: list[Insert]
    query: Query
    first: bool


@dataclass
class Update:
    table: list[str]
    alias: str
    sets: list[tuple[list[str], Any]]
    where: Any
    returning: list[Item] = field(default_factory=list)


@dataclass
class Delete:
    table: list[str]
    alias: str
    where: Any
    returning: list[Item] = field(default_factory=list)


@dataclass
class Merge:
    table: list[str]
    alias: str
    source: Any
    on: Any
    sets: list[tuple[list[str], Any]]
    update_where: Any
    delete_where: Any
    columns: list[str]
    values: list[Any]
    insert_where: Any
    returning: list[Item] = field(default_factory=list)
