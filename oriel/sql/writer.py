"""The syntax tree as Spark SQL.

A query becomes one text, so Catalyst sees the whole plan.  What Spark cannot
parse is rewritten here: outer-join marks, partitioned joins, hierarchies,
quantified comparisons, ties and percentages, row numbers, collections.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator
from typing import Any

from pyspark.sql import types as T

from ..catalog import Catalog, CollectionType, ResolutionError, quoted, split_name
from ..functions import scalar as fn
from ..functions import xml
from ..types import spark_type
from . import tree as t
from .lexer import UnsupportedSyntax

SHORT_CALLS = frozenset("SYSDATE SYSTIMESTAMP CURRENT_DATE CURRENT_TIMESTAMP LOCALTIMESTAMP USER SESSION_USER CURRENT_USER UID SESSIONTIMEZONE".split())
METHODS = frozenset("COUNT FIRST LAST LIMIT EXISTS NEXT PRIOR".split())
FLIP = {"=": "=", "<>": "<>", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


@dataclasses.dataclass
class Raw:
    """Spark SQL that is written as it stands."""

    text: str


@dataclasses.dataclass
class Row:
    """The items of a select list as one struct."""

    items: list[t.Item]


def children(node: Any) -> Iterator[Any]:
    if isinstance(node, (list, tuple)):
        yield from node
    elif dataclasses.is_dataclass(node):
        for f in dataclasses.fields(node):
            yield getattr(node, f.name)
    elif isinstance(node, dict):
        yield from node.values()


def find(node: Any, kind: Any, into_queries: bool = False) -> Iterator[Any]:
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, kind):
            yield x
        if isinstance(x, t.Query) and not into_queries and x is not node:
            continue
        todo += children(x)


def conjuncts(e: Any) -> list[Any]:
    if isinstance(e, t.Binary) and e.op == "AND":
        return conjuncts(e.left) + conjuncts(e.right)
    return [] if e is None else [e]


def all_of(parts: list[Any]) -> Any:
    out = None
    for p in parts:
        out = p if out is None else t.Binary("AND", out, p)
    return out


class Writer:
    def __init__(self, catalog: Catalog, view_of, binds: dict[str, str] | None = None, names: dict[str, Any] | None = None):
        """``view_of(schema, name)`` gives the view a table is read by; ``names`` are variables of an enclosing routine."""
        self.catalog, self.view_of, self.binds, self.names = catalog, view_of, binds or {}, names or {}
        self.scopes: list[dict[str, dict[str, T.DataType] | None]] = []
        self.ctes: list[set[str]] = [set()]
        self.heads: list[tuple[list[str], bool]] = []  # the common table expressions around what is being written
        self.swaps: list[dict[str, str]] = []
        self.hierarchy: list[dict[str, str]] = []
        self.setup: list[str] = []  # statements to run first
        self.host: Any = None  # who can number rows and take shares of them: an engine, or nobody where only text is wanted
        self.keeps: dict[int, str] = {}  # by KEEP call: the condition that a row is among the first or last of its group
        self.drawn: dict[tuple[str, str], int] | None = None  # sequence values of the row of VALUES that is being written
        self.n = 0

    def fresh(self, stem: str) -> str:
        self.n += 1
        return f"__{stem}{self.n}"

    def string(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def type_text(self, text: str) -> str:
        return self.catalog.spark_type(text).simpleString() if text else "string"

    # queries

    def query(self, q: t.Query) -> str:
        self.ctes.append(set(self.ctes[-1]))
        for name, params, kind, value in q.functions:
            self.with_function(name, params, kind, value)
        parts, recursive = [], False
        for c in q.ctes:
            text, again = self.cte(c)
            parts += text
            recursive |= again
        self.heads.append((parts, recursive))
        if isinstance(q.body, t.Block):
            body = self.block(q.body, q)
        else:
            body = self.set_op(q.body) + self.tail(q)
            if q.ties or q.percent:
                body = self.limited_set(q)
        self.ctes.pop()
        self.heads.pop()
        head = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} " if parts else ""
        return head + body

    def headed(self, text: str) -> str:
        """A part of a query that is run by itself, with the common table expressions it may name."""
        parts = [p for own, _ in self.heads for p in own]
        return (f"WITH {'RECURSIVE ' if any(r for _, r in self.heads) else ''}{', '.join(parts)} " if parts else "") + text

    def with_function(self, name: str, params: list[tuple[str, str]], kind: str, value: Any) -> str:
        own = self.fresh(f"fn_{name.lower()}_")
        self.names = self.names | {p.lower(): Raw(quoted(p.lower())) for p, _ in params}
        args = ", ".join(f"{quoted(p.lower())} {self.type_text(k)}" for p, k in params)
        self.setup.append(f"CREATE OR REPLACE TEMPORARY FUNCTION {own}({args}) RETURNS {self.type_text(kind)} RETURN {self.expr(value)}")
        self.names = {k: v for k, v in self.names.items() if k not in {p.lower() for p, _ in params}}
        self.catalog.functions[self.catalog.schema, name.upper()] = own
        return own

    def cte(self, c: t.Cte) -> tuple[list[str], bool]:
        name = c.name.lower()
        again = any(tb.name[-1].lower() == name for tb in find(c.query, t.Table, into_queries=True))
        cols = f"({', '.join(quoted(x) for x in c.columns)})" if c.columns else ""
        self.ctes[-1].add(name)
        if not again:
            return [f"{quoted(c.name)}{cols} AS ({self.query(c.query)})"], False
        if c.search or c.cycle:
            return self.walked_cte(c), True
        return [f"{quoted(c.name)}{cols} AS ({self.query(c.query)})"], True

    def walked_cte(self, c: t.Cte) -> list[str]:
        """A recursive query with SEARCH or CYCLE: rows carry their path."""
        body = c.query.body
        if not (isinstance(body, t.SetOp) and body.op == "UNION ALL" and isinstance(body.left, t.Block) and isinstance(body.right, t.Block) and c.columns):
            raise UnsupportedSyntax("SEARCH and CYCLE need a column list and two branches under UNION ALL")
        inner = self.fresh(c.name.lower())
        left, right = body.left, body.right
        place = {x.lower(): i for i, x in enumerate(c.columns)}
        own = next(tb for tb in find(right.tables, t.Table) if tb.name[-1].lower() == c.name.lower())
        own.alias = own.alias or own.name[-1]
        own.name = [inner]
        self.ctes[-1].add(inner.lower())
        extra, outer, hidden = [], [], []

        def at(side: t.Block, names: list[str]) -> list[Any]:
            return [side.items[place[n.lower()]].expr for n in names]

        if c.search:
            keys = [o.expr.parts[-1] for o in c.search[1]]
            if any(o.desc for o in c.search[1]):
                raise UnsupportedSyntax("SEARCH BY ... DESC")
            write = lambda side: f"struct({', '.join(self.inside(side, e) for e in at(side, keys))})"
            if c.search[0] == "DEPTH":
                left.items.append(t.Item(Raw(f"array({write(left)})")))
                right.items.append(t.Item(Raw(f"array_append({quoted(own.alias)}.`__path`, {write(right)})")))
                outer.append(f"row_number() OVER (ORDER BY `__path`) AS {quoted(c.search[2])}")
            else:
                left.items.append(t.Item(Raw(f"struct(1 AS d, {write(left)} AS k)")))
                right.items.append(t.Item(Raw(f"struct({quoted(own.alias)}.`__path`.d + 1 AS d, {write(right)} AS k)")))
                outer.append(f"row_number() OVER (ORDER BY `__path`.d, `__path`.k) AS {quoted(c.search[2])}")
            extra.append("`__path`")
            hidden.append("`__path`")
        if c.cycle:
            cols, mark, yes, no = c.cycle
            write = lambda side: f"struct({', '.join(self.inside(side, e) for e in at(side, cols))})"
            left.items += [t.Item(Raw(f"array({write(left)})")), t.Item(Raw(self.string(no)))]
            seen = f"{quoted(own.alias)}.`__seen`"
            right.items += [t.Item(Raw(f"array_append({seen}, {write(right)})")), t.Item(Raw(f"CASE WHEN array_contains({seen}, {write(right)}) THEN {self.string(yes)} ELSE {self.string(no)} END"))]
            right.where = all_of([*conjuncts(right.where), Raw(f"{quoted(own.alias)}.{quoted(mark)} = {self.string(no)}")])
            extra += ["`__seen`", quoted(mark)]
            hidden.append("`__seen`")
        head = ", ".join([*(quoted(x) for x in c.columns), *extra])
        text = f"{inner}({head}) AS ({self.query(c.query)})"
        more = "".join(f", {x}" for x in outer)
        return [text, f"{quoted(c.name)} AS (SELECT * EXCEPT ({', '.join(hidden)}){more} FROM {inner})"]

    def inside(self, side: t.Block, e: Any) -> str:
        self.scopes.append(self.scope(side.tables))
        out = self.expr(e)
        self.scopes.pop()
        return out

    def set_op(self, s: Any) -> str:
        """Set operators are left associative and of equal precedence, so each step is parenthesised."""
        if isinstance(s, t.SetOp):
            return f"({self.set_op(s.left)}) {s.op} ({self.set_op(s.right)})"
        return self.query(s) if isinstance(s, t.Query) else self.block(s)

    def limited_set(self, q: t.Query) -> str:
        if q.percent and (text := self.share(f"SELECT *{{keys}} FROM ({self.set_op(q.body)})", q, {})):
            return text
        rank = self.rank_of(q, q.order)
        return f"SELECT * EXCEPT (`__rk`) FROM (SELECT *, {rank} AS `__rk` FROM ({self.set_op(q.body)})) WHERE {self.rank_limit(q)} ORDER BY `__rk`"

    def rank_of(self, q: t.Query, order: list[t.Order], swap: dict[str, Any] | None = None) -> str:
        keys = self.orders(order, swap) if order else "1"
        if q.percent and not q.ties:
            return f"named_struct('r', row_number() OVER (ORDER BY {keys}), 'n', count(*) OVER ())"
        if q.percent:
            return f"named_struct('r', rank() OVER (ORDER BY {keys}), 'n', count(*) OVER ())"
        return f"rank() OVER (ORDER BY {keys})"  # a plain rank lets Spark limit each task's rows first

    def rank_limit(self, q: t.Query) -> str:
        if q.offset is not None:
            raise UnsupportedSyntax("OFFSET with ties or a percentage")
        n = self.expr(q.fetch)
        return f"`__rk`.r <= ceil(`__rk`.n * {n} / 100.0)" if q.percent else f"`__rk` <= {n}"

    def share(self, text: str, q: t.Query, swap: dict[str, Any]) -> str | None:
        """FETCH n PERCENT from rows written in order, none where that cannot be; ``text`` has room for sort keys."""
        if self.host is None or not (isinstance(q.fetch, t.Lit) and q.fetch.kind == "number") or not (q.offset is None or isinstance(q.offset, t.Lit)):
            return None
        keys = [(f"`__o{i}`", bool(o.desc), (o.nulls or ("FIRST" if o.desc else "LAST")) == "FIRST") for i, o in enumerate(q.order)]
        more = "".join(f", {self.sort_key(o, swap)} AS {k}" for o, (k, _, _) in zip(q.order, keys))
        view = self.host.share(self, self.headed(text.replace("{keys}", more, 1)), keys, float(q.fetch.value), q.ties, int(q.offset.value) if q.offset is not None else 0)
        if view is None:
            return None
        order = ", ".join(f"{k} {'DESC' if desc else 'ASC'} NULLS {'FIRST' if first else 'LAST'}" for k, desc, first in keys)
        return f"SELECT * EXCEPT ({', '.join(k for k, _, _ in keys)}) FROM {view} ORDER BY {order}" if keys else f"SELECT * FROM {view}"

    def tail(self, q: t.Query | None, swap: dict[str, Any] | None = None) -> str:
        if q is None:
            return ""
        out = f" ORDER BY {self.orders(q.order, swap)}" if q.order else ""
        if q.fetch is not None and not (q.ties or q.percent):
            out += f" LIMIT {self.expr(q.fetch)}"
        if q.offset is not None:
            out += f" OFFSET {self.expr(q.offset)}"
        return out

    def orders(self, order: list[t.Order], swap: dict[str, Any] | None = None) -> str:
        """Sort keys with their nulls placed as Oracle does: last when ascending, first when descending."""
        out = []
        for o in order:
            nulls = o.nulls or ("FIRST" if o.desc else "LAST")
            out.append(f"{self.sort_key(o, swap)} {'DESC' if o.desc else 'ASC'} NULLS {nulls}")
        return ", ".join(out)

    def sort_key(self, o: t.Order, swap: dict[str, Any] | None = None) -> str:
        e = o.expr
        if swap and isinstance(e, t.Name) and len(e.parts) == 1 and e.parts[0].lower() in swap:
            e = swap[e.parts[0].lower()]
        elif swap and isinstance(e, t.Lit) and e.kind == "number":
            e = list(swap.values())[int(e.value) - 1]
        return self.expr(e)

    # blocks

    def block(self, b: t.Block, q: t.Query | None = None) -> str:
        if b.connect is not None:
            return self.connect_by(b, q)
        self.scopes.append(self.scope(b.tables))
        self.swaps.append({})
        try:
            return self._block(b, q)
        finally:
            self.scopes.pop()
            self.swaps.pop()

    def _block(self, b: t.Block, q: t.Query | None) -> str:
        where, limit = self.rownum(conjuncts(b.where))
        tables, where = self.marked_joins(b.tables, where)
        source = self.tables(tables)
        if any(self.is_rownum(n) or self.sequence(n) for n in find([b.items, q.order if q else []], t.Name)) and (view := self.numbered(b, q, tables, source, where, limit)):
            source, where, limit = view, [], None
        if kept := [c for c in find([b.items, b.having, q.order if q else []], t.Call) if c.keep is not None and c.over is None and not self.aligned(c)]:
            source, where, limit = self.with_extremes(b, q, source, where, limit, kept), [], None
        items = ", ".join(self.item(i) for i in b.items)
        text = f"SELECT {'DISTINCT ' if b.distinct else ''}{{items}}" + (f" FROM {source}" if source else "")
        if where:
            text += f" WHERE {self.expr(all_of(where))}"
        if b.group:
            text += f" GROUP BY {', '.join(self.group(g) for g in b.group)}"
        if b.having is not None:
            text += f" HAVING {self.expr(b.having)}"
        swap = {(i.alias or (i.expr.parts[-1] if isinstance(i.expr, t.Name) else f"#{k}")).lower(): i.expr for k, i in enumerate(b.items)}
        if q is not None and q.percent and not b.distinct and (shared := self.share(text.replace("{items}", f"{items}{{keys}}", 1), q, swap)):
            return shared
        if q is not None and (q.ties or q.percent):
            inner = text.replace("{items}", f"{items}, {self.rank_of(q, q.order, swap)} AS `__rk`", 1)
            return f"SELECT * EXCEPT (`__rk`) FROM ({inner}) WHERE {self.rank_limit(q)} ORDER BY `__rk`"
        text = text.replace("{items}", items, 1)
        if limit is not None:  # ROWNUM counts rows before they are ordered
            text = f"{text} LIMIT {limit}"
            return f"SELECT * FROM ({text}){self.tail(q)}" if q is not None and q.order else text
        return text + self.tail(q)

    def item(self, i: t.Item) -> str:
        e = i.expr
        text = self.expr(e)
        if i.alias:
            return f"{text} AS {quoted(i.alias)}"
        if isinstance(e, t.Name) and not text.endswith(quoted(e.parts[-1])):
            return f"{text} AS {quoted(e.parts[-1].lower())}"
        return text

    def group(self, g: Any) -> str:
        if isinstance(g, t.GroupingSets):
            inner = ", ".join(self.group(x) for x in g.items)
            return f"GROUPING SETS ({inner})" if g.kind == "SETS" else f"{g.kind}({inner})"
        if isinstance(g, t.Tuple):
            return f"({', '.join(self.expr(x) for x in g.items)})"
        return self.expr(g)

    def rownum(self, parts: list[Any]) -> tuple[list[Any], int | None]:
        out, limit = [], None
        for p in parts:
            if isinstance(p, t.Binary) and p.op in FLIP:
                a, op, b = p.left, p.op, p.right
                if self.is_rownum(b):
                    a, op, b = b, FLIP[op], a
                if self.is_rownum(a):
                    if not (isinstance(b, t.Lit) and b.kind == "number") or op not in ("<", "<=", "="):
                        raise UnsupportedSyntax("ROWNUM compares with a number by <, <= or =")
                    n = int(float(b.value)) - (op == "<")
                    n = n if op != "=" or n == 1 else 0
                    limit = n if limit is None else min(limit, n)
                    continue
            out.append(p)
        if any(self.is_rownum(x) for p in out for x in find(p, t.Name)):
            raise UnsupportedSyntax("ROWNUM within a larger condition")
        return out, limit

    def numbered(self, b: t.Block, q: t.Query | None, tables: list[Any], source: str, where: list[Any], limit: int | None) -> str | None:
        """The rows that the conditions leave, written with their numbers; from there on names mean the columns written.

        None where nobody can write them, or where they hang on an enclosing query.
        """
        parts = [b.items, b.group, b.having, q.order if q else []]
        stars = [i for i in b.items if isinstance(i.expr, t.Star)]
        if self.host is None or not source or any(True for _ in find(parts, t.Query)) or stars and (len(tables) > 1 or isinstance(tables[0], t.Join)):
            return None
        drawn = {k: n for n in find(b.items, t.Name) if (k := self.sequence(n)) and n.parts[-1].upper() == "NEXTVAL"}
        if drawn and (b.group or b.distinct):
            raise UnsupportedSyntax("NEXTVAL with GROUP BY or DISTINCT")
        columns = self.columns_in(b, parts)
        items = [*(["*"] if stars else []), *(f"{x} AS `__c{i}`" for i, x in enumerate(columns.values()))] or ["1 AS `__c0`"]
        text = f"SELECT {', '.join(items)} FROM {source}" + (f" WHERE {self.expr(all_of(where))}" if where else "") + (f" LIMIT {limit}" if limit is not None else "")
        got = self.host.number(self, self.headed(text))
        if got is None:
            return None
        view, total = got
        self.swaps[-1] |= {low: f"`__c{i}`" for i, low in enumerate(columns)} | {"rownum": "`__rownum`"}
        for key in drawn:
            seq = self.catalog.sequences[key]
            value = f"({seq.next} + {seq.step} * (`__rownum` - 1))"
            seq.next += seq.step * total
            for n in find(b.items, t.Name):
                if self.sequence(n) == key:  # CURRVAL beside NEXTVAL is the same number
                    self.swaps[-1][".".join(n.parts).lower()] = value
        for i in stars:
            i.expr = Raw(f"* EXCEPT ({', '.join(['`__rownum`', *(f'`__c{k}`' for k in range(len(columns)))])})")
        return view

    def columns_in(self, b: t.Block, parts: Any) -> dict[str, str]:
        """The columns that parts of a block name, as they are written there, by lower-case name."""
        aliases = {i.alias.lower() for i in b.items if i.alias}
        out: dict[str, str] = {}
        for n in find(parts, t.Name):
            low = ".".join(n.parts).lower()
            lone = len(n.parts) == 1 and (n.parts[0].upper() in SHORT_CALLS or low in self.names or low in aliases and self.column(n.parts) is None)
            if not (lone or self.is_rownum(n) or self.sequence(n)):
                out.setdefault(low, self._name(n))
        return out

    def with_extremes(self, b: t.Block, q: t.Query | None, source: str, where: list[Any], limit: int | None, calls: list[t.Call]) -> str:
        """The block's rows beside the first or last sort keys of their group, which are aggregated before and joined back.

        Any aggregate can then be taken of the rows whose keys are those, and each part of it adds up before it is shuffled.
        """
        if any(isinstance(g, (t.GroupingSets, t.Tuple)) for g in b.group) or any(True for _ in find([b.items, b.having], t.Query)):
            raise UnsupportedSyntax("KEEP beside grouping sets or subqueries")
        columns = self.columns_in(b, [b.items, b.group, b.having, q.order if q else []])
        items = [f"{x} AS `__c{i}`" for i, x in enumerate(columns.values())] or ["1 AS `__c0`"]
        inner = f"(SELECT {', '.join(items)} FROM {source}" + (f" WHERE {self.expr(all_of(where))}" if where else "") + (f" LIMIT {limit}" if limit is not None else "") + ")"
        self.swaps[-1] |= {low: f"`__c{i}`" for i, low in enumerate(columns)}
        groups = [self.expr(g) for g in b.group]
        picks = [f"{g} AS `__g{i}`" for i, g in enumerate(groups)]
        for i, c in enumerate(calls):
            keys = self.sort_struct(c.keep[1])
            picks.append(f"{'max' if self.last_rows(c) else 'min'}({keys}) AS `__m{i}`")
            self.keeps[id(c)] = f"{keys} <=> `__m{i}`"
        extremes = f"(SELECT {', '.join(picks)} FROM {inner}" + (f" GROUP BY {', '.join(groups)}" if groups else "") + ")"
        return f"{inner} JOIN {extremes} ON {' AND '.join(f'{g} <=> `__g{i}`' for i, g in enumerate(groups)) or 'true'}"

    def last_rows(self, e: t.Call) -> bool:
        """Whether KEEP takes the greatest sort keys."""
        how, order = e.keep
        if len({o.desc for o in order}) > 1:
            raise UnsupportedSyntax("KEEP orders by one direction")
        return (how == "LAST") != order[0].desc

    def aligned(self, e: t.Call) -> bool:
        """MIN of the least rows and MAX of the greatest: one aggregate of keys and value together."""
        return e.parts[-1].upper() == ("MAX" if self.last_rows(e) else "MIN")

    def sort_struct(self, order: list[t.Order]) -> str:
        """Sort keys of one direction as one value: nulls are the greatest, unless the order puts them at the other end."""
        parts = []
        for o in order:
            x = self.expr(o.expr)
            greatest = not o.nulls or (o.nulls == "FIRST") == o.desc
            parts += [f"{x} IS {'' if greatest else 'NOT '}NULL", x]
        return f"struct({', '.join(parts)})"

    def sequence(self, e: Any) -> tuple[str, str] | None:
        """The sequence that a name takes a value of."""
        if not isinstance(e, t.Name) or len(e.parts) < 2 or e.parts[-1].upper() not in ("NEXTVAL", "CURRVAL"):
            return None
        schema, short = split_name(".".join(e.parts[:-1]))
        key = (schema or self.catalog.schema, short)
        return key if key in self.catalog.sequences else None

    def sequence_value(self, e: t.Name, key: tuple[str, str]) -> str:
        """A value outside a query's rows: the current one, or in VALUES the next, once for each row."""
        seq = self.catalog.sequences[key]
        if e.parts[-1].upper() == "CURRVAL":
            return str(seq.current)
        if self.drawn is None:
            raise UnsupportedSyntax("NEXTVAL numbers the rows of a select list, or of VALUES")
        if key not in self.drawn:
            self.drawn[key] = seq.next
            seq.next += seq.step
        return str(self.drawn[key])

    def is_rownum(self, e: Any) -> bool:
        return isinstance(e, t.Name) and [p.upper() for p in e.parts] == ["ROWNUM"]

    def marked_joins(self, tables: list[Any], where: list[Any]) -> tuple[list[Any], list[Any]]:
        """Conditions with (+) move into left joins of the tables they mark."""
        marked: dict[str, list[Any]] = {}
        rest = []
        for p in where:
            owners = {self.owner(n) for n in find(p, t.Name) if n.outer}
            if not owners:
                rest.append(p)
            elif len(owners) > 1:
                raise UnsupportedSyntax("a condition marks more than one table with (+)")
            else:
                marked.setdefault(owners.pop(), []).append(p)
        if not marked:
            return tables, where
        named = {self.alias_of(x).lower(): x for x in tables}
        base = [x for x in tables if self.alias_of(x).lower() not in marked]
        if len(base) == len(tables) or not base:
            raise UnsupportedSyntax("(+) marks a table that is not in FROM")
        out: Any = base[0]
        for x in base[1:]:
            out = t.Join(out, x, "CROSS")
        placed, todo = {self.alias_of(x).lower() for x in base}, dict(marked)
        while todo:  # a table is joined once all that its conditions name is there
            ready = [a for a, ps in todo.items() if all(self.owner(n) in placed | {a} for p in ps for n in find(p, t.Name) if self.owner(n))]
            if not ready:
                raise UnsupportedSyntax("tables marked with (+) depend on each other")
            for a in ready:
                out = t.Join(out, named[a], "LEFT", all_of(todo.pop(a)))
                placed.add(a)
        return [out], rest

    def owner(self, n: t.Name) -> str:
        if len(n.parts) > 1:
            return n.parts[-2].lower()
        for alias, cols in self.scopes[-1].items():
            if cols and n.parts[0].lower() in cols:
                return alias
        return ""

    def alias_of(self, x: Any) -> str:
        return x.alias or (x.name[-1] if isinstance(x, t.Table) else "")

    # relations

    def scope(self, tables: list[Any]) -> dict[str, dict[str, T.DataType] | None]:
        out: dict[str, dict[str, T.DataType] | None] = {}
        todo = list(tables)
        while todo:
            x = todo.pop(0)
            if isinstance(x, t.Join):
                todo = [x.left, x.right, *todo]
            elif isinstance(x, t.Table) and x.name[-1].lower() not in self.ctes[-1] and not (len(x.name) == 1 and x.name[0].upper() == "DUAL"):
                out[self.alias_of(x).lower()] = self.catalog.columns(".".join(x.name))
            elif hasattr(x, "alias"):
                out[(self.alias_of(x) or f"#{len(out)}").lower()] = None
            if isinstance(x, (t.Pivot, t.Unpivot)):
                inner = self.scope([x.source])
                out[(x.alias or f"#{len(out)}").lower()] = {k: v for cols in inner.values() if cols for k, v in cols.items()} or None
        return out

    def tables(self, tables: list[Any]) -> str:
        return ", ".join(self.table(x) for x in tables)

    def table(self, x: Any) -> str:
        alias = f" AS {quoted(x.alias)}" if getattr(x, "alias", "") else ""
        if isinstance(x, t.Table):
            if len(x.name) == 1 and x.name[0].upper() == "DUAL":
                return f"(SELECT 'X' AS dummy) AS {quoted(x.alias or 'dual')}"
            if len(x.name) == 1 and x.name[0].lower() in self.ctes[-1]:
                return quoted(x.name[0]) + alias
            key = self.catalog.resolve(".".join(x.name))
            if x.versions is not None:
                if self.host is None:
                    raise UnsupportedSyntax("versions of a table are read by an engine")
                name = self.host.view_of_versions(self, key, x.versions[0], *(self.expr(b) if b is not None else None for b in x.versions[1:]))
            else:
                name = self.view_of(*key)
            if x.sample is not None:
                name += f" TABLESAMPLE ({x.sample} PERCENT)" + (f" REPEATABLE ({x.seed})" if x.seed is not None else "")
            return f"{name} AS {quoted(x.alias or x.name[-1])}"
        if isinstance(x, t.Derived):
            return f"{'LATERAL ' if x.lateral else ''}({self.query(x.query)}){alias}"
        if isinstance(x, t.Unnest):
            return f"LATERAL explode({self.expr(x.expr)}) AS {quoted(x.alias or self.fresh('u'))}(column_value)"
        if isinstance(x, t.JsonTable):
            return self.json_table(x)
        if isinstance(x, t.XmlTable):
            return self.xml_table(x)
        if isinstance(x, t.Pivot):
            return self.pivot(x) + alias
        if isinstance(x, t.Unpivot):
            return self.unpivot(x) + alias
        return self.join(x)

    def join(self, j: t.Join) -> str:
        if j.partition:
            return self.partitioned(j)
        left = self.table(j.left)
        right = self.table(j.right)
        if isinstance(j.right, t.Join):
            right = f"({right})"
        if j.kind in ("APPLY", "OUTER APPLY"):
            if isinstance(j.right, t.Derived) and not j.right.lateral:
                right = "LATERAL " + right
            return f"{left} CROSS JOIN {right}" if j.kind == "APPLY" else f"{left} LEFT JOIN {right} ON true"
        if j.kind == "CROSS":
            return f"{left} CROSS JOIN {right}"
        kind = {"INNER": "JOIN", "LEFT": "LEFT JOIN", "RIGHT": "RIGHT JOIN", "FULL": "FULL JOIN"}[j.kind]
        if j.natural:
            return f"{left} NATURAL {kind} {right}"
        if j.using:
            return f"{left} {kind} {right} USING ({', '.join(quoted(c) for c in j.using)})"
        return f"{left} {kind} {right} ON {self.expr(j.on)}"

    def partitioned(self, j: t.Join) -> str:
        """Every combination of the partition's keys with the other side, and what there is of the partition."""
        if j.kind != "RIGHT" or not all(isinstance(k, t.Name) for k in j.partition):
            raise UnsupportedSyntax("a partitioned join is a RIGHT OUTER JOIN by columns")
        fact, keys = self.alias_of(j.left), [k.parts[-1] for k in j.partition]
        p = self.fresh("p")
        for k in keys:
            self.swaps[-1][f"{fact}.{k}".lower()] = self.swaps[-1][k.lower()] = f"{p}.{quoted(k)}"
        names = ", ".join(quoted(k) for k in keys)
        same = " AND ".join(f"{p}.{quoted(k)} <=> {quoted(fact)}.{quoted(k)}" for k in keys)
        return f"(SELECT DISTINCT {names} FROM {self.table(j.left)}) AS {p} CROSS JOIN {self.table(j.right)} LEFT JOIN {self.table(j.left)} ON {same} AND {self.expr(j.on)}"

    def json_table(self, x: t.JsonTable) -> str:
        e = self.expr(x.expr)
        each, row = x.path, "j"
        if each.endswith("[*]"):
            base = each[:-3]
            docs = e if base == "$" else f"get_json_object({e}, {self.string(base)})"
            rows = f"posexplode(from_json({docs}, 'array<string>'))"
        else:
            rows = f"posexplode(array({e if each == '$' else f'get_json_object({e}, {self.string(each)})'}))"
        cols = []
        for name, kind, path in x.columns:
            if kind == "ordinality":
                cols.append(f"cast(i + 1 AS INT) AS {quoted(name)}")
            else:
                value = row if path == "$" else f"get_json_object({row}, {self.string(path)})"
                cols.append(f"cast({value} AS {self.type_text(kind)}) AS {quoted(name)}")
        return f"LATERAL (SELECT {', '.join(cols)} FROM {rows} AS t(i, {row})) AS {quoted(x.alias or self.fresh('jt'))}"

    def xml_table(self, x: t.XmlTable) -> str:
        columns = [xml.XmlColumn(n, None if k == "ordinality" else k, p, None if d is None else self.expr(d)) for n, k, p, d in x.columns]
        try:
            made = xml.compiled(self.expr(x.expr), x.path, columns, cast=self.type_text)
        except xml.BadPath as bad:
            raise UnsupportedSyntax(f"XMLTABLE: {bad}") from None
        cols = ", ".join(f"{e} AS {quoted(c.name)}" for c, e in zip(columns, made.columns))
        return f"LATERAL (SELECT {cols} FROM posexplode({made.rows}) AS t(i, r)) AS {quoted(x.alias or self.fresh('xt'))}"

    def pivot(self, x: t.Pivot) -> str:
        self.scopes.append(self.scope([x.source]))
        aggs = ", ".join(self.expr(e) + (f" AS {quoted(a)}" if a else "") for e, a in x.aggregates)
        cols = ", ".join(quoted(c.parts[-1]) for c in x.columns)
        values = ", ".join(f"{self.pivot_value(e)} AS {quoted(a or self.label(e))}" for e, a in x.values)
        source = self.table(x.source)
        self.scopes.pop()
        return f"(SELECT * FROM {source} PIVOT ({aggs} FOR {cols if len(x.columns) == 1 else f'({cols})'} IN ({values})))"

    def pivot_value(self, e: Any) -> str:
        return f"({', '.join(self.expr(i) for i in e.items)})" if isinstance(e, t.Tuple) else self.expr(e)

    def label(self, e: Any) -> str:
        return "_".join(self.label(i) for i in e.items) if isinstance(e, t.Tuple) else str(e.value) if isinstance(e, t.Lit) else "v"

    def unpivot(self, x: t.Unpivot) -> str:
        nulls = "INCLUDE NULLS" if x.nulls else "EXCLUDE NULLS"
        many = len(x.values) > 1
        values = f"({', '.join(quoted(v) for v in x.values)})" if many else quoted(x.values[0])
        cols = ", ".join((f"({', '.join(quoted(c) for c in cs)})" if many else quoted(cs[0])) + f" AS {quoted(label)}" for cs, label in x.columns)
        return f"(SELECT * FROM {self.table(x.source)} UNPIVOT {nulls} ({values} FOR {quoted(x.name)} IN ({cols})))"

    # hierarchies

    def connect_by(self, b: t.Block, q: t.Query | None) -> str:
        """CONNECT BY as a recursive query that carries level, roots, paths and what it has seen."""
        base, h = self.fresh("base"), self.fresh("tree")
        where, joins = [], []
        for p in conjuncts(b.where):
            (joins if len(b.tables) > 1 and isinstance(p, t.Binary) and p.op == "=" and isinstance(p.left, t.Name) and isinstance(p.right, t.Name) else where).append(p)
        alias = self.alias_of(b.tables[0]) if len(b.tables) == 1 else ""
        self.scopes.append(self.scope(b.tables))
        source = f"SELECT *, xxhash64(struct(*)) AS `__id` FROM {self.tables(b.tables)}" + (f" WHERE {self.expr(all_of(joins))}" if joins else "")
        roots: list[Any] = []
        paths: list[t.Call] = []
        whole = [b.items, where, q.order if q else []]
        for u in find(whole, t.Unary):
            if u.op == "CONNECT_BY_ROOT" and u.arg not in roots:
                roots.append(u.arg)
        for c in find(whole, t.Call):
            if c.parts[-1].upper() == "SYS_CONNECT_BY_PATH" and c not in paths:
                paths.append(c)
        siblings = q.order if q is not None and q.siblings else []
        row = alias or base

        def at(e: Any) -> str:
            """An expression over the table's own row; the tree's row has columns of the same names."""
            self.hierarchy.append({"prior": h, "row": row})
            out = self.expr(e)
            self.hierarchy.pop()
            return out

        first = [f"{quoted(row)}.*", "1 AS `level`", f"array({quoted(row)}.`__id`) AS `__seen`"]
        again = [f"{quoted(row)}.*", f"{h}.`level` + 1", f"array_append({h}.`__seen`, {quoted(row)}.`__id`)"]
        for i, e in enumerate(roots):
            first.append(f"{at(e)} AS `__root{i}`")
            again.append(f"{h}.`__root{i}`")
        for i, c in enumerate(paths):
            first.append(f"concat({at(c.args[1])}, cast({at(c.args[0])} AS STRING)) AS `__path{i}`")
            again.append(f"concat({h}.`__path{i}`, {at(c.args[1])}, cast({at(c.args[0])} AS STRING))")
        if siblings:
            if any(o.desc for o in siblings):
                raise UnsupportedSyntax("ORDER SIBLINGS BY ... DESC")
            keys = f"struct({', '.join(at(o.expr) for o in siblings)})"
            first.append(f"array({keys}) AS `__sort`")
            again.append(f"array_append({h}.`__sort`, {keys})")
        start = f" WHERE {self.expr(b.start)}" if b.start is not None else ""
        link = at(b.connect)
        if b.nocycle:
            link += f" AND NOT array_contains({h}.`__seen`, {quoted(row)}.`__id`)"
        self.scopes.pop()
        # the result is read from the tree under the table's own name
        self.scopes.append({(alias or h).lower(): None})
        self.swaps.append({})
        self.hierarchy.append({"roots": roots, "paths": paths, "leaf": (h, row, link, base)})
        own = alias or h
        items = ", ".join(self.tree_item(i, own, bool(siblings)) for i in b.items)
        text = f"SELECT {'DISTINCT ' if b.distinct else ''}{items} FROM {h} AS {quoted(own)}"
        if where:
            text += f" WHERE {self.expr(all_of(where))}"
        if b.group:
            text += f" GROUP BY {', '.join(self.group(g) for g in b.group)}"
        if b.having is not None:
            text += f" HAVING {self.expr(b.having)}"
        if siblings:
            text += " ORDER BY `__sort`" + self.tail(dataclasses.replace(q, order=[]))
        else:
            text += self.tail(q)
        self.hierarchy.pop()
        self.swaps.pop()
        self.scopes.pop()
        frm = f"{base} AS {quoted(row)}"
        return (
            f"WITH RECURSIVE {base} AS ({source}), {h} AS (SELECT {', '.join(first)} FROM {frm}{start}"
            f" UNION ALL SELECT {', '.join(again)} FROM {frm} JOIN {h} ON {link}) {text}"
        )

    def tree_item(self, i: t.Item, own: str, sorted_: bool) -> str:
        if isinstance(i.expr, t.Star):
            h = self.hierarchy[-1]
            hide = ["`level`", "`__id`", "`__seen`", *(f"`__root{k}`" for k in range(len(h["roots"]))), *(f"`__path{k}`" for k in range(len(h["paths"]))), *(["`__sort`"] if sorted_ else [])]
            return f"* EXCEPT ({', '.join(hide)})"
        return self.item(i)

    # expressions

    def expr(self, e: Any) -> str:
        return getattr(self, "_" + type(e).__name__.lower())(e)

    def _raw(self, e: Raw) -> str:
        return e.text

    def _lit(self, e: t.Lit) -> str:
        if e.kind == "null":
            return "NULL"
        if e.kind == "bool":
            return "true" if e.value else "false"
        if e.kind == "number":
            v = e.value
            if v[-1] in "dDfF":
                return v[:-1] + ("D" if v[-1] in "dD" else "F")
            return v + "0" if v.endswith(".") else v
        if e.kind == "date":
            return f"TIMESTAMP_NTZ '{e.value}'" if len(e.value) > 10 else f"TIMESTAMP_NTZ '{e.value} 00:00:00'"
        if e.kind == "timestamp":
            return f"TIMESTAMP_NTZ '{e.value}'"
        return self.string(e.value)

    def _bind(self, e: t.Bind) -> str:
        if e.name.lower() in self.names:
            return self.expr(self.names[e.name.lower()])
        if e.name not in self.binds:
            raise ResolutionError(f"no value for :{e.name}")
        return f":{e.name}"

    def _star(self, e: t.Star) -> str:
        return f"{quoted(e.table[-1])}.*" if e.table else "*"

    def column(self, parts: list[str]) -> T.DataType | None:
        """The type of a column in scope, if it is known."""
        for scope in reversed(self.scopes):
            if len(parts) > 1:
                cols = scope.get(parts[0].lower()) or {}
                if parts[1].lower() in cols:
                    return cols[parts[1].lower()]
            for cols in scope.values():
                if cols and parts[0].lower() in cols:
                    return cols[parts[0].lower()]
        return None

    def _name(self, e: t.Name) -> str:
        parts = e.parts
        low = ".".join(parts).lower()
        if self.swaps and low in self.swaps[-1]:
            return self.swaps[-1][low]
        if key := self.sequence(e):
            return self.sequence_value(e, key)
        if len(parts) == 1 and self.column(parts) is None:
            up = parts[0].upper()
            if low in self.names:
                return self.expr(self.names[low])
            if self.hierarchy and up == "LEVEL":
                h = self.hierarchy[-1]
                return f"({h['prior']}.`level` + 1)" if "prior" in h else "`level`"
            if self.hierarchy and up == "CONNECT_BY_ISLEAF":
                return self.is_leaf()
            if up in SHORT_CALLS:
                return fn.TEMPLATES[up] if up in fn.TEMPLATES else "current_date()"
            if self.hierarchy and "row" in self.hierarchy[-1]:
                return f"{quoted(self.hierarchy[-1]['row'])}.{quoted(parts[0])}"
            if up == "ROWNUM":
                return "row_number() OVER (ORDER BY monotonically_increasing_id())"
        if len(parts) == 1 and self.hierarchy and "row" in self.hierarchy[-1]:
            return f"{quoted(self.hierarchy[-1]['row'])}.{quoted(parts[0])}"
        if len(parts) > 1 and parts[-1].upper() in METHODS and self.collection(t.Name(parts[:-1])):
            return self.method(t.Name(parts[:-1]), parts[-1].upper(), [])
        if len(parts) > 1 and low in self.names:
            return self.expr(self.names[low])
        return ".".join(quoted(p) for p in (parts if len(parts) < 3 or self.column(parts) is not None else parts[-2:]))

    def is_leaf(self) -> str:
        h, row, link, base = self.hierarchy[-1]["leaf"]
        own = next(iter(self.scopes[-1]))
        # a row is a leaf if nothing links to it as its parent
        kid = self.fresh("kid")
        text = link.replace(f"{quoted(row)}.", f"{kid}.").replace(f"{h}.", f"{quoted(own)}.")
        return f"CASE WHEN EXISTS (SELECT 1 FROM {base} AS {kid} WHERE {text}) THEN 0 ELSE 1 END"

    def _field(self, e: t.Field) -> str:
        if e.name.startswith("%"):
            raise UnsupportedSyntax("cursor attributes belong to routines")
        if e.name.upper() in METHODS and self.collection(e.base):
            return self.method(e.base, e.name.upper(), e.args or [])
        return f"{self.expr(e.base)}.{quoted(e.name)}"

    def _unary(self, e: t.Unary) -> str:
        if e.op == "NOT":
            return f"(NOT {self.expr(e.arg)})"
        if e.op == "PRIOR":
            h = next((x["prior"] for x in reversed(self.hierarchy) if "prior" in x), None)
            if h is None:
                raise UnsupportedSyntax("PRIOR outside CONNECT BY")
            # the columns of the parent row
            names = {id(n): n.parts for n in find(e.arg, t.Name)}
            for n in find(e.arg, t.Name):
                n.parts = [h, n.parts[-1]]
            out = self.expr(e.arg)
            for n in find(e.arg, t.Name):
                n.parts = names[id(n)]
            return out
        if e.op == "CONNECT_BY_ROOT":
            return f"`__root{self.hierarchy[-1]['roots'].index(e.arg)}`"
        return f"({e.op}{self.expr(e.arg)})"

    def _binary(self, e: t.Binary) -> str:
        op = e.op
        if op in ("MEMBER", "SUBMULTISET"):
            a, b = self.expr(e.left), self.expr(e.right)
            if op == "MEMBER":
                return f"array_contains({b}, {a})"
            return f"forall(array_distinct({a}), x -> size(filter({a}, y -> y = x)) <= size(filter({b}, y -> y = x)))"
        if op.startswith("MULTISET"):
            return self.multiset(op, self.expr(e.left), self.expr(e.right))
        a, b = self.expr(e.left), self.expr(e.right)
        if op == "**":
            return f"power({a}, {b})"
        if op == "MOD":
            return f"({a} % {b})"
        if op == "AT TIME ZONE":
            return f"from_utc_timestamp({a}, {b})" if self.is_ntz(e.left) is False else f"convert_timezone(current_timezone(), {b}, {a})"
        if op == "COLLATE":
            return f"collate({a}, '{self.collation(e.right)}')"
        if op == "[]":
            return f"try_element_at({a}, {b})"
        if op in ("+", "-") and self.is_date(e.left):
            if op == "-" and self.is_date(e.right):
                return f"((unix_micros(cast({a} AS TIMESTAMP)) - unix_micros(cast({b} AS TIMESTAMP))) / 86400000000D)"
            if not isinstance(e.right, t.Interval) and not self.is_interval(e.right):
                return f"({a} {op} make_dt_interval(0, 0, 0, cast(({b}) * 86400 AS DECIMAL(18, 6))))"
        if op in FLIP and self.limit_of(e.left) is not None:
            return self.folded(op, self.limit_of(e.left), e.right)
        if op in FLIP and isinstance(e.left, t.Tuple) and isinstance(e.right, t.Sub):
            return f"(({', '.join(self.expr(x) for x in e.left.items)}) IN {b})"
        return f"({a} {op} {b})"

    def folded(self, op: str, limit: int, right: Any) -> str:
        """A comparison with a VARRAY's LIMIT is known when it is written."""
        if isinstance(right, t.Lit) and right.kind == "number":
            r = float(right.value)
            return "true" if {"=": limit == r, "<>": limit != r, "<": limit < r, "<=": limit <= r, ">": limit > r, ">=": limit >= r}[op] else "false"
        return f"({limit} {op} {self.expr(right)})"

    def limit_of(self, e: Any) -> int | None:
        if isinstance(e, t.Name) and len(e.parts) == 2 and e.parts[1].upper() == "LIMIT":
            kind = self.catalog.type_of(e.parts[0]) or self.names.get(f"{e.parts[0].lower()}%type")
            return kind.limit if isinstance(kind, CollectionType) else None
        return None

    def multiset(self, op: str, a: str, b: str) -> str:
        _, what, how = op.split()
        if how == "DISTINCT":
            return {"UNION": f"array_union({a}, {b})", "INTERSECT": f"array_intersect({a}, {b})", "EXCEPT": f"array_except({a}, {b})"}[what]
        if what == "UNION":
            return f"concat({a}, {b})"
        # the k-th copy of a value is in the other as well if that holds k copies
        kth = f"size(filter(slice({a}, 1, i + 1), y -> y <=> x))"
        there = f"size(filter({b}, y -> y <=> x))"
        return f"filter({a}, (x, i) -> {kth} {'<=' if what == 'INTERSECT' else '>'} {there})"

    def collation(self, e: Any) -> str:
        name = e.parts[-1].upper()
        if name in ("BINARY_CI", "BINARY_AI") or name.endswith("_CI"):
            return "UTF8_LCASE" if name == "BINARY_CI" else "UNICODE_CI"
        return {"BINARY": "UTF8_BINARY"}.get(name, name)

    def _is(self, e: t.Is) -> str:
        x, no = self.expr(e.arg), "NOT " if e.negated else ""
        if e.what == "NULL":
            return f"({x} IS {no}NULL)"
        text = {
            "NAN": f"isnan({x})",
            "EMPTY": f"(size({x}) = 0)",
            "INFINITE": f"(abs({x}) = double('infinity'))",
            "PRESENT": f"({x} IS NOT NULL)",
            "JSON": f"(try_parse_json({x}) IS NOT NULL)",
            "A SET": f"(size({x}) = size(array_distinct({x})))",
        }[e.what]
        return f"({no}{text})"

    def _in(self, e: t.In) -> str:
        left = f"({', '.join(self.expr(x) for x in e.arg.items)})" if isinstance(e.arg, t.Tuple) else self.expr(e.arg)
        right = self.query(e.items) if isinstance(e.items, t.Query) else ", ".join(self.pivot_value(x) for x in e.items)
        return f"({left} {'NOT ' if e.negated else ''}IN ({right}))"

    def _between(self, e: t.Between) -> str:
        return f"({self.expr(e.arg)} {'NOT ' if e.negated else ''}BETWEEN {self.expr(e.low)} AND {self.expr(e.high)})"

    def _like(self, e: t.Like) -> str:
        # without ESCAPE nothing escapes in Oracle; Spark's default is the backslash
        pattern = e.pattern
        escape = f" ESCAPE {self.expr(e.escape)}" if e.escape is not None else ""
        if not escape and isinstance(pattern, t.Lit) and "\\" in str(pattern.value):
            pattern = t.Lit(pattern.value.replace("\\", "\\\\"), "string")
        return f"({self.expr(e.arg)} {'NOT ' if e.negated else ''}{'ILIKE' if e.fold else 'LIKE'} {self.expr(pattern)}{escape})"

    def _quantified(self, e: t.Quantified) -> str:
        left = self.expr(e.left)
        if isinstance(e.right, list):
            return "(" + (" OR " if e.how == "ANY" else " AND ").join(f"{left} {e.op} {self.expr(x)}" for x in e.right) + ")"
        q, c = self.query(e.right), self.fresh("q")
        rows = f"(SELECT * FROM ({q})) AS {c}(v)"
        if e.how == "ANY":
            if e.op == "=":
                return f"({left} IN ({q}))"
            if e.op == "<>":
                return f"EXISTS (SELECT 1 FROM {rows} WHERE {c}.v <> {left})"
            pick = "max" if e.op in ("<", "<=") else "min"
            return f"coalesce({left} {e.op} (SELECT {pick}(v) FROM {rows}), false)"
        if e.op == "<>":
            return f"({left} NOT IN ({q}))"
        if e.op == "=":
            return f"coalesce((SELECT min(v) = {left} AND max(v) = {left} AND count(*) = count(v) FROM {rows}), true)"
        pick = "min" if e.op in ("<", "<=") else "max"
        # true over no rows; unknown, hence not true, where a null is among them
        return f"(coalesce({left} {e.op} (SELECT {pick}(v) FROM {rows}), (SELECT count(*) = 0 FROM {rows})) AND (SELECT count(*) = count(v) FROM {rows}))"

    def _exists(self, e: t.Exists) -> str:
        return f"EXISTS ({self.query(e.query)})"

    def _sub(self, e: t.Sub) -> str:
        return f"({self.query(e.query)})"

    def cursor(self, q: t.Query) -> str:
        """CURSOR(...): the rows of a subquery as an array of structs, which Catalyst turns into one join on what it hangs on."""
        if q.ctes or q.functions or not isinstance(q.body, t.Block) and q.order:
            raise UnsupportedSyntax("CURSOR of a query with common table expressions, or of an ordered set")
        rows, keys = q, []
        if isinstance(q.body, t.Block) and not q.body.group and any(c.over is None and c.parts[-1].upper() in fn.AGGREGATES for c in find(q.body.items, t.Call)):
            # an aggregate of all rows is one row, also of none
            return f"array(({self.query(dataclasses.replace(q, body=dataclasses.replace(q.body, items=[t.Item(Row(q.body.items), 'r')]), order=[]))}))"
        if q.order:
            if len({o.desc for o in q.order}) > 1:
                raise UnsupportedSyntax("CURSOR orders by one direction")
            aliases = {(i.alias or (i.expr.parts[-1] if isinstance(i.expr, t.Name) else "")).lower(): i.expr for i in q.body.items}
            exprs = [aliases.get(o.expr.parts[0].lower(), o.expr) if isinstance(o.expr, t.Name) and len(o.expr.parts) == 1 else o.expr for o in q.order]
            keys = [f"__o{i}" for i in range(len(exprs))]
            body = dataclasses.replace(q.body, items=[*q.body.items, *(t.Item(e, k) for e, k in zip(exprs, keys))])
            rows = dataclasses.replace(q, body=body) if q.fetch is not None else dataclasses.replace(q, body=body, order=[])
        inner = self.query(rows)
        c = self.fresh("cur")
        if not keys:
            return f"coalesce((SELECT collect_list(struct({c}.*)) FROM ({inner}) AS {c}), array())"
        sort = self.sort_struct([dataclasses.replace(o, expr=Raw(f"{c}.`{k}`")) for o, k in zip(q.order, keys)])
        rows_in_order = f"sort_array(collect_list(struct({sort} AS k, struct({c}.* EXCEPT ({', '.join(keys)})) AS r)), {'false' if q.order[0].desc else 'true'})"
        return f"coalesce((SELECT transform({rows_in_order}, s -> s.r) FROM ({inner}) AS {c}), array())"

    def _row(self, e: Row) -> str:
        return f"struct({', '.join(self.item(i) for i in e.items)})"

    def _query(self, e: t.Query) -> str:
        return f"({self.query(e)})"

    def _tuple(self, e: t.Tuple) -> str:
        return f"struct({', '.join(self.expr(x) for x in e.items)})"

    def _case(self, e: t.Case) -> str:
        out = "CASE" + (f" {self.expr(e.subject)}" if e.subject is not None else "")
        out += "".join(f" WHEN {self.expr(c)} THEN {self.expr(v)}" for c, v in e.whens)
        return out + (f" ELSE {self.expr(e.other)}" if e.other is not None else "") + " END"

    def _cast(self, e: t.Cast) -> str:
        if e.multiset:
            return f"(SELECT collect_list(v) FROM ({self.query(e.arg.query)}) AS {self.fresh('m')}(v))"
        kind = self.type_text(e.type)
        x = self.expr(e.arg)
        return f"cast({x} AS {kind})" if e.default is None else f"coalesce(try_cast({x} AS {kind}), cast({self.expr(e.default)} AS {kind}))"

    def _interval(self, e: t.Interval) -> str:
        return f"INTERVAL '{e.text.value}' {e.unit}"

    def _call(self, e: t.Call) -> str:
        up = e.parts[-1].upper()
        if len(e.parts) == 1:
            if up == "TABLE":
                raise UnsupportedSyntax("TABLE() outside FROM")
            if self.hierarchy and up == "SYS_CONNECT_BY_PATH":
                return f"`__path{self.hierarchy[-1]['paths'].index(e)}`"
            if e.parts[0].lower() in self.names or isinstance(self.column(e.parts), (T.ArrayType, T.MapType)):
                return self.indexed(t.Name(e.parts), e.args)
        elif up in METHODS and self.collection(t.Name(e.parts[:-1])):
            return self.method(t.Name(e.parts[:-1]), up, e.args)
        elif isinstance(self.column(e.parts), (T.ArrayType, T.MapType)):
            return self.indexed(t.Name(e.parts), e.args)
        kind = self.catalog.type_of(".".join(e.parts))
        if kind is not None:
            return self.constructor(kind, e.args)
        own = self.function(e.parts)
        if own:
            return f"{own}({', '.join(self.expr(a) for a in e.args)})"
        if e.keep is not None:
            return self.kept(up, e)
        if up == "CURSOR" and isinstance(e.args[0], t.Sub):
            return self.cursor(e.args[0].query)
        if up in fn.WRITERS:
            return fn.WRITERS[up](self, e)
        args = [self.expr(a) for a in e.args]
        if up in fn.TEMPLATES:
            try:
                text = fn.TEMPLATES[up].format(*args)
            except IndexError:
                raise UnsupportedSyntax(f"{up} needs more arguments") from None
            return self.windowed(text, e)
        name = fn.RENAMED.get(up) or (up.lower() if up in fn.SAME else None)
        if name is None:
            raise UnsupportedSyntax(f"unknown function {'.'.join(e.parts)}")
        text = f"{name}({'DISTINCT ' if e.distinct else ''}{', '.join(args)})"
        if e.order:
            text += f" WITHIN GROUP (ORDER BY {self.orders(e.order)})"
        if e.nulls:
            text += f" {e.nulls} NULLS"
        return self.windowed(text, e)

    def function(self, parts: list[str]) -> str | None:
        """A routine of the catalog: the schema's own by its short name, or SCHEMA.PACKAGE_name."""
        up = [p.upper() for p in parts]
        schema = self.catalog.schema
        for key in ((schema, "_".join(up)), (up[0], "_".join(up[1:])) if len(up) > 1 else None):
            if key in self.catalog.functions:
                return self.catalog.functions[key]
        return None

    def windowed(self, text: str, e: t.Call) -> str:
        return text if e.over is None else f"{text} OVER ({self.over(e.over)})"

    def over(self, o: t.Over) -> str:
        out = []
        if o.partition:
            out.append(f"PARTITION BY {', '.join(self.expr(p) for p in o.partition)}")
        if o.order:
            out.append(f"ORDER BY {self.orders(o.order)}")
        if o.frame:
            edge = [(f"{self.expr(e)} {way}" if e is not None else way) for way, e in o.bounds]
            out.append(f"{o.frame} BETWEEN {edge[0]} AND {edge[1]}")
        return " ".join(out)

    def kept(self, up: str, e: t.Call) -> str:
        """An aggregate over the first or last rows of an order."""
        if id(e) in self.keeps:
            if up not in fn.AGGREGATES:
                raise UnsupportedSyntax(f"KEEP goes with aggregates, not {up}")
            return f"{self._call(dataclasses.replace(e, keep=None))} FILTER (WHERE {self.keeps[id(e)]})"
        if up not in ("MIN", "MAX") or not self.aligned(e):
            raise UnsupportedSyntax("that KEEP over a window")
        x, keys = self.expr(e.args[0]), self.sort_struct(e.keep[1])
        # of the rows that tie, those without a value do not count
        value = f"{x} IS NULL AS n, {x} AS x" if up == "MIN" else f"{x} AS x"
        return self.windowed(f"{up.lower()}(struct({keys} AS k, {value}))", e) + ".x"

    def json_scalar(self, e: Any, absent: bool = True) -> str:
        """A value as JSON text; a null is left out unless NULL ON NULL is said."""
        if isinstance(e, t.Call) and e.parts[-1].upper().startswith("JSON_"):
            return self.expr(e)
        if isinstance(e, t.Lit) and e.kind == "null":
            return "cast(NULL AS STRING)" if absent else "'null'"
        x = self.expr(e)
        text = f"to_json(named_struct('a', {x}))"
        return f"CASE WHEN {x} IS NULL THEN {'NULL' if absent else self.string('null')} ELSE substring({text}, 6, length({text}) - 6) END"

    # collections

    def collection(self, e: Any) -> bool:
        if isinstance(e, t.Name):
            if isinstance(self.column(e.parts), (T.ArrayType, T.MapType)):
                return True
            low = ".".join(e.parts).lower()
            return f"{low}%type" in self.names
        return isinstance(e, t.Call) and (self.catalog.type_of(".".join(e.parts)) is not None or e.parts[-1].upper() == "COLLECT")

    def is_map(self, e: Any) -> bool:
        if isinstance(e, t.Name):
            kind = self.column(e.parts) or self.names.get(".".join(e.parts).lower() + "%type")
            return isinstance(kind, T.MapType) or isinstance(kind, CollectionType) and kind.key is not None
        return False

    def indexed(self, e: t.Name, args: list[Any]) -> str:
        return f"try_element_at({self.expr(e)}, {self.expr(args[0])})" if self.is_map(e) else f"try_element_at({self.expr(e)}, cast({self.expr(args[0])} AS INT))"

    def method(self, e: Any, name: str, args: list[Any]) -> str:
        a = self.expr(e)
        i = self.expr(args[0]) if args else ""
        if name == "LIMIT":
            limit = self.limit_of(t.Name([*e.parts, "LIMIT"])) if isinstance(e, t.Name) else None
            return "NULL" if limit is None else str(limit)
        if self.is_map(e):
            keys = f"map_keys({a})"
            return {
                "COUNT": f"size({a})",
                "FIRST": f"array_min({keys})",
                "LAST": f"array_max({keys})",
                "EXISTS": f"map_contains_key({a}, {i})",
                "NEXT": f"array_min(filter({keys}, k -> k > {i}))",
                "PRIOR": f"array_max(filter({keys}, k -> k < {i}))",
            }[name]
        return {
            "COUNT": f"size({a})",
            "FIRST": f"CASE WHEN size({a}) > 0 THEN 1 END",
            "LAST": f"CASE WHEN size({a}) > 0 THEN size({a}) END",
            "EXISTS": f"({i} BETWEEN 1 AND size({a}))",
            "NEXT": f"CASE WHEN {i} < size({a}) THEN {i} + 1 END",
            "PRIOR": f"CASE WHEN {i} > 1 AND {i} <= size({a}) + 1 THEN {i} - 1 END",
        }[name]

    def constructor(self, kind: Any, args: list[Any]) -> str:
        if isinstance(kind, CollectionType):
            if kind.limit is not None and len(args) > kind.limit:
                raise ResolutionError(f"{kind.name} holds at most {kind.limit} elements")
            return f"cast(array({', '.join(self.expr(a) for a in args)}) AS {kind.spark.simpleString()})"
        if isinstance(kind, T.StructType):
            if len(args) != len(kind.fields):
                raise ResolutionError(f"the type has {len(kind.fields)} attributes")
            pairs = ", ".join(f"'{f.name}', cast({self.expr(a)} AS {f.dataType.simpleString()})" for f, a in zip(kind.fields, args))
            return f"named_struct({pairs})"
        return f"cast({self.expr(args[0])} AS {kind.simpleString()})"

    # types, as far as rewrites need them

    def is_date(self, e: Any) -> bool:
        if isinstance(e, t.Lit):
            return e.kind in ("date", "timestamp")
        if isinstance(e, t.Name):
            if len(e.parts) == 1 and e.parts[0].upper() in fn.DATES and self.column(e.parts) is None:
                return True
            return isinstance(self.column(e.parts), (T.DateType, T.TimestampType, T.TimestampNTZType))
        if isinstance(e, t.Call):
            up = e.parts[-1].upper()
            return up in fn.DATES or up in ("TRUNC", "ROUND", "MIN", "MAX", "NVL", "COALESCE", "GREATEST", "LEAST", "LAG", "LEAD", "FIRST_VALUE", "LAST_VALUE") and bool(e.args) and self.is_date(e.args[0])
        if isinstance(e, t.Cast):
            try:
                return isinstance(spark_type(e.type), (T.DateType, T.TimestampType, T.TimestampNTZType))
            except ValueError:
                return False
        if isinstance(e, t.Binary) and e.op in ("+", "-"):
            return self.is_date(e.left) and not self.is_date(e.right)
        return isinstance(e, t.Unary) and e.op == "PRIOR" and self.is_date(e.arg)

    def is_ntz(self, e: Any) -> bool | None:
        kind = self.column(e.parts) if isinstance(e, t.Name) else None
        return isinstance(kind, T.TimestampNTZType) if kind is not None else (True if isinstance(e, t.Lit) else None)

    def is_interval(self, e: Any) -> bool:
        return isinstance(e, t.Call) and e.parts[-1].upper() in ("TO_DSINTERVAL", "TO_YMINTERVAL", "NUMTODSINTERVAL", "NUMTOYMINTERVAL")
