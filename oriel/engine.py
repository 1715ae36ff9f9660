"""The session: Oracle-dialect statements over a catalog of Spark tables.

Queries become one Spark SQL text.  DML gives a table a new snapshot: a lazy
plan over the old one, never a row-by-row change.
"""

from __future__ import annotations

import dataclasses
import re
import uuid
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import Catalog, ResolutionError, normal, quoted, split_name
from .operators.changes import NEW, OLD, ROW, ChangeSet
from .operators.ranks import in_order
from .operators.ranks import key as sort_key
from .operators.versions import VersionedTable
from .sql import tree as t
from .sql.parser import Parser, parse_statement
from .sql.writer import Raw, Writer, all_of

SAFE = re.compile(r"\W+")


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog | None = None):
        self.spark = spark
        self.catalog = catalog or Catalog()
        self.tag = uuid.uuid4().hex[:8]
        self.seen: dict[str, int] = {}
        self.triggers: list[Any] = []
        self.versions: dict[tuple[str, str], VersionedTable] = {}
        # hierarchies may be deep and wide; neither has a limit in Oracle
        spark.conf.set("spark.sql.cteRecursionLevelLimit", "100000")
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")

    @classmethod
    def over(cls, spark: SparkSession, folder: str, *tables: str) -> Engine:
        """An engine over parquet tables of a folder."""
        out = cls(spark)
        for name in tables:
            out.catalog.add_loader(name, lambda name=name: spark.read.parquet(f"{folder}/{name}.parquet"))
        return out

    def view_of(self, schema: str, name: str) -> str:
        """The temporary view that holds a table's current snapshot."""
        df = self.catalog.relation(schema, name)
        view = SAFE.sub("_", f"ora_{self.tag}_{schema}_{name}".lower())
        if self.seen.get(view) != id(df):
            df.createOrReplaceTempView(view)
            self.seen[view] = id(df)
        return view

    def writer(self, binds: dict[str, Any] | None = None, names: dict[str, Any] | None = None) -> Writer:
        return Writer(self.catalog, self.view_of, binds, names)

    def translate(self, text: str, binds: dict[str, Any] | None = None) -> str:
        """The Spark SQL of a query."""
        w = self.writer(binds)
        out = w.query(parse_statement(text))
        for s in w.setup:
            self.spark.sql(s)
        return out

    def sql(self, text: str, binds: dict[str, Any] | None = None) -> DataFrame:
        """A query's result, or the new snapshot of the table that a statement changes."""
        return self.run(parse_statement(text), binds)

    def run(self, statement: Any, binds: dict[str, Any] | None = None, names: dict[str, Any] | None = None) -> DataFrame:
        w = self.writer(binds, names)
        w.host = self
        if isinstance(statement, t.Query):
            text = w.query(statement)
            for s in w.setup:
                self.spark.sql(s)
            return self.spark.sql(text, args=binds) if binds else self.spark.sql(text)
        if not isinstance(statement, t.InsertAll) and (statement.returning or self.catalog.resolve(".".join(statement.table)) in self.versions):
            done = self.change(statement, binds, names)
            if not statement.returning:
                return self.catalog.relation(*self.catalog.resolve(".".join(statement.table)))
            alias = getattr(statement, "alias", "") or statement.table[-1]
            w.scopes.append({alias.lower(): {f.name.lower(): f.dataType for f in done.rows.schema[NEW].dataType}})
            return done.image().alias(alias).selectExpr(*[w.item(i) for i in statement.returning])
        made = {t.Insert: self.insert, t.InsertAll: self.insert_all, t.Update: self.update, t.Delete: self.delete, t.Merge: self.merge}[type(statement)]
        return made(statement, w, binds)

    # rows that get numbers: they are written, as a plan that is run twice need not give them in the same order

    def _rows(self, w: Writer, text: str) -> DataFrame | None:
        """What a part of a query gives by itself; None if it hangs on the rest."""
        for s in w.setup:
            self.spark.sql(s)
        try:
            return self.spark.sql(text, args=w.binds) if w.binds else self.spark.sql(text)
        except AnalysisException:
            return None

    def number(self, w: Writer, text: str) -> tuple[str, int] | None:
        """A view of the rows of ``text`` with ``__rownum`` from 1, and how many they are."""
        if (df := self._rows(w, text)) is None:
            return None
        rows = in_order(df, None, "rownum")
        view = f"ora_{self.tag}_numbered_{uuid.uuid4().hex[:8]}"
        rows.numbered("__rownum").createOrReplaceTempView(view)
        return view, rows.total

    def share(self, w: Writer, text: str, keys: list[tuple[str, bool, bool]], percent: float, ties: bool, offset: int) -> str | None:
        """A view of the first ``percent`` of the rows of ``text`` in the order of its columns ``keys`` (name, descending, nulls first)."""
        if (df := self._rows(w, text)) is None:
            return None
        view = f"ora_{self.tag}_share_{uuid.uuid4().hex[:8]}"
        in_order(df, [sort_key(F.col(k), desc, first) for k, desc, first in keys], "share").percent(percent, ties, offset).createOrReplaceTempView(view)
        return view

    def script(self, text: str) -> list[DataFrame]:
        """Statements separated by lines that hold a semicolon alone, or by trailing semicolons; the first failure ends it."""
        parts = [p.strip().rstrip(";").strip() for p in re.split(r"(?m)^;\s*$|;\s*$", text)]
        return [self.sql(p) for p in parts if p]

    def execute_immediate(self, text: str, *using: Any) -> DataFrame:
        """Dynamic SQL: :1, :2 or named binds in the order they appear."""
        names = list(dict.fromkeys(x.text for x in Parser(text).toks if x.kind == "bind"))
        text = re.sub(r":(\d+)\b", r":b\1", text)
        names = [f"b{n}" if n.isdigit() else n for n in names]
        return self.sql(text, dict(zip(names, using)))

    def create_function(self, name: str, params: list[tuple[str, str]], returns: str, body: str) -> None:
        """A function whose body is one RETURN expression, as a SQL function that Catalyst inlines."""
        own = SAFE.sub("_", f"fn_{self.tag}_{name}".lower())
        p = Parser(body)
        e = p.expr()
        p.end()
        w = self.writer(names={n.lower(): Raw(quoted(n.lower())) for n, _ in params})
        args = ", ".join(f"{quoted(n.lower())} {w.type_text(k)}" for n, k in params)
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {own}({args}) RETURNS {w.type_text(returns)} RETURN {w.expr(e)}")
        schema, _, short = name.rpartition(".")
        self.catalog.functions[normal(schema) if schema else self.catalog.schema, short.upper()] = own

    # DDL

    def create_table(self, name: str, columns: list[tuple[str, str]], required: tuple[str, ...] = (), defaults: dict[str, str] | None = None) -> DataFrame:
        """An empty table from (name, type) pairs; ``required`` columns take no null, ``defaults`` are expressions."""
        schema, table = split_name(name)
        key = (schema or self.catalog.schema, table)
        if self.catalog.relation(*key) is not None:
            raise ResolutionError(f"{key[0]}.{key[1]} is there already")
        known = {c.lower() for c, _ in columns}
        if len(known) != len(columns) or unknown_of(known, [*required, *(defaults or {})]):
            raise LookupError(f"columns of {name} repeat or are not named")
        fields = [T.StructField(c.lower(), self.catalog.spark_type(kind)) for c, kind in columns]
        self.catalog.schemas.add(key[0])
        self.catalog.tables[key] = self.spark.createDataFrame([], T.StructType(fields))
        self.catalog.required[key] = {c.lower() for c in required}
        self.catalog.defaults[key] = {c.lower(): e for c, e in (defaults or {}).items()}
        return self.catalog.tables[key]

    def create_empty_view(self, name: str, columns: list[tuple[str, str]]) -> DataFrame:
        """A view of typed nulls and no rows, that others can name before its query can be written."""
        kinds = [F.lit(None).cast(self.catalog.spark_type(kind)).alias(c.lower()) for c, kind in columns]
        self.catalog.add_view(name, self.spark.range(0).select(*kinds))
        return self.catalog.relation(*self.catalog.resolve(name))

    def create_view(self, name: str, query: str) -> DataFrame:
        """A view's query in place of what the name stood for; its columns must be those of an empty view before it."""
        schema, short = split_name(name)
        old = self.catalog.views.get((schema or self.catalog.schema, short))
        new = self.sql(query)
        if old is not None and [f.name.lower() for f in old.schema] != [f.name.lower() for f in new.schema]:
            raise ResolutionError(f"view {name} has other columns than it was announced with")
        self.catalog.add_view(name, new)
        return new

    # DML

    def _target(self, name: list[str]) -> tuple[tuple[str, str], DataFrame]:
        key = self.catalog.resolve(".".join(name))
        return key, self.catalog.relation(*key)

    def _replace(self, key: tuple[str, str], text: str, binds: dict[str, Any] | None) -> DataFrame:
        out = self.spark.sql(text, args=binds) if binds else self.spark.sql(text)
        self.catalog.tables[key] = out
        return out

    def insert(self, s: t.Insert, w: Writer, binds: dict[str, Any] | None) -> DataFrame:
        key, df = self._target(s.table)
        return self._replace(key, f"SELECT * FROM {self.view_of(*key)} UNION ALL {self._new_rows(s, w, key, df)}", binds)

    def _new_rows(self, s: t.Insert, w: Writer, key: tuple[str, str], df: DataFrame) -> str:
        """The rows that an INSERT adds."""
        given = [c.lower() for c in s.columns] or [f.name.lower() for f in df.schema][: len(s.rows[0]) if s.rows else None]
        unknown = set(given) - {f.name.lower() for f in df.schema}
        if unknown:
            raise LookupError(f"no column {', '.join(sorted(unknown))}")
        cols = ", ".join(f"`__c{i}`" for i in range(len(given)))
        if s.rows is not None:
            lines = []
            for row in s.rows:
                w.drawn = {}
                lines.append(f"SELECT {', '.join(w.expr(v) for v in row)}")
            w.drawn = None
            source = " UNION ALL ".join(lines)
        else:
            source = w.query(s.query)
        place = {c: f"`__c{i}`" for i, c in enumerate(given)}
        defaults = {c: w.expr(Parser(e).expr()) for c, e in self.catalog.defaults.get(key, {}).items()}
        required = self.catalog.required.get(key, set())

        def value(f: T.StructField) -> str:
            out = f"cast({place.get(f.name.lower(), defaults.get(f.name.lower(), 'NULL'))} AS {f.dataType.simpleString()})"
            return f"coalesce({out}, raise_error('{key[1]}.{f.name} takes no null'))" if f.name.lower() in required else out

        items = ", ".join(f"{value(f)} AS {quoted(f.name)}" for f in df.schema)
        new = f"SELECT {items} FROM ({source}) AS __new({cols})"
        return self._fire("INSERT", key, df, new)

    def insert_all(self, s: t.InsertAll, w: Writer, binds: dict[str, Any] | None) -> DataFrame:
        rows = self.run(s.query, binds)
        name = f"ora_{self.tag}_rows_{uuid.uuid4().hex[:6]}"
        rows.createOrReplaceTempView(name)
        before: list[Any] = []
        out = None
        for i in s.inserts:
            # a row goes to every branch that holds, or with FIRST to the first one; ELSE takes what none took
            if i.when == "ELSE":
                hold: Any = all_of([t.Unary("NOT", t.Call(["NVL"], [b, t.Lit(False, "bool")])) for b in before])
            else:
                hold = i.when
                if s.first and before and hold not in before:
                    hold = all_of([hold, *(t.Unary("NOT", t.Call(["NVL"], [b, t.Lit(False, "bool")])) for b in before if b != i.when)])
                if i.when is not None and i.when not in before:
                    before.append(i.when)
            values = ", ".join(w.expr(v) for v in i.rows[0]) if i.rows else "*"
            where = f" WHERE {w.expr(hold)}" if hold is not None else ""
            key, df = self._target(i.table)
            given = i.columns or [f.name for f in df.schema]
            place = {c.lower(): f"`__c{k}`" for k, c in enumerate(given)}
            items = ", ".join(f"cast({place.get(f.name.lower(), 'NULL')} AS {f.dataType.simpleString()}) AS {quoted(f.name)}" for f in df.schema)
            cols = ", ".join(place.values())
            out = self._replace(key, f"SELECT * FROM {self.view_of(*key)} UNION ALL SELECT {items} FROM (SELECT {values} FROM {name}{where}) AS __new({cols})", binds)
        return out

    def _sets(self, sets: list[tuple[list[str], Any]], w: Writer) -> dict[str, str]:
        out: dict[str, str] = {}
        for cols, e in sets:
            if isinstance(e, t.Query) and len(cols) > 0 and isinstance(e.body, t.Block):
                for i, c in enumerate(cols):
                    one = dataclasses.replace(e, body=dataclasses.replace(e.body, items=[e.body.items[i]]))
                    out[c.lower()] = f"({w.query(one)})"
            else:
                out[cols[0].lower()] = w.expr(e)
        return out

    def update(self, s: t.Update, w: Writer, binds: dict[str, Any] | None) -> DataFrame:
        key, df = self._target(s.table)
        alias = s.alias or s.table[-1]
        w.scopes.append({alias.lower(): {f.name.lower(): f.dataType for f in df.schema}})
        sets = self._sets(s.sets, w)
        hit = f"coalesce({w.expr(s.where)}, false)" if s.where is not None else "true"
        unknown = set(sets) - {f.name.lower() for f in df.schema}
        if unknown:
            raise LookupError(f"no column {', '.join(sorted(unknown))}")
        sets |= self._row_hooks("UPDATE", key, df, sets, alias)
        items = ", ".join(
            f"CASE WHEN {hit} THEN cast({sets[f.name.lower()]} AS {f.dataType.simpleString()}) ELSE {quoted(alias)}.{quoted(f.name)} END AS {quoted(f.name)}" if f.name.lower() in sets else f"{quoted(alias)}.{quoted(f.name)}"
            for f in df.schema
        )
        return self._replace(key, f"SELECT {items} FROM {self.view_of(*key)} AS {quoted(alias)}", binds)

    def delete(self, s: t.Delete, w: Writer, binds: dict[str, Any] | None) -> DataFrame:
        key, df = self._target(s.table)
        alias = s.alias or s.table[-1]
        w.scopes.append({alias.lower(): {f.name.lower(): f.dataType for f in df.schema}})
        keep = f"coalesce({w.expr(s.where)}, false) = false" if s.where is not None else "false"
        return self._replace(key, f"SELECT * FROM {self.view_of(*key)} AS {quoted(alias)} WHERE {keep}", binds)

    def merge(self, s: t.Merge, w: Writer, binds: dict[str, Any] | None) -> DataFrame:
        """One full outer join; marks on both sides say which rows met.  A target row that would be changed twice raises."""
        key, df = self._target(s.table)
        a = s.alias or s.table[-1]
        b = getattr(s.source, "alias", "") or (s.source.name[-1] if isinstance(s.source, t.Table) else "__s")
        source = self.view_of(*self.catalog.resolve(".".join(s.source.name))) if isinstance(s.source, t.Table) else f"({w.query(s.source.query)})"
        w.scopes.append({a.lower(): {f.name.lower(): f.dataType for f in df.schema}, b.lower(): None})
        sets = self._sets(s.sets, w)
        both = f"{quoted(a)}.`__t` AND {quoted(b)}.`__s`"
        change = f"{both}" + (f" AND coalesce({w.expr(s.update_where)}, false)" if s.update_where is not None else "")
        given = [c.lower() for c in s.columns] or [f.name.lower() for f in df.schema][: len(s.values)]
        new = {c: w.expr(v) for c, v in zip(given, s.values)}
        items = []
        for f in df.schema:
            c, kind = f.name.lower(), f.dataType.simpleString()
            old = f"{quoted(a)}.{quoted(f.name)}"
            text = f"CASE WHEN {quoted(a)}.`__t` IS NULL THEN cast({new.get(c, 'NULL')} AS {kind})"
            if c in sets:
                text += f" WHEN {change} THEN cast({sets[c]} AS {kind})"
            items.append(f"{text} ELSE {old} END AS {quoted(f.name)}")
        fresh = f"({quoted(a)}.`__t` IS NOT NULL" + ("" if not s.values else f" OR coalesce({w.expr(s.insert_where)}, false)" if s.insert_where is not None else " OR true") + ")"
        once = f"coalesce({quoted(a)}.`__tid`, -1 - {quoted(b)}.`__sid`)"  # a row of either side
        twice = f"sum(CASE WHEN coalesce({change}, false) THEN 1 ELSE 0 END) OVER (PARTITION BY {once}) > 1"
        text = (
            f"SELECT {', '.join(items)}, coalesce({change}, false) AS `__changed`, {twice} AS `__twice`"
            f" FROM (SELECT *, true AS `__t`, monotonically_increasing_id() AS `__tid` FROM {self.view_of(*key)}) AS {quoted(a)}"
            f" FULL OUTER JOIN (SELECT *, true AS `__s`, monotonically_increasing_id() AS `__sid` FROM {source}) AS {quoted(b)} ON {w.expr(s.on)} WHERE {fresh}"
        )
        checked = "CASE WHEN `__twice` AND `__changed` THEN cast(raise_error('MERGE: two source rows match one target row') AS BOOLEAN) ELSE true END"
        gone = ""
        if s.delete_where is not None:  # judged on the updated row
            d = self.writer(binds)
            d.scopes.append({a.lower(): {f.name.lower(): f.dataType for f in df.schema}})
            gone = f" AND NOT (`__changed` AND coalesce({d.expr(s.delete_where)}, false))"
        return self._replace(key, f"SELECT * EXCEPT (`__changed`, `__twice`) FROM ({text}) AS {quoted(a)} WHERE {checked}{gone}", binds)

    # change sets and versions

    def versioned(self, name: str) -> VersionedTable:
        """The log of a table; the first call writes the table as version 0."""
        key = self.catalog.resolve(name)
        if key not in self.versions:
            self.versions[key] = VersionedTable.create(self.catalog.relation(*key))
            self.versions[key].required = tuple(self.catalog.required.get(key, ()))
            self.catalog.tables[key] = self.versions[key].as_of()
        return self.versions[key]

    def view_of_versions(self, w: Writer, key: tuple[str, str], how: str, low: str | None, high: str | None) -> str:
        """A view of a table AS OF a version or a moment, or of all images between two."""
        if key not in self.versions:
            raise ResolutionError(f"{key[0]}.{key[1]} keeps no versions")
        log = self.versions[key]

        def version(text: str | None) -> int | None:
            if text is None:
                return None
            kind = f"unix_micros(cast({text} AS timestamp))" if how.startswith("TIMESTAMP") else f"cast({text} AS bigint)"
            value = self.spark.sql(f"SELECT {kind}", args=w.binds).first()[0]
            return log.version_at(value) if how.startswith("TIMESTAMP") else value

        df = log.between(version(low), version(high)) if how.endswith("RANGE") else log.as_of(version(low))
        view = f"ora_{self.tag}_versions_{uuid.uuid4().hex[:8]}"
        df.createOrReplaceTempView(view)
        return view

    def change(self, statement: Any, binds: dict[str, Any] | None = None, names: dict[str, Any] | None = None) -> ChangeSet:
        """INSERT, UPDATE, DELETE or MERGE as a change set, committed to the table's log; a table without a log gets one."""
        s = parse_statement(statement) if isinstance(statement, str) else statement
        w = self.writer(binds, names)
        w.host = self
        log = self.versioned(".".join(s.table))
        key, df = self._target(s.table)
        if isinstance(s, t.Insert):
            text = self._new_rows(s, w, key, df)
            done = log.insert(self._run(w, text))
        else:
            kind = log.schema().simpleString()
            alias = getattr(s, "alias", "") or s.table[-1]
            a = quoted(alias)
            base = f"ora_{self.tag}_rows_{uuid.uuid4().hex[:8]}"
            log.as_of(rows=True).createOrReplaceTempView(base)
            columns = {f.name.lower(): f.dataType for f in df.schema}
            image = lambda of: f"named_struct({', '.join(f'{w.string(f.name)}, {of(f)}' for f in df.schema)})"
            old = image(lambda f: f"{a}.{quoted(f.name)}")
            touched: set[str] | None = None
            if isinstance(s, t.Merge):
                text = self._merged(s, w, df, base, image, old, kind, binds)
            else:
                w.scopes.append({alias.lower(): columns})
                hit = f"coalesce({w.expr(s.where)}, false)" if s.where is not None else "true"
                new = f"cast(null AS {kind})"
                if isinstance(s, t.Update):
                    sets = self._sets(s.sets, w)
                    if unknown := set(sets) - set(columns):
                        raise LookupError(f"no column {', '.join(sorted(unknown))}")
                    touched = set(sets)
                    sets |= self._row_hooks("UPDATE", key, df, sets, alias)
                    new = image(lambda f: f"cast({sets.get(f.name.lower(), f'{a}.{quoted(f.name)}')} AS {f.dataType.simpleString()})")
                text = f"SELECT {a}.`{ROW}`, {old} AS {OLD}, {new} AS {NEW} FROM {base} AS {a} WHERE {hit}"
            event = {t.Update: "UPDATE", t.Delete: "DELETE", t.Merge: "MERGE"}[type(s)]
            done = log.apply(self._run(w, text), event, touched)
        self.catalog.tables[key] = log.as_of()
        return done

    def _run(self, w: Writer, text: str) -> DataFrame:
        for x in w.setup:
            self.spark.sql(x)
        return self.spark.sql(text, args=w.binds) if w.binds else self.spark.sql(text)

    def _merged(self, s: t.Merge, w: Writer, df: DataFrame, base: str, image: Any, old: str, kind: str, binds: dict[str, Any] | None) -> str:
        """One left join from the source: rows that meet are updated or deleted, others inserted."""
        a = s.alias or s.table[-1]
        b = getattr(s.source, "alias", "") or (s.source.name[-1] if isinstance(s.source, t.Table) else "__s")
        source = self.view_of(*self.catalog.resolve(".".join(s.source.name))) if isinstance(s.source, t.Table) else f"({w.query(s.source.query)})"
        w.scopes.append({a.lower(): {f.name.lower(): f.dataType for f in df.schema}, b.lower(): None})
        sets = self._sets(s.sets, w)
        met = f"{quoted(a)}.`{ROW}` IS NOT NULL"
        given = [c.lower() for c in s.columns] or [f.name.lower() for f in df.schema][: len(s.values)]
        values = {c: w.expr(v) for c, v in zip(given, s.values)}
        changed = f"{met} AND {f'coalesce({w.expr(s.update_where)}, false)' if s.update_where is not None else ('true' if s.sets else 'false')}"
        fresh = f"NOT ({met}) AND {f'coalesce({w.expr(s.insert_where)}, false)' if s.insert_where is not None else ('true' if s.values else 'false')}"
        updated = image(lambda f: f"cast({sets.get(f.name.lower(), f'{quoted(a)}.{quoted(f.name)}')} AS {f.dataType.simpleString()})")
        inserted = image(lambda f: f"cast({values.get(f.name.lower(), 'NULL')} AS {f.dataType.simpleString()})")
        text = (
            f"SELECT {quoted(a)}.`{ROW}`, CASE WHEN {met} THEN {old} END AS {OLD}, CASE WHEN {met} THEN {updated} ELSE {inserted} END AS {NEW}"
            f" FROM {source} AS {quoted(b)} LEFT JOIN {base} AS {quoted(a)} ON {w.expr(s.on)} WHERE ({changed}) OR ({fresh})"
        )
        if s.delete_where is None:
            return text
        d = self.writer(binds)  # judged on the updated row
        d.scopes.append({a.lower(): {f.name.lower(): f.dataType for f in df.schema}})
        gone = f"{OLD} IS NOT NULL AND coalesce({d.expr(s.delete_where)}, false)"
        return f"SELECT `{ROW}`, {OLD}, CASE WHEN {gone} THEN cast(null AS {kind}) ELSE {NEW} END AS {NEW} FROM (SELECT `{ROW}`, {OLD}, {NEW}, {NEW}.* FROM ({text})) AS {quoted(a)}"

    # triggers

    def _row_hooks(self, event: str, key: tuple[str, str], df: DataFrame, sets: dict[str, str], alias: str) -> dict[str, str]:
        out: dict[str, str] = {}
        for trigger in self.triggers:
            if trigger.applies(event, key, set(sets)):
                old = {f.name.lower(): f"{quoted(alias)}.{quoted(f.name)}" for f in df.schema}
                out |= trigger.changes(self, event, old | sets | out, old, set(sets))
        return out

    def _fire(self, event: str, key: tuple[str, str], df: DataFrame, rows: str) -> str:
        for trigger in self.triggers:
            if trigger.applies(event, key, set()):
                new = {f.name.lower(): f"__n.{quoted(f.name)}" for f in df.schema}
                got = trigger.changes(self, event, new, {c: "NULL" for c in new}, set())
                items = ", ".join(f"cast({got.get(f.name.lower(), new[f.name.lower()])} AS {f.dataType.simpleString()}) AS {quoted(f.name)}" for f in df.schema)
                rows = f"SELECT {items} FROM ({rows}) AS __n"
        return rows


def unknown_of(known: set[str], names: list[str]) -> set[str]:
    return {n.lower() for n in names} - known


def dual(spark: SparkSession) -> DataFrame:
    """The relation of one row."""
    return spark.range(1).select(F.lit("X").alias("dummy"))
