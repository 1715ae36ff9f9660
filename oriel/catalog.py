"""Schemas, synonyms and the names that queries resolve to."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .operators.sequences import Sequence
from .types import spark_type

# fixed values: words that need quotes as identifiers
RESERVED = frozenset(
    "ALL AND ANY AS ASC BETWEEN BY CASE CHECK COLLATE COLUMN CONNECT CREATE CROSS CURRENT_DATE CURRENT_TIMESTAMP CURRENT_USER DEFAULT DELETE DESC DISTINCT DROP ELSE END EXCEPT EXISTS FALSE FETCH FOR FOREIGN FROM FULL GRANT GROUP HAVING IN INNER INSERT INTERSECT INTO IS JOIN LEFT LIKE LIMIT MINUS NATURAL NOT NULL OFFSET ON OR ORDER OUTER PRIMARY REFERENCES RIGHT SELECT SESSION_USER SET SOME TABLE THEN TO TRUE UNION UNIQUE UPDATE USER USING VALUES WHEN WHERE WITH".split()
)


class ResolutionError(LookupError):
    """A name that means nothing, or more than one thing."""


def normal(name: str) -> str:
    """Unquoted names fold to upper case; quotes go."""
    name = name.strip()
    return name[1:-1] if len(name) > 1 and name[0] == name[-1] == '"' else name.upper()


def split_name(name: str) -> tuple[str, str]:
    """(schema or "", object) of a dotted name."""
    parts = re.findall(r'"[^"]+"|[^.]+', name)
    return (normal(parts[-2]) if len(parts) > 1 else ""), normal(parts[-1])


def quoted(name: str) -> str:
    """An identifier for output, in back quotes only where it needs them."""
    return name if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) and name.upper() not in RESERVED else "`" + name.replace("`", "``") + "`"


@dataclass
class Synonym:
    owner: str
    name: str
    schema: str
    target: str


@dataclass
class CollectionType:
    """VARRAY, nested table or table indexed by a key; ``limit`` is a VARRAY's."""

    name: str
    element: T.DataType
    limit: int | None = None
    key: T.DataType | None = None

    @property
    def spark(self) -> T.DataType:
        return T.MapType(self.key, self.element) if self.key is not None else T.ArrayType(self.element)


@dataclass
class Catalog:
    """What names stand for: tables (any DataFrame), views, synonyms, types and routines by schema."""

    schema: str = "MAIN"
    tables: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    views: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    synonyms: list[Synonym] = field(default_factory=list)
    types: dict[tuple[str, str], T.DataType | CollectionType] = field(default_factory=dict)
    functions: dict[tuple[str, str], str] = field(default_factory=dict)
    constraints: dict[tuple[str, str], list] = field(default_factory=dict)
    schemas: set[str] = field(default_factory=set)
    #: By table: columns that take no null, and expressions for columns that an INSERT leaves out.
    required: dict[tuple[str, str], set[str]] = field(default_factory=dict)
    defaults: dict[tuple[str, str], dict[str, str]] = field(default_factory=dict)
    sequences: dict[tuple[str, str], Sequence] = field(default_factory=dict)
    #: Relations that are opened when a query first names them.
    loaders: dict[tuple[str, str], Callable[[], DataFrame]] = field(default_factory=dict)

    def add_schema(self, name: str) -> None:
        self.schemas.add(normal(name))

    def add_sequence(self, name: str, start: int = 1, step: int = 1) -> Sequence:
        schema, short = split_name(name)
        return self.sequences.setdefault((schema or self.schema, short), Sequence(start, step))

    def add_table(self, name: str, df: DataFrame) -> None:
        schema, table = split_name(name)
        self.tables[schema or self.schema, table] = df

    def add_view(self, name: str, df: DataFrame) -> None:
        schema, view = split_name(name)
        self.views[schema or self.schema, view] = df

    def add_synonym(self, owner: str, name: str, schema: str, target: str) -> None:
        self.synonyms.append(Synonym(normal(owner), normal(name), normal(schema), normal(target)))

    def add_type(self, name: str, kind: T.DataType | CollectionType) -> None:
        schema, short = split_name(name)
        self.types[schema or self.schema, short] = kind

    def add_loader(self, name: str, load: Callable[[], DataFrame]) -> None:
        schema, table = split_name(name)
        self.loaders[schema or self.schema, table] = load

    def relation(self, schema: str, name: str) -> DataFrame | None:
        key = (schema, name)
        if key not in self.tables and key not in self.views and key in self.loaders:
            self.tables[key] = self.loaders[key]()
        return self.tables.get((schema, name), self.views.get((schema, name)))

    def resolve(self, name: str) -> tuple[str, str]:
        """(schema, table or view): the schema's own, then exactly one synonym there, then a public one."""
        schema, short = split_name(name)
        schema = schema or self.schema
        if self.relation(schema, short) is not None:
            return schema, short
        for owner in (schema, "PUBLIC"):
            found = [s for s in self.synonyms if s.owner == owner and s.name == short]
            if len(found) > 1:
                raise ResolutionError(f"{schema}.{short} is the name of {len(found)} synonyms")
            if found:
                s = found[0]
                if self.relation(s.schema, s.target) is None:
                    raise ResolutionError(f"synonym {owner}.{short} points to {s.schema}.{s.target}, which is not there")
                return s.schema, s.target
        raise ResolutionError(f"no table or view {schema}.{short}")

    def type_of(self, name: str) -> T.DataType | CollectionType | None:
        """A type by name: the schema's own, a synonym's, then any schema's."""
        schema, short = split_name(name)
        wanted = schema or self.schema
        if (wanted, short) in self.types:
            return self.types[wanted, short]
        for s in self.synonyms:
            if s.name == short and s.owner in (wanted, "PUBLIC") and (s.schema, s.target) in self.types:
                return self.types[s.schema, s.target]
        return next((v for (_, n), v in self.types.items() if n == short), None)

    def spark_type(self, text: str) -> T.DataType:
        """Any type text: built in, of the catalog, ``table.column%TYPE`` or ``table%ROWTYPE``."""
        m = re.fullmatch(r"(.+)%(TYPE|ROWTYPE)", text.strip(), re.I)
        if m and m[2].upper() == "ROWTYPE":
            return T.StructType([T.StructField(f.name.lower(), f.dataType) for f in self.relation(*self.resolve(m[1])).schema])
        if m:
            table, _, column = m[1].rpartition(".")
            for f in self.relation(*self.resolve(table)).schema:
                if f.name.upper() == normal(column):
                    return f.dataType
            raise ResolutionError(f"{table} has no column {column}")

        def lookup(name: str) -> T.DataType | None:
            found = self.type_of(name)
            return found.spark if isinstance(found, CollectionType) else found

        return spark_type(text, lookup)

    def columns(self, name: str) -> dict[str, T.DataType]:
        return {f.name.lower(): f.dataType for f in self.relation(*self.resolve(name)).schema}
