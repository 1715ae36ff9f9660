"""Constraints as checks on a table's rows.

Each validator is a lazy table of violations.  They apply in the order primary
key, unique, check, foreign key; one that cannot be applied is reported and
the others go on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog, ResolutionError, normal
from ..engine import Engine
from ..sql.parser import Parser

ORDER = {"P": 0, "U": 1, "C": 2, "R": 3}


@dataclass(frozen=True)
class Constraint:
    """kind: P, U, R or C, as the dictionary says."""

    name: str
    kind: str
    columns: tuple[str, ...] = ()
    condition: str = ""
    target: str = ""
    target_columns: tuple[str, ...] = ()
    on_delete: str = "NO ACTION"
    deferrable: bool = False
    enabled: bool = True


def duplicates(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Keys without a null that more than one row has, with their counts."""
    known = df.select(*columns).na.drop(subset=list(columns))
    return known.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def primary_key(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Keys that repeat, and keys with a null."""
    some = F.lit(False)
    for c in columns:
        some = some | F.col(c).isNull()
    return duplicates(df, columns).unionByName(df.where(some).groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")))


def foreign_key(df: DataFrame, columns: tuple[str, ...], parent: DataFrame, parent_columns: tuple[str, ...]) -> DataFrame:
    """Keys without a null that the parent does not hold, with their counts; counted before they are joined."""
    keys = df.select(*columns).na.drop(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows"))
    there = parent.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(parent_columns)]).distinct()
    same = [F.col(c) == F.col(f"__p{i}") for i, c in enumerate(columns)]
    return keys.join(there, same, "left_anti")


def check(engine: Engine, df: DataFrame, condition: str) -> DataFrame:
    """Rows for which the condition is false; an unknown one holds."""
    p = Parser(condition)
    e = p.expr()
    p.end()
    w = engine.writer()
    w.scopes.append({"": {f.name.lower(): f.dataType for f in df.schema}})
    return df.where(F.expr(f"NOT ({w.expr(e)})"))


@dataclass
class Outcome:
    constraint: Constraint
    violations: DataFrame | None
    skipped: str = ""


def validate(engine: Engine, table: str, constraints: list[Constraint]) -> list[Outcome]:
    """Outcomes in the order of application; a foreign key without its target table is skipped."""
    catalog: Catalog = engine.catalog
    df = catalog.relation(*catalog.resolve(table))
    out = []
    for c in sorted(constraints, key=lambda c: ORDER[c.kind]):
        try:
            if not c.enabled:
                out.append(Outcome(c, None, "disabled"))
            elif c.kind == "P":
                out.append(Outcome(c, primary_key(df, c.columns)))
            elif c.kind == "U":
                out.append(Outcome(c, duplicates(df, c.columns)))
            elif c.kind == "C":
                out.append(Outcome(c, check(engine, df, c.condition)))
            else:
                parent = catalog.relation(*catalog.resolve(c.target))
                out.append(Outcome(c, foreign_key(df, c.columns, parent, c.target_columns)))
        except (ResolutionError, ValueError) as e:
            out.append(Outcome(c, None, str(e)))
    return out


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]
    kind: str = "NORMAL"
    unique: bool = False
    valid: bool = True
    partitioned: bool = False


#: Most columns of an index that is carried over.
MOST_COLUMNS = 32


def index_advice(indexes: list[Index], constraints: list[Constraint]) -> list[tuple[str, str]]:
    """(index, advice): what a layout can do in an index's place, or why nothing does.

    Spark has no indexes; order within files and Bloom filters serve lookups.
    """
    covered = {tuple(map(normal, c.columns)) for c in constraints if c.kind in "PU"}
    out = []
    for i in indexes:
        if i.kind != "NORMAL":
            out.append((i.name, f"not supported: {i.kind.lower()}"))
        elif not i.valid:
            out.append((i.name, "not supported: invalid"))
        elif i.partitioned:
            out.append((i.name, "not supported: partitioned"))
        elif len(i.columns) > MOST_COLUMNS:
            out.append((i.name, f"not supported: more than {MOST_COLUMNS} columns"))
        elif tuple(map(normal, i.columns)) in covered:
            out.append((i.name, "covered by a constraint"))
        elif len(i.columns) == 1:
            out.append((i.name, f"bloom filter on {i.columns[0]}" if i.unique else f"sort files by {i.columns[0]}"))
        else:
            out.append((i.name, f"sort files by {', '.join(i.columns)}"))
    return out
