"""Triggers on change sets.

A row trigger is one expression over all pending rows.  What its body would look up for each row by a
query of its own (SELECT ... INTO) is one join: the table is grouped by the columns that the query compares with
the row, and joined to the pending rows once.  A statement trigger runs once, on the change set.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .changes import NEW, OLD, ROW, ChangeSet, kind

EVENTS = frozenset({"INSERT", "UPDATE", "DELETE"})


@dataclass(frozen=True)
class Lookup:
    """SELECT ``value`` INTO ``name`` FROM ``table`` WHERE each column of ``keys`` equals its expression over ``old`` and ``new``.

    A plain value raises where a row finds none or more than one; ``missing`` is what a handler of NO_DATA_FOUND would
    put in place instead.  An ``aggregate`` (COUNT, SUM, ...) has one value always: for rows without any match that of ``missing``, 0 for a count.
    A null key equals nothing.  ``where`` holds for the table's rows alone.
    """

    name: str
    table: DataFrame | Callable[[], DataFrame]
    keys: dict[str, str]
    value: str
    aggregate: bool = False
    where: str | None = None
    missing: str | None = None

    def join(self, rows: DataFrame, wanted: Column) -> DataFrame:
        """``rows`` with the column ``name``; rows that are not ``wanted`` look nothing up."""
        source = self.table() if callable(self.table) else self.table
        if self.where:
            source = source.where(self.where)
        keys = [f"__k{i}" for i in range(len(self.keys))]
        grouped = source.groupBy(*[F.col(c).alias(k) for c, k in zip(self.keys, keys)])
        value = F.expr(self.value) if self.aggregate else F.first(F.expr(self.value))
        found = grouped.agg(value.alias("__value"), F.count(F.lit(1)).alias("__found"))
        same = F.lit(True)
        for e, k in zip(self.keys.values(), keys):
            same &= F.expr(e) == F.col(k)
        out = rows.join(found, wanted & same, "left")
        kept = F.col("__value")
        kinds = found.schema["__value"].dataType
        none = F.col("__found").isNull()
        if self.aggregate:
            kept = F.when(none, F.expr(self.missing or "null").cast(kinds)).otherwise(kept)
        else:
            instead = F.expr(self.missing).cast(kinds) if self.missing is not None else F.raise_error(F.lit(f"NO_DATA_FOUND: {self.name}")).cast(kinds)
            kept = F.when(~wanted, F.lit(None)).when(none, instead).when(F.col("__found") > 1, F.raise_error(F.lit(f"TOO_MANY_ROWS: {self.name}")).cast(kinds)).otherwise(kept)
        return out.withColumn(self.name, kept).drop(*keys, "__value", "__found")


@dataclass(frozen=True)
class RowTrigger:
    """BEFORE ... FOR EACH ROW.

    ``sets`` gives columns of the new image by expressions over ``old``, ``new`` and the names of the lookups, in order: a later one sees
    what an earlier one set.  ``checks`` are conditions that must not hold, with what RAISE_APPLICATION_ERROR would say.
    """

    events: frozenset[str] | set[str] = EVENTS
    sets: dict[str, str] = field(default_factory=dict)
    when: str | None = None
    #: UPDATE OF: the trigger fires only for statements that set one of these.
    of: frozenset[str] | set[str] = frozenset()
    lookups: tuple[Lookup, ...] = ()
    checks: tuple[tuple[str, str], ...] = ()

    def applies(self, events: set[str], columns: set[str] | None) -> bool:
        return _fires(set(self.events), set(self.of), events, columns)

    def apply(self, rows: DataFrame) -> DataFrame:
        image = rows.schema[NEW].dataType
        known = {f.name.lower(): f for f in image}
        if unknown := {c.lower() for c in self.sets} - set(known):
            raise LookupError(f"no column {', '.join(sorted(unknown))}")
        hit = kind().isin(*self.events)
        if self.when:
            hit &= F.coalesce(F.expr(self.when), F.lit(False))
        rows = rows.withColumn("__hit", hit)
        for look in self.lookups:
            rows = look.join(rows, F.col("__hit"))
        for condition, says in self.checks:
            bad = F.col("__hit") & F.coalesce(F.expr(condition), F.lit(False))
            rows = rows.withColumn("__hit", F.when(bad, F.raise_error(F.lit(says)).cast("boolean")).otherwise(F.col("__hit")))
        for c, e in self.sets.items():
            f = known[c.lower()]
            value = F.when(F.col("__hit"), F.expr(e).cast(f.dataType)).otherwise(F.col(f"{NEW}.`{f.name}`"))
            rows = rows.withColumn(NEW, F.when(F.col(NEW).isNotNull(), F.col(NEW).withField(f"`{f.name}`", value)))
        if not self.sets and self.checks:  # a check that nothing reads would not be made
            rows = rows.where(F.col("__hit").isNotNull())
        return rows.select(ROW, OLD, F.col(NEW).cast(image).alias(NEW))


@dataclass(frozen=True)
class StatementTrigger:
    """Once for each statement: BEFORE it with nothing, or AFTER it with its change set, which may be empty."""

    action: Callable[[ChangeSet | None], None]
    timing: str = "AFTER"
    events: frozenset[str] | set[str] = EVENTS
    of: frozenset[str] | set[str] = frozenset()

    def applies(self, events: set[str], columns: set[str] | None) -> bool:
        return _fires(set(self.events), set(self.of), events, columns)


def _fires(mine: set[str], of: set[str], events: set[str], columns: set[str] | None) -> bool:
    hit = mine & events
    return bool(hit - {"UPDATE"} or "UPDATE" in hit and (not of or columns is None or {c.lower() for c in of} & {c.lower() for c in columns}))
