"""Versioned tables: a log of snapshots and change sets, so that queries read a table AS OF a version or a time.

A table is a folder.  ``rows-*`` hold a whole snapshot, each row with the number it keeps; ``changes-*`` hold the change
set of one commit; ``_log`` has one small record for each commit, written after the data it names, so that
a commit that fails half-way is not there.  A version is read by merging: of the changes since the snapshot, the last one
of each row; rows of the snapshot without one; and what the last changes left.  Only the changes are shuffled as a whole,
and where they are few, they are broadcast and the snapshot is only read.  ``compact`` writes a new snapshot.

Statements on a table change what they hit, whatever its size: nothing rewrites the rest.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..scratch import delete, shared_folder, written
from .changes import NEW, OLD, ROW, ChangeSet, kind
from .ranks import in_order
from .triggers import RowTrigger, StatementTrigger


class SnapshotTooOld(LookupError):
    """A version that is not there, or no more."""


@dataclass(frozen=True)
class Commit:
    version: int
    #: Microseconds since 1970, UTC.
    at: int
    kind: str  # rows or changes
    path: str
    #: The number that the next new row gets.
    next_row: int
    #: Where rows came after a compaction that dropped what was before.
    floor: int = 0


LOG = "version long, at long, kind string, path string, next_row long, floor long"


def micros(at: datetime | int) -> int:
    """A moment as microseconds since 1970; a time without a zone is UTC."""
    if isinstance(at, int):
        return at
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1_000_000)


@dataclass
class VersionedTable:
    spark: SparkSession
    folder: str
    log: list[Commit] = field(default_factory=list)
    triggers: list[RowTrigger | StatementTrigger] = field(default_factory=list)
    #: Columns that take no null.
    required: tuple[str, ...] = ()

    # the log

    @classmethod
    def create(cls, df: DataFrame, folder: str | None = None, at: datetime | int | None = None) -> VersionedTable:
        """A table of the rows of ``df`` as version 0."""
        clash = {ROW, OLD, NEW} & set(df.columns)
        if clash or len({c.lower() for c in df.columns}) != len(df.columns):
            raise ValueError(f"columns of a versioned table are not named {', '.join(sorted(clash)) or 'alike'}")
        spark = df.sparkSession
        out = cls(spark, folder or f"{shared_folder(spark)}/oriel-table-{uuid.uuid4().hex[:12]}")
        ordered = in_order(df, None, "rows")
        path = f"rows-{uuid.uuid4().hex[:8]}"
        ordered.numbered(ROW, 0).write.option("compression", "zstd").parquet(f"{out.folder}/{path}")
        out._record(Commit(0, micros(at) if at is not None else time.time_ns() // 1000, "rows", path, ordered.total))
        return out

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> VersionedTable:
        """A table that is there, with all its versions."""
        rows = spark.read.schema(LOG).json(f"{folder}/_log/*").collect()
        return cls(spark, folder, sorted((Commit(**r.asDict()) for r in rows), key=lambda c: (c.version, c.kind)))

    def _record(self, c: Commit) -> None:
        """A record that is there already belongs to another writer: this commit fails, and its data is never named."""
        if self.log and c.at < (last := self.log[-1].at):
            c = Commit(**(c.__dict__ | {"at": last}))  # clocks may go back, the log does not
        row = self.spark.createDataFrame([tuple(c.__dict__.values())], LOG)
        row.coalesce(1).write.mode("errorifexists").json(f"{self.folder}/_log/{c.version:012d}-{c.kind}")
        self.log.append(c)

    @property
    def version(self) -> int:
        return max(c.version for c in self.log)

    @property
    def floor(self) -> int:
        return max(c.floor for c in self.log)

    @property
    def next_row(self) -> int:
        return max(c.next_row for c in self.log)

    def schema(self) -> T.StructType:
        full = self._rows_of(next(c for c in self.log if c.kind == "rows" and c.version >= self.floor)).schema
        return T.StructType([f for f in full if f.name != ROW])

    def version_at(self, at: datetime | int) -> int:
        """The last version committed up to a moment."""
        found = [c.version for c in self.log if c.at <= micros(at)]
        if not found:
            raise SnapshotTooOld("the table was not there yet")
        return max(found)

    # reading

    def _rows_of(self, c: Commit) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{c.path}")

    def _since(self, low: int, high: int) -> list[tuple[int, DataFrame]]:
        return [(c.version, self._rows_of(c)) for c in self.log if c.kind == "changes" and low < c.version <= high]

    def as_of(self, version: int | None = None, at: datetime | int | None = None, rows: bool = False) -> DataFrame:
        """The table as it was at a version or a moment, else as it is; with ``rows`` each row's number too."""
        wanted = self.version_at(at) if at is not None else self.version if version is None else version
        if not self.floor <= wanted <= self.version:
            raise SnapshotTooOld(f"version {wanted}: versions {self.floor} to {self.version} are there")
        base = max((c for c in self.log if c.kind == "rows" and c.version <= wanted), key=lambda c: c.version)
        out = self._rows_of(base)
        names = [c for c in out.columns if c != ROW]
        if since := self._since(base.version, wanted):
            if len(since) == 1:
                last = since[0][1].select(ROW, NEW)
            else:
                every = reduce(DataFrame.unionByName, [df.select(ROW, NEW, F.lit(v).alias("v")) for v, df in since])
                last = every.groupBy(ROW).agg(F.max_by(F.struct(NEW), "v").alias("s")).select(ROW, f"s.{NEW}")
            left = last.where(F.col(NEW).isNotNull()).select(ROW, f"{NEW}.*")
            out = out.join(last.select(ROW), ROW, "left_anti").select(ROW, *map(_q, names)).unionByName(left)
        return out if rows else out.select(*map(_q, names))

    def changes(self, version: int) -> ChangeSet:
        """The change set of a commit."""
        found = self._since(version - 1, version) if version > self.floor else []
        if not found:
            raise SnapshotTooOld(f"version {version} has no change set")
        return ChangeSet.of(found[0][1], version)

    def between(self, low: int | None = None, high: int | None = None) -> DataFrame:
        """VERSIONS BETWEEN: every image that a row had from ``low`` to ``high``, with the version it began at (null for those that
        were there at ``low``), the version that ended it (null for those still there at ``high``) and the operation that made it."""
        low, high = self.floor if low is None else low, self.version if high is None else high
        at_first = self.as_of(low, rows=True)
        names = [c for c in at_first.columns if c != ROW]
        first = at_first.select(ROW, F.lit(low).cast("long").alias("v"), F.struct(*map(_q, names)).alias("image"), F.lit(None).cast("string").alias("op"))
        parts = [first, *(df.select(ROW, F.lit(v).cast("long").alias("v"), F.coalesce(NEW, OLD).alias("image"), kind().substr(1, 1).alias("op")) for v, df in self._since(low, high))]
        every = reduce(DataFrame.unionByName, parts)
        end = F.lead("v").over(Window.partitionBy(ROW).orderBy("v"))
        return every.withColumn("versions_endscn", end).select("image.*", F.when(F.col("op").isNotNull(), F.col("v")).alias("versions_startscn"), "versions_endscn", F.col("op").alias("versions_operation"))

    def compact(self, keep_older: bool = True) -> None:
        """A new snapshot of the last version; unless older ones are kept, what only they need is deleted."""
        c = Commit(self.version, time.time_ns() // 1000, "rows", f"rows-{uuid.uuid4().hex[:8]}", self.next_row, self.floor if keep_older else self.version)
        if any(x.kind == "rows" and x.version == c.version for x in self.log):
            return
        self.as_of(rows=True).write.option("compression", "zstd").parquet(f"{self.folder}/{c.path}")
        self._record(c)
        if not keep_older:
            for x in [x for x in self.log if x.version < c.version or x.kind == "changes"]:
                delete(self.spark, f"{self.folder}/{x.path}")

    # statements

    def insert(self, df: DataFrame) -> ChangeSet:
        """New rows; columns that ``df`` does not have are null."""
        schema = self.schema()
        given = {c.lower(): c for c in df.columns}
        if unknown := set(given) - {f.name.lower() for f in schema}:
            raise LookupError(f"no column {', '.join(sorted(unknown))}")
        image = F.struct(*[(F.col(_q(given[f.name.lower()])) if f.name.lower() in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        return self._commit(df.select(F.lit(None).cast("long").alias(ROW), F.lit(None).cast(schema).alias(OLD), image.alias(NEW)), "INSERT")

    def update(self, sets: dict[str, str | Column], where: str | Column = "true") -> ChangeSet:
        """Rows that the condition holds for get new values, all computed from the row before."""
        schema = self.schema()
        new = {c.lower(): F.expr(e) if isinstance(e, str) else e for c, e in sets.items()}
        if unknown := set(new) - {f.name.lower() for f in schema}:
            raise LookupError(f"no column {', '.join(sorted(unknown))}")
        hit = self.as_of(rows=True).where(_condition(where))
        image = F.struct(*[new.get(f.name.lower(), F.col(_q(f.name))).cast(f.dataType).alias(f.name) for f in schema])
        return self._commit(hit.select(ROW, F.struct(*[F.col(_q(f.name)) for f in schema]).alias(OLD), image.alias(NEW)), "UPDATE", set(new))

    def update_from(self, df: DataFrame, on: list[str], sets: list[str]) -> ChangeSet:
        """Rows that meet a row of ``df`` in the columns ``on`` take its values of ``sets``; one that meets two ends the commit.  A null key meets none."""
        schema = self.schema()
        names = {f.name.lower(): f.name for f in schema}
        if unknown := {c.lower() for c in (*on, *sets)} - set(names):
            raise LookupError(f"no column {', '.join(sorted(unknown))}")
        source = df.select(*[F.col(_q(c)).alias(f"__k{i}") for i, c in enumerate(on)], *[F.col(_q(c)).alias(f"__s{i}") for i, c in enumerate(sets)])
        place = {c.lower(): f"__s{i}" for i, c in enumerate(sets)}
        same = F.lit(True)
        for i, c in enumerate(on):
            same &= F.col(_q(names[c.lower()])) == F.col(f"__k{i}")
        image = F.struct(*[F.col(place.get(f.name.lower(), _q(f.name))).cast(f.dataType).alias(f.name) for f in schema])
        hit = self.as_of(rows=True).join(source, same)
        return self._commit(hit.select(ROW, F.struct(*[F.col(_q(f.name)) for f in schema]).alias(OLD), image.alias(NEW)), "UPDATE", set(place), once=True)

    def delete(self, where: str | Column = "true") -> ChangeSet:
        schema = self.schema()
        hit = self.as_of(rows=True).where(_condition(where))
        return self._commit(hit.select(ROW, F.struct(*[F.col(_q(f.name)) for f in schema]).alias(OLD), F.lit(None).cast(schema).alias(NEW)), "DELETE")

    def apply(self, rows: DataFrame, event: str = "MERGE", columns: set[str] | None = None) -> ChangeSet:
        """Commit (__row, old, new) rows that a statement made; a null row number asks for a new one."""
        return self._commit(rows, event, columns)

    def _commit(self, rows: DataFrame, event: str, columns: set[str] | None = None, once: bool = False) -> ChangeSet:
        """Statement triggers before, row triggers on all rows at once, the change set, the log, statement triggers after.

        New rows are numbered where they are written; a row that would be changed twice, or a null where none may be, ends the commit.
        """
        events = {event} if event != "MERGE" else {"INSERT", "UPDATE", "DELETE"}
        each = lambda timing: [t for t in self.triggers if isinstance(t, StatementTrigger) and t.timing == timing and t.applies(events, columns)]
        for t in each("BEFORE"):
            t.action(None)
        for t in self.triggers:
            if isinstance(t, RowTrigger) and t.applies(events, columns):
                rows = t.apply(rows)
        missing = [c for c in self.required if c.lower() in {f.lower() for f in rows.schema[NEW].dataType.fieldNames()}]
        for c in missing:
            bad = F.col(NEW).isNotNull() & F.col(f"{NEW}.{_q(c)}").isNull()
            rows = rows.withColumn(NEW, F.when(bad, F.raise_error(F.lit(f"{c} takes no null")).cast(rows.schema[NEW].dataType)).otherwise(F.col(NEW)))
        version, path = self.version + 1, f"changes-{uuid.uuid4().hex[:8]}"
        next_row = self.next_row
        if event == "INSERT" or event == "MERGE":
            ordered = in_order(rows, None, "changes")  # written once: numbers and what RETURNING shows stay the same
            rows = ordered.numbered("__n", next_row).withColumn(ROW, F.coalesce(ROW, "__n")).drop("__n")
            next_row += ordered.total
        rows.write.option("compression", "zstd").parquet(f"{self.folder}/{path}")
        kept = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{path}")
        if (once or event == "MERGE") and kept.groupBy(ROW).count().where("count > 1").limit(1).count():
            delete(self.spark, f"{self.folder}/{path}")
            raise ValueError(f"{event}: two source rows match one target row")
        self._record(Commit(version, time.time_ns() // 1000, "changes", path, next_row))
        out = ChangeSet.of(kept, version)
        for t in each("AFTER"):
            t.action(out)
        return out


def _condition(where: str | Column) -> Column:
    return (F.expr(where) if isinstance(where, str) else where).cast("boolean")


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`" if not re.fullmatch(r"\w+", name) else name


@dataclass
class TriggeredView:
    """A view that statements change by INSTEAD OF triggers.

    ``rows`` gives the view's rows; the trigger of each event gets the pending change set, whose images are rows of the view, all at
    once, and changes the tables behind it.  The change set is written before, so the trigger may read it while those tables change.
    """

    rows: Callable[[], DataFrame]
    instead_of: dict[str, Callable[[ChangeSet], None]]

    def _fire(self, event: str, old: Column | None, new: Column | None, rows: DataFrame, kind_of: T.StructType) -> ChangeSet:
        if event not in self.instead_of:
            raise ValueError(f"the view takes no {event}")
        none = F.lit(None).cast(kind_of)
        out = ChangeSet.of(written(rows.select(F.lit(None).cast("long").alias(ROW), (none if old is None else old).alias(OLD), (none if new is None else new).alias(NEW)), "instead"))
        self.instead_of[event](out)
        return out

    def insert(self, df: DataFrame) -> ChangeSet:
        schema = self.rows().schema
        return self._fire("INSERT", None, F.struct(*[(F.col(_q(f.name)) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]), df, schema)

    def update(self, sets: dict[str, str], where: str | Column = "true") -> ChangeSet:
        rows = self.rows()
        if unknown := set(sets) - set(rows.columns):
            raise LookupError(f"no column {', '.join(sorted(unknown))}")
        new = F.struct(*[(F.expr(sets[f.name]) if f.name in sets else F.col(_q(f.name))).cast(f.dataType).alias(f.name) for f in rows.schema])
        return self._fire("UPDATE", F.struct(*[F.col(_q(c)) for c in rows.columns]), new, rows.where(_condition(where)), rows.schema)

    def delete(self, where: str | Column = "true") -> ChangeSet:
        rows = self.rows()
        return self._fire("DELETE", F.struct(*[F.col(_q(c)) for c in rows.columns]), None, rows.where(_condition(where)), rows.schema)
