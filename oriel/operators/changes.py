"""Change sets: what a statement does to a table, row by row, before it is done.

A change set has a row for each row that is inserted, updated or deleted: the number the row keeps for life, its
image before (``old``, null for an insert) and its image after (``new``, null for a delete).  Counts, RETURNING,
triggers and the next snapshot are all read from it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW, OLD, NEW = "__row", "old", "new"


def kind() -> Column:
    """INSERT, UPDATE or DELETE, by the images that are there."""
    return F.when(F.col(OLD).isNull(), "INSERT").when(F.col(NEW).isNull(), "DELETE").otherwise("UPDATE")


@dataclass(frozen=True)
class ChangeSet:
    """``rows`` has (__row, old, new); ``version`` is the commit that wrote it, none while it is pending."""

    rows: DataFrame
    version: int | None = None
    #: Columns of the table.
    columns: tuple[str, ...] = field(default=())

    @classmethod
    def of(cls, rows: DataFrame, version: int | None = None) -> ChangeSet:
        return cls(rows, version, tuple(rows.schema[NEW].dataType.fieldNames()))

    def count(self) -> int:
        """SQL%ROWCOUNT."""
        return self.rows.count()

    def counts(self) -> dict[str, int]:
        """Rows by INSERT, UPDATE and DELETE."""
        return {"INSERT": 0, "UPDATE": 0, "DELETE": 0} | {r["k"]: r["count"] for r in self.rows.groupBy(kind().alias("k")).count().collect()}

    def only(self, *kinds: str) -> ChangeSet:
        return ChangeSet(self.rows.where(kind().isin(*kinds)), self.version, self.columns)

    def image(self) -> DataFrame:
        """The rows as they are after the statement, or as they were where it deletes them."""
        now = F.coalesce(F.col(NEW), F.col(OLD))
        return self.rows.select(ROW, OLD, NEW, now.alias("__now")).select(ROW, OLD, NEW, "__now.*")

    def returning(self, *exprs: str | Column) -> DataFrame:
        """Expressions over each changed row: plain names mean the image after, or of a deleted row that before;
        ``old.c`` and ``new.c`` mean either.  Without expressions, all columns."""
        made = [F.expr(e) if isinstance(e, str) else e for e in exprs or self.columns]
        return self.image().select(*made)
