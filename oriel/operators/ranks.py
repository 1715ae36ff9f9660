"""Places of rows in one whole order, without bringing the rows into one task.

The rows are dealt by ranges of the order, sorted within each range and written.  Each
written row knows its range and its place there.  Counts of the ranges, added up, give each
range's first place; they are as many as there are partitions, and are joined back by broadcast.

The table is written before it is counted: range bounds are drawn by sampling anew in
each job, so a plan that is run twice does not give the same ranges.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written

#: Bits of a mark that count within its range.
WITHIN = 33
MARK = "__mark"


def hashable(kind: T.DataType) -> bool:
    """Spark hashes neither maps nor variants, nor what holds them."""
    if isinstance(kind, T.ArrayType):
        return hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(hashable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def ties(df: DataFrame) -> list[Column]:
    """What orders rows that an order leaves equal, so that one frequent value still spreads over many ranges."""
    known = [F.col(f"`{f.name}`") for f in df.schema if hashable(f.dataType)]
    return [*([F.xxhash64(*known)] if known else []), F.monotonically_increasing_id()]


@dataclass(frozen=True)
class Ordered:
    """A written table whose rows carry a mark, and the number of rows before each range."""

    rows: DataFrame
    order: list[Column]
    before: dict[int, int]
    total: int

    def _placed(self, column: str) -> DataFrame:
        if not self.before:
            return self.rows.withColumn(column, F.lit(0).cast("long"))
        spark = self.rows.sparkSession
        starts = spark.createDataFrame(pa.table({"__range": pa.array(self.before, pa.int64()), "__before": pa.array(self.before.values(), pa.int64())}))
        out = self.rows.withColumn("__range", F.shiftright(MARK, WITHIN)).join(F.broadcast(starts), "__range")
        return out.withColumn(column, F.col("__before") + F.col(MARK).bitwiseAND(F.lit((1 << WITHIN) - 1))).drop("__range", "__before")

    def numbered(self, column: str, first: int = 1, step: int = 1) -> DataFrame:
        """The rows with ``first``, ``first + step``, ... in their order."""
        return self._placed("__place").withColumn(column, F.lit(first) + F.lit(step) * F.col("__place")).drop("__place", MARK)

    def between(self, start: int, end: int, with_ties: bool = False) -> DataFrame:
        """The rows at places ``start`` to ``end`` - 1, counted from 0; with ties also those equal in the order to the last of them."""
        end = min(end, self.total)
        if start >= end:
            return self.rows.limit(0).drop(MARK)
        placed = self._placed("__place")
        hit = (F.col("__place") >= start) & (F.col("__place") < end)
        # ranges that hold none of these places are not read: marks rise with places, and parquet keeps their bounds
        lowest = max(r for r, b in self.before.items() if b <= start)
        highest = max(r for r, b in self.before.items() if b < end)
        hit &= (F.col(MARK) >= lowest << WITHIN) & (F.col(MARK) < (highest + 1) << WITHIN)
        if with_ties and end < self.total and self.order:
            keys = [f"__k{i}" for i in range(len(self.order))]
            values = [_value(c).alias(k) for c, k in zip(self.order, keys)]
            last = placed.where(F.col("__place") == end - 1).select(*values).first()
            schema = placed.select(*values).schema
            edge = self.rows.sparkSession.createDataFrame([tuple(last)], schema)
            placed = placed.crossJoin(F.broadcast(edge))  # one row
            equal = F.lit(True)
            for c, k in zip(self.order, keys):
                equal &= _value(c).eqNullSafe(F.col(k))
            return placed.where(hit | equal & (F.col("__place") >= end)).drop(*keys, "__place", MARK)
        return placed.where(hit).drop("__place", MARK)

    def percent(self, share: float, with_ties: bool = False, offset: int = 0) -> DataFrame:
        """The first ``share`` per cent of the rows, rounded up to whole rows, after ``offset`` rows."""
        n = -(-self.total * share // 100) if isinstance(share, int) else -(-self.total * float(share) // 100)
        return self.between(offset, offset + max(int(n), 0), with_ties)


def _value(c: Column) -> Column:
    """The expression that a sort key sorts by."""
    return getattr(c, "__sorts__", c)


def key(c: Column, descending: bool = False, nulls_first: bool | None = None) -> Column:
    """A sort key that remembers its expression; nulls sort last when ascending and first when descending unless told."""
    first = descending if nulls_first is None else nulls_first
    out = (c.desc_nulls_first() if first else c.desc_nulls_last()) if descending else (c.asc_nulls_first() if first else c.asc_nulls_last())
    out.__sorts__ = c
    return out


def in_order(df: DataFrame, order: list[str | Column] | None = None, label: str = "order") -> Ordered:
    """``df`` written in the order of ``order``, or as it stands without one, which shuffles nothing.

    Rows that the order leaves equal follow in an order of their own.  Any table will do: an empty one
    gives no numbers, nulls sort as ``key`` says, and a value that many rows share is spread over ranges.
    Names that begin with two underscores are taken.
    """
    keys = [key(F.col(c)) if isinstance(c, str) else c for c in order or []]
    if keys:
        df = df.repartitionByRange(*keys, *ties(df)).sortWithinPartitions(*keys)
    rows = written(df.withColumn(MARK, F.monotonically_increasing_id()), label)
    counts = rows.groupBy(F.shiftright(MARK, WITHIN).alias("part")).count().collect()  # a row for each partition
    by_part = dict(sorted((r["part"], r["count"]) for r in counts))
    starts = dict(zip(by_part, accumulate(by_part.values(), initial=0)))
    return Ordered(rows, keys, starts, sum(by_part.values()))
