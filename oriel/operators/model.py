"""MODEL: rules over the cells of a table, which its dimensions address within each partition.

Rules that name their cells by constants need those cells only: one grouped pass brings them into a row for each partition,
every rule is an expression on that row, and the cells that were set go back to the table by one join.  A partition of any size
gives a row of as many cells as the rules name.  A rule for all cells that fit a condition reads others by joins on their addresses.
Nothing gathers the cells of a partition.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written


@dataclass(frozen=True)
class CV:
    """The current value of a dimension of the cell that is set, plus ``offset``."""

    offset: int = 0


@dataclass(frozen=True)
class Any_:
    """All values of a dimension."""


ANY = Any_()


@dataclass(frozen=True)
class Rule:
    """``measure[at] = value``: ``at`` gives each dimension a constant or ``ANY``, ``value`` takes the cells that ``reads`` names.

    With constants alone the cell is made if it is missing (UPSERT); with ``ANY`` the cells that are there are set, where ``where`` holds.
    """

    measure: str
    at: dict[str, Any]
    value: Callable[..., Column]
    #: (measure, address) of each argument of ``value``; addresses are constants or ``CV``.
    reads: tuple[tuple[str, dict[str, Any]], ...] = ()
    where: str | None = None

    @property
    def single(self) -> bool:
        return not any(isinstance(v, Any_) for v in self.at.values())

    def address(self, read: dict[str, Any]) -> dict[str, Any]:
        """A read with the constants of the target in place of current values, where there are any."""
        out = {}
        for d, v in read.items():
            own = self.at.get(d)
            out[d] = v if not isinstance(v, CV) or isinstance(own, Any_) else own if not v.offset else own + v.offset
        return out


def _meet(a: dict[str, Any], b: dict[str, Any]) -> bool:
    """Whether two addresses can be of one cell."""
    return all(isinstance(x, (Any_, CV)) or isinstance(y, (Any_, CV)) or x == y for x, y in ((v, b[d]) for d, v in a.items()))


@dataclass
class Model:
    partition: list[str]
    dimensions: list[str]
    measures: list[str]
    rules: list[Rule] = field(default_factory=list)
    #: Missing cells and nulls count as 0 (IGNORE NAV).
    ignore_nav: bool = False
    #: AUTOMATIC ORDER: a rule comes after those that set what it reads; else rules apply as they stand.
    automatic: bool = True

    def __post_init__(self) -> None:
        for r in self.rules:
            for m, at in ((r.measure, r.at), *r.reads):
                if m not in self.measures or set(at) != set(self.dimensions):
                    raise ValueError(f"{m}[{', '.join(map(str, at))}] is no cell of this model")
            if any(isinstance(v, CV) for v in r.at.values()):
                raise ValueError("CV() stands on the right side of a rule")

    def ordered(self) -> list[Rule]:
        """The rules in an order in which each reads what others have set; rules that wait for one another raise."""
        if not self.automatic:
            return self.rules
        needs = [{j for j, s in enumerate(self.rules) if any(m == s.measure and _meet(r.address(at), s.at) for m, at in r.reads)} for r in self.rules]
        out: list[int] = []
        while len(out) < len(self.rules):
            ready = [i for i in range(len(self.rules)) if i not in out and needs[i] <= set(out)]
            if not ready:
                raise ValueError("rules read each other's cells in a circle")
            out.append(ready[0])
        return [self.rules[i] for i in out]

    def apply(self, df: DataFrame) -> DataFrame:
        """The table after all rules: columns of the partition, the dimensions and the measures.

        Dimensions address one row each within a partition; a second row with the same address raises.  Null dimensions are values like others.
        Groups of rules are written one after the other.  A table without rows has no partitions and stays empty.
        """
        cells = df.select(*self.partition, *self.dimensions, *self.measures)
        rules = self.ordered()
        i = 0
        while i < len(rules):
            if rules[i].single and all(not isinstance(v, (CV, Any_)) for _, at in rules[i].reads for v in rules[i].address(at).values()):
                j = i
                while j < len(rules) and rules[j].single:
                    j += 1
                cells = self._single(cells, rules[i:j])
                i = j
            else:
                cells = self._each(cells, rules[i])
                i += 1
            if i < len(rules):
                cells = written(cells, "model")
        return cells

    def _nav(self, c: Column) -> Column:
        return F.coalesce(c, F.lit(0)) if self.ignore_nav else c

    def _is(self, at: dict[str, Any]) -> Column:
        out = F.lit(True)
        for d, v in at.items():
            out &= F.col(d).eqNullSafe(F.lit(v))
        return out

    def _single(self, cells: DataFrame, rules: list[Rule]) -> DataFrame:
        """Rules on named cells: one row a partition, then one join."""
        named: dict[tuple, str] = {}
        key = lambda m, at: (m, *(at[d] for d in self.dimensions))
        for r in rules:
            for m, at in ((r.measure, r.at), *((m, r.address(at)) for m, at in r.reads)):
                named.setdefault(key(m, at), f"__c{len(named)}")
        places = {p: i for i, p in enumerate(dict.fromkeys(k[1:] for k in named))}
        at_of = lambda place: dict(zip(self.dimensions, place))
        aggs = [F.max(F.when(self._is(at_of(k[1:])), F.col(k[0]))).alias(c) for k, c in named.items()]
        there = [F.count(F.when(self._is(at_of(p)), 1)).alias(f"__n{i}") for p, i in places.items()]
        row = cells.groupBy(*self.partition).agg(*aggs, *there)
        twice = F.greatest(*[F.col(f"__n{i}") for i in places.values()], F.lit(0)) > 1
        first = f"__n{next(iter(places.values()))}"
        row = row.withColumn(first, F.when(twice, F.raise_error(F.lit("a cell has two rows")).cast("long")).otherwise(F.col(first)))
        kinds = {m: cells.schema[m].dataType for m in self.measures}
        for r in rules:
            own = [self._nav(F.col(named[key(m, r.address(at))])) for m, at in r.reads]
            row = row.withColumn(named[key(r.measure, r.at)], r.value(*own).cast(kinds[r.measure]))
        row = written(row, "cells")
        targets = {key(r.measure, r.at) for r in rules}
        back = row.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(self.partition)], *[named[k] for k in targets])
        same = F.lit(True)
        for i, p in enumerate(self.partition):
            same &= F.col(p).eqNullSafe(F.col(f"__p{i}"))
        updated = cells.join(back, same)
        values = {}
        for m in self.measures:
            out = F.col(m)
            for k in (k for k in targets if k[0] == m):
                out = F.when(self._is(at_of(k[1:])), F.col(named[k])).otherwise(out)
            values[m] = out
        updated = updated.select(*self.partition, *self.dimensions, *[v.alias(m) for m, v in values.items()])
        for place in {k[1:] for k in targets}:  # cells that were not there
            made = [F.col(named[m, *place]).alias(m) if (m, *place) in targets else F.lit(None).cast(kinds[m]).alias(m) for m in self.measures]
            dims = [F.lit(v).cast(cells.schema[d].dataType).alias(d) for d, v in at_of(place).items()]
            updated = updated.unionByName(row.where(F.col(f"__n{places[place]}") == 0).select(*self.partition, *dims, *made))
        return updated

    def _each(self, cells: DataFrame, rule: Rule) -> DataFrame:
        """A rule for many cells: each reads others by a join on their addresses, as they were before the rule."""
        own, out = [], cells
        for i, (m, at) in enumerate(rule.reads):
            other = cells.select(*[F.col(p).alias(f"__p{k}") for k, p in enumerate(self.partition)], *[F.col(d).alias(f"__d{k}") for k, d in enumerate(self.dimensions)], F.col(m).alias(f"__r{i}"))
            if all(isinstance(v, CV) and not v.offset for v in rule.address(at).values()):
                own.append(self._nav(F.col(m)))
                continue
            same = F.lit(True)
            for k, p in enumerate(self.partition):
                same &= F.col(p).eqNullSafe(F.col(f"__p{k}"))
            for k, d in enumerate(self.dimensions):
                v = rule.address(at)[d]
                wanted = F.col(f"__d{k}")
                if isinstance(v, CV):
                    same &= wanted.eqNullSafe(F.col(d) + F.lit(v.offset) if v.offset else F.col(d))
                else:  # constants hold for the other side alone, which is filtered before the join
                    other = other.where(wanted.eqNullSafe(F.lit(v)))
            out = out.join(other, same, "left").drop(*[f"__p{k}" for k in range(len(self.partition))], *[f"__d{k}" for k in range(len(self.dimensions))])
            own.append(self._nav(F.col(f"__r{i}")))
        hit = self._is({d: v for d, v in rule.at.items() if not isinstance(v, Any_)})
        if rule.where:
            hit &= F.coalesce(F.expr(rule.where), F.lit(False))
        value = F.when(hit, rule.value(*own).cast(cells.schema[rule.measure].dataType)).otherwise(F.col(rule.measure))
        return out.withColumn("__new", value).select(*self.partition, *self.dimensions, *[F.col("__new").alias(m) if m == rule.measure else m for m in self.measures])
