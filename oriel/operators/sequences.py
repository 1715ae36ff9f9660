"""Sequences: numbers without gaps for the rows of a table, without bringing them into one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from .ranks import in_order


@dataclass
class Sequence:
    start: int = 1
    step: int = 1
    #: The value that the next row gets.
    next: int | None = None

    def __post_init__(self) -> None:
        if self.step == 0:
            raise ValueError("a sequence needs a step")
        if self.next is None:
            self.next = self.start

    @property
    def current(self) -> int:
        """CURRVAL: the value given last."""
        if self.next == self.start:
            raise ValueError("a sequence has no current value before its first number")
        return self.next - self.step

    def numbered(self, df: DataFrame, column: str, order: list[str | Column] | None = None) -> DataFrame:
        """``df`` with the sequence's next values; rows are numbered in the order of ``order``, else in any order.

        The numbers are fixed with this call: the rows are written, so reading the result again gives the same ones.
        """
        out = in_order(df, order, "sequence")
        first = self.next
        self.next += self.step * out.total
        return out.numbered(column, first, self.step)
