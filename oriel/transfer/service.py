"""Transfers of many tables, each by itself: one that fails does not stop the others."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .planner import analyse, plan


@dataclass
class Progress:
    tables: int
    rows_expected: int = 0
    tables_done: int = 0
    rows_done: int = 0
    began: float = field(default_factory=time.time)

    @property
    def percent(self) -> float:
        if self.rows_expected:
            return min(100.0, 100.0 * self.rows_done / self.rows_expected)
        return 100.0 * self.tables_done / self.tables if self.tables else 100.0

    @property
    def rate(self) -> float:
        return self.rows_done / max(time.time() - self.began, 1e-9)

    @property
    def seconds_left(self) -> float | None:
        return None if not self.rows_done or not self.rows_expected else max(0.0, (self.rows_expected - self.rows_done) / self.rate)


@dataclass(frozen=True)
class Result:
    table: str
    rows: int
    seconds: float
    error: str = ""
    analysis: str = ""


@dataclass
class Results:
    tables: list[Result] = field(default_factory=list)

    @property
    def failed(self) -> list[Result]:
        return [r for r in self.tables if r.error]

    @property
    def rows(self) -> int:
        return sum(r.rows for r in self.tables)

    def __str__(self) -> str:
        return f"{len(self.tables) - len(self.failed)} of {len(self.tables)} tables, {self.rows} rows"


def transfer(tables: dict[str, DataFrame], sink: Callable[[str, DataFrame], None], expected: dict[str, int] | None = None, at_once: int = 4) -> tuple[Results, Progress]:
    """Write each table by ``sink(name, frame)``, up to ``at_once`` of them at a time, so that small tables do not wait for large ones.

    Rows are counted as they pass, without another scan.  A table's failure is its result; results stand in the order of ``tables``.
    """
    progress, lock = Progress(len(tables), sum((expected or {}).values())), threading.Lock()

    def one(name: str, df: DataFrame) -> Result:
        began = time.time()
        try:
            seen = Observation()
            sink(name, plan(df).observe(seen, F.count(F.lit(1)).alias("n")))
            out = Result(name, seen.get["n"], time.time() - began, "", str(analyse(df.schema)))
        except Exception as e:  # noqa: BLE001
            out = Result(name, 0, time.time() - began, f"{type(e).__name__}: {e}"[:500])
        with lock:
            progress.rows_done += out.rows
            progress.tables_done += 1
        return out

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        return Results(list(pool.map(one, tables.keys(), tables.values()))), progress
