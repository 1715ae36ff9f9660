"""A registered query: Oracle text for the engine, and what DuckDB says instead."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..catalog import CollectionType
from ..engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class Registered:
    name: str
    oracle: str
    duck: str | None  # None: the same text
    rows_only: bool = False

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir).sql(self.oracle)


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    out = Engine.over(spark, sf_dir, *TABLES)
    from pyspark.sql import types as T

    out.catalog.add_type("t_numbers", CollectionType("T_NUMBERS", T.LongType()))
    out.catalog.add_type("t_small", CollectionType("T_SMALL", T.LongType(), limit=10))
    out.catalog.add_loader("v_big_orders", lambda: out.sql("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000"))
    return out


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str, duck: str | None = "", rows_only: bool = False) -> None:
        """``duck`` is DuckDB's text; left out, DuckDB takes the Oracle text."""
        r = Registered(name, oracle, duck or None, rows_only)
        self.queries[name] = r.run
        if not rows_only:
            self.oracles[name] = duck or oracle

    def made(self, name: str, duck: str | None = None):
        """Register a function (spark, sf_dir) -> DataFrame."""

        def keep(f: Callable[[SparkSession, str], DataFrame]):
            self.queries[name] = f
            if duck:
                self.oracles[name] = duck
            return f

        return keep
