"""Database tables over JDBC, driven by the database's own dictionary.

Reading: the dictionary names the columns and the key; the key's quantiles, taken from a scan of the key alone, give ranges of
equal numbers of rows however the keys lie, and each range is one task's query.  Writing: rows get numbers and are staged, whatever
tasks are run again; one statement in one transaction moves each number once and records the load, so a load that is repeated does nothing.
"""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import in_order
from .tables import BATCH_ROWS, FETCH_ROWS

#: Loads that are done, by their id.
LOADS = "ORIEL_LOADS"
ROW = "ORIEL_ROW"


@dataclass(frozen=True)
class Database:
    url: str
    user: str = ""
    password: str = ""
    driver: str | None = None

    @property
    def options(self) -> dict[str, str]:
        return {"url": self.url, **({"user": self.user, "password": self.password} if self.user else {}), **({"driver": self.driver} if self.driver else {})}

    @contextmanager
    def connected(self, spark: SparkSession) -> Iterator[Any]:
        """A connection of the driver's JVM, for statements and the dictionary; rows never pass here."""
        jvm = spark.sparkContext._jvm
        if self.driver:
            jvm.java.lang.Class.forName(self.driver)
        c = jvm.java.sql.DriverManager.getConnection(self.url, self.user, self.password) if self.user else jvm.java.sql.DriverManager.getConnection(self.url)
        try:
            yield c
        finally:
            c.close()

    def run(self, spark: SparkSession, *statements: str) -> list[int]:
        """Statements in one transaction, and how many rows each changed."""
        with self.connected(spark) as c:
            c.setAutoCommit(False)
            try:
                s = c.createStatement()
                out = [s.executeUpdate(x) for x in statements]
                c.commit()
                return out
            except Exception:
                c.rollback()
                raise


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    type: str
    size: int
    digits: int | None
    nullable: bool

    @property
    def ddl(self) -> str:
        up = self.type.upper()
        if re.search("CHAR|RAW|BINARY", up) and "(" not in up and "LONG" not in up:
            return f"{self.type}({self.size})"
        if up in ("DECIMAL", "NUMERIC", "NUMBER") and self.size:
            return f"{self.type}({self.size}, {max(self.digits or 0, 0)})"
        return self.type


@dataclass(frozen=True)
class TableInfo:
    schema: str | None
    name: str
    columns: list[ColumnInfo]
    #: Columns of the primary key in their order.
    key: list[str]

    @property
    def full(self) -> str:
        return f'"{self.schema}"."{self.name}"' if self.schema else f'"{self.name}"'


def _all(results: Any, *names: str) -> Iterator[tuple[Any, ...]]:
    try:
        while results.next():
            yield tuple(results.getObject(n) for n in names)
    finally:
        results.close()


def tables(spark: SparkSession, db: Database, schema: str | None = None) -> list[str]:
    """Names of the tables of a schema."""
    with db.connected(spark) as c:
        kinds = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.String, 1)
        kinds[0] = "TABLE"
        return sorted(n for (n,) in _all(c.getMetaData().getTables(None, schema, "%", kinds), "TABLE_NAME"))


def table_info(spark: SparkSession, db: Database, table: str, schema: str | None = None) -> TableInfo:
    """What the dictionary says of a table; an unknown one raises."""
    with db.connected(spark) as c:
        meta = c.getMetaData()
        columns = [(place, ColumnInfo(n, k, int(size or 0), digits, null != 0)) for place, n, k, size, digits, null in _all(meta.getColumns(None, schema, table, "%"), "ORDINAL_POSITION", "COLUMN_NAME", "TYPE_NAME", "COLUMN_SIZE", "DECIMAL_DIGITS", "NULLABLE")]
        if not columns:
            raise LookupError(f"no table {table}")
        key = sorted(_all(meta.getPrimaryKeys(None, schema, table), "KEY_SEQ", "COLUMN_NAME"))
        return TableInfo(schema, table, [x for _, x in sorted(columns, key=lambda x: x[0])], [n for _, n in key])


def literal(value: Any) -> str:
    """A value as JDBC writes it for any database."""
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, datetime.datetime):
        return f"{{ts '{value:%Y-%m-%d %H:%M:%S.%f}'}}"
    if isinstance(value, datetime.date):
        return f"{{d '{value:%Y-%m-%d}'}}"
    if isinstance(value, (int, Decimal)):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}" if "e" in repr(value) else f"{value!r}e0"
    return "'" + str(value).replace("'", "''") + "'"


def split_points(keys: DataFrame, column: str, ranges: int) -> list[Any]:
    """At most ``ranges`` - 1 values that cut the column into equal numbers of rows; a value that many rows share is not cut."""
    kind = keys.schema[column].dataType
    shares = [i / ranges for i in range(1, ranges)]
    if not shares:
        return []
    if isinstance(kind, T.NumericType):
        found = keys.agg(F.percentile_approx(column, shares, 100_000)).first()[0] or []
    else:  # texts and times have no percentiles, but an order
        ordered = in_order(keys.where(F.col(column).isNotNull()), [column], "keys")
        wanted = sorted({min(int(s * ordered.total), ordered.total - 1) for s in shares}) if ordered.total else []
        placed = ordered.numbered("__place", 0)
        found = [r[0] for r in placed.where(F.col("__place").isin(wanted)).select(column).collect()] if wanted else []
    return sorted(set(found))


def predicates(column: str, points: list[Any]) -> list[str]:
    """Conditions of the ranges: each row meets exactly one, a null key the first."""
    q = f'"{column}"'
    if not points:
        return ["1 = 1"]
    out = [f"{q} < {literal(points[0])} OR {q} IS NULL"]
    out += [f"{q} >= {literal(a)} AND {q} < {literal(b)}" for a, b in zip(points, points[1:])]
    return [*out, f"{q} >= {literal(points[-1])}"]


def read(spark: SparkSession, db: Database, table: str, schema: str | None = None, ranges: int = 8, key: str | None = None) -> DataFrame:
    """A table in ranges of equal numbers of rows by the first column of its key; one without a key is read by one query."""
    info = table_info(spark, db, table, schema)
    column = key or (info.key[0] if info.key else None)
    known = {c.name: c for c in info.columns}
    if column is not None and column not in known:
        raise LookupError(f"{table} has no column {column}")
    options = db.options | {"fetchsize": str(FETCH_ROWS)}
    whole = spark.read.format("jdbc").options(**options, dbtable=info.full).load()
    if column is None or ranges < 2:
        return whole
    cuts = split_points(whole.select(column), column, ranges)  # the database sends the key column alone
    return spark.read.jdbc(db.url, info.full, predicates=predicates(column, cuts), properties={k: v for k, v in options.items() if k != "url"})


def _stage(rows: DataFrame, db: Database, stage: str) -> None:
    rows.write.format("jdbc").options(**db.options, dbtable=f'"{stage}"', batchsize=str(BATCH_ROWS), isolationLevel="READ_COMMITTED").mode("append").save()


def load(df: DataFrame, db: Database, table: str, load_id: str, schema: str | None = None) -> int:
    """Append rows to a table once for each ``load_id``; how many were added, 0 if that load was done before.

    Rows are written with numbers first, so a task that runs again stages the same numbers, and of what it staged twice one copy is
    moved.  Columns are matched by name without regard to case; those that ``df`` does not have stay null.  A load that fails leaves the table as it was.
    """
    spark = df.sparkSession
    info = table_info(spark, db, table, schema)
    names = {c.name.upper(): c.name for c in info.columns}
    if unknown := {c for c in df.columns if c.upper() not in names}:
        raise LookupError(f"{table} has no column {', '.join(sorted(unknown))}")
    if LOADS not in tables(spark, db):
        db.run(spark, f'CREATE TABLE "{LOADS}" (LOAD_ID VARCHAR(200) NOT NULL PRIMARY KEY, ROWS_LOADED DECIMAL(18, 0))')
    done = spark.read.format("jdbc").options(**db.options, dbtable=f'"{LOADS}"').load().where(F.col("LOAD_ID") == load_id)
    if done.limit(1).count():
        return 0
    ordered = in_order(df.select(*[F.col(f"`{c}`").alias(names[c.upper()]) for c in df.columns]), None, "load")
    rows = ordered.numbered(ROW, 0)
    own = [c for c in info.columns if c.name in rows.columns]
    stage = f"ORIEL_STAGE_{uuid.uuid4().hex[:12].upper()}"
    columns = ", ".join(f'"{c.name}" {c.ddl}' for c in own)
    db.run(spark, f'CREATE TABLE "{stage}" ("{ROW}" DECIMAL(18, 0) NOT NULL, {columns})')
    try:
        _stage(rows, db, stage)
        listed = ", ".join(f'"{c.name}"' for c in own)
        once = f'SELECT DISTINCT "{ROW}", {listed} FROM "{stage}"'
        moved = db.run(spark, f"INSERT INTO {info.full} ({listed}) SELECT {listed} FROM ({once}) x", f"INSERT INTO \"{LOADS}\" VALUES ({literal(load_id)}, {ordered.total})")
        return moved[0]
    finally:
        db.run(spark, f'DROP TABLE "{stage}"')
