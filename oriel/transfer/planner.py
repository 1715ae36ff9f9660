"""What a table needs on its way out, decided for each column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..semi.values import anydata, object_json

#: Planning rates in rows a second, by what the table's columns are.
RATES = {"simple": 10_000, "complex": 1_000, "mixed": 5_000}
LEAST_SECONDS, EMPTY_SECONDS = 1.0, 0.1
# fixed values: rows to expect by parts of a table's name, where nothing else is known
NAME_ROWS = (("CONFIG", 100), ("LOOKUP", 100), ("LOG", 100_000), ("HIST", 100_000), ("AUDIT", 100_000), ("TRANS", 10_000), ("ORDER", 10_000), ("USER", 5_000), ("CUSTOMER", 5_000))
OTHER_ROWS, COMPLEX_ROWS = 1_000, 2_000


def kind_of(t: T.DataType) -> str:
    """simple, object (a struct), variant, or complex (arrays and maps)."""
    if isinstance(t, T.StructType):
        return "object"
    if isinstance(t, T.VariantType):
        return "variant"
    return "complex" if isinstance(t, (T.ArrayType, T.MapType)) else "simple"


@dataclass(frozen=True)
class Analysis:
    simple: int
    object: int
    variant: int
    complex: int

    @property
    def shape(self) -> str:
        other = self.object + self.variant + self.complex
        return "simple" if not other else "complex" if not self.simple else "mixed"

    def __str__(self) -> str:
        return f"{self.simple} simple, {self.object} object, {self.variant} variant, {self.complex} complex columns"


def analyse(schema: T.StructType) -> Analysis:
    kinds = [kind_of(f.dataType) for f in schema]
    return Analysis(*(kinds.count(k) for k in ("simple", "object", "variant", "complex")))


def seconds(schema: T.StructType, rows: int) -> float:
    """Time to plan with for a transfer."""
    return EMPTY_SECONDS if rows == 0 else max(LEAST_SECONDS, rows / RATES[analyse(schema).shape])


def expected_rows(name: str, schema: T.StructType | None = None) -> int:
    up = name.upper()
    for part, n in NAME_ROWS:
        if re.search(part, up):
            return n
    return COMPLEX_ROWS if schema is not None and analyse(schema).shape != "simple" else OTHER_ROWS


def converted(f: T.StructField) -> Column:
    """A column as its target takes it: structs and collections as JSON, binary as hex, times and intervals as text."""
    c = F.col(f"`{f.name}`")
    t = f.dataType
    if isinstance(t, T.StructType):
        out = object_json(c, t)
    elif isinstance(t, T.VariantType):
        out = F.to_json(c)
    elif isinstance(t, (T.ArrayType, T.MapType)):
        out = F.to_json(c)
    elif isinstance(t, T.BinaryType):
        out = F.when(c.isNotNull(), F.concat(F.lit("\\x"), F.lower(F.hex(c))))
    elif isinstance(t, (T.TimestampType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
        out = c.cast("string")
    else:
        out = c
    return out.alias(f.name)


def plan(df: DataFrame) -> DataFrame:
    """A table ready to be written; simple columns pass as they are."""
    return df.select(*[converted(f) for f in df.schema])


def tagged(df: DataFrame, column: str) -> Column:
    """A column as a tagged generic value."""
    f = df.schema[column]
    return anydata(F.col(f"`{column}`"), f.dataType, column, f.metadata.get("oracle_type") if f.metadata else None)
