"""Oracle types as Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Default of NUMBER without precision.
NUMBER = T.DecimalType(38, 10)

# fixed values: type names by the Spark type they map to
_GROUPS: tuple[tuple[str, T.DataType], ...] = (
    ("VARCHAR2 NVARCHAR2 CHAR NCHAR CHARACTER VARCHAR STRING LONG CLOB NCLOB BFILE ROWID UROWID MLSLABEL XMLTYPE HTTPURITYPE DBURITYPE XDBURITYPE SDO_GEOMETRY TIMEZONE_REGION TIMEZONE_ABBR", T.StringType()),
    ("RAW BLOB", T.BinaryType()),
    ("BINARY_INTEGER PLS_INTEGER NATURAL NATURALN POSITIVE POSITIVEN SIMPLE_INTEGER INTEGER INT YEAR MONTH DAY HOUR MINUTE SECOND TIMEZONE_HOUR TIMEZONE_MINUTE", T.IntegerType()),
    ("SIGNTYPE SMALLINT", T.ShortType()),
    ("BINARY_FLOAT FLOAT REAL", T.FloatType()),
    ("BINARY_DOUBLE DOUBLE", T.DoubleType()),
    ("BOOLEAN", T.BooleanType()),
    ("DATE", T.TimestampNTZType()),
    ("ANYDATA JSON", T.VariantType()),
)
SIMPLE: dict[str, T.DataType] = {name: kind for names, kind in _GROUPS for name in names.split()}
DECIMALS = frozenset({"NUMBER", "NUMERIC", "DEC", "DECIMAL"})

_HEADERS = T.MapType(T.StringType(), T.StringType())
AQ_TYPES: dict[str, T.StructType] = {
    "AQ$_JMS_TEXT_MESSAGE": T.StructType().add("message_type", "string").add("text_content", "string").add("headers", _HEADERS).add("properties", _HEADERS).add("metadata", _HEADERS),
    "AQ$_SIG_PROP": T.StructType()
    .add("signature_type", "string")
    .add("signature_properties", T.StructType().add("algorithm", "string").add("digest", "string").add("signature", "string"))
    .add("metadata", T.StructType().add("timestamp", "string").add("signer", "string").add("validation_status", "string"))
    .add("technical_info", _HEADERS),
    "AQ$_RECIPIENTS": T.StructType()
    .add("recipients_type", "string")
    .add("recipients", T.ArrayType(T.StructType().add("address", "string").add("name", "string").add("delivery_status", "string").add("routing_info", "string").add("priority", "integer").add("index", "integer")))
    .add("metadata", T.StructType().add("total_count", "integer").add("delivery_mode", "string"))
    .add("technical_info", _HEADERS),
}


class UnknownType(ValueError):
    """A name that is neither a built-in type nor a type of the catalog."""


def spark_type(text: str, lookup=None) -> T.DataType:
    """The Spark type of an Oracle type; ``lookup`` resolves the catalog's own types."""
    name = re.sub(r"\s+", " ", text.strip())
    up = name.upper()
    if up.startswith("TIMESTAMP"):
        return T.TimestampType() if "TIME ZONE" in up else T.TimestampNTZType()
    if up.startswith("INTERVAL"):
        return T.YearMonthIntervalType() if "YEAR" in up else T.DayTimeIntervalType()
    if up in ("DOUBLE PRECISION",):
        return T.DoubleType()
    if up.startswith("LONG RAW"):
        return T.BinaryType()
    m = re.fullmatch(r"([\w$.#]+)\s*(?:\(\s*([\d*]+)(?:\s*,\s*(-?\d+))?[^)]*\))?", up)
    if m:
        base, p, s = m.groups()
        base = base.removeprefix("SYS.")
        if base in DECIMALS:
            if p is None:
                return NUMBER
            precision = 38 if p == "*" else min(int(p), 38)
            return T.DecimalType(precision, max(0, min(int(s or 0), precision)))
        if base in SIMPLE:
            return SIMPLE[base]
        if base in AQ_TYPES:
            return AQ_TYPES[base]
    if lookup is not None and (found := lookup(name)) is not None:
        return found
    raise UnknownType(text)


def field(name: str, text: str, nullable: bool = True, lookup=None) -> T.StructField:
    """A column; what the Spark type cannot hold (length, the Oracle name) is kept as metadata."""
    m = re.search(r"CHAR2?\s*\(\s*(\d+)", text, re.I)
    return T.StructField(name, spark_type(text, lookup), nullable, {"oracle_type": text.strip()} | ({"length": int(m[1])} if m else {}))


DEFAULTS = {"SYSTIMESTAMP": "current_timestamp()", "SYSDATE": "localtimestamp()", "USER": "current_user()", "NULL": "NULL"}


def default_value(text: str | None) -> str | None:
    """A column default as a Spark expression: strings, numbers and the known keywords; else None."""
    text = (text or "").strip()
    if re.fullmatch(r"'(?:[^']|'')*'|-?\d+(\.\d+)?", text):
        return text
    return DEFAULTS.get(text.upper())
