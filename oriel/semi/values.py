"""Generic values (ANYDATA) and object types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Oracle's type tags by Spark type.
TAGS: tuple[tuple[type, str], ...] = (
    (T.StringType, "VARCHAR2"), (T.BooleanType, "NUMBER"), (T.NumericType, "NUMBER"), (T.DateType, "DATE"), (T.TimestampNTZType, "TIMESTAMP"),
    (T.TimestampType, "TIMESTAMP_TZ"), (T.BinaryType, "BLOB"), (T.StructType, "OBJECT"), (T.ArrayType, "TABLE"),
)


def tag_of(kind: T.DataType) -> str:
    return next((tag for k, tag in TAGS if isinstance(kind, k)), "UNKNOWN")


def anydata(column: Column, kind: T.DataType, name: str, original: str | None = None) -> Column:
    """A value as ``{type, value, metadata}`` JSON; null stays null; objects number their attributes."""
    tag = tag_of(kind)
    if tag == "UNKNOWN":
        error = F.to_json(F.struct(F.lit("ERROR").alias("type"), F.lit("UnsupportedType").alias("error_type"), F.lit(f"no tag for {kind.simpleString()}").alias("error_message")))
        return F.when(column.isNotNull(), error)
    if isinstance(kind, T.StructType):
        value = F.struct(*[column.getField(f.name).alias(f"attr_{i + 1}") for i, f in enumerate(kind.fields)])
    elif isinstance(kind, T.BinaryType):
        value = F.base64(column)
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        value = column.cast("string")
    else:
        value = column
    meta = F.struct(F.lit(original or tag).alias("original_type"), F.lit(name).alias("column_name"), F.lit("direct").alias("conversion_method"))
    return F.when(column.isNotNull(), F.to_json(F.struct(F.lit(tag).alias("type"), value.alias("value"), meta.alias("metadata"))))


def anydata_value(column: Column) -> Column:
    """The value within such JSON, as text."""
    return F.get_json_object(column, "$.value")


def object_json(column: Column, kind: T.StructType) -> Column:
    """An object as JSON with lower-case keys; whole numbers have no fraction, others are doubles."""
    fields = []
    for f in kind.fields:
        v = column.getField(f.name)
        if isinstance(f.dataType, T.DecimalType):
            v = v.cast("long") if f.dataType.scale == 0 else v.cast("double")
        fields.append(v.alias(f.name.lower()))
    return F.when(column.isNotNull(), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def object_tuple(column: Column, kind: T.StructType) -> Column:
    """An object as a tuple literal: text quoted and escaped, a null an empty slot."""
    parts = []
    for f in kind.fields:
        v = column.getField(f.name)
        if isinstance(f.dataType, T.NumericType):
            text = v.cast("string")
        else:
            text = F.concat(F.lit('"'), F.replace(F.replace(v.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        parts.append(F.coalesce(text, F.lit("")))
    return F.when(column.isNotNull(), F.concat(F.lit("("), F.concat_ws(",", *parts), F.lit(")")))
