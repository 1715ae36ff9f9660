"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows fetched and written at a time over JDBC.
FETCH_ROWS, BATCH_ROWS = 5000, 1000


def write_tsv(df: DataFrame, path: str) -> None:
    r"""Tab-separated text with ``\N`` for null and backslash escapes, as bulk loaders take it."""

    def cell(f: T.StructField):
        c = F.col(f"`{f.name}`").cast("string")
        for raw, out in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            c = F.replace(c, F.lit(raw), F.lit(out))
        return F.coalesce(c, F.lit("\\N"))

    df.select(F.concat_ws("\t", *[cell(f) for f in df.schema]).alias("value")).write.mode("overwrite").text(path)


def _plain(part: Column) -> Column:
    for raw, out in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
        part = F.replace(part, F.lit(raw), F.lit(out))
    return part


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows that ``write_tsv`` wrote, in the types of ``schema``."""
    parts = F.split("value", "\t", -1)

    def back(i: int, f: T.StructField):
        c = parts[i]
        # between two escaped backslashes every backslash begins another escape
        text = F.array_join(F.transform(F.split(c, r"\\\\", -1), _plain), "\\")
        return F.when(c != "\\N", text).cast(f.dataType).alias(f.name)

    return spark.read.text(path).select(*[back(i, f) for i, f in enumerate(schema)])


def read_jdbc(spark: SparkSession, url: str, table: str, user: str, password: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1) -> DataFrame:
    """A database table, in parallel ranges of a numeric column where one is named."""
    options = {"url": url, "dbtable": table, "user": user, "password": password, "fetchsize": str(FETCH_ROWS)}
    if column and bounds:
        options |= {"partitionColumn": column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**options).load()


def write_jdbc(df: DataFrame, url: str, table: str, user: str, password: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, user=user, password=password, batchsize=str(BATCH_ROWS)).mode("append").save()
