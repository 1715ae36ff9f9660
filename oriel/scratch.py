"""Tables that are written once and read again: where they lie, and how they go."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a new local one where it is unset and Spark runs on one machine."""
    sc = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="oriel-"))
    return sc.getCheckpointDir().rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _quietly(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder, which goes when the driver ends.

    A written table cuts lineage, survives lost executors and gives every later
    job the same rows in the same partitions, which a plan that is run twice does not.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/oriel-{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_quietly, spark, path)
    return spark.read.schema(df.schema).parquet(path)
