"""Connected components of a link table, by alternating large-star and small-star steps.

All state stays in Spark; each step is two aggregations over the links, and
the number of steps grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _mins(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.join(_mins(both), "u").where("v > u")
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    mins = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(mins, "u")
    return (
        near.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(mins.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def components(ws: Workspace, links: DataFrame, label: str = "cc") -> DataFrame:
    """(node, root) for every node that has a link; the root is the smallest node reachable.

    ``links`` has columns u, v of one ordered type.  Nulls and self links are
    ignored; repeated links are harmless; an empty table gives an empty result.
    """
    now = ws.keep(links.where("u <> v").select("u", "v").distinct(), f"{label}-0")
    state, step = None, 0
    while True:
        seen = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
        ).first()
        if tuple(seen) == state or not seen[0]:
            break
        state = tuple(seen)
        step += 1
        now = ws.keep(_small_star(_large_star(now)), f"{label}-{step}")
        ws.drop(f"{label}-{step - 1}")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
