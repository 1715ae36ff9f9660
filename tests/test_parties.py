"""Scores and labels of parties are those of DuckDB, also for balances that are no amounts of money."""

import math
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oriel.plans.nested import rounded

ODD = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, -0.001, 0.0025, 1.005, -1.005, 1.115, -500.0, -500.001, 1e14 + 0.125, 12345678901234.565, 2.0**52 + 1, 1e17 + 12345, 1.2345678901234567e20, 1.7e308]


def test_scores_round_and_print_as_sql_does(spark, tmp_path):
    r = random.Random(4)
    balances = ODD[:-1] + [r.randrange(-10**6, 10**7) / 1000 for _ in range(3000)] + [round(r.uniform(-1000, 10000), 2) for _ in range(500)]
    n = len(balances)
    pq.write_table(pa.table({"c_custkey": range(2 * n), "c_name": [None if i % 50 == 7 else f"C{i}" for i in range(2 * n)], "c_acctbal": pa.array(balances * 2, pa.float64()), "c_mktsegment": ["BUILDING"] * n + ["MACHINERY"] * n}), tmp_path / "customer.parquet")
    pq.write_table(pa.table({"s_suppkey": range(n), "s_name": [f"S{i}" for i in range(n)], "s_nationkey": pa.array([i % 25 for i in range(n)], pa.int32()), "s_acctbal": pa.array(balances, pa.float64())}), tmp_path / "supplier.parquet")
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = entry.queries()["object_methods"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()['object_methods']})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_a_product_that_overflows_is_left_alone(spark):
    out = spark.createDataFrame([(b,) for b in ODD], "b double").select("b", rounded(F.col("b")).alias("r")).collect()
    con = duckdb.connect()
    assert [repr(x.r) for x in out] == [repr(con.execute("SELECT ROUND(CAST(? AS DOUBLE), 2)", [x.b]).fetchone()[0]) for x in out]
