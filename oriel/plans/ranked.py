"""Sequence values, row numbers and shares of rows in a whole order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import in_order, key
from .base import Registry, engine

R = Registry()
q, made = R.add, R.made

q("rownum_ordered", "SELECT ROWNUM AS rn, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey)", "SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn, o_orderkey FROM orders")
q("rownum_page", "SELECT rn, c_custkey FROM (SELECT x.*, ROWNUM AS rn FROM (SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey) x WHERE ROWNUM <= 60) WHERE rn > 40",
  "SELECT rn, c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn BETWEEN 41 AND 60")
q("rownum_aggregate", "SELECT o_orderstatus, COUNT(*) AS n, COUNT(DISTINCT rn) AS d FROM (SELECT o_orderstatus, ROWNUM AS rn FROM orders) GROUP BY o_orderstatus", "SELECT o_orderstatus, COUNT(*) AS n, COUNT(*) AS d FROM orders GROUP BY o_orderstatus")
q("limit_percent_ties", "SELECT n_regionkey, n_name FROM nation ORDER BY n_regionkey FETCH FIRST 10 PERCENT ROWS WITH TIES", "SELECT n_regionkey, n_name FROM nation QUALIFY RANK() OVER (ORDER BY n_regionkey) <= ceil(COUNT(*) OVER () * 10 / 100.0)")
q("limit_percent_offset", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey OFFSET 100 ROWS FETCH NEXT 12.5 PERCENT ROWS ONLY",
  "SELECT o_orderkey, o_custkey FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY o_custkey DESC, o_orderkey) AS k, COUNT(*) OVER () AS n FROM orders) WHERE k > 100 AND k <= 100 + ceil(n * 12.5 / 100.0)")
q("limit_percent_grouped", "SELECT o_custkey, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey ORDER BY s DESC, o_custkey FETCH FIRST 5 PERCENT ROWS ONLY",
  "SELECT o_custkey, s FROM (SELECT o_custkey, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey) QUALIFY ROW_NUMBER() OVER (ORDER BY s DESC, o_custkey) <= ceil(COUNT(*) OVER () * 5 / 100.0)")
q("limit_percent_set", "SELECT c_nationkey AS k FROM customer UNION SELECT s_suppkey FROM supplier ORDER BY k FETCH FIRST 20 PERCENT ROWS ONLY",
  "SELECT k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_suppkey FROM supplier) QUALIFY ROW_NUMBER() OVER (ORDER BY k) <= ceil(COUNT(*) OVER () * 20 / 100.0)")


@made("seq_nextval_sql", "SELECT o_orderkey, 500 - 3 * (row_number() OVER (ORDER BY o_orderkey) - 1) AS id, 500 - 3 * (row_number() OVER (ORDER BY o_orderkey) - 1) AS again FROM orders WHERE o_orderstatus = 'F'")
def seq_nextval_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.catalog.add_sequence("down", 500, -3)
    return e.sql("SELECT o.o_orderkey, down.NEXTVAL AS id, down.CURRVAL AS again FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey) o")


@made("seq_insert_select", "SELECT COUNT(*) AS n, COUNT(*) AS d, 0 AS low, 1000 + 2 * (SELECT COUNT(*) FROM customer) AS high FROM (SELECT r_regionkey FROM region UNION ALL SELECT c_custkey FROM customer UNION ALL SELECT 1)")
def seq_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row by VALUES and one for each customer; every row has a number of its own."""
    e = engine(spark, sf_dir)
    e.catalog.add_sequence("ids", 1000, 2)
    e.sql("INSERT INTO region (r_regionkey, r_name) VALUES (ids.NEXTVAL, 'R' || ids.CURRVAL)")
    e.sql("INSERT INTO region (r_regionkey, r_name) SELECT ids.NEXTVAL, c_name FROM customer")
    return e.sql("SELECT COUNT(*) AS n, COUNT(DISTINCT r_regionkey) AS d, MIN(r_regionkey) AS low, MAX(r_regionkey) AS high FROM region")


@made("rank_whole_order", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) - 1 AS place FROM lineitem")
def rank_whole_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_shipdate")
    return in_order(rows, [key(F.col("l_shipdate"), descending=True), "l_orderkey", "l_linenumber"]).numbered("place", 0).drop("l_shipdate")
