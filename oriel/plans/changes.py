"""Change sets, versions of tables and triggers that read them."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import ChangeSet
from ..operators.triggers import Lookup, RowTrigger, StatementTrigger
from ..operators.versions import TriggeredView, VersionedTable
from .base import Registry, engine

R = Registry()
made = R.made


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# RETURNING


@made("dml_returning", "SELECT o_orderkey, o_totalprice AS was, o_totalprice * 2 AS now, o_totalprice * 2 - o_totalprice AS more FROM orders WHERE o_orderstatus = 'F'")
def dml_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("UPDATE orders o SET o_totalprice = o_totalprice * 2 WHERE o_orderstatus = 'F' RETURNING o.o_orderkey, old.o_totalprice AS was, o_totalprice AS now, new.o_totalprice - old.o_totalprice AS more")


@made("dml_returning_delete", "SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS v FROM lineitem WHERE l_quantity > 45")
def dml_returning_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("DELETE FROM lineitem WHERE l_quantity > 45 RETURNING l_orderkey, l_linenumber, l_quantity * l_extendedprice AS v")


@made("dml_returning_insert", "SELECT 100 + row_number() OVER (ORDER BY c_custkey) - 1 AS id, c_name AS r_name, true AS fresh FROM customer WHERE c_acctbal < 0")
def dml_returning_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.catalog.add_sequence("ids", 100)
    return e.sql("INSERT INTO region (r_regionkey, r_name) SELECT ids.NEXTVAL, c.c_name FROM (SELECT c_name FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey) c RETURNING r_regionkey AS id, r_name, old IS NULL AS fresh")


MERGE = """MERGE INTO customer c USING (SELECT o_custkey, SUM(o_totalprice) AS s FROM orders WHERE o_orderkey < 4000 GROUP BY o_custkey UNION ALL SELECT 1000000 + n_nationkey, n_nationkey FROM nation) o
ON (c.c_custkey = o.o_custkey) WHEN MATCHED THEN UPDATE SET c_acctbal = c_acctbal + o.s DELETE WHERE c_acctbal > 300000
WHEN NOT MATCHED THEN INSERT (c_custkey, c_name, c_acctbal) VALUES (o.o_custkey, 'new', o.s)"""
MERGED = """WITH o AS (SELECT o_custkey, SUM(o_totalprice) AS s FROM orders WHERE o_orderkey < 4000 GROUP BY o_custkey UNION ALL SELECT 1000000 + n_nationkey, n_nationkey FROM nation),
m AS (SELECT o.o_custkey AS k, c.c_acctbal AS was, CASE WHEN c.c_custkey IS NULL THEN o.s ELSE c.c_acctbal + o.s END AS now, CASE WHEN c.c_custkey IS NULL THEN 'INSERT' WHEN c.c_acctbal + o.s > 300000 THEN 'DELETE' ELSE 'UPDATE' END AS op
  FROM o LEFT JOIN customer c ON c.c_custkey = o.o_custkey)"""


@made("dml_merge_changes", f"{MERGED} SELECT op, COUNT(*) AS n, ROUND(SUM(was), 2) AS was, ROUND(SUM(CASE WHEN op = 'DELETE' THEN was ELSE now END), 2) AS now FROM m GROUP BY op")
def dml_merge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of a MERGE by what it did; those of deleted rows are as they were."""
    done = engine(spark, sf_dir).change(MERGE)
    return done.image().selectExpr("CASE WHEN old IS NULL THEN 'INSERT' WHEN new IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op", "old.c_acctbal AS was", "c_acctbal AS now").groupBy("op").agg({"op": "count", "was": "sum", "now": "sum"}).selectExpr("op", "`count(op)` AS n", "round(`sum(was)`, 2) AS was", "round(`sum(now)`, 2) AS now")


@made("dml_merge_snapshot", f"{MERGED}, r AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT k FROM m) UNION ALL SELECT k, now FROM m WHERE op <> 'DELETE') SELECT c_custkey, ROUND(c_acctbal, 2) AS b FROM r")
def dml_merge_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.change(MERGE)
    return e.sql("SELECT c_custkey, ROUND(c_acctbal, 2) AS b FROM customer")


# versions


def changed_orders(spark: SparkSession, sf_dir: str):
    """Three commits on orders: 1 doubles the prices of F, 2 deletes P, 3 adds each customer's first order again."""
    e = engine(spark, sf_dir)
    e.versioned("orders")
    e.sql("UPDATE orders SET o_totalprice = o_totalprice * 2 WHERE o_orderstatus = 'F'")
    e.sql("DELETE FROM orders WHERE o_orderstatus = 'P'")
    e.sql("INSERT INTO orders (o_orderkey, o_custkey) SELECT -MIN(o_orderkey), o_custkey FROM orders GROUP BY o_custkey")
    return e


@made("scan_as_of", """SELECT a.o_orderkey, a.o_totalprice AS before, CASE WHEN a.o_orderstatus = 'F' THEN a.o_totalprice * 2 ELSE a.o_totalprice END AS after, a.o_orderstatus = 'P' AS gone FROM orders a""")
def scan_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = changed_orders(spark, sf_dir)
    return e.sql("SELECT a.o_orderkey, a.o_totalprice AS before, b.o_totalprice AS after, c.o_orderkey IS NULL AS gone FROM orders AS OF SCN 0 a JOIN orders AS OF SCN 1 b ON b.o_orderkey = a.o_orderkey LEFT JOIN orders AS OF SCN 2 c ON c.o_orderkey = a.o_orderkey")


@made("scan_as_of_timestamp", "SELECT o_orderstatus, COUNT(*) AS n, ROUND(SUM(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END * o_totalprice), 2) AS s FROM orders GROUP BY o_orderstatus")
def scan_as_of_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = changed_orders(spark, sf_dir)
    moment = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=e.versioned("orders").log[2].at - 1)
    return e.sql("SELECT o_orderstatus, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s FROM orders AS OF TIMESTAMP :t GROUP BY o_orderstatus", {"t": moment})


@made("scan_versions_between", """WITH k AS (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey)
SELECT 'none' AS op, 1 AS ended, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'none', 2, COUNT(*) FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'none', 0, COUNT(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'P')
UNION ALL SELECT 'U', 0, COUNT(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'D', 0, COUNT(*) FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'I', 0, COUNT(*) FROM k""")
def scan_versions_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = changed_orders(spark, sf_dir)
    return e.sql("SELECT NVL(versions_operation, 'none') AS op, CAST(NVL(versions_endscn, 0) AS INTEGER) AS ended, COUNT(*) AS n FROM orders VERSIONS BETWEEN SCN MINVALUE AND MAXVALUE GROUP BY NVL(versions_operation, 'none'), NVL(versions_endscn, 0)")


@made("scan_compacted", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END * o_totalprice AS p FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT -MIN(o_orderkey), o_custkey, NULL FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey")
def scan_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that was opened anew after its log was compacted."""
    log = changed_orders(spark, sf_dir).versioned("orders")
    log.compact(keep_older=False)
    return VersionedTable.open(spark, log.folder).as_of().selectExpr("o_orderkey", "o_custkey", "o_totalprice AS p")


# triggers


@made("trigger_query", """SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN n_name ELSE o_orderpriority END AS o_orderpriority, o_totalprice + 1 AS o_totalprice
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'O'""")
def trigger_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row trigger that looks up the nation of a row's customer, for expensive orders only."""
    log = VersionedTable.create(read(spark, sf_dir, "orders"))
    of_customer = read(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey").join(read(spark, sf_dir, "nation"), "n_nationkey")
    log.triggers.append(RowTrigger({"UPDATE"}, {"o_orderpriority": "nation"}, when="old.o_totalprice > 100000", lookups=(Lookup("nation", of_customer, {"c_custkey": "new.o_custkey"}, "n_name"),)))
    return log.update({"o_totalprice": "o_totalprice + 1"}, "o_orderstatus = 'O'").returning("o_orderkey", "o_orderpriority", "o_totalprice")


@made("trigger_query_aggregate", "SELECT c_custkey, c_acctbal + 10 * coalesce(n, 0) AS c_acctbal, CASE WHEN coalesce(n, 0) = 0 THEN 'none' ELSE c_name END AS c_name FROM customer LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON o_custkey = c_custkey")
def trigger_query_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each inserted customer's balance grows by what a count over its orders says; the name is set by an earlier value."""
    customers = read(spark, sf_dir, "customer")
    log = VersionedTable.create(customers.limit(0))
    n = Lookup("n", read(spark, sf_dir, "orders"), {"o_custkey": "new.c_custkey"}, "count(*)", aggregate=True, where="o_orderstatus = 'F'", missing="0")
    log.triggers.append(RowTrigger({"INSERT"}, {"c_acctbal": "new.c_acctbal + 10 * n", "c_name": "CASE WHEN n = 0 THEN 'none' ELSE new.c_name END"}, lookups=(n,), checks=(("new.c_custkey IS NULL", "a customer needs a key"),)))
    log.insert(customers)
    return log.as_of().select("c_custkey", "c_acctbal", "c_name")


@made("trigger_statement", """SELECT 1 AS step, 'UPDATE' AS op, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS d FROM orders WHERE o_orderstatus = 'F' UNION ALL
SELECT 2, 'DELETE', COUNT(*), ROUND(-SUM(o_totalprice), 2) FROM orders WHERE o_orderstatus = 'P'""")
def trigger_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement trigger that writes how many rows each statement changed, and by how much in all, into another table."""
    log = VersionedTable.create(read(spark, sf_dir, "orders"))
    audit = VersionedTable.create(spark.createDataFrame([], "step long, op string, n long, d double"))

    def record(done: ChangeSet | None) -> None:
        if done is not None:
            op = "CASE WHEN old IS NULL THEN 'INSERT' WHEN new IS NULL THEN 'DELETE' ELSE 'UPDATE' END"
            by = done.rows.selectExpr(f"{op} AS op", "coalesce(new.o_totalprice, 0) - coalesce(old.o_totalprice, 0) AS d").groupBy("op")
            audit.insert(by.agg({"op": "count", "d": "sum"}).selectExpr(f"{done.version} AS step", "op", "`count(op)` AS n", "round(`sum(d)`, 2) AS d"))

    log.triggers.append(StatementTrigger(record))
    log.update({"o_totalprice": "o_totalprice * 2"}, "o_orderstatus = 'F'")
    log.delete("o_orderstatus = 'P'")
    return audit.as_of()


@made("trigger_instead_of", """WITH gone AS (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0 AND o_orderstatus = 'P')
SELECT c_custkey, CASE WHEN c_nationkey = 3 AND c_custkey IN (SELECT o_custkey FROM orders) THEN upper(c_name) || '!' ELSE c_name END AS c_name, COUNT(o.o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone)) o ON o.o_custkey = c_custkey GROUP BY ALL""")
def trigger_instead_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view over customers and orders: its updates rename customers, its deletes take orders away."""
    customers, orders = VersionedTable.create(read(spark, sf_dir, "customer")), VersionedTable.create(read(spark, sf_dir, "orders"))

    def rows() -> DataFrame:
        return customers.as_of().join(orders.as_of().withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "o_orderkey", "o_orderstatus")

    view = TriggeredView(rows, {
        "UPDATE": lambda c: customers.update_from(c.rows.select("new.c_custkey", "new.c_name").distinct(), ["c_custkey"], ["c_name"]),
        "DELETE": lambda c: orders.apply(orders.as_of(rows=True).alias("o").join(c.rows.selectExpr("old.o_orderkey AS k").distinct(), F.col("o.o_orderkey") == F.col("k")).selectExpr("__row", f"struct({', '.join('o.' + n for n in orders.schema().names)}) AS old", f"cast(null AS {orders.schema().simpleString()}) AS new"), "DELETE"),
    })
    view.update({"c_name": "concat(upper(c_name), '!')"}, "c_nationkey = 3")
    view.delete("c_acctbal < 0 AND o_orderstatus = 'P'")
    kept, named = orders.as_of(), customers.as_of()
    # a customer without orders is not in the view, so the view's update leaves its name
    return named.join(kept, kept["o_custkey"] == named["c_custkey"], "left").groupBy("c_custkey", "c_name").agg(F.count("o_orderkey").alias("n"))
