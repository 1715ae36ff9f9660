"""DML snapshots, routines, maps, constraints, row counts, sinks and queue accessors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import constraints, rowcount
from ..plsql.runtime import Session
from ..semi import queues
from ..sources.tables import read_tsv, write_tsv
from .base import Registry, engine

R = Registry()
made = R.made


@made("dml_insert_values", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 9, 'ATLANTIS'")
def dml_insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("INSERT INTO region (r_regionkey, r_name) VALUES (9, 'ATLANTIS')")


@made("dml_insert_select", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1")
def dml_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("INSERT INTO region SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1")


@made("dml_insert_all", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, 'low' FROM nation WHERE n_nationkey < 3 UNION ALL SELECT n_nationkey, 'high' FROM nation WHERE n_nationkey > 22")
def dml_insert_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "INSERT ALL WHEN n_nationkey < 3 THEN INTO region (r_regionkey, r_name) VALUES (n_nationkey, 'low') WHEN n_nationkey > 22 THEN INTO region (r_regionkey, r_name) VALUES (n_nationkey, 'high') SELECT n_nationkey FROM nation"
    return engine(spark, sf_dir).sql(text)


@made("dml_update", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("UPDATE customer c SET c.c_acctbal = c.c_acctbal + 100 WHERE c.c_mktsegment = 'BUILDING'")


@made("dml_delete", "SELECT * FROM orders WHERE NOT coalesce(NULLIF(o_orderstatus, 'P') = 'F', false)")
def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("DELETE FROM orders WHERE NULLIF(o_orderstatus, 'P') = 'F'")


@made("dml_merge", "SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 'M' || n_nationkey ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT k, 'M' || k, 0 FROM (VALUES (1000), (1001)) v(k)")
def dml_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """MERGE INTO nation n USING (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 1000 FROM dual UNION ALL SELECT 1001 FROM dual) s
        ON (n.n_nationkey = s.k) WHEN MATCHED THEN UPDATE SET n.n_name = 'M' || s.k WHEN NOT MATCHED THEN INSERT (n_nationkey, n_name, n_regionkey) VALUES (s.k, 'M' || s.k, 0)"""
    return engine(spark, sf_dir).sql(text)


@made("dml_trigger", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 50, 'NOWHERE'")
def dml_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(engine(spark, sf_dir))
    s.run("CREATE TRIGGER up BEFORE INSERT ON region FOR EACH ROW BEGIN IF INSERTING THEN :NEW.r_name := UPPER(:NEW.r_name); END IF; END;")
    return s.engine.sql("INSERT INTO region VALUES (50, 'nowhere')")


@made("select_into", "SELECT COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders")
def select_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(engine(spark, sf_dir))
    s.run("CREATE FUNCTION top_order(n OUT NUMBER) RETURN BINARY_DOUBLE IS top BINARY_DOUBLE; BEGIN SELECT COUNT(*), MAX(o_totalprice) INTO n, top FROM orders; RETURN top; END;")
    s.run("CREATE PACKAGE BODY out_p IS n NUMBER; top BINARY_DOUBLE; PROCEDURE go IS BEGIN top := top_order(n); END; END;")
    s.call("out_p.go")
    own = s.packages["out_p"].slots
    return spark.range(1).select(F.lit(own["n"].value).cast("long").alias("n"), F.lit(own["top"].value).cast("double").alias("top"))


@made("for_loop_agg", "SELECT CAST(SUM(n_nationkey) AS BIGINT) AS total, COUNT(*) AS n FROM nation WHERE n_regionkey IN (1, 2)")
def for_loop_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(engine(spark, sf_dir))
    s.run("""CREATE PACKAGE BODY p IS total NUMBER := 0; n NUMBER := 0;
        PROCEDURE go IS BEGIN FOR r IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2)) LOOP total := total + r.n_nationkey; n := n + 1; END LOOP; END; END;""")
    s.call("p.go")
    own = s.packages["p"].slots
    return spark.range(1).select(F.lit(own["total"].value).cast("long").alias("total"), F.lit(own["n"].value).cast("long").alias("n"))


@made("udf_scalar", "SELECT o_orderkey, ROUND(o_totalprice * 1.2 + 5, 2) AS gross FROM orders")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.create_function("main.gross", [("price", "BINARY_DOUBLE"), ("fee", "NUMBER(5)")], "BINARY_DOUBLE", "price * 1.2D + fee")
    return e.sql("SELECT o_orderkey, ROUND(main.gross(o_totalprice, 5), 2) AS gross FROM orders")


def _maps(spark: SparkSession, sf_dir: str):
    e = engine(spark, sf_dir)
    n = e.catalog.relation("MAIN", "NATION")
    pair = F.struct("n_name", F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("nm")))
    e.catalog.add_table("by_region", n.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(pair)).alias("m")))
    return e


@made("map_lookup", "SELECT n_regionkey, MAX(CASE WHEN n_name = 'NATION_6' THEN n_nationkey END) AS id FROM nation GROUP BY n_regionkey")
def map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _maps(spark, sf_dir).sql("SELECT b.n_regionkey, b.m('NATION_6').id AS id FROM by_region b")


@made("map_field", "SELECT n_regionkey, MAX(CASE WHEN n_name = 'NATION_7' THEN n_name END) AS nm FROM nation GROUP BY n_regionkey")
def map_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _maps(spark, sf_dir).sql("SELECT b.n_regionkey, b.m('NATION_7').nm AS nm FROM by_region b")


@made("map_methods", "SELECT n_regionkey, CAST(COUNT(*) AS INTEGER) AS n, MIN(n_name) AS f, MAX(n_name) AS l, bool_or(n_name = 'NATION_8') AS e FROM nation GROUP BY n_regionkey")
def map_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _maps(spark, sf_dir).sql("SELECT b.n_regionkey, b.m.COUNT AS n, b.m.FIRST AS f, b.m.LAST AS l, b.m.EXISTS('NATION_8') AS e FROM by_region b")


@made("arr_extend_trim_delete", "SELECT unnest([1, 2, 3, 9, 9]) AS v UNION ALL SELECT -4")
def arr_extend_trim_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(engine(spark, sf_dir))
    s.run("""CREATE FUNCTION grow RETURN NUMBER PIPELINED IS TYPE t IS TABLE OF NUMBER; a t := t(1, 2, 3, 4, 5); gone t := t(7); BEGIN
        a.TRIM(2); a.EXTEND; a(4) := 9; a.EXTEND(1, 4); gone.DELETE; FOR i IN 1 .. a.COUNT LOOP PIPE ROW(a(i)); END LOOP; PIPE ROW(gone.COUNT - 4); END;""")
    return s.table_of("grow").select(F.col("column_value").cast("int").alias("v"))


# constraints


@made("chk_primary_key", "SELECT n_regionkey, COUNT(*) AS n_rows FROM nation GROUP BY n_regionkey HAVING COUNT(*) > 1")
def chk_primary_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = constraints.Constraint("pk", "P", ("n_regionkey",))
    return constraints.validate(engine(spark, sf_dir), "nation", [c])[0].violations


@made("chk_unique", "SELECT o_custkey, o_orderdate, COUNT(*) AS n_rows FROM orders GROUP BY ALL HAVING COUNT(*) > 1")
def chk_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = constraints.Constraint("uk", "U", ("o_custkey", "o_orderdate"))
    return constraints.validate(engine(spark, sf_dir), "orders", [c])[0].violations


@made("chk_foreign_key", "SELECT doc_id, COUNT(*) AS n_rows FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id")
def chk_foreign_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = constraints.Constraint("fk", "R", ("doc_id",), target="labels", target_columns=("doc_id",))
    return constraints.validate(engine(spark, sf_dir), "documents", [c])[0].violations


@made("chk_check", "SELECT c_custkey, c_acctbal FROM customer WHERE NOT (c_acctbal >= 0 OR NULLIF(c_mktsegment, 'BUILDING') IS NULL)")
def chk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = constraints.Constraint("ck", "C", condition="c_acctbal >= 0 OR NULLIF(c_mktsegment, 'BUILDING') IS NULL")
    return constraints.validate(engine(spark, sf_dir), "customer", [c])[0].violations.select("c_custkey", "c_acctbal")


# row counts and sinks


@made("rowcount_exact", "SELECT COUNT(*) AS n_rows FROM lineitem")
def rowcount_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rowcount.exact(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


@made("rowcount_sampling")
def rowcount_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rowcount.sampled(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), 10)


@made("rowcount_hybrid", "SELECT COUNT(*) AS n_rows, 'exact' AS method FROM customer")
def rowcount_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rowcount.Counter().count(spark.read.parquet(f"{sf_dir}/customer.parquet"))


@made("sink_tsv_roundtrip", "SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS s, 'a' || chr(9) || 'b\\' || o_orderkey AS t FROM orders")
def sink_tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = engine(spark, sf_dir).sql("SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS s, 'a' || CHR(9) || 'b\\' || o_orderkey AS t FROM orders")
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="oriel-tsv-")
    path = f"{folder.rstrip('/')}/oriel-tsv-{uuid.uuid4().hex}"
    write_tsv(df, path)
    return read_tsv(spark, path, df.schema)


# queue accessors


@made("aq_jms_accessors", "SELECT event_id, event_type AS text_content, CAST(length(event_type) AS INTEGER) AS size, event_type ILIKE '%CL%' AS hit, CAST(user_id AS VARCHAR) AS who FROM events")
def aq_jms_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    j = queues.jms_message([F.lit(" "), F.col("event_type")], {"message_id": F.col("event_id").cast("string")}, F.create_map(F.lit("user"), F.col("user_id").cast("string")))
    m = e.select("event_id", j.alias("j"))
    c, g = F.col("j"), queues.JMS
    return m.select("event_id", g["get_text_content"](c).alias("text_content"), g["get_message_size"](c).alias("size"), g["text_contains"](c, "CL").alias("hit"), g["get_property"](c, "user").alias("who"))


@made("aq_recipient_accessors", "SELECT c_custkey, 'c' || c_custkey || '@x.org' AS first_address, 2 AS n, 1 AS pending, 1 AS at_x FROM customer")
def aq_recipient_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    texts = F.array(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@x.org")), F.lit("name=bob;address=b@y.org;status=DELIVERED;priority=3"))
    m, j, g = c.select("c_custkey", queues.recipients(texts).alias("j")), F.col("j"), queues.RECIPIENTS
    return m.select("c_custkey", g["get_first_address"](j).alias("first_address"), g["count"](j).alias("n"), g["count_by_status"](j, "pending").alias("pending"), g["count_by_domain"](j, "x.org").alias("at_x"))
