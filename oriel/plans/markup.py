"""XML made from tables, and read back as rows and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import xml
from ..functions.xml import XmlColumn
from .base import Registry

R = Registry()
q, made = R.add, R.made

#: A document for each customer: its orders as elements with attributes and nested elements.
DOCS = """SELECT o_custkey AS k, XMLELEMENT("orders", XMLATTRIBUTES(o_custkey AS "customer"), XMLAGG(XMLELEMENT("order", XMLATTRIBUTES(o_orderkey AS "id", NULLIF(o_orderstatus, 'P') AS "status"),
  XMLFOREST(o_totalprice AS "price", NULLIF(o_orderpriority, '1-URGENT') AS "priority"), XMLELEMENT("when", XMLELEMENT("year", EXTRACT(YEAR FROM o_orderdate)))) ORDER BY o_orderkey DESC)) AS doc FROM orders GROUP BY o_custkey"""

q("scan_xmltable", f"SELECT c.k, x.n, x.id, x.status, x.price, x.priority, x.y FROM ({DOCS}) c, XMLTABLE('/orders/order' PASSING c.doc COLUMNS n FOR ORDINALITY, id INTEGER PATH '@id', status VARCHAR2(9) PATH '@status' DEFAULT 'open', price BINARY_DOUBLE PATH 'price', priority VARCHAR2(20), y INTEGER PATH 'when/year') x",
  "SELECT o_custkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS INTEGER) AS n, o_orderkey AS id, coalesce(NULLIF(o_orderstatus, 'P'), 'open') AS status, o_totalprice AS price, NULLIF(o_orderpriority, '1-URGENT') AS priority, year(o_orderdate) AS y FROM orders")
q("scan_xmltable_where", f"SELECT c.k, COUNT(*) AS n, MIN(x.id) AS low FROM ({DOCS}) c, XMLTABLE('/orders/order[@status=\"F\"]' PASSING c.doc COLUMNS id INTEGER PATH '@id') x GROUP BY c.k", "SELECT o_custkey AS k, COUNT(*) AS n, MIN(o_orderkey) AS low FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
q("fn_xml_forest", "SELECT c_custkey, XMLFOREST(c_name, NULLIF(c_nationkey, 3) AS \"nation\", 'a < b & c' AS \"note\") AS x FROM customer",
  "SELECT c_custkey, '<c_name>' || c_name || '</c_name>' || CASE WHEN c_nationkey = 3 THEN '' ELSE '<nation>' || c_nationkey || '</nation>' END || '<note>a &lt; b &amp; c</note>' AS x FROM customer")
q("fn_xml_attributes", "SELECT n_nationkey, XMLELEMENT(\"n\", XMLATTRIBUTES(n_regionkey AS \"r\", NULLIF(n_nationkey, 4) AS \"k\", 'say \"<\"' AS \"q\"), n_name) AS x FROM nation",
  """SELECT n_nationkey, '<n r="' || n_regionkey || '"' || CASE WHEN n_nationkey = 4 THEN '' ELSE ' k="' || n_nationkey || '"' END || ' q="say &quot;&lt;&quot;">' || n_name || '</n>' AS x FROM nation""")
q("pred_xmlexists", f"SELECT c.k FROM ({DOCS}) c WHERE XMLEXISTS('/orders/order[price > 400000]' PASSING c.doc)", "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 400000")
q("fn_xml_query", f"SELECT c.k, XMLQUERY('/orders/order/@id' PASSING c.doc RETURNING CONTENT) AS ids, XMLQUERY('/orders/@customer' PASSING c.doc RETURNING CONTENT) AS who FROM ({DOCS}) c", "SELECT o_custkey AS k, string_agg(o_orderkey, ' ' ORDER BY o_orderkey DESC) AS ids, CAST(o_custkey AS VARCHAR) AS who FROM orders GROUP BY o_custkey")
q("agg_xml_many", "SELECT l_linestatus, l_linenumber, LENGTH(XMLAGG(XMLELEMENT(\"k\", l_orderkey) ORDER BY l_orderkey, l_quantity)) AS n FROM lineitem GROUP BY l_linestatus, l_linenumber", "SELECT l_linestatus, l_linenumber, CAST(SUM(length('<k>' || l_orderkey || '</k>')) AS INTEGER) AS n FROM lineitem GROUP BY l_linestatus, l_linenumber")


#: Parts that the customers of a nation are dealt to, each beside all suppliers of the nation: nations are few, and a join on them alone has no more tasks.
DEALS = 32


@made("xml_row_source", "SELECT c_custkey, c_name, s.s_suppkey, s.s_name FROM customer LEFT JOIN supplier s ON s.s_nationkey = c_nationkey AND s.s_suppkey % 2 = 0")
def xml_row_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation as documents of up to 10,000 keys, opened once and then joined to customers; customers of nations without any keep a row."""
    s, c = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 2 = 0"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    parts = xml.element("supplier", xml.forest(name=F.col("s_name")), attributes={"key": F.col("s_suppkey")})
    docs = s.groupBy("s_nationkey", F.expr("s_suppkey div 10000")).agg(F.listagg(parts, F.lit("")).alias("inner")).select(F.col("s_nationkey").alias("c_nationkey"), xml.element("all", xml.element("in", F.col("inner"))).alias("doc"))
    opened = xml.xml_table(docs, "doc", "/all/in/supplier", [XmlColumn("s_suppkey", "bigint", "@key"), XmlColumn("s_name", "string", "name")])
    by = ["c_nationkey", "deal"]
    suppliers = opened.select("c_nationkey", "s_suppkey", "s_name", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal")).repartition(*by)
    customers = c.select("*", F.pmod(F.hash("c_custkey"), F.lit(DEALS)).alias("deal")).repartition(*by)
    return customers.join(suppliers, by, "left").select("c_custkey", "c_name", "s_suppkey", "s_name")
