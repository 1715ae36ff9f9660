"""Aggregates of extreme rows, nested cursors, object types, JSON patches and scoring."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json_patch import Op, json_transform
from ..operators.model import ANY, CV, Model, Rule
from ..operators.scoring import LinearModel, fit_linear, fit_logistic
from ..semi.objects import TypeTree
from .base import Registry, engine

R = Registry()
q, made = R.add, R.made

# KEEP

q("agg_keep_sum", """SELECT o_custkey, SUM(o_totalprice) KEEP (DENSE_RANK LAST ORDER BY o_orderstatus) AS s, COUNT(*) KEEP (DENSE_RANK FIRST ORDER BY o_orderpriority DESC) AS n, COUNT(*) AS rows_all,
  AVG(o_totalprice) KEEP (DENSE_RANK FIRST ORDER BY o_orderstatus, o_orderpriority) AS a, MIN(o_orderkey) KEEP (DENSE_RANK LAST ORDER BY o_orderstatus) AS k FROM orders GROUP BY o_custkey""",
  """WITH r AS (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC) AS x, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC) AS y, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderpriority) AS z FROM orders)
SELECT o_custkey, SUM(o_totalprice) FILTER (WHERE x = 1) AS s, COUNT(*) FILTER (WHERE y = 1) AS n, COUNT(*) AS rows_all, AVG(o_totalprice) FILTER (WHERE z = 1) AS a, MIN(o_orderkey) FILTER (WHERE x = 1) AS k FROM r GROUP BY o_custkey""")
q("agg_keep_nulls", "SELECT o_orderpriority, COUNT(*) KEEP (DENSE_RANK LAST ORDER BY NULLIF(o_orderstatus, 'F')) AS a, MAX(o_orderkey) KEEP (DENSE_RANK LAST ORDER BY NULLIF(o_orderstatus, 'F')) AS b, COUNT(*) KEEP (DENSE_RANK FIRST ORDER BY NULLIF(o_orderstatus, 'F') DESC NULLS LAST) AS c FROM orders GROUP BY o_orderpriority",
  "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS a, MAX(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS b, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS c FROM orders GROUP BY o_orderpriority")
q("agg_keep_join", "SELECT r.r_name, SUM(c.c_acctbal) KEEP (DENSE_RANK FIRST ORDER BY c.c_mktsegment) AS s, COUNT(DISTINCT n.n_name) KEEP (DENSE_RANK LAST ORDER BY c.c_mktsegment) AS d FROM customer c, nation n, region r WHERE c.c_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey GROUP BY r.r_name HAVING COUNT(*) > 1",
  """WITH x AS (SELECT r_name, c_acctbal, n_name, dense_rank() OVER (PARTITION BY r_name ORDER BY c_mktsegment) AS a, dense_rank() OVER (PARTITION BY r_name ORDER BY c_mktsegment DESC) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT r_name, SUM(c_acctbal) FILTER (WHERE a = 1) AS s, COUNT(DISTINCT n_name) FILTER (WHERE b = 1) AS d FROM x GROUP BY r_name HAVING COUNT(*) > 1""")
q("agg_keep_whole", "SELECT SUM(l_quantity) KEEP (DENSE_RANK LAST ORDER BY l_shipdate) AS s, COUNT(*) KEEP (DENSE_RANK FIRST ORDER BY l_shipdate) AS n FROM lineitem", "SELECT SUM(l_quantity) FILTER (WHERE l_shipdate = (SELECT MAX(l_shipdate) FROM lineitem)) AS s, COUNT(*) FILTER (WHERE l_shipdate = (SELECT MIN(l_shipdate) FROM lineitem)) AS n FROM lineitem")


# CURSOR


@made("cursor_subquery", "SELECT c_custkey, CAST(COUNT(o_orderkey) AS INTEGER) AS n, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey DESC), '') AS keys, SUM(o_totalprice) AS s FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def cursor_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = engine(spark, sf_dir).sql("SELECT c.c_custkey, CURSOR(SELECT o_orderkey, o_totalprice AS p FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_orderkey DESC) AS k FROM customer c")
    return out.selectExpr("c_custkey", "size(k) AS n", "array_join(transform(k, x -> cast(x.o_orderkey AS STRING)), ',') AS keys", "aggregate(k, cast(null AS DOUBLE), (a, x) -> coalesce(a, 0) + x.p) AS s")


@made("cursor_grouped", "SELECT r_name, coalesce(string_agg(n_nationkey || ':' || n, ' ' ORDER BY n_nationkey), '') AS counts FROM region LEFT JOIN (SELECT n_regionkey, n_nationkey, COUNT(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey) ON n_regionkey = r_regionkey GROUP BY r_name")
def cursor_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = engine(spark, sf_dir).sql("SELECT r_name, CURSOR(SELECT n_nationkey AS k, COUNT(*) AS n FROM nation, customer WHERE n_regionkey = r.r_regionkey AND c_nationkey = n_nationkey GROUP BY n_nationkey ORDER BY k) AS c FROM region r")
    return out.selectExpr("r_name", "array_join(transform(c, x -> concat(x.k, ':', x.n)), ' ') AS counts")


# object types


def rounded(x: Column, places: int = 2) -> Column:
    """ROUND of a double as SQL has it: halves of the binary product go away from zero, a negative zero stays one, and what the product overflows is left alone.

    Spark's own rounds the shortest decimal that stands for the double, so it takes 1.005 up to 1.01.
    """
    by = float(10**places)
    up = x * by
    size, whole = F.abs(up), F.floor(F.abs(up)).cast("double")
    near = F.when(size < 2.0**52, F.signum(up) * (whole + F.when(size - whole >= 0.5, 1.0).otherwise(0.0))).otherwise(up)
    return F.when(F.abs(near) < math.inf, near / by).otherwise(x)


@F.udf(T.StringType(), useArrow=True)
def two_places(x: float | None) -> str | None:
    """printf('%.2f'): every digit of the double; Java's stops at 17 and writes a null as text."""
    return None if x is None else f"{x:.2f}"


def parties() -> TypeTree:
    """A party, not instantiable; customers and suppliers under it; customers of one segment, who score differently, under those."""
    tree = TypeTree()
    tree.add("t_party", {"id": "bigint", "name": "string", "balance": "double"}, abstract=True, map_method="score",
             score=lambda o: rounded(o.balance), label=lambda o: F.concat(o.name, F.lit(" "), two_places(o.call("score"))))
    tree.add("t_customer", {"segment": "string"}, "t_party", score=lambda o: rounded(o.balance * 2))
    tree.add("t_builder", {}, "t_customer", score=lambda o: o.above("score") + 1000)
    tree.add("t_supplier", {"nation": "bigint"}, "t_party")
    return tree


def all_parties(spark: SparkSession, sf_dir: str, tree: TypeTree) -> DataFrame:
    c, s = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/supplier.parquet")
    own = {"id": F.col("c_custkey"), "name": F.col("c_name"), "balance": F.col("c_acctbal"), "segment": F.col("c_mktsegment")}
    customers = c.select(F.when(F.col("c_mktsegment") == "BUILDING", tree.make("t_builder", **own)).otherwise(tree.make("t_customer", **own)).alias("p"))
    return customers.unionByName(s.select(tree.make("t_supplier", id=F.col("s_suppkey"), name=F.col("s_name"), balance=F.col("s_acctbal"), nation=F.col("s_nationkey")).alias("p")))


PARTIES = """WITH p AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, NULL::BIGINT AS nation, CASE WHEN c_mktsegment = 'BUILDING' THEN 't_builder' ELSE 't_customer' END AS kind FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, s_nationkey, 't_supplier' FROM supplier), s AS (SELECT *, CASE kind WHEN 't_builder' THEN ROUND(balance * 2, 2) + 1000 WHEN 't_customer' THEN ROUND(balance * 2, 2) ELSE ROUND(balance, 2) END AS score FROM p)"""


@made("object_methods", f"{PARTIES} SELECT id, name || ' ' || printf('%.2f', score) AS label, score, segment, nation FROM s")
def object_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, p = parties(), F.col("p")
    return all_parties(spark, sf_dir, tree).select(p["id"].alias("id"), tree.call(p, "label").alias("label"), tree.key(p).alias("score"), tree.attribute(p, "t_customer", "segment").alias("segment"), tree.attribute(p, "t_supplier", "nation").alias("nation"))


@made("object_is_of_type", f"{PARTIES} SELECT kind <> 't_supplier' AS customer, kind = 't_customer' AS only_customer, COUNT(*) AS n, COUNT(segment) AS treated, MAX(score) AS top FROM s GROUP BY ALL")
def object_is_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, p = parties(), F.col("p")
    rows = all_parties(spark, sf_dir, tree)
    by = rows.groupBy(tree.is_of(p, "t_customer").alias("customer"), tree.is_of(p, "t_customer", only=True).alias("only_customer"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.count(tree.treat(p, "t_customer")).alias("treated"), F.max(tree.key(p)).alias("top"))


# JSON


@made("fn_json_transform", """SELECT event_id, '{"kind":"' || event_type || '","tags":["first","' || event_type || '",' || event_id || '],"u":{"deep":{"x":true},"m":' || user_id || ',"twice":' || 2 * user_id || '}}' AS j FROM events""")
def fn_json_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    doc = F.format_string('{"id": %d, "u": {"n": %d, "gone": [1]}, "tags": ["%s"]}', "event_id", "user_id", "event_type")
    ops = [Op("set", "$.u.twice", F.col("user_id") * 2), Op("remove", "$.u.gone"), Op("rename", "$.u.n", "m"), Op("append", "$.tags", F.col("event_id")), Op("prepend", "$.tags", "first"),
           Op("set", "$.u.deep.x", True), Op("insert", "$.kind", F.col("event_type")), Op("insert", "$.tags", "not new"), Op("replace", "$.none", 1), Op("remove", "$.id")]
    return e.select("event_id", json_transform(doc, *ops).alias("j"))


@made("fn_json_transform_keep", """SELECT event_id, '{"a":[' || event_id || ',9],"c":null}' AS j FROM events""")
def fn_json_transform_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    doc = F.format_string('{"a": [%d, 2, 3], "b": {"q": 1}, "c": 5}', "event_id")
    return e.select("event_id", json_transform(doc, Op("keep", "$", ["a", "c"]), Op("set", "$.a[1]", 9), Op("remove", "$.a[2]"), Op("set", "$.c", None)).alias("j"))


# scoring


@made("prediction_linear", "WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem) SELECT l_linenumber, COUNT(*) AS n, ROUND(AVG(m.a * l_quantity + m.b), 4) AS predicted FROM lineitem, m GROUP BY l_linenumber")
def prediction_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that is fitted, stored as text, read back and applied to every row."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    model = LinearModel.from_json(fit_linear(rows, {"quantity": "l_quantity"}, "l_extendedprice").to_json())
    return rows.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(model.prediction()), 4).alias("predicted"))


WORDS = r"size(split(trim(text), '\\s+'))"
FEATURES = {
    "log_words": f"ln(1 + {WORDS})", "word_length": f"n_chars / (1 + {WORDS})", "line_share": "size(split(text, '\\n')) / (1 + n_chars)",
    "symbols": "length(regexp_replace(text, '[\\\\p{L}\\\\s]', '')) / (1 + n_chars)", "distinct": rf"size(array_distinct(split(lower(trim(text)), '\\s+'))) / (1 + {WORDS})",
}


@made("prediction_quality", "SELECT COUNT(*) AS n, TRUE AS better, TRUE AS consistent FROM labels JOIN documents ON documents.doc_id = labels.doc_id")
def prediction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels by text features: right more often than the commoner label is, and the set and the probability agree with the prediction."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    model = fit_logistic(rows, FEATURES, "quality")
    scored = rows.select("quality", model.prediction().alias("p"), model.probability().alias("q"), model.prediction_set().alias("s"), model.details(2).alias("d"))
    agree = (F.col("p") == (F.col("q") >= 0.5).cast("int")) & (F.col("s")[0]["prediction"] == F.col("p")) & (F.size("d") == 2)
    right, ones = F.avg((F.col("p") == F.col("quality")).cast("int")), F.avg("quality")
    return scored.agg(F.count(F.lit(1)).alias("n"), (right > F.greatest(ones, F.lit(1.0) - ones)).alias("better"), F.min(agree).alias("consistent"))


# MODEL


@made("model_rules", """WITH t AS (SELECT c_nationkey AS n, o_orderstatus AS s, CAST(year(o_orderdate) AS INTEGER) AS y, SUM(o_totalprice) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
r AS (SELECT n, coalesce(MAX(v) FILTER (WHERE s = 'F' AND y = 1997), 0) + coalesce(MAX(v) FILTER (WHERE s = 'F' AND y = 1998), 0) AS f FROM t GROUP BY n),
u AS (SELECT n, s, y, v FROM t UNION ALL SELECT n, 'F', 2030, f FROM r UNION ALL SELECT n, 'O', 2030, 2 * f FROM r)
SELECT u.n, u.s, u.y, ROUND(u.v, 2) AS v, ROUND(coalesce(u.v, 0) - coalesce(p.v, 0) + 2 * r.f, 2) AS w FROM u JOIN r ON r.n = u.n LEFT JOIN u p ON p.n = u.n AND p.s = u.s AND p.y = u.y - 1""")
def model_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cells a nation that are made from others, and for every cell its growth over the year before plus one of those made."""
    o, c = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    cells = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_nationkey").alias("n"), F.col("o_orderstatus").alias("s"), F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    cell = lambda s, y: ("v", {"s": s, "y": y})
    model = Model(["n"], ["s", "y"], ["v", "w"], [
        Rule("w", {"s": ANY, "y": ANY}, lambda a, b, m: a - b + m, (cell(CV(), CV()), cell(CV(), CV(-1)), cell("O", 2030))),
        Rule("v", {"s": "O", "y": 2030}, lambda a: a * 2, (cell("F", CV()),)),
        Rule("v", {"s": "F", "y": 2030}, lambda a, b: a + b, (cell("F", 1997), cell("F", 1998))),
    ], ignore_nav=True)
    out = model.apply(cells.withColumn("w", F.lit(None).cast("double")))
    return out.select("n", "s", "y", F.round("v", 2).alias("v"), F.round("w", 2).alias("w"))
