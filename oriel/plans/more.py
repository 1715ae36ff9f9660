"""Binds, routines, dictionary views, table definitions, sequences, queue accessors, counts and transfer."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import constraints, rowcount
from ..pipeline import Migration
from ..plsql.runtime import Session
from ..semi import queues
from ..sources.dictionary import add_dictionary
from ..transfer import planner
from .base import TABLES, Registry, engine

R = Registry()
q, made = R.add, R.made


def values(spark: SparkSession, **columns: object) -> DataFrame:
    """One row of literals."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])


# queries

q("scan_only", "SELECT r_regionkey, r_name FROM ONLY (region)", "SELECT r_regionkey, r_name FROM region")
q("scan_pages", "SELECT page_id, LENGTH(url) AS n FROM pages", "SELECT page_id, CAST(length(url) AS INTEGER) AS n FROM pages")
q("scan_sample_share", "SELECT s.n BETWEEN a.n * 0.05 AND a.n * 0.15 AS about_a_tenth FROM (SELECT COUNT(*) AS n FROM lineitem SAMPLE (10) SEED (1)) s, (SELECT COUNT(*) AS n FROM lineitem) a", "SELECT TRUE AS about_a_tenth")
q("pred_likec", "SELECT n_name FROM nation WHERE n_name LIKEC 'NATION\\_1%' ESCAPE '\\'", "SELECT n_name FROM nation WHERE n_name LIKE 'NATION\\_1%' ESCAPE '\\'")
q("win_lag_diff", "SELECT o_orderkey, LAG_DIFF(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS d FROM orders", "SELECT o_orderkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS d FROM orders")
q("win_lag_diff_percent", "SELECT o_orderkey, LAG_DIFF_PERCENT(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS d FROM orders", "SELECT o_orderkey, (o_totalprice - lag(o_totalprice) OVER w) / lag(o_totalprice) OVER w AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
q("order_for_update", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2 FOR UPDATE OF n_name NOWAIT", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
q("fn_concat", "SELECT CONCAT(n_name, NULLIF(n_nationkey, 3)) AS a, CONCAT(CONCAT('<', n_name), '>') AS b FROM nation", "SELECT n_name || coalesce(CAST(NULLIF(n_nationkey, 3) AS VARCHAR), '') AS a, '<' || n_name || '>' AS b FROM nation")
q("fn_sys_context", "SELECT n_nationkey, n_name || SYS_CONTEXT('USERENV', 'CURRENT_SCHEMA') AS s, CASE WHEN SYS_CONTEXT('USERENV', 'SESSION_USER') = SESSION_USER THEN 1 ELSE 0 END AS u FROM nation", "SELECT n_nationkey, n_name || 'MAIN' AS s, 1 AS u FROM nation")
q("fn_unistr", "SELECT n_name || UNISTR('caf\\00e9 \\\\') AS a FROM nation", "SELECT n_name || 'café \\' AS a FROM nation")
q("fn_now_in_bounds", "SELECT o_orderkey, CASE WHEN CAST(SYSDATE AS DATE) - 1 > o_orderdate AND CAST(SYSDATE AS DATE) >= CURRENT_DATE - 1 THEN 1 ELSE 0 END AS a, CASE WHEN SYSTIMESTAMP <= CURRENT_TIMESTAMP THEN 1 ELSE 0 END AS b FROM orders", "SELECT o_orderkey, 1 AS a, 1 AS b FROM orders")
q("fn_user_is_one", "SELECT n_nationkey, CASE WHEN USER = CURRENT_USER AND LENGTH(USER) > 0 THEN n_name END AS a FROM nation", "SELECT n_nationkey, n_name AS a FROM nation")
q("fn_xml_element", "SELECT n_nationkey, XMLELEMENT(\"nation\", XMLELEMENT(\"name\", n_name), XMLELEMENT(\"note\", 'a < b & c')) AS x FROM nation", "SELECT n_nationkey, '<nation><name>' || n_name || '</name><note>a &lt; b &amp; c</note></nation>' AS x FROM nation")
q("agg_xml", "SELECT n_regionkey, XMLAGG(XMLELEMENT(\"n\", n_name) ORDER BY n_name DESC) AS x FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg('<n>' || n_name || '</n>', '' ORDER BY n_name DESC) AS x FROM nation GROUP BY n_regionkey")


@made("expr_bind_params", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 AND n_name LIKE 'NATION%' AND n_nationkey < 20")
def expr_bind_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = :r AND n_name LIKE :s AND n_nationkey < :k", {"r": 1, "s": "NATION%", "k": 20})


@made("dyn_execute_immediate", "SELECT COUNT(*) AS n FROM orders WHERE o_custkey > 5 AND o_orderstatus = 'F'")
def dyn_execute_immediate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).execute_immediate("SELECT COUNT(*) AS n FROM orders WHERE o_custkey > :1 AND o_orderstatus = :2", 5, "F")


@made("name_synonyms", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def name_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.catalog.add_synonym("MAIN", "countries", "MAIN", "nation")
    e.catalog.add_synonym("PUBLIC", "continents", "MAIN", "region")
    return e.sql("SELECT c.n_name, r.r_name FROM countries c JOIN continents r ON c.n_regionkey = r.r_regionkey")


# routines: control flow on the driver, every query and change as a Spark job


def routine(name: str, duck: str, source: str, *args: object, column: str = "v"):
    """Register the value of a function."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Session(engine(spark, sf_dir))
        for unit in source.split("\n/\n"):
            s.run(unit)
        return values(spark, **{column: str(s.call("f", *args))})

    made(name, duck)(run)


routine("plsql_if_elsif", "SELECT 'mid' AS v", "CREATE FUNCTION f(n NUMBER) RETURN VARCHAR2 IS BEGIN IF n < 3 THEN RETURN 'low'; ELSIF n < 7 THEN RETURN 'mid'; ELSE RETURN 'high'; END IF; END;", 5)
routine("plsql_while", "SELECT '55' AS v", "CREATE FUNCTION f RETURN NUMBER IS i NUMBER := 0; n NUMBER := 0; BEGIN WHILE i < 10 LOOP i := i + 1; n := n + i; END LOOP; RETURN n; END;")
routine("plsql_for_range", "SELECT '13 11 23 21' AS v", """CREATE FUNCTION f RETURN VARCHAR2 IS s VARCHAR2(100) := ''; BEGIN
    <<outer>> FOR a IN 1 .. 3 LOOP FOR b IN REVERSE 1 .. 3 LOOP CONTINUE WHEN b = 2; EXIT outer WHEN a = 3; s := s || a || b || ' '; END LOOP; END LOOP; RETURN TRIM(s); END;""")
routine("plsql_loop_exit", "SELECT 'six' AS v", "CREATE FUNCTION f RETURN VARCHAR2 IS i NUMBER := 0; BEGIN LOOP i := i + 1; EXIT WHEN i > 5; NULL; END LOOP; CASE i WHEN 6 THEN RETURN 'six'; ELSE RETURN 'no'; END CASE; END;")
routine("plsql_recursion", "SELECT '3628800' AS v", "CREATE FUNCTION f(n IN NUMBER) RETURN NUMBER IS BEGIN IF n <= 1 THEN RETURN 1; END IF; RETURN n * f(n - 1); END;", 10)
routine("plsql_out_parameters", "SELECT '210' AS v", "CREATE PROCEDURE both(a IN NUMBER, b OUT NUMBER, c IN OUT NUMBER) IS BEGIN b := a + 1; c := c * 2; END;\n/\nCREATE FUNCTION f RETURN NUMBER IS x NUMBER; y NUMBER := 5; BEGIN both(1, x, y); RETURN x * 100 + y; END;")
routine("plsql_cursor_attributes", "SELECT string_agg(n_name, ',' ORDER BY n_nationkey) || ':' || COUNT(*) AS v FROM nation WHERE n_regionkey = 1", """CREATE FUNCTION f RETURN VARCHAR2 IS CURSOR c(d NUMBER) IS SELECT n_name FROM nation WHERE n_regionkey = d ORDER BY n_nationkey; r c%ROWTYPE; s VARCHAR2(999) := ''; BEGIN
    OPEN c(1); LOOP FETCH c INTO r; EXIT WHEN c%NOTFOUND; IF c%ROWCOUNT > 1 THEN s := s || ','; END IF; s := s || r.n_name; END LOOP; s := s || ':' || c%ROWCOUNT; CLOSE c; RETURN s; END;""")
routine("plsql_cursor_for", "SELECT CAST(SUM(r_regionkey) AS VARCHAR) AS v FROM region", "CREATE FUNCTION f RETURN NUMBER IS n NUMBER := 0; BEGIN FOR x IN (SELECT r_regionkey FROM region) LOOP n := n + x.r_regionkey; END LOOP; RETURN n; END;")
routine("plsql_exceptions", "SELECT 'mine,rows -1422,rows 100,bad' AS v", """CREATE FUNCTION g(k NUMBER) RETURN VARCHAR2 IS mine EXCEPTION; x NUMBER; BEGIN
    IF k = 1 THEN RAISE mine; ELSIF k = 2 THEN SELECT r_regionkey INTO x FROM region; ELSIF k = 3 THEN SELECT r_regionkey INTO x FROM region WHERE r_regionkey = 99; END IF;
    RAISE_APPLICATION_ERROR(-20001, 'bad'); EXCEPTION WHEN mine THEN RETURN 'mine'; WHEN TOO_MANY_ROWS OR NO_DATA_FOUND THEN RETURN 'rows ' || SQLCODE; WHEN OTHERS THEN RETURN SQLERRM; END;
/
CREATE FUNCTION f RETURN VARCHAR2 IS BEGIN RETURN g(1) || ',' || g(2) || ',' || g(3) || ',' || g(4); END;""")
routine("plsql_raise_again", "SELECT 'outer ZERO' AS v", """CREATE FUNCTION f RETURN VARCHAR2 IS x NUMBER; BEGIN BEGIN x := 1 / 0; EXCEPTION WHEN ZERO_DIVIDE THEN RAISE; END; RETURN 'no';
    EXCEPTION WHEN ZERO_DIVIDE THEN RETURN 'outer ZERO'; END;""")
routine("plsql_package_state", "SELECT '6,11' AS v", """CREATE PACKAGE p IS n NUMBER := 1; FUNCTION bump RETURN NUMBER; END;
/
CREATE PACKAGE BODY p IS hidden NUMBER := 10; FUNCTION bump RETURN NUMBER IS BEGIN n := n + hidden; RETURN n; END; BEGIN hidden := 5; END;
/
CREATE FUNCTION f RETURN VARCHAR2 IS a NUMBER; b NUMBER; BEGIN a := p.bump; b := p.bump; RETURN a || ',' || b; END;""")
routine("plsql_collections", "SELECT '333xy1' AS v", """CREATE FUNCTION f RETURN VARCHAR2 IS TYPE v IS VARRAY(3) OF NUMBER; TYPE m IS TABLE OF NUMBER INDEX BY VARCHAR2(9); a v := v(1, 2); b m; s VARCHAR2(99); BEGIN
    a.EXTEND; a(3) := 7; b('y') := 1; b('x') := 2; s := a.COUNT || a.LAST || a.LIMIT || b.FIRST || b.NEXT('x'); b.DELETE('x'); RETURN s || b.COUNT; END;""")
routine("plsql_bulk_collect", "SELECT string_agg(n_name, ' ' ORDER BY n_nationkey) AS v FROM nation WHERE n_regionkey = 3", """CREATE FUNCTION f RETURN VARCHAR2 IS TYPE t IS TABLE OF VARCHAR2(30); names t; s VARCHAR2(999) := ''; BEGIN
    SELECT n_name BULK COLLECT INTO names FROM nation WHERE n_regionkey = 3 ORDER BY n_nationkey; FOR i IN 1 .. names.COUNT LOOP s := s || names(i) || ' '; END LOOP; RETURN TRIM(s); END;""")
routine("plsql_dynamic_sql", "SELECT CAST(COUNT(*) AS VARCHAR) AS v FROM nation WHERE n_regionkey > 2", "CREATE FUNCTION f RETURN NUMBER IS n NUMBER; BEGIN EXECUTE IMMEDIATE 'SELECT COUNT(*) FROM nation WHERE n_regionkey > :1' INTO n USING 2; RETURN n; END;")


@made("plsql_forall", "SELECT r_regionkey, CASE WHEN r_regionkey BETWEEN 1 AND 3 THEN 'r' || r_regionkey ELSE r_name END AS r_name FROM region")
def plsql_forall(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(engine(spark, sf_dir))
    s.run("CREATE PROCEDURE g IS BEGIN FORALL i IN 1 .. 3 UPDATE region SET r_name = 'r' || i WHERE r_regionkey = i; END;")
    s.call("g")
    return s.engine.sql("SELECT r_regionkey, r_name FROM region")


@made("plsql_rollback", "SELECT r_regionkey, r_name FROM region")
def plsql_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(engine(spark, sf_dir))
    s.run("CREATE PROCEDURE g IS BEGIN UPDATE region SET r_name = 'gone'; DELETE FROM region WHERE r_regionkey = 1; ROLLBACK; END;")
    s.call("g")
    return s.engine.sql("SELECT r_regionkey, r_name FROM region")


@made("htp_page", "SELECT '<html>' || chr(10) || 'a' || chr(10) || '1</html>' || chr(10) AS page")
def htp_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(engine(spark, sf_dir))
    s.run("CREATE PROCEDURE page IS BEGIN htp.init; htp.htmlOpen; HTP.P('a'); htp.prn(1); htp.htmlClose; END;")
    s.call("page")
    return values(spark, page=s.flush())


# dictionary and definitions


def with_dictionary(spark: SparkSession, sf_dir: str):
    e = engine(spark, sf_dir)
    e.catalog.constraints["MAIN", "NATION"] = [constraints.Constraint("PK_NATION", "P", ("n_nationkey",)), constraints.Constraint("FK_REGION", "R", ("n_regionkey",), target="region", target_columns=("r_regionkey",))]
    add_dictionary(spark, e.catalog)
    return e


COUNTED = ("region", "nation", "customer", "orders", "documents", "labels")


@made("dict_tables", " UNION ALL ".join(f"SELECT '{t.upper()}' AS table_name, COUNT(*) AS n FROM {t}" for t in COUNTED))
def dict_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary's tables beside the rows that each has."""
    counts = " UNION ALL ".join(f"SELECT '{t.upper()}' AS k, COUNT(*) AS n FROM {t}" for t in COUNTED)
    return with_dictionary(spark, sf_dir).sql(f"SELECT t.table_name, c.n FROM all_tables t, ({counts}) c WHERE t.owner = 'MAIN' AND c.k = t.table_name")


PROFILED = {"orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "documents": ("doc_id", "text", "lang", "source", "n_chars")}


@made("dict_columns", " UNION ALL ".join(f"SELECT '{t.upper()}' AS table_name, '{c.upper()}' AS column_name, {i} AS column_id, COUNT({c}) AS filled, COUNT(DISTINCT {c}) AS kinds, MAX(CASE WHEN typeof({c}) = 'BIGINT' THEN 'bigint' WHEN typeof({c}) = 'VARCHAR' THEN 'string' WHEN typeof({c}) = 'DOUBLE' THEN 'double' WHEN typeof({c}) = 'INTEGER' THEN 'int' ELSE 'timestamp_ntz' END) AS data_type FROM {t}" for t, cs in PROFILED.items() for i, c in enumerate(cs, 1)))
def dict_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile of each column of some tables, by what the dictionary says they have."""
    e = with_dictionary(spark, sf_dir)
    profile = " UNION ALL ".join(f"SELECT '{t.upper()}' AS t, '{c.upper()}' AS c, COUNT({c}) AS filled, COUNT(DISTINCT {c}) AS kinds FROM {t}" for t, cs in PROFILED.items() for c in cs)
    return e.sql(f"SELECT d.table_name, d.column_name, d.column_id, p.filled, p.kinds, d.data_type FROM all_tab_columns d JOIN ({profile}) p ON p.t = d.table_name AND p.c = d.column_name")


@made("dict_constraints", "SELECT 'PK_NATION' AS constraint_name, 'P' AS kind, 'N_NATIONKEY' AS column_name, NULL AS target, COUNT(DISTINCT n_nationkey) AS kinds FROM nation UNION ALL SELECT 'FK_REGION', 'R', 'N_REGIONKEY', 'REGION', COUNT(DISTINCT n_regionkey) FROM nation")
def dict_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints by the dictionary, beside how many values their columns hold."""
    return with_dictionary(spark, sf_dir).sql("""SELECT c.constraint_name, c.constraint_type AS kind, k.column_name, c.r_table_name AS target, v.kinds
        FROM all_constraints c JOIN all_cons_columns k ON c.constraint_name = k.constraint_name AND c.table_name = k.table_name
        JOIN (SELECT 'N_NATIONKEY' AS col, COUNT(DISTINCT n_nationkey) AS kinds FROM nation UNION ALL SELECT 'N_REGIONKEY', COUNT(DISTINCT n_regionkey) FROM nation) v ON v.col = k.column_name""")


@made("ddl_create_table", "SELECT n_nationkey AS id, n_name AS nm, 'new' AS state FROM nation")
def ddl_create_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.catalog.add_schema("hr")
    e.create_table("hr.places", [("id", "INTEGER"), ("nm", "VARCHAR2(40)"), ("state", "VARCHAR2(9)")], required=("id",), defaults={"state": "'new'"})
    return e.sql("INSERT INTO hr.places (id, nm) SELECT n_nationkey, n_name FROM nation")


@made("ddl_empty_view", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 300000")
def ddl_empty_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.create_empty_view("dear", [("k", "NUMBER(19)"), ("p", "BINARY_DOUBLE")])
    e.create_view("dear", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 300000")
    return e.sql("SELECT k, p FROM dear")


@made("seq_nextval", "SELECT o_orderkey, 1000 + 10 * (row_number() OVER (ORDER BY o_orderkey) - 1) AS id FROM orders")
def seq_nextval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    ids = e.catalog.add_sequence("order_ids", 1000, 10)
    return ids.numbered(e.sql("SELECT o_orderkey FROM orders"), "id", ["o_orderkey"]).select("o_orderkey", "id")


# queue documents


@made("aq_signature_accessors", "SELECT event_id, 'RSA' AS algorithm, CAST(user_id AS VARCHAR) AS signer, event_type ILIKE 'click' AS valid, TRUE AS uses_rsa, FALSE AS has_value FROM events")
def aq_signature_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    status = F.when(F.lower("event_type") == "click", "valid").otherwise("invalid")
    j = queues.signature(F.lit("RSA"), F.lit("d"), F.lit(None).cast("string"), F.col("user_id").cast("string"), status, F.lit("2024-01-02 03:04:05"))
    c, g = F.col("j"), queues.SIGNATURE
    return e.select("event_id", j.alias("j")).select(
        "event_id", g["get_algorithm"](c).alias("algorithm"), g["get_signer"](c).alias("signer"), g["is_signature_valid"](c).alias("valid"), g["uses_algorithm"](c, "rsa").alias("uses_rsa"), g["has_signature_value"](c).alias("has_value")
    )


@made("aq_recipients_whole", "SELECT c_custkey, 25 AS n, 'a25' AS last_name FROM customer")
def aq_recipients_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    texts = F.transform(F.sequence(F.lit(1), F.lit(25)), lambda i: F.concat(F.lit("a"), i.cast("string"), F.lit("@x.org")))
    m, j, g = c.select("c_custkey", queues.recipients(texts).alias("j")), F.col("j"), queues.RECIPIENTS
    return m.select("c_custkey", g["count"](j).alias("n"), F.element_at(g["get_names"](j), -1).alias("last_name"))


# counts, transfer, phases


@made("rowcount_statistics", "SELECT COUNT(*) AS n_rows, 'statistics' AS method FROM orders")
def rowcount_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics as an earlier count of the table left them."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    counter = rowcount.Counter(rowcount.Settings(method="STATISTICS_ONLY"))
    return counter.count(orders, rowcount.Statistics(num_rows=rowcount.exact(orders).first().n_rows, modifications=1)).select(F.col("n_rows").cast("long").alias("n_rows"), "method")


@made("rowcount_segment", "SELECT CAST(SUM(strlen(c_name)) // MAX(strlen(c_name)) AS BIGINT) AS by_bytes, COUNT(*) AS by_count, CAST(floor(COUNT(*) * 8192 * 0.8 / MAX(strlen(c_name))) AS BIGINT) AS by_blocks, TRUE AS old, FALSE AS fresh FROM customer")
def rowcount_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates from sizes that are measured on a table."""
    s, n = rowcount.Statistics, F.octet_length("c_name")
    m = spark.read.parquet(f"{sf_dir}/customer.parquet").agg(F.sum(n).alias("bytes"), F.max(n).alias("longest"), F.count(F.lit(1)).alias("rows")).first()
    by = [rowcount.from_segment(x) for x in (s(bytes=m.bytes, avg_row_len=m.longest), s(num_rows=m.rows), s(blocks=m.rows, avg_row_len=m.longest))]
    return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in zip(("by_bytes", "by_count", "by_blocks"), by)], F.lit(rowcount.stale(s(m.rows, 5 * m.rows))).alias("old"), F.lit(rowcount.stale(s(m.rows, m.rows // 10))).alias("fresh"))


@made("rowcount_sampling_near", "SELECT TRUE AS near")
def rowcount_sampling_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    a, b = rowcount.sampled(t, 20).withColumnRenamed("n_rows", "a"), rowcount.exact(t).withColumnRenamed("n_rows", "b")
    return a.join(b).select((F.abs(F.col("a") - F.col("b")) * 5 <= F.col("b")).alias("near"))


@made("transfer_convert", "SELECT doc_id, CAST(to_json({'lang': lang, 'source': source}) AS VARCHAR) AS o, '\\x' || lower(hex(encode(lang))) AS b, CAST(n_chars AS BIGINT) AS n FROM documents")
def transfer_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return planner.plan(d.select("doc_id", F.struct("lang", "source").alias("o"), F.encode("lang", "utf-8").alias("b"), F.col("n_chars").cast("long").alias("n")))


@made("transfer_shapes", "SELECT 'nation' AS table_name, 'simple' AS shape, 0 AS complex, COUNT(*) AS n FROM nation UNION ALL SELECT 'embeddings', 'mixed', 1, COUNT(*) FROM embeddings")
def transfer_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each table would be transferred, and the rows that there are."""
    out = None
    for t in ("nation", "embeddings"):
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        a = planner.analyse(df.schema)
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), F.lit(a.shape).alias("shape"), F.lit(a.complex).cast("int").alias("complex"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@made("job_phases", "SELECT '[\"EXTRACT\", \"TRANSFER\"]' AS ran, 100 AS percent, 'DONE' AS state")
def job_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen: list[str] = []
    m = Migration({p: (lambda ctx, p=p: seen.append(p)) for p in ("TRANSFER", "EXTRACT")})
    m.run()
    return values(spark, ran=json.dumps(seen), percent=int(m.percent), state=m.state)


@made("constraint_order", "SELECT 0 AS place, 'p' AS name, COUNT(*) AS bad FROM (SELECT n_regionkey FROM nation GROUP BY n_regionkey HAVING COUNT(*) > 1) UNION ALL SELECT 1, 'c', COUNT(*) FROM nation WHERE n_nationkey < 5 UNION ALL SELECT 2, 'f', COUNT(DISTINCT n_nationkey) FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)")
def constraint_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints are checked in an order of their own, each with the rows or keys that break it."""
    c = constraints
    given = [c.Constraint("f", "R", ("n_nationkey",), target="region", target_columns=("r_regionkey",)), c.Constraint("c", "C", condition="n_nationkey >= 5"), c.Constraint("p", "P", ("n_regionkey",))]
    out = None
    for i, o in enumerate(c.validate(engine(spark, sf_dir), "nation", given)):
        row = o.violations.agg(F.count(F.lit(1)).alias("bad")).select(F.lit(i).alias("place"), F.lit(o.constraint.name).alias("name"), "bad")
        out = row if out is None else out.unionByName(row)
    return out


@made("index_advice", "SELECT * FROM (VALUES ('a', 'sort files by x'), ('b', 'not supported: bitmap'), ('d', 'covered by a constraint'), ('e', 'bloom filter on u')) v(index_name, advice)")
def index_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = constraints
    got = c.index_advice([c.Index("a", ("x",)), c.Index("b", ("y",), "BITMAP"), c.Index("d", ("id",)), c.Index("e", ("u",), unique=True)], [c.Constraint("p", "P", ("ID",))])
    return spark.createDataFrame([tuple(x) for x in got], "index_name string, advice string")
