"""XML row sources against Python's own parser, and the SQL that uses them."""

import random
import xml.etree.ElementTree as ET

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oriel.engine import Engine
from oriel.functions import xml
from oriel.functions.xml import BadPath, XmlColumn
from oriel.sql.lexer import UnsupportedSyntax


def docs_of(n):
    r = random.Random(n)
    out = []
    for _ in range(n):
        items = "".join(
            f"<item id='{r.randrange(99)}'" + (f" s='{r.choice('xy')}'" if r.random() < 0.6 else "") + ">"
            + (f"<p>{r.randrange(10)}.50</p>" if r.random() < 0.7 else "") + (f"<sub><q k='{r.randrange(5)}'>t &amp; {r.randrange(9)}</q></sub>" if r.random() < 0.5 else "") + "</item>"
            for _ in range(r.randrange(5))
        )
        out.append(r.choice(["", "<?xml version='1.0'?>\n", "<!-- <no> -->"]) + f"<{r.choice(['all', 'all', 'other'])} v='{r.randrange(9)}'><list>{items}</list><list>{items[: items.find('</item>') + 7]}</list></all>".replace("</all>", "</all>"))
    return [d if "<all " in d else d.replace("</all>", "</other>") for d in out] + [None, "<all v='1'/>", "<all2/>"]


def test_rows_and_values_are_those_of_a_plain_parser(spark):
    docs = docs_of(60)
    df = spark.createDataFrame(list(enumerate(docs)), "k int, doc string").repartition(4)
    columns = [XmlColumn("n", None), XmlColumn("id", "int", "@id"), XmlColumn("s", "string", "@s", "'none'"), XmlColumn("p", "decimal(5,2)"), XmlColumn("q", "string", "sub/q"), XmlColumn("kk", "int", "sub/q/@k")]
    want, some = [], []
    for k, d in enumerate(docs):
        top = ET.fromstring(d) if d else None
        rows = top.findall("./list/item") if top is not None and top.tag == "all" else []
        for i, e in enumerate(rows, 1):
            q = e.find("sub/q")
            want.append((k, i, int(e.get("id")), e.get("s", "none"), e.findtext("p"), None if q is None else q.text, None if q is None else int(q.get("k"))))
        some += [(k, int(e.get("id"))) for e in rows if e.get("s") == "x" and e.find("sub/q") is not None and e.find("sub/q").get("k") is not None]
    got = xml.xml_table(df, "doc", "/all/list/item", columns)
    assert got.columns == ["k", "doc", "n", "id", "s", "p", "q", "kk"]
    order = lambda r: tuple(map(str, r))
    assert sorted([(r.k, r.n, r.id, r.s, None if r.p is None else str(r.p), r.q, r.kk) for r in got.collect()], key=order) == sorted(want, key=order)
    hit = xml.xml_table(df, "doc", "all/list/item[@s='x']/sub/q", [XmlColumn("k1", "int", "@k"), XmlColumn("text", "string", ".")])
    assert hit.count() == len(some)
    outer = xml.xml_table(df, "doc", "/all/list/item", [XmlColumn("id", "int", "@id")], outer=True)
    assert outer.count() == len(want) + len(docs) - len({w[0] for w in want})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1 or plan.count("xmltostructs") == 1


def test_what_is_refused(spark):
    df = spark.createDataFrame([("<a><b><p>1</p><p>2</p></b></a>", 1), ("<a><b>", 2)], "doc string, k int")
    with pytest.raises(Exception, match="more than one item at p"):
        xml.xml_table(df.where("k = 1"), "doc", "/a/b", [XmlColumn("p")]).collect()
    with pytest.raises(Exception, match="MALFORMED"):
        xml.xml_table(df.where("k = 2"), "doc", "/a/b", [XmlColumn("p")]).collect()
    for path in ("//b", "/a/*", "/a[1]/b", "", "/a/b[p>1]"):
        with pytest.raises(BadPath):
            xml.xml_table(df, "doc", path, [XmlColumn("p")])
    with pytest.raises(BadPath):
        xml.xml_table(df, "doc", "/a/b", [XmlColumn("p", "int", "../x")])
    with pytest.raises(ValueError, match="there already"):
        xml.xml_table(df, "doc", "/a/b", [XmlColumn("K")])
    with pytest.raises(ValueError, match="element name"):
        xml.element("1a")


def test_markup_is_escaped_and_nulls_left_out(spark):
    df = spark.createDataFrame([("a<b>&\"c", None)], "x string, y string")
    made = df.select(xml.element("e", xml.escaped(F.col("x")), F.col("y"), attributes={"p": F.col("x"), "q": F.col("y")}).alias("e"), xml.forest(x=F.col("x"), y=F.col("y")).alias("f")).first()
    top = ET.fromstring(made.e)
    assert top.text == 'a<b>&"c' and top.attrib == {"p": 'a<b>&"c'} and made.f == '<x>a&lt;b&gt;&amp;"c</x>'


@pytest.fixture()
def e(spark):
    out = Engine(spark)
    out.catalog.add_table("t", spark.range(0, 40, numPartitions=5).selectExpr("id AS a", "cast(id % 3 AS INT) AS b", "if(id % 2 = 0, concat('n<', id), null) AS c"))
    return out


def test_aggregates_keep_their_order(e):
    for order, descending in (("a DESC", True), ("a", False)):
        for r in e.sql(f'SELECT b, XMLAGG(XMLELEMENT("i", a) ORDER BY {order}) AS x FROM t GROUP BY b').collect():
            assert r.x == "".join(f"<i>{i}</i>" for i in sorted((i for i in range(40) if i % 3 == r.b), reverse=descending))
    r = e.sql('SELECT XMLAGG(XMLFOREST(c AS "c") ORDER BY b, a DESC) AS x, XMLAGG(XMLELEMENT("i", a)) AS y FROM t WHERE a < 6').first()
    assert r.x == "<c>n&lt;0</c><c>n&lt;4</c><c>n&lt;2</c>" and r.y == "".join(f"<i>{i}</i>" for i in range(6))
    assert e.sql('SELECT XMLAGG(XMLELEMENT("i", a)) AS x FROM t WHERE a < 0').first().x is None


def test_sql_row_source(e):
    doc = 'SELECT b, XMLELEMENT("l", XMLAGG(XMLELEMENT("i", XMLATTRIBUTES(a AS "id"), XMLFOREST(c)) ORDER BY a)) AS d FROM t GROUP BY b'
    got = e.sql(f"SELECT x.b, i.n, i.id, i.c, i.z FROM ({doc}) x, XMLTABLE('/l/i' PASSING x.d COLUMNS n FOR ORDINALITY, id INTEGER PATH '@id', c VARCHAR2(20), z INTEGER PATH 'none' DEFAULT x.b * 10) i").collect()
    assert sorted((r.b, r.n, r.id, r.c, r.z) for r in got if r.c) == sorted((i % 3, i // 3 + 1, i, f"n<{i}", i % 3 * 10) for i in range(0, 40, 2)) and len(got) == 40
    assert e.sql(f"SELECT COUNT(*) AS n FROM ({doc}) x WHERE XMLEXISTS('/l/i[@id = 4]' PASSING x.d)").first().n == 1
    assert e.sql(f"SELECT XMLQUERY('/l/i/@id' PASSING x.d RETURNING CONTENT) AS q FROM ({doc}) x WHERE x.b = 2").first().q == " ".join(str(i) for i in range(2, 40, 3))
    for bad in ("SELECT * FROM t, XMLTABLE('//i' PASSING t.c COLUMNS id INTEGER PATH '@id') x", "SELECT XMLQUERY('/a/b' PASSING c RETURNING CONTENT) AS q FROM t", "SELECT XMLFOREST(a + 1) AS f FROM t"):
        with pytest.raises(UnsupportedSyntax):
            e.sql(bad)


def test_documents_are_opened_once_and_then_joined(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS c_custkey, 'C' || i AS c_name, CASE WHEN i % 7 > 0 THEN CAST(i % 5 AS INTEGER) END AS c_nationkey FROM range(300) t(i)) TO '{tmp_path}/customer.parquet'")
    con.execute(f"COPY (SELECT i * 37 - 3000 AS s_suppkey, CASE WHEN i % 11 > 0 THEN 'S <' || i || '>' END AS s_name, CASE WHEN i % 13 > 0 THEN CAST(i % 3 AS INTEGER) END AS s_nationkey FROM range(1000) t(i)) TO '{tmp_path}/supplier.parquet'")
    for t in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = entry.queries()["xml_row_source"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()['xml_row_source']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
    assert len(want) > 20000 and sum(r[2] is None for r in want) > 100
    # a document is parsed below the join, not again for each of its nation's customers
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1 and plan.index("Join LeftOuter") < plan.index("from_xml")
