"""The front end: what parses, what it becomes, and what is refused."""

import pytest

from oriel.catalog import Catalog, CollectionType, ResolutionError, normal, quoted
from oriel.engine import Engine
from oriel.sql.formats import date_pattern, is_number_format
from oriel.sql.lexer import UnsupportedSyntax, tokens
from oriel.sql.parser import parse_query
from oriel.types import UnknownType, field, spark_type
from pyspark.sql import types as T


@pytest.fixture()
def engine(spark):
    e = Engine(spark)
    e.catalog.add_table("emp", spark.createDataFrame([(1, "ann", None, 10.0), (2, "bob", 1, 20.0), (3, "cat", 1, None), (4, "dan", 2, 20.0)], "id int, nm string, boss int, pay double"))
    e.catalog.add_table("dept", spark.createDataFrame([(1, "x"), (9, "y")], "id int, dn string"))
    return e


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_tokens():
    got = [(t.kind, t.text) for t in tokens("q'[a'b]' \"X y\" 1.5e3 :b <> a(+) -- c\n/* d */ 'it''s' 1..3")]
    assert got[:-1] == [("string", "a'b"), ("quoted", "X y"), ("number", "1.5e3"), ("bind", "b"), ("op", "<>"), ("name", "a"), ("op", "(+)"), ("string", "it's"), ("number", "1"), ("op", ".."), ("number", "3")]


@pytest.mark.parametrize(
    "text",
    [
        "SELECT 1 FROM t MODEL DIMENSION BY (x) MEASURES (y) RULES ()",
        "SELECT * FROM t AS OF x",
        "SELECT * FROM XMLTABLE('x')",
        "SELECT a b c FROM t",
        "SELECT * FROM t PIVOT XML (COUNT(*) FOR x IN (ANY))",
        "SELECT FROM t",
        "SELECT 1 FROM t WHERE a IS OF TYPE (x)",
    ],
)
def test_refused(text):
    with pytest.raises(UnsupportedSyntax):
        parse_query(text)


def test_unknown_names_are_refused(engine):
    for text in ("SELECT frobnicate(id) FROM emp", "SELECT TO_CHAR(SYSDATE, 'YYYY-XX') FROM dual", "SELECT id FROM emp WHERE ROWNUM > 3", "SELECT CLUSTER_ID(id) FROM emp"):
        with pytest.raises(UnsupportedSyntax):
            engine.translate(text)
    with pytest.raises(ResolutionError):
        engine.translate("SELECT 1 FROM nowhere")


def test_nulls_are_placed_as_in_oracle(engine):
    assert [r[0] for r in rows(engine.sql("SELECT id FROM emp ORDER BY pay, id"))] == [1, 2, 4, 3]
    assert [r[0] for r in rows(engine.sql("SELECT id FROM emp ORDER BY pay DESC, id"))] == [3, 2, 4, 1]


def test_ties_and_percent(engine):
    assert len(rows(engine.sql("SELECT id FROM emp ORDER BY pay DESC NULLS LAST FETCH FIRST 1 ROWS WITH TIES"))) == 2
    assert rows(engine.sql("SELECT id FROM emp ORDER BY id FETCH FIRST 50 PERCENT ROWS ONLY")) == [(1,), (2,)]


def test_outer_marks(engine):
    got = rows(engine.sql("SELECT e.id, d.dn FROM emp e, dept d WHERE e.id = d.id(+) AND d.dn(+) = 'x' AND e.id < 3 ORDER BY 1"))
    assert got == [(1, "x"), (2, None)]
    with pytest.raises(UnsupportedSyntax):
        engine.translate("SELECT 1 FROM emp e, dept d WHERE e.id(+) = d.id(+)")


def test_hierarchies(engine):
    got = rows(engine.sql("SELECT nm, LEVEL, SYS_CONNECT_BY_PATH(nm, '/') FROM emp START WITH boss IS NULL CONNECT BY PRIOR id = boss ORDER SIBLINGS BY nm"))
    assert got == [("ann", 1, "/ann"), ("bob", 2, "/ann/bob"), ("dan", 3, "/ann/bob/dan"), ("cat", 2, "/ann/cat")]
    engine.sql("UPDATE emp SET boss = 4 WHERE id = 1")
    assert len(rows(engine.sql("SELECT id FROM emp START WITH id = 1 CONNECT BY NOCYCLE PRIOR id = boss"))) == 4


def test_quantifiers_and_empty_sets(engine):
    assert len(rows(engine.sql("SELECT id FROM emp WHERE id > ALL (SELECT id FROM dept WHERE id > 100)"))) == 4
    assert rows(engine.sql("SELECT id FROM emp WHERE id >= ALL (SELECT boss FROM emp)")) == []
    assert rows(engine.sql("SELECT id FROM emp WHERE id < ANY (SELECT id FROM dept WHERE dn = 'x')")) == []


def test_set_operators_bind_left(engine):
    text = "SELECT 1 AS k FROM dual UNION ALL SELECT 1 FROM dual MINUS SELECT 2 FROM dual"
    assert rows(engine.sql(text)) == [(1,)]


def test_dml(engine):
    engine.sql("INSERT INTO dept (id, dn) VALUES (3, 'z')")
    engine.sql("UPDATE dept SET dn = (SELECT MAX(nm) FROM emp) WHERE id = 1")
    engine.sql("DELETE FROM dept WHERE NULLIF(id, 3) = 9")
    assert sorted(rows(engine.sql("SELECT id, dn FROM dept"))) == [(1, "dan"), (3, "z")]
    engine.sql("MERGE INTO dept d USING (SELECT id, nm FROM emp) e ON (d.id = e.id) WHEN MATCHED THEN UPDATE SET d.dn = e.nm WHERE e.id > 1 DELETE WHERE d.dn = 'cat' WHEN NOT MATCHED THEN INSERT (id, dn) VALUES (e.id, e.nm) WHERE e.id = 4")
    assert sorted(rows(engine.sql("SELECT id, dn FROM dept"))) == [(1, "dan"), (4, "dan")]
    with pytest.raises(LookupError):
        engine.sql("UPDATE dept SET nope = 1")


def test_binds_and_dynamic_sql(engine):
    assert rows(engine.sql("SELECT nm FROM emp WHERE id = :n", {"n": 2})) == [("bob",)]
    assert rows(engine.execute_immediate("SELECT nm FROM emp WHERE id = :1 OR nm = :2", 1, "dan")) == [("ann",), ("dan",)]


def test_varray_limits_fold(engine):
    engine.catalog.add_type("t_small", CollectionType("T_SMALL", T.IntegerType(), limit=10))
    assert "false" in engine.translate("SELECT id FROM emp WHERE t_small.LIMIT > 10")
    with pytest.raises(ResolutionError):
        engine.translate(f"SELECT t_small({', '.join('1' * 11)}) FROM dual")


def test_types():
    assert spark_type("NUMBER(10,2)") == T.DecimalType(10, 2) and spark_type("number") == T.DecimalType(38, 10)
    assert spark_type("TIMESTAMP(6) WITH TIME ZONE") == T.TimestampType() and spark_type("DATE") == T.TimestampNTZType()
    assert spark_type("SYS.AQ$_SIG_PROP").fieldNames()[0] == "signature_type" and spark_type("LONG RAW") == T.BinaryType()
    assert field("x", "VARCHAR2(30 CHAR)").metadata["length"] == 30
    with pytest.raises(UnknownType):
        spark_type("WIDGET")


def test_names():
    c = Catalog()
    c.add_synonym("MAIN", "s", "OTHER", "t")
    with pytest.raises(ResolutionError, match="not there"):
        c.resolve("s")
    c.add_synonym("MAIN", "s", "OTHER", "u")
    with pytest.raises(ResolutionError, match="2 synonyms"):
        c.resolve("s")
    assert normal('"aB"') == "aB" and normal("ab") == "AB" and quoted("order") == "`order`" and quoted("a b") == "`a b`"


def test_synonyms_and_row_types(engine):
    engine.catalog.add_synonym("PUBLIC", "people", "MAIN", "emp")
    assert engine.sql("SELECT COUNT(*) FROM people").first()[0] == 4
    assert engine.catalog.spark_type("emp%ROWTYPE").fieldNames() == ["id", "nm", "boss", "pay"]
    assert engine.catalog.spark_type("people.pay%TYPE") == T.DoubleType()


def test_formats():
    assert date_pattern('DD"th of" MON YYYY HH24:MI:SS.FF3') == "dd'th of' MMM yyyy HH:mm:ss.SSS"
    assert is_number_format("FM9,990.00") and not is_number_format("YYYY")
