"""Routines on the driver."""

import pytest

from oriel.engine import Engine
from oriel.plsql.parser import parse_unit
from oriel.plsql.runtime import PlsqlError, Session
from oriel.sql.lexer import UnsupportedSyntax


@pytest.fixture()
def session(spark):
    e = Engine(spark)
    e.catalog.add_table("emp", spark.createDataFrame([(i, f"n{i}", i % 2) for i in range(6)], "id int, nm string, dept int"))
    return Session(e)


def test_recursion_and_out_parameters(session):
    session.run("CREATE FUNCTION fact(n IN NUMBER) RETURN NUMBER IS BEGIN IF n <= 1 THEN RETURN 1; END IF; RETURN n * fact(n - 1); END;")
    assert session.call("fact", 10) == 3628800
    session.run("CREATE PROCEDURE both(a IN NUMBER, b OUT NUMBER, c IN OUT NUMBER) IS BEGIN b := a + 1; c := c * 2; END;")
    session.run("CREATE FUNCTION f RETURN NUMBER IS x NUMBER; y NUMBER := 5; BEGIN both(1, x, y); RETURN x * 100 + y; END;")
    assert session.call("f") == 210


def test_control_flow(session):
    session.run("""CREATE FUNCTION f RETURN VARCHAR2 IS s VARCHAR2(100) := ''; i NUMBER := 0; BEGIN
        <<outer>> FOR a IN 1 .. 3 LOOP FOR b IN REVERSE 1 .. 3 LOOP CONTINUE WHEN b = 2; EXIT outer WHEN a = 3; s := s || a || b || ' '; END LOOP; END LOOP;
        WHILE i < 3 LOOP i := i + 1; END LOOP; LOOP i := i + 1; EXIT WHEN i > 5; END LOOP;
        CASE i WHEN 6 THEN s := s || 'six'; ELSE s := s || 'no'; END CASE; RETURN s; END;""")
    assert session.call("f") == "13 11 23 21 six"


def test_cursors(session):
    session.run("""CREATE FUNCTION f RETURN VARCHAR2 IS CURSOR c(d NUMBER) IS SELECT id, nm FROM emp WHERE dept = d ORDER BY id; r c%ROWTYPE; s VARCHAR2(99) := ''; BEGIN
        OPEN c(1); LOOP FETCH c INTO r; EXIT WHEN c%NOTFOUND; s := s || r.nm; END LOOP; s := s || c%ROWCOUNT; CLOSE c;
        FOR x IN c(0) LOOP s := s || x.id; END LOOP; RETURN s; END;""")
    assert session.call("f") == "n1n3n53024"
    session.run("CREATE PROCEDURE g IS CURSOR c IS SELECT id FROM emp; k NUMBER; BEGIN FETCH c INTO k; END;")
    with pytest.raises(PlsqlError, match="INVALID_CURSOR"):
        session.call("g")


def test_exceptions(session):
    session.run("""CREATE FUNCTION f(k NUMBER) RETURN VARCHAR2 IS mine EXCEPTION; x NUMBER; BEGIN
        IF k = 1 THEN RAISE mine; ELSIF k = 2 THEN SELECT id INTO x FROM emp; ELSIF k = 3 THEN SELECT id INTO x FROM emp WHERE id = 99; ELSIF k = 4 THEN x := 1 / 0; END IF;
        RAISE_APPLICATION_ERROR(-20001, 'bad'); EXCEPTION WHEN mine THEN RETURN 'mine'; WHEN TOO_MANY_ROWS OR NO_DATA_FOUND THEN RETURN 'rows ' || SQLCODE; WHEN ZERO_DIVIDE THEN RAISE; WHEN OTHERS THEN RETURN SQLERRM; END;""")
    assert [session.call("f", k) for k in (1, 2, 3, 5)] == ["mine", "rows -1422", "rows 100", "bad"]
    with pytest.raises(PlsqlError, match="ZERO_DIVIDE"):
        session.call("f", 4)


def test_packages_keep_state_until_reset(session):
    session.run("CREATE PACKAGE p IS n NUMBER := 1; FUNCTION bump RETURN NUMBER; END;")
    session.run("CREATE PACKAGE BODY p IS hidden NUMBER := 10; FUNCTION bump RETURN NUMBER IS BEGIN n := n + hidden; RETURN n; END; BEGIN hidden := 5; END;")
    assert [session.call("p.bump"), session.call("p.bump")] == [6, 11]
    session.reset()
    assert session.call("p.bump") == 6
    assert Session(session.engine).packages == {}


def test_collections(session):
    session.run("""CREATE FUNCTION f RETURN VARCHAR2 IS TYPE v IS VARRAY(3) OF NUMBER; TYPE m IS TABLE OF NUMBER INDEX BY VARCHAR2(9); a v := v(1, 2); b m; s VARCHAR2(99); BEGIN
        a.EXTEND; a(3) := 7; b('y') := 1; b('x') := 2; s := a.COUNT || a.LAST || a.LIMIT || b.FIRST || b.NEXT('x'); b.DELETE('x'); RETURN s || b.COUNT; END;""")
    assert session.call("f") == "333xy1"
    session.run("CREATE PROCEDURE g IS TYPE v IS VARRAY(2) OF NUMBER; a v := v(1, 2); BEGIN a.EXTEND; END;")
    with pytest.raises(PlsqlError, match="SUBSCRIPT_OUTSIDE_LIMIT"):
        session.call("g")


def test_sql_in_routines_and_rollback(session):
    session.run("""CREATE FUNCTION f RETURN NUMBER IS TYPE t IS TABLE OF VARCHAR2(9); names t; n NUMBER; BEGIN
        UPDATE emp SET nm = 'q' WHERE id = 1; SELECT nm BULK COLLECT INTO names FROM emp WHERE id < 3 ORDER BY id; DBMS_OUTPUT.PUT_LINE(names(2));
        EXECUTE IMMEDIATE 'SELECT COUNT(*) FROM emp WHERE id > :1' INTO n USING 2; ROLLBACK; RETURN n; END;""")
    assert session.call("f") == 3 and session.output == ["q"]
    assert session.engine.sql("SELECT nm FROM emp WHERE id = 1").first()[0] == "n1"


def test_triggers(session):
    session.run("CREATE TRIGGER t BEFORE INSERT OR UPDATE OF nm ON emp FOR EACH ROW WHEN (NEW.id > 0) BEGIN IF INSERTING THEN :NEW.nm := UPPER(:NEW.nm); ELSIF UPDATING('nm') THEN :NEW.nm := :OLD.nm || :NEW.nm; END IF; END;")
    session.engine.sql("INSERT INTO emp VALUES (7, 'new', 1)")
    session.engine.sql("UPDATE emp SET nm = '!' WHERE id < 2")
    got = {r.id: r.nm for r in session.engine.sql("SELECT id, nm FROM emp").collect()}
    assert (got[7], got[0], got[1]) == ("NEW", "!", "n1!")
    session.run("CREATE TRIGGER u BEFORE DELETE OR INSERT ON emp FOR EACH ROW BEGIN DELETE FROM emp; END;")
    with pytest.raises(UnsupportedSyntax):
        session.engine.sql("INSERT INTO emp VALUES (8, 'x', 1)")


def test_pages(session):
    session.run("CREATE PROCEDURE page IS BEGIN htp.init; htp.htmlOpen; HTP.P('a'); htp.prn(1); htp.htmlClose; END;")
    session.call("page")
    assert session.flush() == "<html>\na\n1</html>\n"


@pytest.mark.parametrize("text", ["BEGIN GOTO x; END;", "CREATE TRIGGER t INSTEAD OF INSERT ON v BEGIN NULL; END;", "BEGIN x :=; END;", "BEGIN IF 1 THEN NULL; END;"])
def test_refused(text):
    with pytest.raises(UnsupportedSyntax):
        parse_unit(text)
