"""Change sets, logs of versions and triggers, against plain dictionaries of rows."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from oriel.catalog import ResolutionError
from oriel.engine import Engine
from oriel.operators.changes import ChangeSet
from oriel.operators.triggers import Lookup, RowTrigger, StatementTrigger
from oriel.operators.versions import Commit, SnapshotTooOld, TriggeredView, VersionedTable
from oriel.sql.lexer import UnsupportedSyntax


@pytest.fixture()
def t(spark):
    return VersionedTable.create(spark.range(0, 40, numPartitions=5).selectExpr("id AS a", "cast(id % 4 AS INT) AS b", "concat('n', id) AS c"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_every_version_is_that_of_plain_rows(spark, t):
    r = random.Random(3)
    now = {i: (i, i % 4, f"n{i}") for i in range(40)}
    versions, new = [dict(now)], 1000
    for step in range(6):
        b = r.randrange(5)
        if step % 3 == 0:
            done = t.update({"b": "b + 1", "c": "concat(c, b)"}, f"b = {b}")
            want = {k: (a, x + 1, f"{c}{x}") for k, (a, x, c) in now.items() if x == b}
        elif step % 3 == 1:
            done = t.delete(F.col("b") == b)
            want = {k: None for k, v in now.items() if v[1] == b}
        else:
            done = t.insert(spark.createDataFrame([(new + i, b) for i in range(7)], "A long, B int").repartition(3))
            want = {new + i: (new + i, b, None) for i in range(7)}
            new += 7
        counts = {"UPDATE": 0, "DELETE": 0, "INSERT": 0}
        for k, v in want.items():
            counts["INSERT" if k not in now else "DELETE" if v is None else "UPDATE"] += 1
        assert done.counts() == counts and done.count() == len(want) and done.version == step + 1
        assert rows(done.returning("a", "old.b", "new.b")) == sorted((((k if v else now[k][0]), now[k][1] if k in now else None, v[1] if v else None) for k, v in want.items()), key=repr)
        now = {k: v for k, v in (now | want).items() if v is not None}
        versions.append(dict(now))
        if step == 3:
            t.compact()
    for v, want in enumerate(versions):
        assert rows(t.as_of(v)) == sorted(want.values(), key=repr)
    ids = [x["__row"] for x in t.as_of(rows=True).collect()]
    assert len(set(ids)) == len(ids)
    again = VersionedTable.open(spark, t.folder)
    assert again.log == t.log and rows(again.as_of(2)) == sorted(versions[2].values(), key=repr)
    again.compact(keep_older=False)
    assert rows(VersionedTable.open(spark, t.folder).as_of()) == sorted(now.values(), key=repr)
    for bad in (0, 5, 7, -1):
        with pytest.raises(SnapshotTooOld):
            again.as_of(bad)
    with pytest.raises(SnapshotTooOld):
        again.changes(6)


def test_moments_and_images(spark):
    at = datetime(2024, 1, 1)
    t = VersionedTable.create(spark.range(6).withColumn("x", F.lit(0)), at=at)
    t.update({"x": "1"}, "id < 3")
    t.update({"x": "2"}, "id < 2")
    t.delete("id = 0")
    with pytest.raises(SnapshotTooOld):
        t.as_of(at=at - timedelta(seconds=1))
    assert t.as_of(at=at + timedelta(days=1)).agg(F.sum("x")).first()[0] == 0
    assert t.version_at(datetime.now(timezone.utc) + timedelta(days=1)) == 3
    got = sorted((r.id, r.x, r.versions_startscn or 0, r.versions_endscn or 99, r.versions_operation or "") for r in t.between().collect())
    assert got == [(0, 0, 0, 1, ""), (0, 1, 1, 2, "U"), (0, 2, 2, 3, "U"), (0, 2, 3, 99, "D"), (1, 0, 0, 1, ""), (1, 1, 1, 2, "U"), (1, 2, 2, 99, "U"), (2, 0, 0, 1, ""), (2, 1, 1, 99, "U"), *((i, 0, 0, 99, "") for i in (3, 4, 5))]
    assert t.between(2, 2).count() == 6
    assert t.changes(2).returning("id").count() == 2


def test_a_commit_that_another_writer_was_first_with_fails(spark, t):
    other = VersionedTable.open(spark, t.folder)
    other.update({"b": "9"}, "a = 1")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        t.delete("a = 2")
    assert t.version == 0 and VersionedTable.open(spark, t.folder).as_of().where("a = 2 OR b = 9").count() == 2


def test_odd_tables_and_statements(spark, t):
    empty = VersionedTable.create(spark.createDataFrame([], "a int, `b c` string"))
    assert empty.update({"a": "1"}).counts() == {"INSERT": 0, "UPDATE": 0, "DELETE": 0} and empty.as_of().columns == ["a", "b c"]
    empty.insert(spark.createDataFrame([(None, "x"), (None, "x")], "a int, `b c` string"))
    assert empty.delete("a IS NULL").count() == 2 and empty.as_of().count() == 0
    assert t.update({"b": "NULL"}, "NULL").count() == 0
    with pytest.raises(LookupError):
        t.update({"nothing": "1"})
    with pytest.raises(LookupError):
        t.insert(spark.range(1).toDF("nothing"))
    with pytest.raises(ValueError, match="old"):
        VersionedTable.create(spark.range(1).toDF("old"))
    t.required = ("c",)
    with pytest.raises(Exception, match="c takes no null"):
        t.insert(spark.range(1).toDF("a"))
    assert t.version == 2 - 1 and t.as_of().count() == 40


# triggers


def test_a_query_in_a_trigger_is_one_join(spark, t):
    names = spark.createDataFrame([(0, "zero"), (1, "one"), (2, "two"), (2, "deux")], "k int, name string")
    look = Lookup("found", names, {"k": "new.b"}, "name", missing="'nobody'")
    t.triggers.append(RowTrigger({"UPDATE"}, {"c": "found"}, when="new.b <> 2", lookups=(look,)))
    done = t.update({"a": "a + 100"}, "a < 8")
    assert dict(rows(done.returning("new.a", "c"))) == {100: "zero", 101: "one", 102: "n2", 103: "nobody", 104: "zero", 105: "one", 106: "n6", 107: "nobody"}
    assert t.triggers[0].apply(done.rows)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    for trigger, says in ((Lookup("found", names, {"k": "new.b"}, "name"), "NO_DATA_FOUND: found"), (Lookup("found", names, {"k": "2"}, "name"), "TOO_MANY_ROWS: found")):
        t.triggers[:] = [RowTrigger({"UPDATE"}, {"c": "found"}, lookups=(trigger,))]
        with pytest.raises(Exception, match=says):
            t.update({"a": "a"}, "b <> 2")
    t.triggers[:] = [RowTrigger({"INSERT"}, {"b": "n", "c": "concat(new.b, '/', n)"}, lookups=(Lookup("n", lambda: t.as_of(), {"b": "new.b"}, "count(*)", True, missing="0"),))]
    done = t.insert(spark.createDataFrame([(1, 1), (2, 77), (3, None)], "a long, b int"))
    assert rows(done.returning("a", "b", "c")) == [(1, 10, "10/10"), (2, 0, "0/0"), (3, 0, "0/0")]


def test_checks_columns_and_statement_triggers(spark, t):
    seen = []
    t.triggers += [
        RowTrigger({"UPDATE"}, {"c": "'renamed'"}, of={"B"}),
        RowTrigger({"DELETE"}, checks=(("old.a = 5", "row 5 stays"),)),
        StatementTrigger(lambda c: seen.append("before"), "BEFORE", {"DELETE"}),
        StatementTrigger(lambda c: seen.append(c.counts()["UPDATE"]), events={"UPDATE"}),
        StatementTrigger(lambda c: seen.append("of a"), events={"UPDATE"}, of={"a"}),
    ]
    assert rows(t.update({"a": "a"}, "a = 1").returning("c")) == [("n1",)]
    assert rows(t.update({"b": "b"}, "a < 3").returning("c")) == [("renamed",)] * 3
    assert t.update({"b": "b"}, "a < 0").count() == 0
    with pytest.raises(Exception, match="row 5 stays"):
        t.delete("a BETWEEN 4 AND 6")
    assert t.delete("a = 6").count() == 1
    assert seen == [1, "of a", 3, 0, "before", "before"]
    with pytest.raises(LookupError):
        RowTrigger(sets={"zz": "1"}).apply(t.changes(1).rows)


def test_views_change_by_their_triggers(spark, t):
    seen = []

    def renamed(c):
        seen.append(c.counts())
        t.update_from(c.rows.select("new.a", "new.c"), ["a"], ["c"])

    view = TriggeredView(lambda: t.as_of().where("b = 1").select("a", "c"), {"UPDATE": renamed, "INSERT": lambda c: t.insert(c.returning("a", "c").withColumn("b", F.lit(1)))})
    assert view.update({"c": "concat(c, '?')"}, "a < 10").count() == 3
    assert seen[0]["UPDATE"] == 3 and rows(t.as_of().where("c LIKE '%?'").select("a")) == [(1,), (5,), (9,)]
    view.insert(spark.createDataFrame([(100,)], "a long"))
    assert rows(view.rows().where("a >= 37")) == [(100, None), (37, "n37")]
    with pytest.raises(ValueError, match="takes no DELETE"):
        view.delete()
    with pytest.raises(LookupError):
        view.update({"b": "1"})
    with pytest.raises(ValueError, match="two source rows"):
        t.update_from(spark.createDataFrame([(1, "x"), (1, "y")], "a long, c string"), ["a"], ["c"])
    assert t.version == 2 and t.update_from(spark.createDataFrame([(None, "x")], "a long, c string"), ["a"], ["c"]).count() == 0
    with pytest.raises(LookupError):
        t.update_from(spark.range(1).toDF("a"), ["a"], ["zz"])


# statements


@pytest.fixture()
def e(spark):
    out = Engine(spark)
    out.catalog.add_table("t", spark.range(0, 30, numPartitions=4).selectExpr("id AS a", "cast(id % 3 AS INT) AS b", "cast(null AS string) AS c"))
    out.catalog.add_table("s", spark.createDataFrame([(1, 100), (2, 200), (99, 300)], "k long, v int"))
    return out


def test_returning(e):
    got = e.sql("UPDATE t x SET b = b + 10, c = 'x' || x.a WHERE x.a < 2 RETURNING x.a, old.b AS was, b, c || '!' AS d")
    assert rows(got) == [(0, 0, 10, "x0!"), (1, 1, 11, "x1!")] and got.columns == ["a", "was", "b", "d"]
    assert rows(e.sql("DELETE FROM t WHERE a = 1 RETURNING a, b")) == [(1, 11)]
    assert rows(e.sql("INSERT INTO t (a) SELECT k FROM s WHERE v > 150 RETURNING a, b, old IS NULL AS fresh")) == [(2, None, True), (99, None, True)]
    assert e.sql("SELECT COUNT(*) AS n, SUM(b) AS s FROM t").first()[:] == (31, 29 + 10)
    # a table with a log keeps it for statements without RETURNING
    e.sql("DELETE FROM t WHERE b = 0")
    assert e.versioned("t").version == 4 and e.sql("SELECT COUNT(*) AS n FROM t AS OF SCN 0").first().n == 30
    with pytest.raises(UnsupportedSyntax, match="INTO"):
        e.sql("DELETE FROM t RETURNING a INTO :x")


def test_merge_as_a_change_set(e):
    done = e.change("MERGE INTO t USING s ON (t.a = s.k) WHEN MATCHED THEN UPDATE SET b = s.v DELETE WHERE b >= 200 WHEN NOT MATCHED THEN INSERT (a, b) VALUES (s.k, s.v)")
    assert done.counts() == {"INSERT": 1, "UPDATE": 1, "DELETE": 1}
    assert rows(e.sql("SELECT a, b FROM t WHERE a IN (1, 2, 99)")) == [(1, 100), (99, 300)]
    e.catalog.add_table("u", e.sql("SELECT 5 AS k, 1 AS v FROM dual UNION ALL SELECT 5, 2 FROM dual"))
    with pytest.raises(ValueError, match="two source rows"):
        e.change("MERGE INTO t USING u ON (t.a = u.k) WHEN MATCHED THEN UPDATE SET b = u.v")
    assert e.versioned("t").version == 1
    only = e.change("MERGE INTO t USING s ON (t.a = s.k) WHEN NOT MATCHED THEN INSERT (a) VALUES (s.k) WHERE s.v < 250")
    assert isinstance(only, ChangeSet) and only.counts() == {"INSERT": 1, "UPDATE": 0, "DELETE": 0}


def test_flashback(e):
    with pytest.raises(ResolutionError, match="keeps no versions"):
        e.sql("SELECT a FROM t AS OF SCN 0")
    log = e.versioned("t")
    e.sql("UPDATE t SET b = -1 WHERE a < 10")
    assert e.sql("SELECT COUNT(*) AS n FROM t AS OF SCN 0 old JOIN t ON t.a = old.a WHERE old.b <> t.b").first().n == 10
    log.log[1] = Commit(**(log.log[1].__dict__ | {"at": log.log[0].at + 10_000_000}))
    moment = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=log.log[0].at + 5)
    assert e.sql("SELECT MIN(b) AS m FROM t AS OF TIMESTAMP :m", {"m": moment}).first().m == 0
    assert e.sql("SELECT MIN(b) AS m FROM t AS OF TIMESTAMP SYSTIMESTAMP + INTERVAL '1' DAY").first().m == -1
    assert e.sql("SELECT COUNT(*) AS n FROM t VERSIONS BETWEEN SCN 0 AND 1 WHERE versions_operation = 'U'").first().n == 10
    with pytest.raises(SnapshotTooOld):
        e.sql("SELECT a FROM t AS OF SCN 7")
    with pytest.raises(UnsupportedSyntax):
        e.translate("SELECT a FROM t AS OF SCN 0")
