"""Constraints, counts, transfer, queue types, phases."""

import json
from decimal import Decimal

import pytest
from oriel.engine import Engine
from oriel.operators import constraints as c
from oriel.operators import rowcount
from oriel.operators.sequences import Sequence
from oriel.pipeline import Migration
from oriel.semi import queues, values
from oriel.sources.tables import read_tsv, write_tsv
from oriel.streaming import incremental
from oriel.transfer import planner, service
from pyspark.sql import functions as F
from pyspark.sql import types as T


def test_constraints_in_order(spark):
    e = Engine(spark)
    e.catalog.add_table("t", spark.createDataFrame([(1, 1, 5.0), (1, 2, -5.0), (None, 3, None)], "id int, k int, pay double"))
    e.catalog.add_table("p", spark.createDataFrame([(1,), (2,)], "k int"))
    out = c.validate(e, "t", [c.Constraint("f", "R", ("k",), target="p", target_columns=("k",)), c.Constraint("x", "R", ("k",), target="gone", target_columns=("k",)), c.Constraint("c", "C", condition="pay > 0"), c.Constraint("p", "P", ("id",))])
    assert [o.constraint.name for o in out] == ["p", "c", "f", "x"]
    assert {tuple(r) for r in out[0].violations.collect()} == {(1, 2), (None, 1)}
    assert [r.k for r in out[1].violations.collect()] == [2] and [r.k for r in out[2].violations.collect()] == [3]
    assert out[3].violations is None and "gone" in out[3].skipped.lower()


def test_index_advice():
    got = dict(c.index_advice([c.Index("a", ("x",)), c.Index("b", ("y",), "BITMAP"), c.Index("d", ("id",)), c.Index("e", ("u",), unique=True)], [c.Constraint("p", "P", ("ID",))]))
    assert got == {"a": "sort files by x", "b": "not supported: bitmap", "d": "covered by a constraint", "e": "bloom filter on u"}


def test_row_counts(spark):
    s = rowcount.Statistics(num_rows=100, modifications=10)
    assert not rowcount.stale(s, 0.5) and rowcount.stale(rowcount.Statistics()) and rowcount.stale(rowcount.Statistics(10, 50))
    assert rowcount.from_segment(rowcount.Statistics(bytes=1000, avg_row_len=10)) == 100 and rowcount.from_segment(rowcount.Statistics(blocks=10, avg_row_len=8)) == 8192
    counter = rowcount.Counter(rowcount.Settings(exact_quota=1))
    df = spark.range(50)
    assert [tuple(counter.count(df, x).first()) for x in (s, rowcount.Statistics())] == [(100, "statistics"), (50, "exact")]
    assert counter.count(df).first().method == "sample"


def test_text_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb\\n\n\r", None), (2, "", 1.5), (3, "\\N", 2.5), (4, None, None), (5, "\x00\\\\t\\", 0.5)], "i int, s string, d double")
    write_tsv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, read_tsv(spark, str(tmp_path / "t"), df.schema).collect())) == sorted(map(tuple, df.collect()))


def test_transfer_goes_on_after_a_failure(spark):
    good = spark.createDataFrame([(1, ("x", 2.0)), (2, None)], "i int, o struct<A:string,B:double>")
    seen = {}

    def sink(name, df):
        if name == "bad":
            raise RuntimeError("no")
        seen[name] = df.collect()

    results, progress = service.transfer({"bad": good, "good": good}, sink, {"good": 2})
    assert results.rows == 2 and [r.table for r in results.failed] == ["bad"] and progress.percent == 100.0
    assert json.loads(seen["good"][0].o) == {"a": "x", "b": 2.0} and seen["good"][1].o is None
    assert planner.analyse(good.schema).shape == "mixed" and planner.seconds(good.schema, 0) == 0.1 and planner.expected_rows("APP_LOG") == 100_000


def test_values(spark):
    kind = T.StructType().add("De", "string").add("n", T.DecimalType(5, 0))
    df = spark.createDataFrame([(("a\"b\\", Decimal(3)),), (None,)], T.StructType().add("o", kind))
    got = df.select(values.object_tuple(F.col("o"), kind), values.object_json(F.col("o"), kind), values.anydata(F.col("o"), kind, "o")).collect()
    assert got[0][0] == '("a\\"b\\\\",3)' and json.loads(got[0][1]) == {"de": 'a"b\\', "n": 3} and tuple(got[1]) == (None, None, None)
    assert json.loads(got[0][2])["value"] == {"attr_1": 'a"b\\', "attr_2": 3}


def test_every_queue_accessor_runs(spark):
    one = spark.range(1)
    jms = queues.jms_message([F.lit(""), F.lit("hello")], {"message_id": F.lit("m1"), "timestamp": F.lit("1000")}, F.create_map(F.lit("k"), F.lit("v")))
    sig = queues.signature(F.lit("RSA"), F.lit("d"), F.lit(None).cast("string"), F.lit("me"), F.lit("valid"), F.lit("2024-01-02 03:04:05"))
    rec = queues.recipients(F.array(F.lit("a@x.org"), F.lit("name=bob;status=DELIVERED;priority=3"), F.lit("carl")))
    more = {"get_property": ("k",), "has_property": ("k",), "text_contains": ("ELL",), "uses_algorithm": ("rsa",), "count_by_status": ("PENDING",), "get_by_status": ("PENDING",), "get_by_address": ("a@x.org",), "get_by_name": ("BOB",), "get_by_routing": ("r",), "contains_address": ("a@x.org",), "get_by_domain": ("x.org",), "count_by_domain": ("x.org",)}
    got = {}
    for label, doc, table in (("jms", jms, queues.JMS), ("sig", sig, queues.SIGNATURE), ("rec", rec, queues.RECIPIENTS)):
        df = one.select(doc.alias("j"))
        row = df.select(*[f(F.col("j"), *more.get(n, ())).alias(n) for n, f in table.items()]).first()
        got[label] = row.asDict(recursive=True)
    assert got["jms"]["get_text_content"] == "hello" and got["jms"]["text_contains"] and got["jms"]["get_property_names"] == ["k"]
    assert got["sig"]["is_signature_valid"] and got["sig"]["uses_algorithm"] and not got["sig"]["has_signature_value"]
    assert (got["rec"]["count"], got["rec"]["count_by_status"], got["rec"]["get_by_name"]["priority"], got["rec"]["get_names"]) == (3, 2, 3, ["a", "bob", "carl"])


def test_phases():
    seen = []
    m = Migration({p: (lambda ctx, p=p: seen.append(p)) for p in ("TRANSFER", "EXTRACT")})
    m.run()
    assert seen == ["EXTRACT", "TRANSFER"] and m.percent == 100 and m.state == "DONE"
    m.phases["EXTRACT"] = lambda ctx: m.cancel()
    m.run()
    assert m.state == "CANCELLED" and m.done == ["EXTRACT"]
    with pytest.raises(ValueError):
        Migration({"LUNCH": print})


def test_incremental(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    incremental(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination(60)
    assert sum(seen) == 5


def test_a_target_row_is_merged_once(spark):
    e = Engine(spark)
    e.catalog.add_table("t", spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    e.catalog.add_table("s", spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (3, "z")], "id int, v string"))
    text = "MERGE INTO t USING s ON (t.id = s.id {}) WHEN MATCHED THEN UPDATE SET t.v = s.v WHEN NOT MATCHED THEN INSERT (id, v) VALUES (s.id, s.v)"
    before = e.catalog.tables["MAIN", "T"]
    with pytest.raises(Exception, match="two source rows match one target row"):
        e.sql(text.format("")).collect()
    e.catalog.tables["MAIN", "T"] = before
    got = e.sql(text.format("AND s.v <> 'y'")).collect()
    assert sorted(map(tuple, got)) == [(1, "x"), (1, "y"), (2, "b"), (3, "z"), (3, "z")]


def test_definitions(spark):
    e = Engine(spark)
    e.create_table("hr.t", [("id", "NUMBER(9)"), ("v", "VARCHAR2(9)")], required=("id",), defaults={"v": "'d'"})
    assert [tuple(r) for r in e.sql("INSERT INTO hr.t (id) VALUES (4)").collect()] == [(Decimal(4), "d")]
    with pytest.raises(Exception, match="takes no null"):
        e.sql("INSERT INTO hr.t (v) VALUES ('x')").collect()
    with pytest.raises(LookupError):
        e.create_table("hr.t", [("id", "NUMBER")])
    e.create_empty_view("w", [("a", "NUMBER(3)")])
    with pytest.raises(LookupError):
        e.create_view("w", "SELECT 1 AS b FROM dual")


def test_sequences_leave_no_gaps(spark):
    s = Sequence(5, 2)
    df = spark.range(100).repartition(7).select("id")
    first = [r.n for r in s.numbered(df, "n", ["id"]).orderBy("id").collect()]
    assert first == list(range(5, 205, 2)) and s.next == 205
    assert s.numbered(spark.range(0).select("id"), "n").count() == 0 and s.next == 205
    assert sorted(r.n for r in s.numbered(spark.range(3).select("id"), "n").collect()) == [205, 207, 209]


def test_long_recipient_lists_are_whole(spark):
    texts = F.array(*[F.lit(f"a{i}@x.org") for i in range(30)])
    row = spark.range(1).select(queues.RECIPIENTS["count"](queues.recipients(texts)).alias("a"), queues.RECIPIENTS["count"](queues.recipients(texts, most=10)).alias("b")).first()
    assert tuple(row) == (30, 10)


def test_tables_are_transferred_side_by_side(spark):
    import threading

    both, seen = threading.Barrier(2, timeout=60), []

    def sink(name, df):
        if name in ("a", "b"):
            both.wait()  # neither would go on if they came one after the other
        seen.append((name, df.count()))

    results, progress = service.transfer({n: spark.range(i + 1).toDF("x") for i, n in enumerate("abcd")}, sink, {"a": 10}, at_once=2)
    assert [(r.table, r.error) for r in results.tables] == [(n, "") for n in "abcd"] and sorted(seen) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    assert progress.tables_done == 4
