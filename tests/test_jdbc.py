"""Reads by quantile ranges and repeatable loads, on an embedded database."""

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from oriel.sources import jdbc
from oriel.sources.jdbc import Database


@pytest.fixture()
def db(spark):
    out = Database(f"jdbc:derby:memory:o{uuid.uuid4().hex[:8]};create=true", driver="org.apache.derby.jdbc.EmbeddedDriver")
    try:
        out.run(spark, "CREATE TABLE ITEMS (ID BIGINT NOT NULL PRIMARY KEY, NAME VARCHAR(40), PRICE DECIMAL(9, 2), SOLD TIMESTAMP)")
    except Exception as bad:  # noqa: BLE001
        pytest.skip(f"no embedded database: {bad}")
    return out


def rows_of(n):
    r = random.Random(n)
    # keys that lie in a few dense places; null texts are left out, as Spark sends them to this database as CLOB
    keys = r.sample(range(1000), n // 2) + r.sample(range(10**12, 10**12 + 10**6), n - n // 2)
    return [(k, r.choice(["", "a'b", "tab\t", "é"]), None if r.random() < 0.1 else r.randrange(10**5) / 100, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=r.randrange(10**6))) for k in keys]


def test_the_dictionary_names_columns_and_keys(spark, db):
    info = jdbc.table_info(spark, db, "ITEMS")
    assert [(c.name, c.ddl, c.nullable) for c in info.columns] == [("ID", "BIGINT", False), ("NAME", "VARCHAR(40)", True), ("PRICE", "DECIMAL(9, 2)", True), ("SOLD", "TIMESTAMP", True)]
    assert info.key == ["ID"] and "ITEMS" in jdbc.tables(spark, db)
    with pytest.raises(LookupError):
        jdbc.table_info(spark, db, "NOTHING")


def test_skewed_keys_give_equal_ranges(spark, db):
    rows = rows_of(400)
    df = spark.createDataFrame(rows, "id long, name string, price double, sold timestamp").withColumn("price", F.col("price").cast("decimal(9,2)"))
    assert jdbc.load(df, db, "ITEMS", "first") == 400
    got = jdbc.read(spark, db, "ITEMS", ranges=8)
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and all(40 <= r["count"] <= 60 for r in sizes)
    assert sorted((r.ID, r.NAME, r.PRICE, r.SOLD) for r in got.collect()) == sorted((r.id, r.name, r.price, r.sold) for r in df.collect())
    for key in ("SOLD", "NAME", "PRICE"):
        by = jdbc.read(spark, db, "ITEMS", ranges=5, key=key)
        assert by.count() == 400 and sorted(r.ID for r in by.collect()) == sorted(r[0] for r in rows)
    assert jdbc.read(spark, db, "ITEMS", ranges=1).count() == 400
    with pytest.raises(LookupError):
        jdbc.read(spark, db, "ITEMS", key="NONE")


def test_loads_are_repeatable_and_staged_copies_count_once(spark, db, monkeypatch):
    df = spark.range(0, 50, numPartitions=4).select("id", F.lit("x").alias("Name"), F.when(F.col("id") > 3, F.col("id")).cast("decimal(9,2)").alias("price"))
    once = jdbc._stage

    def twice(rows, *more):
        once(rows, *more)
        once(rows.where("ORIEL_ROW % 3 = 0"), *more)  # a task that was run again

    monkeypatch.setattr(jdbc, "_stage", twice)
    assert jdbc.load(df, db, "ITEMS", "l1") == 50
    assert jdbc.load(df, db, "ITEMS", "l1") == 0
    got = jdbc.read(spark, db, "ITEMS")
    assert got.count() == 50 and got.where("PRICE IS NULL AND NAME = 'x' AND SOLD IS NULL").count() == 4
    # a failed load leaves nothing, and can be made again
    with pytest.raises(Exception, match="duplicate key|ERROR 23505"):
        jdbc.load(df.limit(5).select("id", "Name").unionByName(spark.createDataFrame([(900, "y")], "id long, Name string")), db, "ITEMS", "l2")
    assert jdbc.read(spark, db, "ITEMS").count() == 50
    assert jdbc.load(spark.createDataFrame([(900, "y")], "id long, Name string"), db, "ITEMS", "l2") == 1
    assert not [t for t in jdbc.tables(spark, db) if t.startswith("ORIEL_STAGE")]
    with pytest.raises(LookupError):
        jdbc.load(df.withColumn("zz", F.lit(1)), db, "ITEMS", "l3")


def test_ranges_meet_each_row_once():
    assert jdbc.predicates("A", []) == ["1 = 1"]
    assert jdbc.predicates("A", [3, 7]) == ['"A" < 3 OR "A" IS NULL', '"A" >= 3 AND "A" < 7', '"A" >= 7']
    assert [jdbc.literal(x) for x in ("o'x", datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 2, 3), 1.5, True)] == ["'o''x'", "{d '2024-01-02'}", "{ts '2024-01-02 03:00:00.000000'}", "1.5e0", "1"]
