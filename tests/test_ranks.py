"""Numbers and shares of rows that lie in many partitions."""

import math
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from oriel.engine import Engine
from oriel.operators.ranks import in_order, key
from oriel.operators.sequences import Sequence
from oriel.sql.lexer import UnsupportedSyntax


@pytest.fixture()
def wide(spark):
    """Sixteen partitions that are not put together."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_numbers_have_no_gaps_over_sixteen_partitions(wide):
    df = wide.range(0, 30_000, numPartitions=16).select((F.hash("id") % 1000).alias("k"), "id")
    ids = Sequence(1000, 10)
    out = ids.numbered(df, "n", ["k", "id"])
    assert out.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first()[:] == (30_000, 1000, 1000 + 10 * 29_999)
    assert len(in_order(df, ["k"]).before) == 16
    want = {r.id: 1000 + 10 * i for i, r in enumerate(sorted(df.collect(), key=lambda r: (r.k, r.id)))}
    assert {r.id: r.n for r in out.collect()} == want == {r.id: r.n for r in out.collect()}
    more = ids.numbered(df.limit(5), "n")
    assert sorted(r.n for r in more.collect()) == [1000 + 10 * (30_000 + i) for i in range(5)] and ids.current == 1000 + 10 * 30_004


def test_one_value_that_most_rows_share_spreads_over_ranges(wide):
    df = wide.range(0, 20_000, numPartitions=16).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("k"))
    got = in_order(df, ["k"])
    starts = [*got.before.values(), got.total]
    assert len(starts) > 16 and max(b - a for a, b in zip(starts, starts[1:])) < 4000


def test_shares_with_ties_nulls_and_offsets(wide):
    r = random.Random(1)
    rows = [(i, r.choice([None, 1, 2, 3, 3, 3, 4])) for i in range(500)]
    df = wide.createDataFrame(rows, "i long, v int").repartition(16)
    for descending in (False, True):
        got = in_order(df, [key(F.col("v"), descending)], "t")
        rank = lambda v: (v is None) * 9 - (v or 0) if not descending else -(9 if v is None else v)
        order = sorted((rank(v) if descending else (9 if v is None else v)) for _, v in rows)
        place = lambda v: -(9 if v is None else v) if descending else (9 if v is None else v)
        for share, offset in ((10, 0), (33.3, 0), (0, 0), (100, 0), (250, 0), (20, 450), (5, 501)):
            n = math.ceil(500 * share / 100)
            end = min(500, offset + n)
            plain = sorted(place(x.v) for x in got.percent(share, offset=offset).collect())
            assert plain == order[offset:end]
            tied = sorted(place(x.v) for x in got.percent(share, True, offset).collect())
            assert tied == (order[offset:end] + [x for x in order[end:] if x == order[end - 1]] if offset < end else [])


def test_tables_without_rows_or_hashable_columns(spark):
    empty = spark.createDataFrame([], "a int")
    assert in_order(empty, ["a"]).numbered("n").count() == 0 and in_order(empty, ["a"]).percent(50, True).count() == 0
    maps = spark.range(3).select(F.create_map(F.lit("k"), F.col("id")).alias("m"), F.lit(1).alias("a"))
    assert sorted(r.n for r in in_order(maps, ["a"]).numbered("n", 5, -2).collect()) == [1, 3, 5]
    with pytest.raises(ValueError, match="step"):
        Sequence(1, 0)
    with pytest.raises(ValueError, match="first number"):
        Sequence(4).current  # noqa: B018


@pytest.fixture()
def e(wide):
    out = Engine(wide)
    out.catalog.add_table("t", wide.range(0, 100, numPartitions=8).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b")))
    out.catalog.add_table("u", wide.range(0, 7).select(F.col("id").alias("b"), F.concat(F.lit("n"), "id").alias("name")))
    out.catalog.add_sequence("s", 10, 2)
    return out


def test_nextval_in_select_lists(e):
    got = e.sql("SELECT s.NEXTVAL AS id, s.CURRVAL + 1 AS c, t.a, u.name FROM t, u WHERE t.b = u.b AND t.a < 50 ORDER BY t.a DESC").collect()
    assert sorted(r.id for r in got) == list(range(10, 110, 2)) and all(r.c == r.id + 1 and r.name == f"n{r.a % 7}" for r in got)
    assert [r.a for r in got] == list(range(49, -1, -1))
    assert e.sql("SELECT s.CURRVAL AS c FROM dual").first().c == 108
    with_cte = e.sql("WITH x AS (SELECT a FROM t WHERE a < 3) SELECT s.NEXTVAL AS id FROM x").collect()
    assert sorted(r.id for r in with_cte) == [110, 112, 114]
    for bad in ("SELECT b, s.NEXTVAL FROM t GROUP BY b", "SELECT DISTINCT s.NEXTVAL FROM t", "SELECT a FROM t WHERE a = s.NEXTVAL", "UPDATE t SET a = s.NEXTVAL"):
        with pytest.raises(UnsupportedSyntax, match="NEXTVAL"):
            e.sql(bad)
    with pytest.raises(AnalysisException):
        e.sql("SELECT nothing.NEXTVAL FROM t")


def test_nextval_in_inserts(e):
    e.sql("INSERT INTO u (b, name) VALUES (s.NEXTVAL, 'v' || s.NEXTVAL)")
    assert e.sql("SELECT b, name FROM u WHERE name LIKE 'v%'").first()[:] == (10, "v10")
    e.sql("INSERT INTO u (b, name) SELECT s.NEXTVAL, 'w' FROM t")
    got = [r.b for r in e.sql("SELECT b FROM u WHERE name = 'w'").collect()]
    assert sorted(got) == list(range(12, 212, 2)) == sorted(r.b for r in e.sql("SELECT b FROM u WHERE name = 'w'").collect())


def test_rownum_in_select_lists(e):
    assert [tuple(r) for r in e.sql("SELECT ROWNUM AS rn, a FROM (SELECT a FROM t ORDER BY a DESC) WHERE ROWNUM <= 3").collect()] == [(1, 99), (2, 98), (3, 97)]
    rows = e.sql("SELECT x.*, ROWNUM AS k FROM t x WHERE x.b = 1").collect()
    assert sorted(r.k for r in rows) == list(range(1, 16)) and set(rows[0].asDict()) == {"a", "b", "k"}
    assert e.sql("SELECT MAX(ROWNUM) AS m FROM t").first().m == 100
    # a subquery that hangs on its outer row is numbered by a window
    assert {r.n for r in e.sql("SELECT (SELECT MAX(k) FROM (SELECT ROWNUM AS k FROM t WHERE t.b = u.b)) AS n FROM u").collect()} <= {14, 15}


def test_percentages_in_sql(e):
    assert [r.a for r in e.sql("SELECT a FROM t ORDER BY b DESC, a FETCH FIRST 3 PERCENT ROWS ONLY").collect()] == [6, 13, 20]
    assert e.sql("SELECT a FROM t ORDER BY b FETCH FIRST 3 PERCENT ROWS WITH TIES").count() == 15
    assert e.sql("SELECT b FROM t UNION ALL SELECT b FROM u ORDER BY b FETCH FIRST 10 PERCENT ROWS ONLY").count() == 11
    assert [r.a for r in e.sql("SELECT a FROM t ORDER BY a OFFSET 98 ROWS FETCH NEXT 50 PERCENT ROWS ONLY").collect()] == [98, 99]
    plan = e.sql("SELECT a FROM t ORDER BY a FETCH FIRST 10 PERCENT ROWS ONLY")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
