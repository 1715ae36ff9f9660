"""MODEL rules against plain dictionaries of cells."""

import random

import pytest
from pyspark.sql import functions as F

from oriel.operators.model import ANY, CV, Model, Rule

DIMS, SUM = ["k", "y"], lambda a, b: a + b


@pytest.fixture()
def cells(spark):
    r = random.Random(6)
    rows = [(p, k, y, float(r.randrange(100)), None) for p in ("a", "b", None) for k in ("tv", "pc") for y in range(2000, 2006) if r.random() < 0.8]
    return spark.createDataFrame(rows, "p string, k string, y int, v double, w double").repartition(4), {(p, k, y): [v, w] for p, k, y, v, w in rows}


def table(df):
    got = {(r.p, r.k, r.y): [r.v, r.w] for r in df.collect()}
    return got


def test_named_cells_are_set_in_the_order_they_need(cells):
    df, plain = cells
    model = Model(["p"], DIMS, ["v", "w"], [
        Rule("v", {"k": "tv", "y": 2010}, lambda a: a * 2, (("v", {"k": "tv", "y": 2009}),)),  # reads what the next one sets
        Rule("v", {"k": "tv", "y": 2009}, SUM, (("v", {"k": "tv", "y": 2001}), ("v", {"k": "tv", "y": CV(-7)}))),
        Rule("v", {"k": "pc", "y": 2002}, lambda: F.lit(-1.0)),
        Rule("w", {"k": "pc", "y": 2002}, lambda a: a + 5, (("v", {"k": "pc", "y": 2002}),)),
    ], ignore_nav=True)
    for p in ("a", "b", None):
        get = lambda k, y: plain.get((p, k, y), [0])[0] or 0  # noqa: B023, E731
        first = get("tv", 2001) + get("tv", 2002)
        plain[p, "tv", 2009], plain[p, "tv", 2010] = [first, None], [2 * first, None]
        plain[p, "pc", 2002] = [-1.0, 4.0]
    assert table(model.apply(df)) == plain
    with pytest.raises(ValueError, match="circle"):
        Model(["p"], DIMS, ["v", "w"], [model.rules[0], Rule("v", {"k": "tv", "y": 2009}, lambda a: a, (("v", {"k": "tv", "y": 2010}),))]).apply(df)
    in_order = Model(["p"], DIMS, ["v", "w"], model.rules[:2], automatic=False).apply(df)
    assert {r.v for r in in_order.where("y = 2010").collect()} == {None}


def test_all_cells_of_a_condition_are_set_by_joins(cells):
    df, plain = cells
    model = Model(["p"], DIMS, ["v", "w"], [
        Rule("w", {"k": ANY, "y": ANY}, lambda a, b, c: a / b + F.coalesce(c, F.lit(1000.0)), (("v", {"k": CV(), "y": CV()}), ("v", {"k": "tv", "y": 2030}), ("v", {"k": CV(), "y": CV(-1)}))),
        Rule("v", {"k": "tv", "y": 2030}, lambda a: F.coalesce(a, F.lit(0.0)) + 1, (("v", {"k": "tv", "y": 2001}),)),
        Rule("v", {"k": "pc", "y": ANY}, lambda a: a * 10, (("v", {"k": CV(), "y": CV()}),), where="y > 2003"),
    ], automatic=False)
    model.rules = [model.rules[1], model.rules[0], model.rules[2]]
    for p in ("a", "b", None):
        plain[p, "tv", 2030] = [(plain.get((p, "tv", 2001), [0.0])[0]) + 1, None]
    before = {k: v[0] for k, v in plain.items()}
    for (p, k, y), v in plain.items():
        c = before.get((p, k, y - 1), 1000.0)
        v[1] = before[p, k, y] / before[p, "tv", 2030] + c
    for (p, k, y), v in plain.items():
        if k == "pc" and y > 2003:
            v[0] *= 10
    got = table(model.apply(df))
    assert got.keys() == plain.keys() and all(abs(got[k][0] - plain[k][0]) < 1e-9 and abs(got[k][1] - plain[k][1]) < 1e-9 for k in plain)


def test_odd_tables(spark, cells):
    df, plain = cells
    one = Rule("v", {"k": "tv", "y": 2001}, lambda: F.lit(1.0))
    assert Model(["p"], DIMS, ["v", "w"], [one]).apply(df.limit(0)).count() == 0
    whole = Model([], DIMS, ["v"], [one]).apply(df.where("p = 'a'"))
    assert whole.where("k = 'tv' AND y = 2001").first().v == 1.0
    with pytest.raises(Exception, match="two rows"):
        Model([], DIMS, ["v"], [one]).apply(spark.createDataFrame([("tv", 2001, 1.0)] * 2, "k string, y int, v double")).collect()
    for bad in (Rule("z", {"k": 1, "y": 1}, lambda: 1), Rule("v", {"k": 1}, lambda: 1), Rule("v", {"k": CV(), "y": 1}, lambda: 1)):
        with pytest.raises(ValueError):
            Model(["p"], DIMS, ["v"], [bad])
    assert table(Model(["p"], DIMS, ["v", "w"], []).apply(df)) == plain
