"""KEEP, CURSOR, object types, JSON patches and scoring, against plain Python."""

import copy
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oriel.engine import Engine
from oriel.functions.json_patch import Op, json_transform, steps_of
from oriel.operators.scoring import LinearModel, fit_linear, fit_logistic
from oriel.semi.objects import TypeTree
from oriel.sql.lexer import UnsupportedSyntax


@pytest.fixture()
def e(spark):
    out = Engine(spark)
    r = random.Random(5)
    rows = [(i, r.choice([None, 1, 2]), r.choice([None, 1, 2, 3]), r.choice([None, 5, 6, 7])) for i in range(120)]
    out.catalog.add_table("t", spark.createDataFrame(rows, "i int, g int, k int, v int").repartition(4))
    out.catalog.add_table("u", spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "g int, name string"))
    out.rows = rows
    return out


@pytest.mark.parametrize(("keep", "pick"), [
    ("LAST ORDER BY k", lambda ks: None if None in ks else max(ks)), ("FIRST ORDER BY k", lambda ks: min((k for k in ks if k is not None), default=None)),
    ("FIRST ORDER BY k DESC", lambda ks: None if None in ks else max(ks)), ("LAST ORDER BY k DESC", lambda ks: min((k for k in ks if k is not None), default=None)),
    ("FIRST ORDER BY k NULLS FIRST", lambda ks: None if None in ks else min(ks)), ("LAST ORDER BY k NULLS FIRST", lambda ks: max((k for k in ks if k is not None), default=None)),
])
def test_keep_takes_the_rows_that_tie(e, keep, pick):
    got = e.sql(f"SELECT g, SUM(v) KEEP (DENSE_RANK {keep}) AS s, COUNT(*) KEEP (DENSE_RANK {keep}) AS n, MIN(v) KEEP (DENSE_RANK {keep}) AS lo, MAX(v) KEEP (DENSE_RANK {keep}) AS hi, COUNT(*) AS c FROM t WHERE i < 100 GROUP BY g").collect()
    assert len(got) == 3
    for r in got:
        mine = [x for x in e.rows if x[1] == r.g and x[0] < 100]
        tied = [x[3] for x in mine if x[2] == pick([x[2] for x in mine])]
        values = [v for v in tied if v is not None]
        assert (r.s, r.n, r.lo, r.hi, r.c) == (sum(values) if values else None, len(tied), min(values, default=None), max(values, default=None), len(mine))


def test_keep_shuffles_no_sorted_groups(e):
    df = e.sql("SELECT g, SUM(v) KEEP (DENSE_RANK LAST ORDER BY k) AS s FROM t GROUP BY g")
    plan = df._jdf.queryExecution().toString()
    assert "Window" not in plan and "collect_list" not in plan
    for bad in ("SELECT SUM(v) KEEP (DENSE_RANK LAST ORDER BY k, i DESC) AS s FROM t", "SELECT SUM(v) KEEP (DENSE_RANK LAST ORDER BY k) OVER (PARTITION BY g) AS s FROM t", "SELECT g, SUM(v) KEEP (DENSE_RANK LAST ORDER BY k) AS s FROM t GROUP BY ROLLUP (g)"):
        with pytest.raises(UnsupportedSyntax):
            e.sql(bad)


def test_cursor_is_an_array_of_rows(e):
    got = e.sql("SELECT u.name, CURSOR(SELECT i, v AS w FROM t WHERE t.g = u.g AND t.k = 2 ORDER BY i DESC) AS c FROM u").collect()
    for r in got:
        g = {"one": 1, "two": 2, "three": 3}[r.name]
        assert [tuple(x) for x in r.c] == [(x[0], x[3]) for x in reversed(e.rows) if x[1] == g and x[2] == 2]
    plain = e.sql("SELECT name, CURSOR(SELECT SUM(v) AS s FROM t WHERE t.g = u.g) AS c FROM u").collect()
    assert {r.name: r.c[0].s for r in plain} == {n: sum(x[3] or 0 for x in e.rows if x[1] == g) or None for g, n in ((1, "one"), (2, "two"), (3, "three"))}
    with pytest.raises(UnsupportedSyntax):
        e.sql("SELECT CURSOR(SELECT i FROM t ORDER BY i, k DESC) AS c FROM u")


# JSON patches


def patched(doc, op, path, value=None):
    """The operations on plain lists and dictionaries."""
    steps = steps_of(path)
    if not steps:
        if op in ("set", "insert", "replace"):
            return value
        if op == "keep":
            return {k: v for k, v in doc.items() if k in value} if isinstance(doc, dict) else doc
        return ([*doc, value] if op == "append" else [value, *doc]) if isinstance(doc, list) else doc
    doc = copy.deepcopy(doc)
    at, made = doc, op in ("set", "insert")
    for n, s in enumerate(steps[:-1]):
        if isinstance(s, str) and isinstance(at, dict) and s not in at and made and all(isinstance(x, str) for x in steps[n + 1 :]):
            at[s] = {}
        if not (isinstance(at, dict) and isinstance(s, str) and s in at or isinstance(at, list) and isinstance(s, int) and s < len(at)):
            return doc
        at = at[s]
    last = steps[-1]
    if isinstance(last, str):
        if not isinstance(at, dict):
            return doc
        there = last in at
        if op == "set" or op == "insert" and not there or op == "replace" and there:
            at[last] = value
        elif there and op == "remove":
            del at[last]
        elif there and op == "rename":
            at[value] = at.pop(last)
        elif there and op in ("append", "prepend", "keep"):
            at[last] = patched(at[last], op, "$", value)
    elif isinstance(at, list):
        there = last < len(at)
        if op in ("set", "replace") and there:
            at[last] = value
        elif op == "set" and last == len(at):
            at.append(value)
        elif op == "insert" and last <= len(at):
            at.insert(last, value)
        elif there and op == "remove":
            del at[last]
        elif there and op in ("append", "prepend", "keep"):
            at[last] = patched(at[last], op, "$", value)
    return doc


def test_patches_are_those_of_plain_dictionaries(spark):
    docs = [{"a": 1, "b": {"c": [1, {"q": 2}], "d": "x"}}, {"a": [1, [2, 3]], "b c": None}, [1, {"a": 5}], {}, 5, None, {"b": {"c": []}}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(99, None)], "i int, j string").repartition(3)
    ops = [("set", "$.a", 7), ("set", "$.b.c[1].q", "y"), ("set", "$.x.y", [1]), ("set", "$.b.c[2]", 5), ("insert", "$.a", 3), ("insert", "$.b.c[1]", True), ("insert", "$[0]", None), ("replace", "$.b.d", None),
           ("replace", "$.none", 1), ("remove", "$.b.c[0]", None), ("remove", "$.a[1]", None), ('remove', '$."b c"', None), ("rename", "$.a", "z"), ("append", "$.b.c", 9), ("append", "$.a[1]", 4), ("prepend", "$", 0), ("keep", "$", ["a"]), ("keep", "$.b", ["d"]), ("set", "$", 1)]
    values = [json_transform(F.col("j"), Op(o, p, F.parse_json(F.lit(json.dumps(v))) if isinstance(v, list) and o == "set" else v)).alias(f"c{i}") for i, (o, p, v) in enumerate(ops)]
    for r in df.select("i", *values).collect():
        for i, (o, p, v) in enumerate(ops):
            if r.i == 99:
                assert r[f"c{i}"] is None
            else:
                assert json.loads(r[f"c{i}"]) == patched(docs[r.i], o, p, v), (docs[r.i], o, p)
    both = df.where("i = 0").select(json_transform(F.col("j"), Op("set", "$.n", F.col("i") + 1), Op("rename", "$.n", "m"), Op("remove", "$.b"))).first()[0]
    assert both == '{"a":1,"m":1}'
    for bad in ("a", "$..a", "$.a["):
        with pytest.raises(ValueError, match="JSON path"):
            steps_of(bad)
    with pytest.raises(ValueError):
        Op("remove", "$")
    with pytest.raises(Exception, match="MALFORMED"):
        spark.sql("SELECT 'x{' AS j").select(json_transform(F.col("j"), Op("set", "$.a", 1))).collect()


# object types


def test_types_dispatch_by_their_tag(spark):
    tree = TypeTree()
    tree.add("shape", {"name": "string"}, abstract=True, map_method="area", area=lambda o: F.lit(0.0), label=lambda o, tail: F.concat(o.name, F.lit(":"), o.call("area").cast("string"), F.lit(tail)))
    tree.add("circle", {"r": "double"}, "shape", area=lambda o: o.r * o.r * 3)
    tree.add("square", {"a": "double"}, "shape", area=lambda o: o.a * o.a)
    tree.add("cube", {}, "square", area=lambda o: o.above("area") * 6)
    made = [tree.make("circle", name="c", r=2), tree.make("square", name="s", a=3), tree.make("cube", name="k", a=1.5), F.lit(None).cast(tree.schema), tree.make("square")]
    rows = spark.range(5)
    pick = F.lit(None).cast(tree.schema)
    for i, m in enumerate(made):
        pick = F.when(F.col("id") == i, m).otherwise(pick)
    o = F.col("o")
    got = rows.select("id", pick.alias("o")).select("id", tree.call(o, "label", "!").alias("l"), tree.is_of(o, "square").alias("sq"), tree.is_of(o, "square", only=True).alias("only"), tree.attribute(o, "square", "a").alias("a"), tree.key(o).alias("k"), tree.treat(o, "cube").isNotNull().alias("cube")).orderBy("id").collect()
    assert [r.l for r in got] == ["c:12.0!", "s:9.0!", "k:13.5!", None, None]
    assert [(r.sq, r.only, r.a, r.k, r.cube) for r in got] == [(False, False, None, 12.0, False), (True, True, 3.0, 9.0, False), (True, False, 1.5, 13.5, True), (None, None, None, None, False), (True, True, None, None, False)]
    for bad, error in ((lambda: tree.make("shape"), ValueError), (lambda: tree.make("circle", a=1), LookupError), (lambda: tree.add("circle", {}, "shape"), ValueError), (lambda: tree.add("other", {}), ValueError),
                       (lambda: tree.add("more", {"a": "string"}, "circle"), ValueError), (lambda: tree.call(o, "none"), LookupError), (lambda: tree.treat(o, "none"), LookupError), (lambda: tree.attribute(o, "circle", "a"), LookupError)):
        with pytest.raises(error):
            bad()
    # siblings may have attributes of one name and type
    tree.add("ball", {"r": "double"}, "shape")
    assert tree.schema.fieldNames() == ["__type", "name", "r", "a"]


# scoring


def test_linear_models_are_those_of_numpy(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 2)) * [3, 0.1] + [5, -2]
    y = x @ [2.0, -7.0] + 1 + r.normal(size=400) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)] + [(1.0, 2.0, None)], "a double, b double, y double").repartition(5)
    model = LinearModel.from_json(fit_linear(df, {"a": "a", "b": "b", "same": "1"}, "y").to_json())
    want = np.linalg.lstsq(np.c_[np.ones(400), x], y, rcond=None)[0]
    got = df.select("a", "b", model.prediction().alias("p"), model.details(1).alias("d")).collect()
    assert all(abs(g.p - (want @ [1, g.a, g.b])) < 1e-6 for g in got) and {g.d[0].feature for g in got} <= {"a", "b"}
    with pytest.raises(ValueError, match="probabilities"):
        model.probability()


def test_logistic_models_separate_and_agree(spark):
    r = random.Random(2)
    rows = [(x := r.gauss(0, 1), z := r.gauss(0, 1), int(r.random() < 1 / (1 + math.exp(-(3 * x - z + 0.5))))) for _ in range(1500)] + [(None, 1.0, 1)]
    df = spark.createDataFrame(rows, "x double, z double, y int").repartition(4)
    model = fit_logistic(df, {"x": "x", "z": "z"}, "y")
    assert 2.2 < model.weights[1] / model.scales[0] < 3.8 and -1.5 < model.weights[2] / model.scales[1] < -0.5
    got = df.select("y", model.prediction().alias("p"), model.probability().alias("q"), model.probability(0).alias("n"), model.prediction_set().alias("s")).collect()
    assert sum(g.p == g.y for g in got) > 0.8 * len(got)
    assert all(g.p == (g.q >= 0.5) and abs(g.q + g.n - 1) < 1e-12 and g.s[0].probability >= g.s[1].probability and g.s[0].prediction == g.p for g in got)
    none = fit_logistic(df.limit(0), {"x": "x"}, "y")
    assert none.weights == [0.0, 0.0]
