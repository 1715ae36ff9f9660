"""Short lines that recur, alone and in the pipeline's stage."""

import random

import corpus_pipeline
from oriel.llm import linededup

from .helpers import frame

NOTICE, PAIR, HEAD = "all rights reserved here", "only in two places", "two words"


def texts():
    own = lambda i: [f"own{i} line{i} of{i} document{i}", f"more{i} of{i} it{i}"]
    out = [[*own(i)[:1], NOTICE, *own(i)[1:], HEAD] for i in range(6)]
    out[1].append(PAIR)
    out[2].append(PAIR)
    out.append(["this refrain comes again", "a b c d", "this refrain comes again", "e f g h", "this refrain comes again"])  # in one document only
    return [(i, "\n".join(x), "s") for i, x in enumerate(out)]


def want(d, t):
    return "\n".join(x for x in t.split("\n") if x != NOTICE or d == 0)


def test_a_short_line_goes_where_counts_show_that_it_recurs(spark):
    rows = texts()
    got = {r.doc_id: (r.text, r["__n_removed"]) for r in linededup.line_dedup(frame(spark, rows, False), linededup.CORPUS).collect()}
    assert got == {d: (want(d, t), int(0 < d < 6)) for d, t, _ in rows}
    plain = linededup.line_dedup(frame(spark, rows, False)).collect()
    assert {r.doc_id: r.text for r in plain} == {d: t for d, t, _ in rows}


def test_the_pipeline_removes_recurring_short_lines(spark):
    docs = spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in texts()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {d: (want(d, t), len(want(d, t))) for d, t, _ in texts()}


def test_fewer_fingerprints_than_windows_and_none_lost(spark):
    r = random.Random(4)
    lines = [f"line {i} of many" for i in range(400)]
    texts = [[r.choice(lines) for _ in range(60)] for _ in range(40)]
    texts += [texts[i][10:30] + [f"own {i}"] for i in range(5)]
    rows = [(i, "\n".join(t), "s") for i, t in enumerate(texts)]
    rule = linededup.Winnow(long_words=99)
    sketch = linededup._sketch(frame(spark, rows, False), "doc_id", "text")
    prints = linededup.fingerprints(sketch, rule).count()
    assert prints < 0.65 * sum(len(t) - 2 for t in texts)
    got = {x.doc_id: x["__n_removed"] for x in linededup.line_dedup(frame(spark, rows, False), rule).collect()}
    assert all(got[40 + i] >= 20 for i in range(5))


def test_columns_named_like_the_added_ones(spark):
    docs = spark.createDataFrame([(1, "a b\nc d", 7)], "doc_id long, text string, __n_removed int")
    out = linededup.line_dedup(docs)
    assert sorted(out.columns) == ["__n_removed", "__n_runs", "doc_id", "text"] and out.first()["__n_removed"] == 0
