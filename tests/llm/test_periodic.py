"""Periodic runs against a plain search over all starts, ends and periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from oriel.llm import periodic, queries
from oriel.llm.periodic import Periodic

SCHEMA = "doc_id long, text string, runs string, collapsed string, n_words long, start long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(words, least=6, exponent=4):
    n, out = len(words), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, exponent * p):
                out.setdefault((i, j + p), p)  # the smallest period comes first
            i = j
    return sorted((s, e - s, p) for (s, e), p in out.items())


def rewritten(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    return words


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    r = random.Random(4)
    out = []
    for _ in range(220):
        unit = [r.choice("ab cd é x1 \U0001f600".split()) for _ in range(r.randint(1, 9))]
        kind = r.randrange(4)
        if kind == 0:
            w = [r.choice("ab") for _ in range(r.randint(0, 60))]
        elif kind == 1:
            w = [str(r.random()) for _ in range(r.randint(0, 5))] + unit * r.randint(3, 9) + unit[: r.randrange(len(unit))] + ["end"] * r.randint(0, 7)
        elif kind == 2:
            w = (unit * 4 + ["y"]) * r.randint(1, 5)
        else:
            w = [r.choice("the a of to cat dog".split()) for _ in range(r.randint(0, 120))]
        out.append(r.choice([" ", "\t", "\r\n", "  "]).join(w))
    return out


def test_runs_and_texts_are_those_of_a_plain_search(spark):
    rows = list(enumerate(texts())) + [(500, None), (501, ""), (502, " \n "), (None, "a " * 9), (7, "b " * 9), (7, "b " * 9), (503, "lone")]
    docs = spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    for rule in (Periodic(), Periodic(bytes=64, pairs=5), Periodic(least=4, exponent=2)):
        want = []
        for i, t in rows:
            w = words_of(t)
            runs = plain_runs(w, rule.least, rule.exponent)
            want.append((i, len(w), runs, collapsed(w, runs)))
        got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs, rule).collect()]
        order = lambda x: (x[0] is None, x[0] or 0, x[3])
        assert sorted(got, key=order) == sorted(want, key=order)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_the_query_is_a_plain_search(spark, tmp_path):
    rows = [(i * 7, t) for i, t in enumerate(texts())] + [(None, "a " * 8), (-5, "c d " * 8), (90_001, None)]
    spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in rows:
        w = words_of(t) if i is None else rewritten(i, words_of(t))
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(lines), sha(collapsed(w, runs))))
    got = [tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()]
    order = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(got, key=order) == sorted(want, key=order)
    assert sum(rewritten(i, words_of(t)) != words_of(t) for i, t in rows if i is not None) > 5


def test_equal_hashes_of_different_words_are_found_out(monkeypatch):
    """Thue-Morse words have equal polynomial hashes modulo a power of two; here all hashes are equal."""
    monkeypatch.setattr(periodic.Prefixes, "equal", lambda self, at, period, length: np.ones(len(at), bool))
    r = random.Random(8)
    for _ in range(60):
        docs = [[r.randrange(2) for _ in range(r.randint(0, 40))] + [5] * r.randint(0, 9) for _ in range(4)]
        bounds = np.cumsum([0, *map(len, docs)])
        got = periodic.runs_of(np.array([w for d in docs for w in d], np.int64), bounds)
        want = [(s + b, s + n + b, p) for d, b in zip(docs, bounds.tolist()) for s, n, p in plain_runs(d)]
        assert sorted(map(tuple, got.tolist())) == sorted(want)


@pytest.mark.parametrize("words", [["a"] * 200_000, ["a", "b", "c"] * 60_000, [str(i % 40_001) for i in range(200_000)]])
def test_long_texts_take_no_more_than_their_length_times_its_logarithm(words):
    runs = periodic.runs_of(np.unique(words, return_inverse=True)[1].astype(np.int64), np.array([0, len(words)]))
    period = len(set(words))
    assert runs.tolist() == [[0, len(words), period]]


def test_a_rule_needs_two_periods():
    with pytest.raises(ValueError, match="twice"):
        Periodic(exponent=1)
