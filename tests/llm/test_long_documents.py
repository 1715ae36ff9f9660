"""Mixing where documents are longer than the table of the dynamic program."""

import random
from itertools import combinations

import numpy as np
import pytest

from oriel.llm import mixing, quality


@pytest.mark.parametrize(
    ("lengths", "budget", "best"),
    [
        ([100_000, 100_001, 100_002], 150_000, 100_002),
        ([90_000, 100_000], 150_000, 100_000),
        ([60_000, 70_000, 80_000], 135_000, 130_000),  # what remains is more than the longest
        ([7, 66_000, 90_000, 400_000], 160_000, 156_007),
    ],
)
def test_long_documents_fill_what_remains(lengths, budget, best):
    lengths = np.array(lengths)
    taken = mixing.fit(lengths, np.ones_like(lengths), budget, 1 << 16)
    assert (lengths * taken).sum() == best and set(taken) <= {0, 1}


def test_every_length_competes_under_a_small_table():
    r = random.Random(6)
    for _ in range(200):
        lengths = np.array(sorted(r.sample(range(5, 60), 6)))
        budget = r.randint(0, 2 * int(lengths.max()))
        budget = min(budget, 2 * int(lengths[lengths <= budget].max(initial=0)))
        taken = mixing.fit(lengths, np.ones_like(lengths), budget, 4)
        best = max(s for n in range(7) for c in combinations(lengths.tolist(), n) if (s := sum(c)) <= budget)
        assert (lengths * taken).sum() == best
        counts = np.array([r.randint(1, 9) for _ in lengths])
        budget = r.randint(0, int((lengths * counts).sum()))
        taken = mixing.fit(lengths, counts, budget, 4)
        left = budget - (lengths * taken).sum()
        assert left >= 0 and ((taken >= 0) & (taken <= counts)).all() and not ((lengths <= left) & (taken < counts)).any()


def test_the_mix_takes_long_documents(spark):
    rows = [(i, "w " * n, "a") for i, n in enumerate((100_000, 100_001, 100_002))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), mixing.Mix(weights=(1,), share=0.5)).collect()
    assert {r.doc_id: r.copies for r in got} == {0: 0, 1: 0, 2: 1}


@pytest.mark.parametrize(
    ("lengths", "counts", "budget", "best"),
    [([70_000, 80_000], [1, 1], 75_000, 70_000), ([66_000, 70_001, 90_000], [1, 1, 1], 70_001, 70_001), ([3, 100_000], [10, 1], 100_001, 100_000)],
)
def test_a_budget_of_few_documents_is_met_exactly(lengths, counts, budget, best):
    taken = mixing.fit(np.array(lengths), np.array(counts), budget, 1 << 16)
    assert (np.array(lengths) * taken).sum() == best


def test_best_sums_match_brute_force_for_any_counts():
    r = random.Random(9)
    for _ in range(100):
        lengths = np.array(sorted(r.sample(range(3, 40), 4)))
        counts = np.array([r.randint(1, 3) for _ in lengths])
        budget = r.randint(0, 2 * int(lengths.max()))
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        taken = mixing.fit(lengths, counts, budget, 80)
        assert (lengths * taken).sum() == max(s for s in sums if s <= budget)


def test_rows_alike_repeat_the_same_texts_on_every_run(spark):
    rows = [(1, f"{w} b c", "a") for w in "pqrstuvwxyz"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted(r.text for r in mixing.mixed(docs.repartition(n), mixing.Mix(weights=(1,), share=1.5)).collect()) for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 16


def test_four_million_distinct_words_repeat_nothing(spark):
    text = " ".join(map(str, range(4_000_000)))
    row = quality.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.n_repeat_words) == (4_000_000, 0)


def test_the_mix_itself_holds_the_copies_that_are_planned(spark):
    r = random.Random(12)
    rows = [(i, "w " * r.choice([0, 1, 2, 3, 5, 8, 900]), r.choice(["a", "b", None]), "key") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key string")
    want = {x.doc_id: x.copies for x in mixing.mix(docs).collect() if x.copies}
    out = mixing.mixed(docs)
    got = {x.doc_id: x["count"] for x in out.groupBy("doc_id").count().collect()}
    assert got == want and out.columns == docs.columns and len({*want.values()}) == 2
