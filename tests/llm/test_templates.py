"""Near duplicates where very many unlike documents share a template, and so a band."""

import random

import pytest

from oriel.llm import hyperminhash


def family(n, words, common, seed=8):
    """n documents whose first ``common`` words are the same, and near copies of a few of them."""
    r = random.Random(seed)
    head = [f"t{i}" for i in range(common)]
    own = [head + [f"u{i}x{j}" for j in range(words - common)] for i in range(n)]
    for i in range(0, n, 100):
        copy = list(own[i])
        copy[-1 - r.randrange(5)] = "changed"
        own.append(copy)
    return [(i, " ".join(w)) for i, w in enumerate(own)]


@pytest.mark.parametrize("common", [80])
def test_near_copies_within_a_template_are_found(spark, common):
    n = 900
    rows = family(n, 120, common)
    got = {r.doc_id: r.component_id for r in hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), hyperminhash.NearDup(4, 80)).collect()}
    assert got == {i: i if i < n else 100 * (i - n) for i, _ in rows}
