"""Vector codes against plain Python integers, round by round."""

import hashlib
import random

import numpy as np
import pytest

from oriel.llm import queries, vectorcode
from oriel.llm.vectorcode import Coding

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, id string, x string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, label, "a", "b", "c", "d") for i, v, label in rows], SCHEMA).repartition(parts)


def plain(rows, rule):
    """(rows, books): all rounds with Python integers, every sum anew."""
    kept = [(i, [int(np.floor(float(np.float32(c)) * rule.scale)) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // rule.parts
    cut = lambda v, k: v[k * width : (k + 1) * width]
    books = [[cut(v, k) for _, v, _ in kept[: rule.entries]] for k in range(rule.parts)]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))

    def near(v, k):
        return min(range(len(books[k])), key=lambda e: (far(cut(v, k), books[k][e]), e))

    for _ in range(rule.rounds):
        for k in range(rule.parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(v, k), []).append(cut(v, k))
            for e, vs in groups.items():
                books[k][e] = [sum(c) // len(vs) for c in zip(*vs)]
    out = []
    for i, v, label in kept:
        codes = [near(v, k) for k in range(rule.parts)]
        out.append([i, label, bytes(codes).hex(), sum(far(cut(v, k), books[k][e]) for k, e in enumerate(codes))])
    sums = {}
    for _, label, _, error in out:
        sums[label] = sums.get(label, 0) + error
    return [(i, label, c, e, sums[label]) for i, label, c, e in out], hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def order(r):
    return (r[0] is None, r[0] or 0, r[2], r[3])


def rows_of(n, seed=1, dims=8):
    r = random.Random(seed)
    out = [(i * 3, [r.gauss(i % 5, 1) for _ in range(dims)], r.choice([0, 1, None, 7])) for i in range(n)]
    out += [(1, None, 0), (2, [float("nan")] * dims, 1), (4, [1.0] * (dims - 1) + [None], 1), (5, [float("inf")] * dims, 1), (7, [1.0, 2.0], 1), (8, [], 2)]
    return out + [out[3], out[3], (None, [0.5] * dims, None), (10, [-0.0] * dims, 0), (11, [-1 / 4096] * dims, 0)]


@pytest.mark.parametrize("rule", [Coding(4, 16, 4), Coding(2, 5, 3), Coding(1, 256, 2, 7), Coding(8, 3, 0)])
def test_codes_are_those_of_plain_integers(spark, rule):
    rows = rows_of(160)
    usable = [r for r in rows if r[1] is None or len(r[1]) == 8]
    want, digest = plain(usable, rule)
    got, books = vectorcode.encode(frame(spark, rows), rule)
    assert books.digest() == digest
    assert sorted((tuple(r) for r in got.select("id", "label", "code", "error", "label_error").collect()), key=order) == sorted(want, key=order)


def test_ties_go_to_the_lower_entry_and_unused_entries_stay(spark):
    rows = [(i, [0.0, 0.0, 0.0, 0.0], 1) for i in range(6)] + [(6, [1.0, 0.0, 0.0, 0.0], 1), (7, [0.5, 0.0, 0.0, 0.0], 1)]
    rule = Coding(4, 7, 2)
    got, books = vectorcode.encode(frame(spark, rows), rule)
    want, digest = plain(rows, rule)
    assert books.digest() == digest and books.books[0].ravel().tolist() == [512, 0, 0, 0, 0, 0, 1024]
    assert sorted((tuple(r) for r in got.select("id", "label", "code", "error", "label_error").collect()), key=order) == sorted(want, key=order)


def test_only_parts_that_moved_are_sent(spark):
    """Running sums stay those of a full count."""
    rows = [(i, v, k) for i, v, k in rows_of(300, 5) if v is not None and len(v) == 8]
    _, books = vectorcode.encode(frame(spark, rows, 5), Coding(4, 32, 4))
    assert books.counts.sum(1).tolist() == [int(books.counts[0].sum())] * 4
    x = np.array([[1, 0], [5, 5], [1, 1]], np.int64)
    old, new = np.array([[[0, 0], [9, 9]]]), np.array([[[0, 0], [5, 4]]])
    import pyarrow as pa

    state = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "label": [0, 0, 0], "x": x.tolist(), "codes": pa.nulls(3, pa.binary())})
    first = list(vectorcode._round(old)(iter([state])))
    assert first[1].column("n").to_pylist() == [2, 1]
    again = pa.RecordBatch.from_pydict({n: first[0].column(n) for n in ("id", "label", "x", "codes")})
    assert len(list(vectorcode._round(new)(iter([again])))) == 1  # nothing moved, nothing sent


def test_large_components_are_exact(spark):
    r = np.random.default_rng(3)
    x = r.integers(-(1 << 29), 1 << 29, (50, 3))
    book = np.concatenate([x[:7] + 1, x[:7] - 1])
    at, far = vectorcode.nearest(x, book)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book)) for v in x]
    assert [(int(f), int(a)) for f, a in zip(far, at)] == want
    with pytest.raises(ValueError, match="64 bits"):
        vectorcode.encode(frame(spark, [(1, [1e30] * 4, 0)]), Coding())
    with pytest.raises(ValueError, match="equal parts"):
        vectorcode.encode(frame(spark, [(1, [1.0] * 6, 0)]), Coding())


def test_rare_and_frequent_labels(spark, monkeypatch):
    monkeypatch.setattr(vectorcode, "HOT", 10)
    rows = [(i, [float(i % 13), 1.0, 2.0, float(i % 7)], None if i % 3 == 0 else i % 60) for i in range(240)]
    rule = Coding(4, 8, 1)
    got, _ = vectorcode.encode(frame(spark, rows), rule)
    want, _ = plain(rows, rule)
    assert sorted((tuple(r) for r in got.select("id", "label", "code", "error", "label_error").collect()), key=order) == sorted(want, key=order)


def test_no_vectors(spark, tmp_path):
    got, books = vectorcode.encode(frame(spark, [(1, None, 0)]), Coding())
    assert got.count() == 0 and books is None
    frame(spark, []).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert queries.QUERIES["op13_vector_codes"](spark, str(tmp_path)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
