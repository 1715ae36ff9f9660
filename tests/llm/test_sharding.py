"""Sharding by bytes: the capacity against a plain search over all cuts, and what holds of shards and slots."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from oriel.llm import sharding
from oriel.llm.common import Workspace

SCHEMA = "doc_id long, text string, shard string, size string, digest string, slot long"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", "y", "z", 7) for i, t in rows], SCHEMA).repartition(parts)


def ordered(rows, shards):
    """(digest, bytes) of the groups in the operator's order."""
    sizes = {}
    for _, t in rows:
        d = hashlib.sha256((t or "").encode()).digest()
        sizes[d] = sizes.get(d, 0) + len((t or "").encode()) + 1
    left, large = dict(sizes), []
    for d, b in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        k = shards - len(large)
        if k < 2 or b * k <= sum(left.values()):
            break
        large.append((d, left.pop(d)))
    return large + sorted(left.items())


def smallest(sizes, shards):
    """The least capacity by dynamic programming over all cuts."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    best = ends.astype(float)
    for _ in range(shards - 1):
        best = np.array([min(max(best[i], ends[j] - ends[i]) for i in range(j + 1)) for j in range(len(ends))])
    return int(best[-1])


def checked(rows, got, plan, shards):
    groups = ordered(rows, shards)
    assert len(got) == len(rows)
    by_text, loads, slots = {}, [0] * shards, [[] for _ in range(shards)]
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    for r in got:
        t = next(t for t in texts[r.doc_id] if (zlib.crc32(t.encode()), len(t.encode()) + 1) == (r.text_crc32, r["size"]))
        assert by_text.setdefault(t, r.shard) == r.shard
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    for s in slots:
        assert sorted(s) == list(range(len(s)))
    assert plan.capacity == max(loads) == smallest([b for _, b in groups], shards)
    by_digest = {hashlib.sha256(t.encode()).digest(): s for t, s in by_text.items()}
    order = [by_digest[d] for d, _ in groups]
    assert order == sorted(order)  # contiguous
    return loads


@pytest.mark.parametrize(("seed", "shards", "blocks"), [(1, 3, 48), (2, 8, 128), (3, 5, 80), (4, 2, 65536)])
def test_capacity_is_the_smallest(spark, seed, shards, blocks):
    r = random.Random(seed)
    rows = [(i, "".join(r.choice("abcé") for _ in range(int(r.paretovariate(0.7)) % 900))) for i in range(150)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(40)]
    got, plan = sharding.assign(frame(spark, rows), sharding.Sharding(shards, blocks))
    got = got.collect()
    checked(rows, got, plan, shards)
    again, _ = sharding.assign(frame(spark, rows[::-1], 5), sharding.Sharding(shards, 65536))
    if blocks == 65536:
        assert sorted(got) == sorted(again.collect())


def test_a_text_of_a_third_of_all_rows_leaves_the_others_even(spark):
    r = random.Random(9)
    rows = [(i, f"{r.random()}" * 3) for i in range(400)] + [(10_000 + i, "the same " * 6) for i in range(200)]
    got, plan = sharding.assign(frame(spark, rows), sharding.Sharding(8))
    loads = checked(rows, got.collect(), plan, 8)
    assert len(plan.large) == 1 and loads[0] == 200 * 55
    assert max(loads[1:]) - min(loads[1:]) <= 2 * 70


def test_even_without_frequent_texts(spark):
    rows = [(i, "x" * (i % 50) + str(i)) for i in range(1500)]
    got, plan = sharding.assign(frame(spark, rows, 7), sharding.Sharding(8, 128))
    loads = checked(rows, got.collect(), plan, 8)
    assert max(loads) - min(loads) <= 2 * 54


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a"), (3, "a"), (3, "a"), (3, "b"), (4, "long " * 200_000), (None, None)]
    got, plan = sharding.assign(frame(spark, rows), sharding.Sharding(8))
    got = got.collect()
    checked(rows, got, plan, 8)
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got if r.doc_id in (1, 2)} == {(1, 1, 0), (2, 1, 0)}
    assert sharding.assign(frame(spark, []), sharding.Sharding(8))[0].count() == 0
    one, _ = sharding.assign(frame(spark, [(7, "a")]), sharding.Sharding(1))
    assert [tuple(r) for r in one.collect()] == [(7, 2, zlib.crc32(b"a"), 0, 0)]
    with pytest.raises(ValueError, match="16 blocks"):
        sharding.Sharding(100, 128)


def test_the_driver_sees_a_bounded_number_of_blocks(spark, monkeypatch):
    seen, plain = [], sharding._blocks
    monkeypatch.setattr(sharding, "_blocks", lambda *a: (got := plain(*a), seen.append(len(got)))[0])
    docs = spark.range(0, 20_000, numPartitions=6).select(F.col("id").alias("doc_id"), F.expr("repeat('a', cast(id % 97 AS INT)) || id").alias("text"))
    got, plan = sharding.assign(docs, sharding.Sharding(8, 256))
    assert len(seen) > 2 and max(seen) <= 4 * 256
    rows = [(i, "a" * (i % 97) + str(i)) for i in range(20_000)]
    loads = {r.shard: r.b for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert max(loads.values()) == plan.capacity
    ends = np.cumsum([b for _, b in ordered(rows, 8)])
    for capacity, fits in ((plan.capacity, True), (plan.capacity - 1, False)):
        at = 0
        for _ in range(8):
            i = int(np.searchsorted(ends, at + capacity, "right"))
            at = int(ends[i - 1]) if i else 0
        assert (at == ends[-1]) == fits


def test_documents_are_written_by_the_plan(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 5)) for i in range(60)]
    docs = frame(spark, rows)
    got, plan = sharding.assign(docs, sharding.Sharding(4))
    sharding.write(docs, plan, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.text, r["__shard"]) for r in back.collect()} == {(r.doc_id, dict(rows)[r.doc_id], r.shard) for r in got.collect()}
    assert set(docs.columns) < set(back.columns)


def test_a_plan_of_no_rows(spark):
    assert sharding.fit(spark.createDataFrame([], "digest binary, size long"), sharding.Sharding(), Workspace(spark, "t")) is None
