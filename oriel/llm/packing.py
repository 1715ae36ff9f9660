"""Packing token pieces into sequences: best-fit decreasing with a segment tree over capacities.

Best-fit decreasing looks at nothing but lengths, and there are no more lengths
than tokens in a sequence.  So pieces are counted by length where they are, the
driver packs that one bounded histogram, and the plan comes back as runs: pieces
of one length with ranks in a range go to sequences in a range.  Bins that look
alike are kept as ranges of sequence numbers in a leaf for their remaining
capacity; the tree finds the tightest leaf with an open bin in logarithmic time.
The outcome is that of packing document by document, at any number of them.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, in_batches, text_slices, trim, word_spans

#: Places that the pieces of one length are dealt to when they are ranked.
BUCKETS = 1024


@dataclass(frozen=True)
class Packing:
    """Path of a tokenizer file, tokens in a sequence, and the id that ends a document."""

    tokenizer: str
    capacity: int = 4096
    end_id: int = 1
    #: Distinct words whose ids a task remembers.
    remembered: int = 1_500_000


class Capacities:
    """Segment tree over remaining capacities; a leaf holds ranges (first bin, bins) of equal bins."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1 - 1).bit_length()
        self.open = np.zeros(2 * self.size, np.int64)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _count(self, leaf: int, n: int) -> None:
        i = leaf + self.size
        while i:
            self.open[i] += n
            i >>= 1

    def push(self, left: int, first: int, bins: int) -> None:
        self.ranges[left].append((first, bins))
        self._count(left, bins)

    def pop(self, left: int, most: int) -> tuple[int, int]:
        """Up to ``most`` bins of a leaf's latest range."""
        first, bins = self.ranges[left].pop()
        if bins > most:
            self.ranges[left].append((first + most, bins - most))
            bins = most
        self._count(left, -bins)
        return first, bins

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least ``need`` that an open bin has left."""
        i = need + self.size
        if self.open[i]:
            return need
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, pieces per sequence, offset of the first).

    Pieces of a run are dealt ``per`` at a time to consecutive sequences.
    """
    tree, runs, bins = Capacities(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            left = tree.tightest(length)
            if left is None:
                per = min(capacity // length, todo)
                first, n, left = bins, todo // per, capacity
                bins += n
            else:
                # after one piece the bin is the tightest still, as long as another fits
                per = min(left // length, todo)
                first, n = tree.pop(left, todo // per)
            runs.append((length, rank, n * per, first, per, capacity - left))
            rank, todo = rank + n * per, todo - n * per
            if left - per * length:
                tree.push(left - per * length, first, n)
    return runs


class WordIds:
    """Token ids by word: a tokenizer that never looks across white space needs each distinct word once.

    Words are known by a 64-bit hash, in sorted arrays, so the memory holds a
    word in some thirty bytes; it is emptied when it is full.
    """

    def __init__(self, path: str, remembered: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bank = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            e = self.tokenizer.encode(words[at : at + 20_000], is_pretokenized=True, add_special_tokens=False)
            ids, part = np.array(e.ids, np.uint32), hashes[at : at + 20_000]
            sizes = np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)) if len(ids) else np.zeros(len(part), np.int64)
            if self.used + len(ids) > len(self.bank):
                self.bank = np.concatenate([self.bank, np.zeros(max(len(self.bank), len(ids)), np.uint32)])
            self.bank[self.used : self.used + len(ids)] = ids
            where = np.searchsorted(self.hashes, part)
            self.hashes = np.insert(self.hashes, where, part)
            self.starts = np.insert(self.starts, where, self.used + np.cumsum(sizes) - sizes)
            self.sizes = np.insert(self.sizes, where, sizes)
            self.used += len(ids)

    def __call__(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents of a run in a row, offsets of each document in them)."""
        first, last, hashes = word_spans(offsets, data)
        distinct, example, index = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != distinct[inside]
        if len(self.hashes) + new.sum() > self.remembered:
            self._forget()
            new[:] = True
        if new.any():
            raw = data.tobytes()
            spans = zip(first[example[new]].tolist(), last[example[new]].tolist())
            self._learn(distinct[new], [raw[a:b].decode() for a, b in spans])
        at = np.searchsorted(self.hashes, distinct)[index]
        starts, sizes = self.starts[at], self.sizes[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.bank[np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])]
        return ids, total[np.searchsorted(first, offsets)]


@functools.lru_cache(maxsize=2)
def word_ids(path: str, remembered: int) -> WordIds:
    """One memory a worker process, which outlives its tasks."""
    return WordIds(path, remembered)


def _pieces(rule: Packing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(rule.tokenizer, rule.remembered)
        kinds = {"doc_id": pa.int64(), "row": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            docs, names = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            for first, n, offsets, data in text_slices(batch, "text"):
                ids, at = encode(offsets, data)
                for i in range(n):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(rule.end_id)).astype("<u4")
                    for k, s in enumerate(range(0, len(own), rule.capacity)):
                        cut = own[s : s + rule.capacity]
                        yield docs[first + i], names[first + i], k, s, len(cut), zlib.crc32(cut)

        for batch in batches:
            yield from in_batches(kinds, rows(batch))
        trim()

    return run


def pack(docs: DataFrame, rule: Packing, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id; only what exceeds a sequence is cut.  A
    null or empty text is the end id alone.  Null and repeated ids are documents
    of their own.  Nothing is dropped; no document gives an empty result.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "pack")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    src = src.withColumn("row", F.xxhash64("doc_id", "text"))
    pieces = ws.keep(src.mapInArrow(_pieces(rule), "doc_id long, row long, piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs = best_fit(counts, rule.capacity)

    # ranks within a length: buckets before, then the order within the bucket
    bucket = F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(BUCKETS)).cast("int")
    placed = pieces.withColumn("bucket", bucket)
    per = placed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.withColumn("k", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "row", "piece")))
    ranked = ranked.join(per.select("length", "bucket", before.alias("before")), ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("k") - 1)

    # the plan by length, as one array a length
    plan: dict[int, list] = {}
    for length, rank, n, first, each, offset in runs:
        plan.setdefault(length, []).append((rank, n, first, each, offset))
    kind = "length long, runs array<struct<rank:bigint,n:bigint,first:bigint,per:bigint,offset:bigint>>"
    plans = spark.createDataFrame(list(plan.items()), kind)
    out = ranked.join(F.broadcast(plans), "length")  # bounded by the capacity, not by the data
    run = F.expr("filter(runs, r -> rank >= r.rank and rank < r.rank + r.n)[0]")
    out = out.withColumn("r", run).withColumn("i", F.col("rank") - F.col("r.rank"))
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("r.first") + F.floor(F.col("i") / F.col("r.per"))).cast("long").alias("sequence_id"),
        (F.col("r.offset") + (F.col("i") % F.col("r.per")) * F.col("length")).cast("long").alias("offset"),
    )
