"""Periodic runs: stretches of words that repeat with a period four times or more.

A run of period p has words p apart that are equal over at least 3p consecutive places, so one of
those places is a multiple of 3p.  For each document and each period up to a quarter of its
words, the multiples of 3p are the grid: n/3 times a harmonic number of points in all.  Points whose word differs from
that p ahead fall at once.  For the others, prefix hashes of the words tell whether two stretches
are equal; the longest common extensions of all (period, point) pairs of many documents, forwards
and backwards, are found by one binary search over NumPy arrays.  Hashes only propose: each stretch is
verified on its words, and where a hash was wrong its true runs are found by scanning.  Points of one run
meet in the same stretch and are merged, and so are multiples of its period.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_WHITE, POWERS, Workspace, mix64, text_slices, trim, word_bounds

#: Of a document id and its number of words: the first word of a tail and the period it is written anew with, or none.
Tail = Callable[[int, int], tuple[int, int] | None]


@dataclass(frozen=True)
class Periodic:
    #: Words of a run at least, and periods that it holds at least (two or more).
    least: int = 6
    exponent: int = 4
    #: Bytes of text that are looked at together, and (period, point) pairs; bounds of memory, longer texts stay whole.
    bytes: int = 1 << 19
    pairs: int = 1 << 20

    def __post_init__(self) -> None:
        if self.exponent < 2:
            raise ValueError("a run holds its period at least twice")


def planted_tail(doc_id: int, n: int) -> tuple[int, int] | None:
    """Tails that a tenth of all ids get, by the checksum of the id: words from the first on repeat with the period."""
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


class Prefixes:
    """Prefix hashes of a word sequence; equal stretches have equal hashes."""

    def __init__(self, ids: np.ndarray):
        self.up, _ = POWERS.get(len(ids) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(ids) + 1, np.uint64)
            np.cumsum(mix64(ids.astype(np.uint64) + np.uint64(1)) * self.up[: len(ids)], out=self.sums[1:])

    def equal(self, at: np.ndarray, period: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches from ``at`` and from ``at + period`` agree over ``length`` words, as far as hashes tell."""
        with np.errstate(over="ignore"):
            return (self.sums[at + length] - self.sums[at]) * self.up[period] == self.sums[at + period + length] - self.sums[at + period]

    def extended(self, at: np.ndarray, period: np.ndarray, most: np.ndarray, sign: int) -> np.ndarray:
        """The longest agreement of each pair from ``at`` on (sign 1) or before it (sign -1), all pairs at once."""
        low, high = np.zeros(len(at), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            good = self.equal(at if sign > 0 else at - mid, period, mid)
            low, high = np.where(good, mid, low), np.where(good, high, mid - 1)
        return low


def _pairs(bounds: np.ndarray, rule: Periodic) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, period, point) of the grid, some ``rule.pairs`` at a time; one period of one document is never parted."""
    n = np.diff(bounds)
    most = n // rule.exponent
    doc = np.repeat(np.arange(len(n)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = (rule.exponent - 1) * period
    points = (n[doc] - 1 - period) // step + 1
    ends = np.cumsum(points)
    a = 0
    while a < len(doc):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - points[a] + rule.pairs, "right")))
        c = points[a:b]
        d, p = np.repeat(doc[a:b], c), np.repeat(period[a:b], c)
        k = np.arange(len(d)) - np.repeat(np.cumsum(c) - c, c)
        yield d, p, bounds[d] + k * (rule.exponent - 1) * p
        a = b


def _claims(ids: np.ndarray, bounds: np.ndarray, rule: Periodic) -> np.ndarray:
    """(start, end, period) of all stretches that the hashes call runs, each once."""
    known = Prefixes(ids)
    found = [np.zeros((0, 3), np.int64)]
    for d, p, g in _pairs(bounds, rule):
        hit = ids[g] == ids[g + p]
        d, p, g = d[hit], p[hit], g[hit]
        ahead, behind = bounds[d + 1] - g - p, g - bounds[d]
        # one side of the point holds half of the agreement or more
        half = ((rule.exponent - 1) * p + 1) // 2
        right, left = ahead >= half, behind >= half
        right[right] = known.equal(g[right], p[right], half[right])
        left[left] = known.equal(g[left] - half[left], p[left], half[left])
        hit = right | left
        p, g, ahead, behind = p[hit], g[hit], ahead[hit], behind[hit]
        start = g - known.extended(g, p, behind, -1)
        end = g + p + known.extended(g, p, ahead, 1)
        long = end - start >= np.maximum(rule.least, rule.exponent * p)
        if long.any():
            found.append(np.unique(np.stack([start[long], end[long], p[long]], 1), axis=0))
    return np.unique(np.concatenate(found), axis=0)


def _true(ids: np.ndarray, claims: np.ndarray, most: int) -> np.ndarray:
    """Whether all words of each claim agree with those a period ahead; about ``most`` words are compared at a time."""
    length = claims[:, 1] - claims[:, 0] - claims[:, 2]
    out, ends, a = np.zeros(len(claims), bool), np.cumsum(length), 0
    while a < len(claims):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - length[a] + most, "right")))
        c = length[a:b]
        first = np.cumsum(c) - c
        at = np.arange(int(c.sum())) - np.repeat(first, c) + np.repeat(claims[a:b, 0], c)
        out[a:b] = np.logical_and.reduceat(ids[at] == ids[at + np.repeat(claims[a:b, 2], c)], first)
        a = b
    return out


def _scanned(ids: np.ndarray, low: int, high: int, claim: np.ndarray, rule: Periodic) -> Iterator[tuple[int, int, int]]:
    """The true runs of a claim's period that meet its stretch, within the document's words ``low`` to ``high``."""
    start, end, p = claim.tolist()
    same = np.flatnonzero(np.diff(np.concatenate([[False], ids[start : end - p] == ids[start + p : end], [False]]).astype(np.int8)))
    for a, b in (same.reshape(-1, 2) + start).tolist():
        while a > low and ids[a - 1] == ids[a - 1 + p]:
            a -= 1
        while b + p < high and ids[b] == ids[b + p]:
            b += 1
        if b + p - a >= max(rule.least, rule.exponent * p):
            yield a, b + p, p


def runs_of(ids: np.ndarray, bounds: np.ndarray, rule: Periodic = Periodic()) -> np.ndarray:
    """(start, end, smallest period) of all runs, ordered; document i has the word numbers ``ids[bounds[i]:bounds[i + 1]]``."""
    claims = _claims(ids, bounds, rule)
    if not len(claims):
        return claims
    # a stretch is verified for its smallest period; of a true one, multiples hold as well and say nothing new
    first = np.ones(len(claims), bool)
    first[1:] = (claims[1:, :2] != claims[:-1, :2]).any(1)
    least = claims[first]
    true = _true(ids, least, rule.pairs)
    group = np.cumsum(first) - 1
    wrong = ~true[group] | (claims[:, 2] % least[group, 2] != 0)
    if not wrong.any():
        return least
    doc = np.searchsorted(bounds, claims[:, 0], "right") - 1
    more = [r for i in np.flatnonzero(wrong) for r in _scanned(ids, int(bounds[doc[i]]), int(bounds[doc[i] + 1]), claims[i], rule)]
    every = np.unique(np.concatenate([least[true], np.array(more, np.int64).reshape(-1, 3)]), axis=0)
    keep = np.ones(len(every), bool)
    keep[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
    return every[keep]


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _slice(ids: pa.Array, offsets: np.ndarray, data: np.ndarray, rule: Periodic, tail: Tail | None) -> pa.RecordBatch:
    starts, ends = word_bounds(offsets, data)
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=places[1:])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data[~IS_WHITE[data]])])
    bounds = np.searchsorted(starts, offsets)
    origin = np.arange(len(starts))
    if tail is not None:
        for i, (doc_id, low, high) in enumerate(zip(ids.to_pylist(), bounds.tolist(), bounds[1:].tolist())):
            if doc_id is not None and (found := tail(doc_id, high - low)):
                first, period = found
                origin[low + first : high] = low + first + np.arange(high - low - first) % period
    numbers = words.dictionary_encode().indices.to_numpy()[origin]
    runs = runs_of(numbers, bounds, rule)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    doc = np.searchsorted(bounds, runs[:, 0], "right") - 1
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
    texts = pc.binary_join(pa.LargeListArray.from_arrays(np.searchsorted(kept, bounds), words.take(pa.array(origin[kept]))), pa.scalar(" ", pa.large_string()))
    values = pa.StructArray.from_arrays([pa.array(x) for x in (runs[:, 0] - bounds[doc], runs[:, 1] - runs[:, 0], runs[:, 2])], names=["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(bounds))).astype(np.int32)), values)
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds)), lists, texts.cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def _found(rule: Periodic, tail: Tail | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, offsets, data in text_slices(batch, "text", rule.bytes):
                yield _slice(batch.column("doc_id").slice(first, n), offsets, data, rule, tail)
        trim()

    return run


def periodic_runs(docs: DataFrame, rule: Periodic = Periodic(), tail: Tail | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each document.

    Words are ``[^\\x20\\x09-\\x0D]+``.  ``runs`` has (start, length, period) of each run by start and period: consecutive
    words with this smallest period, as long as the rule asks, which no neighbouring word extends.  ``collapsed`` is the text
    without the words that any run holds after its first period, joined by one space.  A null or empty text has no words, no runs
    and an empty text; repeated rows are judged each.  No row meets another, so a text of any length is one task's work, in memory
    that grows with that text only.  No documents, no rows.
    """
    Workspace(docs.sparkSession, "periodic")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_found(rule, tail), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def longest(runs: Column) -> Column:
    """The run of greatest length, of smallest start and period among equals; null without runs."""
    key = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.struct((-key["start"]).alias("start"), key["length"].alias("length"), (-key["period"]).alias("period"))
