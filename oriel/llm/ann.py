"""Approximate nearest neighbours over balanced posting lists.

Centroids come from a balanced bisection of a bounded sample.  They are held in
memory as a graph; best-first search on it finds the lists of a vector.  A vector
near a boundary is replicated to each list whose centroid is nearly as close as the
closest one; a query reads the lists that distance-ratio pruning leaves.  The ratio is
measured on the sample: the smallest with which so many of the true neighbours there
lie in lists that are read, so data in clusters is pruned hard, and data without any
structure reads as much as its recall needs.  A query on or very near a centroid counts as being a small
radius away, which the sample gives, so ratios are finite whatever the data.  A query that wants more
lists than the graph search returned is compared with all centroids.

Equal vectors are one class with its smallest id, however many rows share it; the other ids
of a class are looked up where a result holds it, and equal queries are asked once.  Lists are
dealt to shards of bounded bytes, a long list to several, and a query goes once to each shard that has
lists it reads, so what is shuffled follows the shards and not the lists.  A shard multiplies blocks of
queries with its lists, drops what is farther than twice as many of the sample as the query wants, and
takes exact distances of the rest.  Replicas are made where the sample says that they spare
comparisons.  A query that finds fewer than it should is asked of all lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace


@dataclass(frozen=True)
class Spann:
    #: Vectors that centroids are fitted on, and what bounds the index in memory.
    sample: int = 20_000
    #: Vectors a list should hold, before replication; lists are at most a sixteenth of the sample in number.
    list_size: int = 128
    #: Replicas of a vector at most, and how much farther than the closest their centroids may be.
    replicas: int = 2
    replica_ratio: float = 1.1
    #: Share of a query's true neighbours in the sample that the lists it reads must hold, and queries that it is measured on.
    recall: float = 0.97
    measured_on: int = 400
    degree: int = 24
    #: Centroids that the graph search keeps open: of a query, and of a vector that gets its few lists.
    beam: int = 48
    place_beam: int = 12
    #: Bytes of vectors that a task holds at once, and shards at least where there are as many lists.
    shard_bytes: int = 48 << 20
    shards: int = 96
    k: int = 10


def bisect(x: np.ndarray, parts: int) -> list[np.ndarray]:
    """Row numbers of ``parts`` groups of nearly equal size, neighbours in space being neighbours in the list."""
    out: list[np.ndarray] = []
    stack = [(np.arange(len(x)), parts)]
    while stack:
        rows, n = stack.pop()
        if n <= 1 or len(rows) <= 1:
            out.append(rows)
            continue
        y = x[rows] - x[rows].mean(0)
        axis = y[np.argmax((y * y).sum(1))]
        for _ in range(8):  # towards the direction of most spread
            axis = y.T @ (y @ axis)
            axis = axis / max(np.linalg.norm(axis), 1e-300)
        order = np.argsort(y @ axis, kind="stable")
        half = n // 2
        cut = len(rows) * half // n
        stack += [(rows[order[cut:]], n - half), (rows[order[:cut]], half)]
    return [r for r in out if len(r)]


@dataclass
class Centroids:
    """Centroids and their neighbourhood graph."""

    points: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    #: Distances to the closest centroid count as this much at least when ratios are taken.
    radius: float

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, rule: Spann) -> Centroids:
        x = sample.astype(np.float64)
        points = np.unique(np.array([x[r].mean(0) for r in bisect(x, lists)]), axis=0) if len(x) else x
        n = len(points)
        norms = (points**2).sum(1)
        near = []
        for a in range(0, n, 512):
            d = norms[a : a + 512, None] - 2 * points[a : a + 512] @ points.T + norms[None, :]
            near.append(np.argsort(d, axis=1, kind="stable")[:, : rule.degree + 1])
        near_ = np.concatenate(near) if near else np.zeros((0, 1), np.int64)
        links: list[set[int]] = [set(r.tolist()) for r in near_]
        for i, r in enumerate(near_):  # both ways
            for j in r.tolist():
                links[j].add(i)
        width = max((len(s) for s in links), default=1)
        graph = np.array([sorted(s) + [i] * (width - len(s)) for i, s in enumerate(links)], np.int64).reshape(n, width)
        step = max(1, int(np.sqrt(n)))
        out = cls(points, graph, np.arange(0, n, step), 1.0)
        # the median distance of sampled vectors from their centroid; where they lie on centroids, that between centroids
        own = [float(x) for a in range(0, len(sample), 256) for x in np.sqrt(out.all(sample[a : a + 256])[1][:, 0])] if n else []
        apart = np.sqrt(np.sort(out.all(points[:256])[1], axis=1)[:, 1]) if n > 1 else np.zeros(0)
        usual = float(np.median(own)) if own else 0.0
        out.radius = usual or (float(np.median(apart)) if len(apart) else 0.0) or 1.0
        return out

    def all(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid numbers, squared distances) of all centroids, nearest first."""
        d = np.maximum((self.points**2).sum(1)[None, :] - 2 * x @ self.points.T + (x**2).sum(1)[:, None], 0)
        ids = np.argsort(d, axis=1, kind="stable")
        return ids, np.take_along_axis(d, ids, 1)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroid numbers, squared distances) of the beam's best, nearest first; -1 and infinity fill up."""
        n, b = len(self.points), len(x)
        beam = min(beam, n)
        norms, xn = (self.points**2).sum(1), (x**2).sum(1)
        if 4 * beam >= n:  # a graph saves nothing where most of it is asked for
            ids, d = self.all(x)
            return ids[:, :beam], d[:, :beam]
        seen = np.zeros((b, n), bool)
        ids = np.full((b, beam), -1, np.int64)
        dist = np.full((b, beam), np.inf)
        done = np.ones((b, beam), bool)

        def offer(rows: np.ndarray, new: np.ndarray) -> None:
            """Unseen centroids ``new`` (one row of numbers for each of ``rows``) into the beams."""
            fresh = ~seen[rows[:, None], new]
            # a number twice in one row counts once
            order = np.argsort(new, axis=1, kind="stable")
            ordered = np.take_along_axis(new, order, 1)
            twice = np.zeros_like(fresh)
            twice[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
            np.put_along_axis(fresh, order, np.take_along_axis(fresh, order, 1) & ~twice, 1)
            seen[rows[:, None], new] = True
            d = norms[new] - 2 * np.einsum("rkd,rd->rk", self.points[new], x[rows]) + xn[rows][:, None]
            d = np.where(fresh, np.maximum(d, 0), np.inf)
            all_ids = np.concatenate([ids[rows], new], 1)
            all_d = np.concatenate([dist[rows], d], 1)
            all_done = np.concatenate([done[rows], ~fresh], 1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            ids[rows] = np.take_along_axis(all_ids, best, 1)
            dist[rows] = np.take_along_axis(all_d, best, 1)
            done[rows] = np.take_along_axis(all_done, best, 1) | ~np.isfinite(dist[rows])

        every = np.arange(b)
        for a in range(0, len(self.entries), 64):
            offer(every, np.repeat(self.entries[None, a : a + 64], b, 0))
        while len(rows := np.flatnonzero(~done.all(1))):
            at = np.argmin(done[rows], 1)  # beams are sorted: the first that is open is the nearest
            done[rows, at] = True
            offer(rows, self.graph[ids[rows, at]])
        return np.where(np.isfinite(dist), ids, -1), dist

    def lists(self, x: np.ndarray, beam: int, ratio: float, most: int | None = None) -> Iterator[np.ndarray]:
        """The lists of each vector: the closest, and others up to ``ratio`` times as far; ``most`` bounds replicas."""
        for a in range(0, len(x), 256):
            y = x[a : a + 256]
            ids, d = self.search(y, beam)
            good = self.within(ids, d, ratio)
            wide = good[:, -1] & (ids.shape[1] < len(self.points)) if most is None else np.zeros(len(y), bool)
            more, far = self.all(y[wide]) if wide.any() else (ids[:0], d[:0])
            rest = iter(zip(more, self.within(more, far, ratio)))
            for i, g, w in zip(ids, good, wide):
                i, g = next(rest) if w else (i, g)
                yield i[g][:most]

    def closest(self, x: np.ndarray, ratio: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the closest list of each vector, and of others up to ``ratio`` times as far, ``most`` in all."""
        rows, lists = [], []
        norms = (self.points**2).sum(1)
        for a in range(0, len(x), 1024):
            y = x[a : a + 1024]
            d, every = norms[None, :] - 2 * y @ self.points.T, np.arange(len(y))
            own = (y**2).sum(1)
            for turn in range(min(most, len(self.points))):
                at = np.argmin(d, axis=1)
                far = np.sqrt(np.maximum(d[every, at] + own, 0))
                limit = far if not turn else limit
                good = far <= (ratio if turn else 1.0) * np.maximum(limit, self.radius) * (1 + 1e-9)
                rows.append(a + every[good])
                lists.append(at[good])
                d[every, at] = np.inf
        return (np.concatenate(rows), np.concatenate(lists)) if rows else (np.zeros(0, np.int64),) * 2

    def within(self, ids: np.ndarray, d: np.ndarray, ratio: float) -> np.ndarray:
        """Which of the centroids found are at most ``ratio`` times as far as the closest."""
        return (ids >= 0) & (np.sqrt(d) <= ratio * np.maximum(np.sqrt(d[:, :1]), self.radius) * (1 + 1e-9))


def measured_ratio(index: Centroids, sample: np.ndarray, rule: Spann) -> tuple[float, int]:
    """The distance ratio that reaches ``rule.recall`` on the sample, and the most lists that a query there then reads."""
    return measured(index, sample, rule, rule.replicas)[:2]


def measured(index: Centroids, sample: np.ndarray, rule: Spann, replicas: int) -> tuple[float, int, float]:
    """``measured_ratio`` for so many replicas at most, and the comparisons of a query for each vector of the corpus."""
    n, lists = len(sample), len(index.points)
    if lists < 2 or n < 2:
        return np.inf, lists, 1.0
    asked = np.unique(np.linspace(0, n - 1, min(rule.measured_on, n)).astype(int))
    norms, points = (sample**2).sum(1), (index.points**2).sum(1)
    near, ratios = [], []
    for q in asked.tolist():
        d = norms - 2 * sample @ sample[q]
        d[q] = np.inf
        near.append(np.argpartition(d, min(rule.k, n - 1) - 1)[: min(rule.k, n - 1)])
        c = np.sqrt(np.maximum(points - 2 * index.points @ sample[q] + norms[q], 0))
        ratios.append(c / max(c.min(), index.radius))
    wanted, where = np.unique(np.concatenate(near), return_inverse=True)
    row, at = index.closest(sample[wanted], rule.replica_ratio, replicas)
    member = [at[row == i] for i in range(len(wanted))]
    ends = np.cumsum([len(rows) for rows in near])
    needed = [float(r[member[i]].min()) for r, rows in zip(ratios, np.split(where, ends[:-1])) for i in rows.tolist()]
    ratio = max(1.0, float(np.quantile(needed, rule.recall, method="higher")))
    read = [int((r <= ratio * (1 + 1e-9)).sum()) for r in ratios]
    return ratio, max(read), len(row) / len(wanted) * float(np.mean(read)) / lists


def usable(vector: Column) -> Column:
    """No null, no non-finite component, and not all zero."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(v, lambda x: x != 0.0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type = np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


@dataclass
class Shards:
    """To which shards the lists go: ``parts`` shards from ``first`` on, by a hash of the vector."""

    first: np.ndarray
    parts: np.ndarray

    @classmethod
    def deal(cls, expected: np.ndarray, most: int, least: int) -> Shards:
        """From the vectors expected in each list: neighbouring lists together up to ``most`` vectors, ``least`` shards if there are as many lists."""
        room = min(most, max(1.0, float(expected.sum()) / max(1, min(least, len(expected)))))
        first, parts, shard, held = [], [], 0, 0.0
        for n in expected.tolist():
            if held and held + n > room * 1.01:
                shard, held = shard + 1, 0.0
            wide = int(np.ceil(max(n, 1.0) / most))
            first.append(shard)
            parts.append(wide)
            held += n
            if wide > 1:
                shard, held = shard + wide, 0.0
        return cls(np.array(first), np.array(parts))


def _post(index: Centroids, shards: Shards, ratio: float, replicas: int):
    """Rows of vectors in their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, lists = index.closest(_matrix(batch.column("v")), ratio, replicas)
            h = batch.column("h").to_numpy()[rows].view(np.uint64)
            shard = shards.first[lists] + (h % shards.parts[lists].astype(np.uint64)).astype(np.int64)
            out = batch.take(pa.array(rows))
            none = pa.nulls(len(rows), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(np.zeros(len(rows), np.int32)), pa.array(lists), *(out.column(c) for c in ("id", "n", "h", "g", "v")), pa.nulls(len(rows), pa.float64()), none], names=DEALT
            )

    return run


DEALT = ["shard", "side", "list", "id", "n", "h", "g", "v", "bound", "lists"]


def _probe(index: Centroids, shards: Shards, beam: int, ratio: float, sample: np.ndarray, k: int):
    """A row for each query and shard that it reads: its lists there, and the squared distance of its k-th nearest in the sample, beyond which nothing is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = (sample**2).sum(1)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                x = _matrix(batch.column("v"))
                own = (x**2).sum(1)
                bound = np.full(len(x), np.inf)
                if len(sample) >= k:
                    d = np.partition(norms[None, :] - 2 * x @ sample.T, k - 1, axis=1)[:, k - 1] + own
                    bound = np.maximum(d, 0) + 1e-9 * (own + norms.max())
                found = list(index.lists(x, beam, ratio))
                row, at = np.repeat(np.arange(len(x)), [len(f) for f in found]), np.concatenate(found)
                wide = shards.parts[at]
                row, at = np.repeat(row, wide), np.repeat(at, wide)
                shard = shards.first[at] + np.arange(len(at)) - np.repeat(np.cumsum(wide) - wide, wide)
                order = np.lexsort((at, shard, row))
                row, at, shard = row[order], at[order], shard[order]
                head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(at)), pa.int32()), pa.array(at, pa.int32()))
                out, n = batch.take(pa.array(row[head])), len(head)
                zero = pa.array(np.zeros(n, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(shard[head]), pa.array(np.ones(n, np.int32)), zero, out.column("q"), zero, zero, zero, out.column("v"), pa.array(bound[row[head]]), lists], names=DEALT)

    return run


def _in_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], pa.RecordBatch]]:
    """(all vectors of a shard, some of its queries), from rows sorted by shard and side."""
    held: list[pa.RecordBatch] = []
    shard, asked = None, False
    for batch in batches:
        at, side = batch.column("shard").to_numpy(), batch.column("side").to_numpy()
        cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(side) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if a == b:
                continue
            if at[a] != shard:
                held, shard = [], at[a]
            if side[a] == 0:
                held.append(batch.slice(a, b - a))
            elif held:
                for z in range(a, b, 1024):
                    yield held, batch.slice(z, min(1024, b - z))


FOUND = ["q", "score", "id", "n", "h", "g"]


def _best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, h: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the ``k`` nearest of each query, ties to the smaller id, a class once; by query."""
    order = np.lexsort((h, ids, score, q))
    a = order[1:], order[:-1]
    order = order[np.concatenate([[True], (q[a[0]] != q[a[1]]) | (ids[a[0]] != ids[a[1]]) | (h[a[0]] != h[a[1]])])] if len(order) else order
    own = q[order]
    head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
    place = np.arange(len(own)) - np.repeat(head, np.diff(np.append(head, len(own))))
    return order[place < k]


def _nearest(k: int, kind: type):
    """The ``k`` nearest classes of each query among the lists of a shard that it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[pa.RecordBatch] | None = None
        for held, asked in _in_shards(batches):
            if held is not last:
                last, t = held, pa.Table.from_batches(held)
                v, ids, h = _matrix(t.column("v"), kind), t.column("id").to_numpy(), t.column("h").to_numpy()
                lists, starts = np.unique(t.column("list").to_numpy(), return_index=True)
                ends = np.append(starts[1:], len(v))
                place = {int(x): (int(a), int(b)) for x, a, b in zip(lists, starts, ends)}
                norms = np.einsum("ij,ij->i", v, v, dtype=np.float64)
                # products in single precision where its range and margin allow
                small = np.float32 if norms.max(initial=0) < 1e30 else np.float64
                quick, eps = v.astype(small, copy=False), (v.shape[1] + 16) * float(np.finfo(small).eps)
            x = _matrix(asked.column("v"))
            own, bound = (x**2).sum(1), asked.column("bound").to_numpy().copy()
            if own.max(initial=0) >= 1e30 and small is np.float32:
                small, quick, eps = np.float64, v.astype(np.float64), (v.shape[1] + 16) * float(np.finfo(np.float64).eps)
            y, best = x.astype(small), [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            wanted = asked.column("lists")
            who = np.repeat(np.arange(len(x)), np.diff(wanted.offsets.to_numpy()))
            which = wanted.flatten().to_numpy()
            order = np.argsort(which, kind="stable")
            which, who = which[order], who[order]
            for r in np.split(np.arange(len(which)), np.flatnonzero(np.diff(which)) + 1):
                if not len(r) or int(which[r[0]]) not in place:
                    continue
                begin, end = place[int(which[r[0]])]
                rows = who[r]
                for a in range(begin, end, 8192):
                    b = min(a + 8192, end)
                    far = norms[a:b]
                    limit = (bound[rows] * (1 + 1e-12) + eps * (own[rows] + far.max()) - own[rows] + 1e-36)[:, None]
                    i, j = np.nonzero((y[rows] * small(-2)) @ quick[a:b].T + far.astype(small)[None, :] <= limit.astype(small))
                    if not len(i):
                        continue
                    i, j = rows[i], j + a
                    d = np.concatenate([np.sqrt(((v[j[z : z + 65536]].astype(np.float64, copy=False) - x[i[z : z + 65536]]) ** 2).sum(1)) for z in range(0, len(j), 65536)])
                    good = np.isfinite(d)
                    both = [np.concatenate(c) for c in zip(best, (i[good], j[good], d[good]))]
                    some = _best(both[0], both[2], ids[both[1]], h[both[1]], k)
                    best = [c[some] for c in both]
                    full, count = np.unique(best[0], return_counts=True)
                    last_of = np.cumsum(count) - 1
                    full, last_of = full[count == k], last_of[count == k]
                    bound[full] = np.minimum(bound[full], best[2][last_of] ** 2)
            if len(best[0]):
                at = pa.array(best[1])
                yield pa.RecordBatch.from_arrays([asked.column("id").take(pa.array(best[0])), pa.array(best[2]), *(t.column(c).take(at).combine_chunks() for c in ("id", "n", "h", "g"))], names=FOUND)

    return run


def _merged(k: int):
    """The ``k`` nearest classes of each query, from rows sorted by query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            parts = [x for x in (rest, batch) if x is not None]
            if not parts:
                continue
            t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            q = t.column("q").to_numpy()
            some = np.sort(_best(q, *(t.column(c).to_numpy() for c in ("score", "id", "h")), k))
            cut = len(some) if batch is None else int(np.searchsorted(q[some], q[-1]))  # the last query may go on
            rest = t.take(pa.array(some[cut:]))
            if cut:
                yield t.take(pa.array(some[:cut]))

    return run


def search(vectors: DataFrame, queries: DataFrame, rule: Spann = Spann(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest ``rule.k`` found of each query, by Euclidean distance.

    ``queries`` has the same two columns as ``vectors``; a vector with the query's
    id is no candidate.  Vectors that are null, zero or hold null or non-finite
    components take no part, nor do null ids and vectors of another length than
    the most usual one.  Equal distances go to the smaller id; rows that repeat an id and a vector are
    one candidate.  No vectors, no rows.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "ann")
    kind = vectors.schema[vector_col].dataType.simpleString()
    plus = F.lit(0).cast(kind[len("array<") : -1])
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())
    digests = (F.xxhash64("v").alias("h"), F.xxhash64(F.lit(7), "v").alias("g"))
    signed = lambda df: df.withColumn("v", F.transform("v", lambda x: x + plus))  # noqa: E731  of two zeros one, as in groups
    sizes = pick(vectors).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, total, more = sizes["d"], sizes["count"], rule.k + 1
    base = pick(vectors).where(F.size("v") == dims)
    asked = signed(pick(queries).where(F.size("v") == dims)).select("id", "v", *digests)
    classes = base.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    classes = ws.keep(classes.select("id", "n", *digests, "v"), "classes")
    asks = ws.keep(asked.groupBy("v").agg(F.min("id").alias("q")).select("q", *digests, "v"), "asks")
    distinct = classes.count()
    share = min(1 << 30, -(-rule.sample * (1 << 30) // distinct))  # about as many as the sample holds, by hash
    drawn = classes.where(F.pmod(F.xxhash64("h", "id"), F.lit(1 << 30)) < share).select("v").toArrow()
    lists = int(np.clip(-(-distinct // rule.list_size), 1, max(1, rule.sample // 16)))
    sample = np.unique(_matrix(drawn.column("v")), axis=0)
    index = Centroids.fit(sample, lists, rule)
    # replicas if they spare comparisons
    replicas = min(range(1, rule.replicas + 1), key=lambda r: measured(index, sample, rule, r)[2])
    ratio, most, _ = measured(index, sample, rule, replicas)
    expected = np.bincount(index.closest(sample, rule.replica_ratio, replicas)[1], minlength=len(index.points)) * (distinct / max(1, len(sample)))
    shards = Shards.deal(expected, max(1, rule.shard_bytes // (4 * dims)), rule.shards)

    posted = f"shard long, side int, list long, id long, n long, h long, g long, v {kind}, bound double, lists array<int>"

    def compared(asks: DataFrame, beam: int, ratio: float, label: str) -> DataFrame:
        """(q, score, id, n, h, g): the nearest classes of each query."""
        dealt = classes.mapInArrow(_post(index, shards, rule.replica_ratio, replicas), posted).unionByName(asks.select("q", "v").mapInArrow(_probe(index, shards, beam, ratio, sample, 2 * more), posted))
        schema = "q long, score double, id long, n long, h long, g long"
        near = dealt.repartition("shard").sortWithinPartitions("shard", "side", "list").mapInArrow(_nearest(more, np.float32 if kind == "array<float>" else np.float64), schema)
        return ws.keep(near.repartition("q").sortWithinPartitions("q").mapInArrow(_merged(more), schema), label)

    found = compared(asks, max(rule.beam, most), ratio, "found")
    # queries that their lists hold too few vectors for, if there are any
    enough = found.groupBy("q").agg(F.sum("n").alias("n")).where(F.col("n") >= min(more, total)).select("q")
    short = ws.keep(asks.join(enough, "q", "left_anti"), "short")
    if short.limit(1).count():
        every = compared(short, len(index.points), np.inf, "every")
        found = found.join(short.select("q"), "q", "left_anti").unionByName(every)
    # all ids of the classes found that have several, at most as many as a result can hold
    several = found.where("n > 1").select("h", "g", "id", "n").distinct()
    several = ws.keep(several.withColumnRenamed("id", "c"), "several")
    if several.limit(1).count():
        alike = signed(base).select("id", *digests).join(several, ["h", "g"])
        least = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, more)
        alike = alike.groupBy("h", "c", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / 4096))).agg(least(F.collect_list("id")).alias("ids"))
        alike = alike.groupBy("h", "c").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"))
        found = found.withColumnRenamed("id", "c").join(alike, ["h", "c"], "left").select("q", "score", F.explode(F.coalesce("ids", F.array("c"))).alias("id"))
    of = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "id"))), 1, more).alias("near"))
    ids = asked.select("id", "h", "g").join(asks.select("q", "h", "g"), ["h", "g"]).select("id", "q")
    # a query id that several vectors have gets the nearest of all of them
    own = ids.join(of, "q").groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("near")))).alias("near"))
    near = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, rule.k)
    return own.select(F.col("id").alias("query_id"), F.posexplode(near).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
