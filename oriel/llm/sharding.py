"""Shards of nearly equal bytes: a minimax contiguous partition of ordered atomic groups.

Documents of equal text are one group, which no cut parts.  Groups are ordered by the digest of
their text, those larger than a fair share before the others, largest first.  The smallest capacity
with which so many shards hold all groups in this order is found by binary search: a capacity is
feasible if filling shard after shard greedily reaches the end.  The cuts are set there.

No task and no driver holds all groups.  Running sums of bytes come from groups written in ranges
of their order.  The driver sees blocks of consecutive groups, a bounded number at a time.  Where a
cut falls into a block, two greedy fillings bound it: one stops before the block, one at any byte
within.  Blocks in which these bounds still differ are read again in finer blocks, until
each block that a cut may touch is one group; then search and cuts are exact.  Among cuts that keep
the capacity, those nearest to even shares of what remains are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import in_order
from .common import Workspace


@dataclass(frozen=True)
class Sharding:
    shards: int = 8
    #: Blocks that the driver looks at in one round of the search; a bound of memory, not of what is searched.
    blocks: int = 65_536

    def __post_init__(self) -> None:
        if self.shards < 1 or self.blocks < 16 * self.shards:
            raise ValueError("at least one shard, and 16 blocks for each")


@dataclass
class Blocks:
    """Consecutive blocks of groups: where each begins, whether it is a single group, and the digest it begins with."""

    starts: np.ndarray
    single: np.ndarray
    digests: list[bytes]
    total: int

    def down(self, x: int, sure: bool) -> int:
        """The last group bound up to byte ``x``: one that is known, or one that may be there."""
        if x >= self.total:
            return self.total
        i = int(np.searchsorted(self.starts, x, "right")) - 1
        return int(self.starts[i]) if sure or self.single[i] else x

    def up(self, x: int, sure: bool) -> int:
        """The first group bound from byte ``x`` on."""
        if x <= 0:
            return 0
        i = int(np.searchsorted(self.starts, x, "left"))
        if i < len(self.starts) and self.starts[i] == x:
            return x
        end = int(self.starts[i]) if i < len(self.starts) else self.total
        return end if sure or self.single[i - 1] else x

    def filled(self, shards: int, capacity: int, sure: bool) -> list[int]:
        """Ends of shards that are filled from the left as far as the capacity lets them."""
        return list(accumulate(range(shards), lambda p, _: self.down(p + capacity, sure), initial=0))[1:]

    def filled_back(self, shards: int, capacity: int, sure: bool) -> list[int]:
        """Ends of shards that are filled from the right."""
        out = list(accumulate(range(shards - 1), lambda p, _: self.up(p - capacity, sure), initial=self.total))
        return out[::-1]

    def smallest(self, shards: int, sure: bool) -> int:
        """The smallest capacity that is feasible."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            mid = (low + high) // 2
            if self.filled(shards, mid, sure)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def unsure(self, shards: int) -> list[tuple[int, int]]:
        """Spans of blocks that a cut may fall into, from the least capacity that may do to the least that does."""
        low, high = self.smallest(shards, False), self.smallest(shards, True)
        near = zip(self.filled(shards, low, True)[:-1], self.filled(shards, high, False)[:-1])
        back = zip(self.filled_back(shards, high, False)[:-1], self.filled_back(shards, low, True)[:-1])
        ends = np.append(self.starts[1:], self.total)
        spans = []
        for a, b in (*near, *back):
            hit = np.flatnonzero(~self.single & (ends > min(a, b)) & (self.starts < max(a, b)))
            if len(hit):
                spans.append((int(self.starts[hit[0]]), int(ends[hit[-1]])))
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged

    def refined(self, spans: list[tuple[int, int]], rows: list[tuple[int, bool, bytes]]) -> Blocks:
        """With the blocks of ``spans`` replaced by ``rows``."""
        keep = np.ones(len(self.starts), bool)
        for a, b in spans:
            keep &= (self.starts < a) | (self.starts >= b)
        left = [(int(self.starts[i]), bool(self.single[i]), self.digests[i]) for i in np.flatnonzero(keep)]
        return Blocks.of(left + rows, self.total)

    @classmethod
    def of(cls, rows: list[tuple[int, bool, bytes]], total: int) -> Blocks:
        rows = sorted(rows)
        return cls(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], bool), [r[2] for r in rows], total)

    def cuts(self, shards: int, capacity: int) -> list[int]:
        """``shards`` - 1 group bounds, each as near to an even share of what is left as the capacity lets it be."""
        last, first = self.filled(shards, capacity, True), self.filled_back(shards, capacity, True)
        bounds = np.append(self.starts, self.total)
        out, at = [], 0
        for i in range(shards - 1):
            high = min(last[i], self.down(at + capacity, True))
            known = bounds[np.searchsorted(bounds, max(first[i], at)) : np.searchsorted(bounds, high, "right")]
            filled = known[known > at]  # an empty shard only where there is no other way
            known = filled if len(filled) else known
            share = at + (self.total - at) / (shards - i)
            at = int(known[np.argmin(np.abs(known - share))])
            out.append(at)
        return out


@dataclass(frozen=True)
class Plan:
    """Where the cuts are: shards of large groups by digest, and the digests at which further shards begin."""

    shards: int
    capacity: int
    #: Groups larger than a fair share, by digest; fewer than there are shards.
    large: dict[bytes, int] = field(default_factory=dict)
    first: int = 0
    begins: list[bytes] = field(default_factory=list)

    def shard(self, digest: Column) -> Column:
        """The shard of a document by the digest of its text: no join, so whole documents can be written by it as well."""
        out = F.lit(self.first)
        for b in self.begins:
            out = out + (digest >= F.lit(b)).cast("int")
        for d, s in self.large.items():
            out = F.when(digest == F.lit(d), s).otherwise(out)
        return out.cast("int")


def digest_of(text: Column) -> Column:
    """SHA-256 of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes before each group within its range, which is one task."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column("bytes").to_numpy()
        ends = at + np.cumsum(size)
        at = int(ends[-1])
        yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("bytes"), pa.array(np.full(len(size), part, np.int64)), pa.array(ends - size)], names=["digest", "bytes", "part", "before"])


def _large(groups: DataFrame, total: int, shards: int) -> list[tuple[bytes, int]]:
    """Groups larger than a fair share of what is left when those before them are gone, largest first."""
    out: list[tuple[bytes, int]] = []
    for r in groups.orderBy(F.desc("bytes"), "digest").limit(shards).collect():
        left = shards - len(out)
        if left < 2 or r["bytes"] * left <= total - sum(b for _, b in out):
            break
        out.append((bytes(r["digest"]), r["bytes"]))
    return out


def _blocks(placed: DataFrame, spans: list[tuple[int, int]], width: int) -> list[tuple[int, bool, bytes]]:
    """(start, single, first digest) of blocks of about ``width`` bytes within ``spans``; a group of more is a block of its own."""
    hit = F.lit(False)
    for a, b in spans:
        hit |= (F.col("start") >= a) & (F.col("start") < b)
    block = placed.where(hit).groupBy(F.floor(F.col("start") / F.lit(width)).alias("b"), (F.col("bytes") > width).alias("own"))
    got = block.agg(F.min("start").alias("start"), F.count(F.lit(1)).alias("n"), F.min("digest").alias("digest")).collect()
    return [(r["start"], r["n"] == 1, bytes(r["digest"])) for r in got]


def fit(slim: DataFrame, rule: Sharding, ws: Workspace) -> Plan | None:
    """The plan of a table of ``digest`` and ``size``; none for a table without rows."""
    groups = ws.keep(slim.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0]
    if not total:
        return None
    large = _large(groups, total, rule.shards)
    rest = groups.where(~F.col("digest").isin([F.lit(d) for d, _ in large])) if large else groups
    # digests are evenly spread, so ranges of them are even
    ranged = rest.repartitionByRange("digest").sortWithinPartitions("digest")
    ranged = ws.keep(ranged.mapInArrow(_running, "digest binary, bytes long, part long, before long"), "ranged")
    ends = ranged.groupBy("part").agg(F.max(F.col("before") + F.col("bytes")).alias("bytes")).collect()  # a row for each range
    sizes = dict(sorted((r["part"], r["bytes"]) for r in ends))
    base = sum(b for _, b in large)
    offsets = pa.table({"part": pa.array(sizes, pa.int64()), "offset": pa.array([base + x for x in accumulate(sizes.values(), initial=0)][: len(sizes)], pa.int64())})
    placed = ranged.join(F.broadcast(slim.sparkSession.createDataFrame(offsets)), "part").select("digest", "bytes", (F.col("offset") + F.col("before")).alias("start"))

    width = max(1, -(-total // rule.blocks))
    own = [(s, True, d) for s, (d, _) in zip(accumulate((b for _, b in large), initial=0), large)]
    blocks = Blocks.of(own + (_blocks(placed, [(base, total)], width) if sizes else []), total)
    while spans := blocks.unsure(rule.shards):
        width = max(1, min(width // 4, -(-sum(b - a for a, b in spans) // rule.blocks)))
        blocks = blocks.refined(spans, _blocks(placed, spans, width))
    capacity = blocks.smallest(rule.shards, True)
    cuts = blocks.cuts(rule.shards, capacity)
    ws.drop("groups", "ranged")
    begin = dict(zip(blocks.starts.tolist(), blocks.digests))
    of_large = {d: sum(c <= s for c in cuts) for s, _, d in own}
    return Plan(rule.shards, capacity, of_large, sum(c <= base for c in cuts), [begin[c] for c in cuts if base < c < total])


def assign(docs: DataFrame, rule: Sharding = Sharding(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Plan | None]:
    """(doc_id, size, text_crc32, shard, slot) of each document, and the plan, whose ``shard`` places documents of the same table.

    A document's size is its UTF-8 bytes and one more; a null text counts as empty.  Slots number the documents of
    a shard without gaps from 0, in the order of digests and ids; a null id comes last.  Documents of one text stay together, repeated rows
    too, so one very frequent text makes its shard as large as it is.  Of fewer groups than shards, some shards stay empty.  No documents, no rows.
    """
    ws = Workspace(docs.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), digest_of(text).alias("digest"))
    slim = ws.keep(slim, "slim")
    plan = fit(slim, rule, ws)
    if plan is None:
        return slim.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")), None
    placed = in_order(slim.withColumn("shard", plan.shard(F.col("digest"))), ["shard", "digest", "doc_id"], "shards")
    held = {r["shard"]: r["count"] for r in placed.rows.groupBy("shard").count().collect()}  # a row for each shard
    before = list(accumulate((held.get(i, 0) for i in range(plan.shards)), initial=0))
    ws.drop("slim")
    skip = F.lit(0)
    for i in range(1, plan.shards):
        skip = F.when(F.col("shard") == i, F.lit(before[i])).otherwise(skip)
    out = placed.numbered("slot", 0).withColumn("slot", (F.col("slot") - skip).cast("long"))
    return out.select("doc_id", "size", "text_crc32", "shard", "slot"), plan


def write(docs: DataFrame, plan: Plan | None, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Whole documents as parquet in a folder for each shard, in the order of slots within files; all columns stay."""
    digest = digest_of(F.col(text_col).cast("string"))
    placed = docs.withColumn("__shard", plan.shard(digest) if plan else F.lit(0)).withColumn("__digest", digest)
    placed = placed.repartitionByRange("__shard", "__digest", F.col(id_col), F.monotonically_increasing_id()).sortWithinPartitions("__shard", "__digest", F.col(id_col).asc_nulls_last())
    placed.drop("__digest").write.partitionBy("__shard").parquet(path)

