"""Exact substring deduplication with an enhanced suffix array, cut into independent buckets.

A repeated string of ``length`` bytes is found without comparing texts with each
other.  Each window of ``length`` bytes selects the least hash of its k-byte
grams; runs of windows that select the same gram make one segment, and equal
windows always lie in segments of the same gram.  So segments are dealt by gram:

1. grams alone (five bytes and a place) tell which segments have a partner in another document;
2. the bytes of those segments meet in their gram's bucket, where equal segments
   become one and a suffix array with common prefixes is built over the rest;
3. a stack scan turns the array into the tree of common-prefix intervals; those whose
   left extensions differ are the maximal repeats, reported with all their occurrences;
4. an occurrence after the first document of its repeat is removed.

Everything that is shuffled is packed in compressed blobs.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODE, POWERS, Workspace, in_groups, mix64, text_slices

LOW6 = np.uint64(63)
#: Bytes of input for each bucket of grams, each part (whole buckets that are sent together) and each block of documents.
#: What is sent has a blob for each part and block, so these are as large as a task can hold.
BUCKET_BYTES, PART_BYTES, BLOCK_BYTES = 1 << 20, 16 << 20, 16 << 20
#: Partitions that the driver keeps track of at most; beyond, each has several buckets or blocks, one after the other.
MOST_PARTITIONS = 16_384
#: Bytes that one suffix array is built over, but for a single gram's segments.
ARRAY_BYTES = 1 << 19


@dataclass(frozen=True)
class Repeats:
    """Bytes of a repeat at least, and bytes of a gram; 64 grams a window at most."""

    length: int = 50
    gram: int = 20

    @property
    def grams(self) -> int:
        return self.length - self.gram + 1


def gram_keys(data: np.ndarray, k: int) -> np.ndarray:
    """For each gram start: 58 bits of its hash, and its place modulo 64."""
    n = len(data) - k + 1
    up, down = POWERS.get(len(data))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODE[data] * up[: len(data)], out=total[1:])
        h = mix64((total[k:] - total[:n]) * down[:n])
    return (h & ~LOW6) | (np.arange(n, dtype=np.uint64) & LOW6)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def segments(offsets: np.ndarray, data: np.ndarray, rule: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, windows, gram hash) of each segment; windows stay within documents."""
    none = np.zeros(0, np.int64)
    if len(data) < rule.length:
        return none, none, none, none.astype(np.uint64)
    least = sliding_min(gram_keys(data, rule.gram), rule.grams)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    at = np.arange(len(least))
    inside = at + rule.length <= offsets[1:][doc]
    at, least, doc = at[inside], least[inside], doc[inside]
    if not len(at):
        return none, none, none, none.astype(np.uint64)
    place = at + (((least & LOW6).astype(np.int64) - at) & 63)
    head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    size = np.diff(np.append(head, len(at)))
    return doc[head], at[head] - offsets[:-1][doc[head]], size, least[head] >> np.uint64(6)


# blobs: columns of one length, compressed together


@functools.cache
def _coder() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One for all blobs of a process: making one costs more than a small blob does."""
    return zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()


def pack(*columns: np.ndarray) -> bytes:
    head = np.array([len(columns), len(columns[0]), *(c.dtype.itemsize for c in columns)], "<u4").tobytes()
    return _coder()[0].compress(head + b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = _coder()[1].decompress(blob)
    _, n = np.frombuffer(raw, "<u4", 2)
    at, out = 4 * (2 + len(kinds)), []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def dealt(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, row numbers) in the order of keys, rows in their own order."""
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(key[rows[0]]), rows


def _step_back(x: np.ndarray) -> np.ndarray:
    """Differences, which compress where values rise in small steps."""
    return np.diff(x, prepend=x.dtype.type(0))


def _grams(rule: Repeats, parts: int, fine: int):
    """The segments of runs of batches, dealt by part."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        d, a, n, h = (np.concatenate(c) for c in zip(*held))
        if not len(d):
            return
        keys, blobs, tags = [], [], []
        for key, r in dealt((h % np.uint64(parts)).astype(np.int64)):
            tag = (h[r] // np.uint64(parts)).astype("<u8")  # five of its bytes are sent
            keys.append(key)
            blobs.append(pack(_step_back(d[r]), a[r], n[r], (tag % np.uint64(fine)).astype("u1")))
            tags.append(tag.view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary()), pa.array(tags, pa.binary())], names=["bucket", "blob", "tags"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column("d").to_numpy()
            for first, rows, offsets, data in text_slices(batch, "text"):
                doc, a, n, h = segments(offsets, data, rule)
                held.append((ids[first : first + rows][doc], a.astype(np.uint32), n.astype(np.uint8), h))
                size += len(data)
                if size >= PART_BYTES:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _partners(blocks: int):
    """Of a bucket's segments, those whose gram two documents hold, dealt by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in in_groups(batches, ["bucket"]):
            bucket, parts = t.column("bucket")[0].as_py(), []
            for blob, tags in zip(t.column("blob").to_pylist(), t.column("tags").to_pylist()):
                d, a, w, sub = unpack(blob, "<i8", "<u4", "u1", "u1")
                tag = np.zeros((len(d), 8), np.uint8)
                tag[:, :5] = np.frombuffer(tags, np.uint8).reshape(-1, 5)
                parts.append((np.cumsum(d), a, w, sub, tag.view("<u8").reshape(-1)))
            d, a, w, sub, tag = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(tag, kind="stable")
            head = np.flatnonzero(np.concatenate([[True], np.diff(tag[order]) != 0]))
            sizes = np.diff(np.append(head, len(order)))
            sd = d[order]
            good = np.repeat(np.minimum.reduceat(sd, head) != np.maximum.reduceat(sd, head), sizes)
            pick = np.sort(order[good])
            if not len(pick):
                continue
            d, a, w, sub = d[pick], a[pick], w[pick], sub[pick]
            keys, blobs = [], []
            for key, r in dealt(block_of(d, blocks)):
                keys.append(key)
                blobs.append(pack(d[r], a[r], w[r], sub[r]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int32()), pa.array([bucket] * len(keys), pa.int32()), pa.array(blobs, pa.binary())], names=["block", "bucket", "blob"]
            )

    return run


def block_of(d: np.ndarray, blocks: int) -> np.ndarray:
    """The block of a document; the same as in ``with_texts``."""
    return (d ^ (d >> 11)) % blocks


def _with_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, bytes]], Iterator[pa.RecordBatch]]]:
    """For each block, its blobs (bucket, blob) and then its texts batch by batch."""
    state: dict = {"block": None, "rest": None}

    def pieces() -> Iterator[tuple[int, int, pa.RecordBatch]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                yield int(block[a]), int(kind[a]), batch.slice(a, b - a)

    flow = pieces()
    state["rest"] = next(flow, None)
    while state["rest"] is not None:
        block = state["rest"][0]
        blobs: list[tuple[int, bytes]] = []
        while state["rest"] is not None and state["rest"][0] == block and state["rest"][1] == 0:
            part = state["rest"][2]
            blobs += zip(part.column("bucket").to_pylist(), part.column("blob").to_pylist())
            state["rest"] = next(flow, None)

        def texts(block=block) -> Iterator[pa.RecordBatch]:
            while state["rest"] is not None and state["rest"][0] == block:
                part = state["rest"][2]
                state["rest"] = next(flow, None)
                yield part

        yield blobs, texts()


def _contents(rule: Repeats):
    """The bytes of chosen segments, dealt by part, those of a bucket together."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """A blob for each part from (part, document, place, bytes, bucket, ends of bytes, bytes) of several slices, each sorted by part."""
        keys, heads, raws = [], [], []
        for key in np.unique(np.concatenate([x[0] for x in held])).tolist():
            mine, raw = [], []
            for part, d, a, n, sub, ends, data in held:
                lo, hi = (int(np.searchsorted(part, key, s)) for s in ("left", "right"))
                if hi > lo:
                    mine.append((d[lo:hi], a[lo:hi], n[lo:hi], sub[lo:hi]))
                    raw.append(data[ends[lo - 1] if lo else 0 : ends[hi - 1]])
            keys.append(key)
            heads.append(pack(*(np.concatenate(c) for c in zip(*mine))))
            raws.append(_coder()[0].compress(b"".join(raw)))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(heads, pa.binary()), pa.array(raws, pa.binary())], names=["bucket", "blob", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs, texts in _with_texts(batches):
            parts = [(*unpack(blob, "<i8", "<u4", "u1", "u1"), bucket) for bucket, blob in blobs]
            if parts:
                d, a, w, sub = (np.concatenate([p[i] for p in parts]) for i in range(4))
                bucket = np.repeat([p[4] for p in parts], [len(p[0]) for p in parts])
                order = np.argsort(d, kind="stable")
                d, a, w, sub, bucket = d[order], a[order].astype(np.int64), w[order].astype(np.int64), sub[order], bucket[order]
            held, size = [], 0
            for batch in texts:
                if not parts:
                    continue
                ids = batch.column("d").to_numpy()
                for first, rows, offsets, data in text_slices(batch, "text", 4 << 20):
                    lo, hi = (np.searchsorted(d, ids[first : first + rows], s) for s in ("left", "right"))
                    count = hi - lo
                    if not count.sum():
                        continue
                    pick = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
                    start = np.repeat(offsets[:-1], count) + a[pick]
                    n = w[pick] + rule.length - 1
                    fits = start + n <= np.repeat(offsets[1:], count)  # all, unless an id repeats with another text
                    pick, start, n = pick[fits], start[fits], n[fits]
                    if not len(pick):
                        continue
                    order = np.argsort(bucket[pick], kind="stable")
                    pick, start, n = pick[order], start[order], n[order]
                    take = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
                    held.append((bucket[pick], d[pick], a[pick].astype("<u4"), n.astype("u1"), sub[pick], np.cumsum(n), data[take].tobytes()))
                    size += len(held[-1][-1])
                    if size >= 2 * PART_BYTES:
                        yield from flush(held)
                        held, size = [], 0
            if held:
                yield from flush(held)

    return run


@dataclass
class Repeat:
    """A maximal repeat: its length, and the starts of all its occurrences in the array's text."""

    length: int
    starts: np.ndarray


class SuffixArray:
    """Suffixes of at least ``least`` bytes of several strings, in the order of their first bytes.

    ``text`` holds the strings one after the other, ``ends`` where each ends.
    Order and common prefixes go as far as the longest string does.
    """

    def __init__(self, text: np.ndarray, ends: np.ndarray, least: int):
        self.text, self.ends, self.least = text, ends, least
        owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        at = np.arange(len(text))
        self.room = ends[owner] - at  # bytes left of the string
        starts = at[self.room >= least]
        rank = self._ranks(starts)
        order = np.argsort(rank, kind="stable")
        self.order, self.rank = starts[order], rank[order]
        # only suffixes that share `least` bytes with a neighbour can repeat
        same = self.rank[1:] == self.rank[:-1]
        keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        self.order, self.rank = self.order[keep], self.rank[keep]
        self._sort_within()
        self.lcp = self._common()

    def _ranks(self, starts: np.ndarray) -> np.ndarray:
        """Ranks of the first ``least`` bytes, by doubling."""
        padded = np.concatenate([self.text, np.zeros(8, np.uint8)])
        word = np.zeros(len(self.text), np.uint64)
        for i in range(8):
            word = (word << np.uint64(8)) | padded[i : i + len(word)].astype(np.uint64)
        size, rank = 8, word
        if self.least < 8:
            return (word >> np.uint64(8 * (8 - self.least)))[starts]
        rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
        while size < self.least:
            step = min(size, self.least - size)
            shifted = np.concatenate([rank[step:], np.zeros(step, np.uint64)])
            rank = (rank << np.uint64(32)) | shifted
            size += step
            if size < self.least:
                rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
        return rank[starts]

    def _sort_within(self) -> None:
        """Suffixes of equal rank by the bytes that follow, up to the longest string."""
        depth, most = self.least, int(self.room[self.order].max(initial=0))
        group = np.cumsum(np.concatenate([[0], self.rank[1:] != self.rank[:-1]])) if len(self.rank) else self.rank
        while depth < most and len(self.order):
            key = np.zeros(len(self.order), np.uint64)
            for i in range(depth, depth + 7):  # 9 bits a byte: 0 past the end
                inside = self.room[self.order] > i
                byte = self.text[np.minimum(self.order + i, len(self.text) - 1)].astype(np.uint64) + np.uint64(1)
                key = (key << np.uint64(9)) | np.where(inside, byte, np.uint64(0))
            by = np.lexsort((key, group))
            self.order, key, group = self.order[by], key[by], group[by]
            group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (key[1:] != key[:-1])]))
            depth += 7
        self.top = group

    def _common(self) -> np.ndarray:
        """Length of the common prefix of each suffix with the one before; 0 at the first."""
        if not len(self.order):
            return np.zeros(0, np.int64)
        a, b = self.order[:-1], self.order[1:]
        most = np.minimum(self.room[a], self.room[b])
        out = np.zeros(len(a), np.int64)
        alive = np.arange(len(a))
        depth = 0
        while len(alive):
            i = alive[most[alive] > depth]
            i = i[self.text[a[i] + depth] == self.text[b[i] + depth]]
            out[i] = depth + 1
            alive, depth = i, depth + 1
        return np.concatenate([[0], out])

    def repeats(self) -> Iterator[Repeat]:
        """Maximal repeats: intervals of the common-prefix tree whose left extensions differ."""
        before = np.where(self.room[self.order - 1] == self.room[self.order] + 1, self.text[self.order - 1], 0).astype(np.int64) if len(self.order) else self.order
        # a suffix at the start of its string extends to the left like no other
        first = (self.order == 0) | (self.room[self.order - 1] != self.room[self.order] + 1) if len(self.order) else np.zeros(0, bool)
        left = np.where(first, -1 - np.arange(len(self.order)), before)
        lcp = self.lcp.tolist() + [0]
        lefts = left.tolist()
        # stack of open intervals: [common prefix, first row, left extension or None if they differ]
        stack: list[list] = []
        for row in range(1, len(lcp)):
            value, start, side = lcp[row], row - 1, lefts[row - 1]
            while stack and stack[-1][0] > value:
                depth, begin, own = stack.pop()
                own = own if own == side else None
                if depth >= self.least and own is None:
                    yield Repeat(depth, self.order[begin:row])
                start, side = begin, own
            if value >= self.least:
                if stack and stack[-1][0] == value:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == side else None
                else:
                    stack.append([value, start, side])


def _removals(rule: Repeats, blocks: int, fine: int):
    """Byte ranges that go, by document, from the segments of one part, bucket by bucket."""

    def ranges(segments: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known: dict[bytes, int] = {}
        firsts: list[int] = []
        ids, docs, starts = [], [], []
        for d, a, n, begins, raw in segments:
            own = []
            for begin, end, doc in zip(begins.tolist(), (begins + n).tolist(), d.tolist()):
                s = raw[begin:end]
                i = known.setdefault(s, len(known))
                if i == len(firsts):
                    firsts.append(doc)
                elif doc < firsts[i]:
                    firsts[i] = doc
                own.append(i)
            ids.append(np.array(own, np.int64))
            docs.append(d)
            starts.append(a)
        which, d, a = np.concatenate(ids), np.concatenate(docs), np.concatenate(starts).astype(np.int64)
        first = np.array(firsts, np.int64)
        strings = list(known)
        sizes = np.array([len(s) for s in strings], np.int64)
        ends = np.cumsum(sizes)
        text = np.frombuffer(b"".join(strings), np.uint8)
        del known, strings

        # the first document that holds each window: the segment's own, or that of a repeat it shares
        windows = sizes - rule.length + 1
        at = np.cumsum(windows) - windows
        least = np.repeat(first, windows)
        begins = ends - sizes
        # the last grams of a string reach into the next: mask them
        inside = np.repeat(ends, sizes) - np.arange(len(text)) >= rule.gram
        keys = np.full(len(text), ~np.uint64(0))
        usable = gram_keys(text, rule.gram) >> np.uint64(6)
        keys[: len(usable)] = usable
        keys[~inside] = ~np.uint64(0)
        gram = np.minimum.reduceat(keys, begins)
        inverse, count = np.unique(gram, return_inverse=True, return_counts=True)[1:]
        chosen = np.flatnonzero(count[inverse] > 1)  # grams with different segments
        chosen = chosen[np.argsort(inverse[chosen], kind="stable")]
        # grams are independent: arrays over runs of whole grams, of bounded size
        weight = np.cumsum(sizes[chosen])
        turn = np.flatnonzero(np.diff(inverse[chosen])) + 1
        turn = turn[np.diff(weight[turn - 1] // ARRAY_BYTES, prepend=0) != 0] if len(turn) else turn
        for some in np.split(chosen, turn):
            if not len(some):
                continue
            n = sizes[some]
            take = np.repeat(begins[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
            array = SuffixArray(text[take], np.cumsum(n), rule.length)
            owner = np.repeat(some, n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            for repeat in array.repeats():
                who = owner[repeat.starts]
                low = first[who].min()
                slot = at[who] + inner[repeat.starts]
                for k in range(repeat.length - rule.length + 1):
                    least[slot + k] = np.minimum(least[slot + k], low)
        # occurrences: windows whose first document is an earlier one
        n = windows[which]
        slot = np.repeat(at[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
        doc = np.repeat(d, n)
        place = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        gone = least[slot] < doc
        doc, place = doc[gone], place[gone]
        head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)])) if len(doc) else np.zeros(0, np.int64)
        last = np.append(head[1:], len(doc)) - 1
        return (doc[head], place[head], place[last] + rule.length) if len(doc) else (doc, place, place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in in_groups(batches, ["bucket"]):
            held = []
            for blob, packed in zip(t.column("blob").to_pylist(), t.column("bytes").to_pylist()):
                d, a, n, sub = unpack(blob, "<i8", "<u4", "u1", "u1")
                n = n.astype(np.int64)
                held.append((d, a, n, np.cumsum(n) - n, sub, _coder()[1].decompress(packed)))
            gone = []
            for bucket in range(fine):
                some = [(d[r], a[r], n[r], begins[r], raw) for d, a, n, begins, sub, raw in held if len(r := np.flatnonzero(sub == bucket))]
                if some:
                    gone.append(ranges(some))
            d, a, z = (np.concatenate(c) for c in zip(*gone)) if gone else (np.zeros(0, np.int64),) * 3
            if not len(d):
                continue
            keys, blobs = [], []
            for key, r in dealt(block_of(d, blocks)):
                keys.append(key)
                blobs.append(pack(d[r], a[r].astype("<u4"), z[r].astype("<u4")))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([0] * len(keys), pa.int32()), pa.array(blobs, pa.binary())], names=["block", "bucket", "blob"])

    return run


def union_of(a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by ranges [a, z)."""
    order = np.argsort(a, kind="stable")
    a, z = a[order], np.maximum.accumulate(z[order])
    head = np.flatnonzero(np.concatenate([[True], a[1:] > z[:-1]]))
    return a[head], z[np.append(head[1:], len(a)) - 1]


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs, texts in _with_texts(batches):
            parts = [unpack(blob, "<i8", "<u4", "<u4") for _, blob in blobs]
            d, a, z = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
            order = np.argsort(d, kind="stable")
            d, a, z = d[order], a[order].astype(np.int64), z[order].astype(np.int64)
            for batch in texts:
                rows = []
                for first, n, offsets, data in text_slices(batch, "text", 4 << 20):
                    ids = batch.column("d").slice(first, n).to_numpy()
                    lo, hi = (np.searchsorted(d, ids, s) for s in ("left", "right"))
                    for i in range(n):
                        own = data[offsets[i] : offsets[i + 1]]
                        if hi[i] > lo[i]:
                            x, y = union_of(a[lo[i] : hi[i]], np.minimum(z[lo[i] : hi[i]], len(own)))
                            left, at = [], 0
                            for s, e in zip(x.tolist(), y.tolist()):
                                left.append(own[at:s])
                                at = e
                            left.append(own[at:])
                            kept = np.concatenate(left).tobytes()
                            spans = list(zip(x.tolist(), y.tolist()))
                        else:
                            kept, spans = own.tobytes(), []
                        rows.append((len(own), len(own) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"a": s, "z": e} for s, e in spans], kept if keep_text else None))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())])), pa.binary()]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([batch.column("d"), *cols], names=["d", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return run


def dealing(size: int) -> tuple[int, int]:
    """(buckets, blocks) for so many bytes of text: what a task holds at once is a part of buckets or a block, however many its partition has."""
    return max(48, size // BUCKET_BYTES), max(48, size // BLOCK_BYTES)


def parts_of(buckets: int) -> tuple[int, int]:
    """(parts, buckets in each): up to PART_BYTES in a part, and 48 parts where there are as many buckets."""
    fine = max(1, min(PART_BYTES // (1 << 20), buckets // 48))
    return -(-buckets // fine), fine


def substring_dedup(docs: DataFrame, rule: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans [a, z), kept (bytes, if asked for).

    A byte is removed if a string of ``rule.length`` bytes that covers it also
    starts in a document with a smaller id; all strings are judged on the input.
    A null text is empty.  Rows with a null id come back whole and lend no string to
    others; rows that repeat an id are taken to repeat its text and lend none to each other.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "substring")
    src = docs.select(F.col(id_col).cast("long").alias("d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    named = src.where("d is not null")
    # both follow the input, so what a task holds does not
    size = named.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets, blocks = dealing(size)
    parts, fine = parts_of(buckets)
    grams = named.where(F.octet_length("text") >= rule.length).mapInArrow(_grams(rule, parts, fine), "bucket int, blob binary, tags binary")
    grams = grams.repartition(min(parts, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket")
    partners = ws.keep(grams.mapInArrow(_partners(blocks), "block int, bucket int, blob binary"), "partners")

    def with_texts(blobs: DataFrame, texts: DataFrame) -> DataFrame:
        block = F.pmod(F.col("d").bitwiseXOR(F.shiftright("d", 11)), F.lit(blocks)).cast("int")
        return (
            blobs.select("block", F.lit(0).alias("kind"), "bucket", "blob", F.lit(None).cast("long").alias("d"), F.lit(None).cast("string").alias("text"))
            .unionByName(texts.select(block.alias("block"), F.lit(1).alias("kind"), F.lit(0).alias("bucket"), F.lit(None).cast("binary").alias("blob"), "d", "text"))
            .repartition(min(blocks, MOST_PARTITIONS), "block")
            .sortWithinPartitions("block", "kind")
        )

    contents = with_texts(partners, named.where(F.octet_length("text") >= rule.length)).mapInArrow(_contents(rule), "bucket int, blob binary, bytes binary")
    removals = contents.repartition(min(parts, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket").mapInArrow(_removals(rule, blocks, fine), "block int, bucket int, blob binary")
    removals = ws.keep(removals, "removals")
    ws.drop("partners")
    schema = "d long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:bigint,z:bigint>>, kept binary"
    out = with_texts(removals, named).mapInArrow(_cut(keep_text), schema)
    whole = src.where("d is null").select(
        "d", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), F.lit(None).cast("array<struct<a:bigint,z:bigint>>").alias("spans"),
        (F.encode("text", "utf-8") if keep_text else F.lit(None).cast("binary")).alias("kept"),
    )
    return out.unionByName(whole).withColumnRenamed("d", "doc_id")
