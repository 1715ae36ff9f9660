"""Near-duplicate documents by HyperMinHash registers, banding and exact verification.

One hash per distinct word shingle.  Its top bits choose a bucket; a bucket's
register keeps the leading-zero count of the smallest hash that fell into it
and the mantissa bits after the leading one.  Bands of registers propose
candidates, a collision-corrected estimate of the Jaccard similarity discards
hopeless ones, and the rest are confirmed on full shingle sets.

Equal sets form one class before anything is compared, so copies never become
pairs.  A bucket of any size first costs a number of pairs linear in its members:
each member is compared with the bucket's smallest one.  What that leaves in
other components is compared with the rest of its bucket, by sketches of a bit a
register and then by the estimate, each pair in the first band that it shares: at once where the bucket, or what is apart in it, is at most ``CROWD``.
A larger bucket is compared with a few of its members drawn at random, which joins
what is alike; if it then still holds components apart, it is compared in blocks, or
from ``WIDE_FROM`` members on banded again, with wider bands of other registers, until its
parts are that small, so documents that share a template and little else part
ways.  Where wider bands would not thin a bucket out, its documents being alike
but below the threshold, it is compared block by block, and only links that join
components leave a block.  No cap drops a candidate.

What can be missed: a pair at exactly 80 % agrees in no band of the first round
with probability 5e-8, in none of a later round with 4e-9, and falls below the
sketch's or the estimate's margin (five and six standard deviations) with less
than 1e-6; more similar pairs are safer.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Workspace, in_groups, mix64, text_slices, trim, word_hashes
from .components import components

BUCKET_BITS, MANTISSA_BITS = 7, 10
BUCKETS = 1 << BUCKET_BITS
REST_BITS = 64 - BUCKET_BITS
#: Registers are 16 bits wide, so a band of four is one 64-bit word: 32 bands.
ROWS_PER_BAND = 4
BANDS = BUCKETS // ROWS_PER_BAND
#: Members of a bucket, or members apart from the rest, that are compared as they are.
CROWD = 128
#: Registers in a band of later rounds, bands, and rounds before what is left is compared in blocks.
WIDE_ROWS, WIDE_BANDS, WIDE_ROUNDS = 6, 64, 4
#: A bucket is banded again only if that leaves a quarter of its pairs or less.
THINNING = 4
#: Members of a bucket from which it is banded again; smaller ones are compared in blocks, so a member has at most so many partners.
WIDE_FROM = 2048
#: Ids (of 8 bytes) that are broadcast to fetch their documents; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: Members of a larger bucket that all of it is compared with before it is banded again.
PIVOTS = 4
#: Rows of a bucket in a block that a few of its members are compared with.
BLOCK_ROWS = 4096
#: Bytes of shingle sets that either side of a block holds.
BLOCK_BYTES = 6 << 20


@dataclass(frozen=True)
class NearDup:
    """Words per shingle and the similarity, in hundredths, from which documents are linked."""

    shingle: int = 5
    percent: int = 80

    @property
    def least(self) -> int:
        """Sets of fewer elements are linked with equal sets only: k / (k + 1) is below the threshold."""
        return next(k for k in range(1, 1000) if 100 * k >= self.percent * (k + 1)) if self.percent < 100 else 1 << 30


def shingle_sets(offsets: np.ndarray, data: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each document of a run."""
    doc, words = word_hashes(offsets, LOWER[data])
    n_docs = len(offsets) - 1
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    salt = mix64(np.arange(1, k + 2, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        full = len(words) - k + 1
        grams = np.zeros(max(full, 0), np.uint64)
        for i in range(k):
            if full > 0:
                grams += words[i : i + full] * salt[i]
        grams = mix64(grams)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(grams[a : b - k + 1]))
            elif b > a:
                out.append(mix64(((words[a:b] * salt[: b - a]).sum(dtype=np.uint64) + salt[k] * np.uint64(b - a)).reshape(1)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers, one row of BUCKETS 16-bit words a set; 0 is an empty bucket."""
    sizes = np.array([len(s) for s in sets])
    sig = np.zeros((len(sets), BUCKETS), np.uint16)
    if not sizes.sum():
        return sig
    h = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    bucket = (h >> np.uint64(REST_BITS)).astype(np.int64)
    head = np.ones(len(h), bool)
    head[1:] = (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])
    rest = h[head] & np.uint64((1 << REST_BITS) - 1)  # sets are sorted: the first of a bucket is its least
    length = np.frexp((rest >> np.uint64(4)).astype(np.float64))[1] + 4
    shift = np.maximum(length - 1 - MANTISSA_BITS, 0).astype(np.uint64)
    mantissa = (rest >> shift) & np.uint64((1 << MANTISSA_BITS) - 1)
    sig[row[head], bucket[head]] = ((REST_BITS - length + 1).astype(np.uint64) << np.uint64(MANTISSA_BITS) | mantissa).astype(np.uint16)
    return sig


def _chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected number of equal registers of two disjoint sets of n and m elements.

    A register value with leading-zero count z and one of 2**r mantissas covers
    a slice of width 2**-(z + 1 + r) of the unit interval; the least of n / BUCKETS
    uniform values falls into it with the difference of two survival terms.
    """
    z = np.arange(0, 40)[:, None]
    lo, width = 2.0 ** -(z + 1), 2.0 ** -(z + 1 + MANTISSA_BITS)

    def density(k):
        rate = np.maximum(np.atleast_1d(k)[None, :], 1) / BUCKETS
        return rate * np.exp(-rate * lo * 1.5)

    return BUCKETS * (2.0**MANTISSA_BITS * width**2 * density(n) * density(m)).sum(0)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of register rows, and the buckets they rest on."""
    used = ((a != 0) | (b != 0)).sum(-1)
    same = ((a == b) & (a != 0)).sum(-1)
    chance = _chance(np.ravel(n), np.ravel(m)).reshape(np.shape(same)) if np.size(n) == np.size(same) else 0.0
    corrected = (same - chance) / np.maximum(used - chance, 1)
    return np.clip(corrected, 0, 1), used


def hopeful(est: np.ndarray, used: np.ndarray, percent: int) -> np.ndarray:
    """Whether a pair can reach the threshold: within six standard deviations of the estimate."""
    t = percent / 100
    return est >= t - 6 * np.sqrt(t * (1 - t) / np.maximum(used, 1)) - 1 / np.maximum(used, 1)


def _sign(rule: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, offsets, data in text_slices(batch, "text"):
                sets = shingle_sets(offsets, data, rule.shingle)
                sig = registers(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, rows),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([x.tobytes() for x in sig], pa.binary()),
                    ],
                    names=["doc_id", "n", "key", "sig"],
                )
        trim()

    return run


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _bucket_keys(values: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    """A 64-bit key of each cell of a table of band values: its column and its value."""
    place = mix64(np.arange(1, values.shape[1] + 1, dtype=np.uint64) + np.uint64(salt))
    with np.errstate(over="ignore"):
        return mix64(values * np.uint64(0x9E3779B97F4A7C15) ^ place[None, :]).view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each band of a document that holds a register, with the size of its set, so that no bucket looks it up."""
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            values = np.ascontiguousarray(_signatures(part.column("sig"))).view(np.uint64)
            keys, held = _bucket_keys(values, 0), values != 0
            rep, n = (np.repeat(part.column(c).to_numpy(), held.sum(1)) for c in ("rep", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(keys[held]), pa.array(rep), pa.array(n)], names=["bucket", "rep", "n"])


def _wide_bands(salt: int):
    """Rows (parent, bucket, rep, comp, n): the bands that a bucket's members are dealt to again."""
    draw = np.random.default_rng(1000 + salt)
    chosen = np.array([draw.choice(BUCKETS, WIDE_ROWS, replace=False) for _ in range(WIDE_BANDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = mix64(np.arange(77, 77 + WIDE_ROWS, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                sig = _signatures(part.column("sig"))[:, chosen]
                parent, rep, comp, n = (np.repeat(part.column(c).to_numpy(), WIDE_BANDS) for c in ("bucket", "rep", "comp", "n"))
                with np.errstate(over="ignore"):
                    value = mix64((sig.astype(np.uint64) * weight).sum(2, dtype=np.uint64))
                    keys = mix64(_bucket_keys(value, salt + 1).view(np.uint64).reshape(-1) ^ mix64(parent.view(np.uint64)))
                held = (sig != 0).any(2).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(x[held]) for x in (parent, keys.view(np.int64), rep, comp, n)], names=["parent", "bucket", "rep", "comp", "n"])

    return run


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, n and the lowest bit of every register, as two words."""
    for batch in batches:
        if batch.num_rows:
            bits = np.packbits(_signatures(batch.column("sig")) & 1, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy())], names=["rep", "n", "s0", "s1"])


def _sets(rule: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, offsets, data in text_slices(batch, "text"):
                sets = shingle_sets(offsets, data, rule.shingle)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, rows),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "key", "members"],
                )
        trim()

    return run


def differing(percent: int) -> int:
    """Bits in which the sketches of a pair at the threshold can differ, five standard deviations included."""
    apart = (1 - percent / 100) / 2
    return int(BUCKETS * apart + 5 * np.sqrt(BUCKETS * apart * (1 - apart))) + 1


def _near(a: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, rule: NearDup) -> np.ndarray:
    """Which of the rows i and j may be a link that this bucket has to report.

    They are of other components, of fitting sizes, of like sketches, and can reach the threshold by the
    estimate.  A pair that meets in an earlier band of the first round is that band's bucket's to report.
    """
    n, m = a["n"][i], a["n"][j]
    at = np.flatnonzero((a["comp"][i] != a["comp"][j]) & (100 * np.minimum(n, m) >= rule.percent * np.maximum(n, m)))
    bits = np.bitwise_count(a["sketch"][i[at]] ^ a["sketch"][j[at]]).sum(1, dtype=int)
    at = at[bits <= differing(rule.percent)]
    good = np.zeros(len(i), bool)
    for z in range(0, len(at), 1 << 14):
        some = at[z : z + (1 << 14)]
        x, y = a["sig"][i[some]], a["sig"][j[some]]
        bands, other = x.view(np.uint64), y.view(np.uint64)
        before = np.arange(BANDS)[None, :] < a["band"][i[some], None]
        met = ((bands == other) & (bands != 0) & before).any(1)
        est, used = estimate(x, y, n[some], m[some])
        good[some] = hopeful(est, used, rule.percent) & ~met
    return good


COLUMNS = ("bucket", "rep", "comp", "n")


def _facts(bucket: np.ndarray, sig: np.ndarray) -> dict[str, np.ndarray]:
    """Signatures, their sketches, and the band of the first round that a row's bucket is, 0 for later rounds'."""
    keys = _bucket_keys(np.ascontiguousarray(sig).view(np.uint64), 0) == bucket[:, None]
    return {"sig": sig, "sketch": np.packbits(sig & 1, axis=1).view(np.uint64), "band": np.argmax(keys, axis=1)}


def _pairs(a: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    u, v = a["rep"][i], a["rep"][j]
    both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["u", "v"])


def _crowds(rule: NearDup):
    """Candidates within buckets of at most CROWD rows, from rows sorted by bucket: row i with row i + 1, i + 2, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = {c: np.zeros(0, np.int64) for c in COLUMNS} | {"sig": np.zeros((0, BUCKETS), np.uint16)}
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                own = {c: batch.column(c).to_numpy() for c in COLUMNS} | {"sig": _signatures(batch.column("sig"))}
                rest = {c: np.concatenate([rest[c], x]) for c, x in own.items()}
            b = rest["bucket"]
            cut = len(b) if batch is None else int(np.searchsorted(b, b[-1])) if len(b) else 0  # the last bucket may go on
            a, rest = {c: x[:cut] for c, x in rest.items()}, {c: x[cut:] for c, x in rest.items()}
            a |= _facts(a["bucket"], a["sig"])
            b, left = a["bucket"], np.arange(cut)
            for shift in range(1, cut):
                left = left[left + shift < cut]
                left = left[b[left] == b[left + shift]]
                if not len(left):
                    break
                if (good := _near(a, left, left + shift, rule)).any():
                    yield _pairs(a, left[good], left[good] + shift)

    return run


def _few_apart(rule: NearDup, once: bool):
    """Candidates between few members (``other``) and a block of their bucket; ``once``: in their first band only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in in_groups(batches, ["bucket", "x"]):
            a = {c: t.column(c).to_numpy() for c in COLUMNS}
            a |= _facts(a["bucket"], _signatures(t.column("sig")))
            a["band"] = a["band"] * once
            rows = np.flatnonzero(~t.column("other").to_numpy())
            for r in np.flatnonzero(t.column("other").to_numpy()):
                if (good := _near(a, rows, np.full(len(rows), r), rule)).any():
                    yield _pairs(a, rows[good], np.full(int(good.sum()), r))

    return run


def _promising(rule: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (_signatures(batch.column(c)) for c in ("sig_u", "sig_v"))
            n, m = (batch.column(c).to_numpy() for c in ("n_u", "n_v"))
            good = hopeful(*estimate(a, b, n, m), rule.percent) & (100 * np.minimum(n, m) >= rule.percent * np.maximum(n, m))
            yield batch.select(["u", "v"]).filter(pa.array(good))

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| on sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirm(rule: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), rule.percent)
                for x, y in zip(batch.column("set_u").to_pylist(), batch.column("set_v").to_pylist())
            ]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))
        trim()

    return run


def _blocks(rule: NearDup):
    """Links between different components within one block of a bucket; at most one for each merge."""

    def links(t: pa.Table) -> Iterator[tuple[int, int]]:
        side = t.column("side").to_numpy()
        rep, comp, n = (t.column(c).to_numpy() for c in ("rep", "comp", "n"))
        sig = _signatures(t.column("sig"))
        members = t.column("members").to_pylist()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        found: list[tuple[float, int, int]] = []
        # a pair that meets in an earlier band of the first round is that band's bucket's to report
        bands = sig.view(np.uint64)
        earlier = bands[:, : _facts(t.column("bucket").to_numpy()[:1], sig[:1])["band"][0]]
        signs = 2 * (sig & 1).astype(np.float32) - 1  # the product of two rows is their agreeing bits less the others
        for a in range(0, len(right), 512):
            i, j = np.nonzero(signs[right[a : a + 512]] @ signs[left].T >= BUCKETS - 2 * differing(rule.percent))
            i, j = right[a + i], left[j]
            good = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= rule.percent * np.maximum(n[i], n[j]))
            i, j = i[good], j[good]
            for z in range(0, len(i), 1 << 14):
                x, y = i[z : z + (1 << 14)], j[z : z + (1 << 14)]
                est, used = estimate(sig[x], sig[y], n[x], n[y])
                good = hopeful(est, used, rule.percent) & ~((earlier[x] == earlier[y]) & (earlier[x] != 0)).any(1)
                found += zip((-est[good]).tolist(), x[good].tolist(), y[good].tolist())
        for _, x, y in sorted(found):
            a, b = root(int(comp[x])), root(int(comp[y]))
            if a != b and similar(np.frombuffer(members[x], np.uint64), np.frombuffer(members[y], np.uint64), rule.percent):
                up[max(a, b)] = min(a, b)
                yield int(rep[x]), int(rep[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in in_groups(batches, ["bucket", "x", "y"]):
            out = list(links(group))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])
        trim()

    return run


class _Search:
    """Candidates to links, and the rounds that find candidates which the first has left apart."""

    def __init__(self, ws: Workspace, rule: NearDup, src: DataFrame, classes: DataFrame):
        self.ws, self.rule, self.src, self.classes = ws, rule, src, classes

    def promising(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that can reach the threshold by the estimate from signatures."""
        of = lambda end: self.classes.select(F.col("rep").alias(end), F.col("n").alias(f"n_{end}"), F.col("sig").alias(f"sig_{end}"))
        signed = pairs.distinct().join(of("u"), "u").join(of("v"), "v").select("u", "v", "n_u", "n_v", "sig_u", "sig_v")
        return signed.mapInArrow(_promising(self.rule), "u long, v long")

    def signed(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.classes.select("rep", "sig"), "rep")

    def sets(self, wanted: DataFrame, label: str) -> DataFrame:
        """(rep, members): the full shingle sets of the classes ``wanted`` (rep)."""
        keys = wanted.join(self.classes.select("rep", "key"), "rep").select(F.col("rep").alias("doc_id"), "key")
        ids = wanted.select(F.col("rep").alias("doc_id"))
        if wanted.count() <= BROADCAST_IDS:  # the texts are not shuffled
            ids = F.broadcast(ids)
        found = self.src.join(ids, "doc_id", "left_semi").mapInArrow(_sets(self.rule), "doc_id long, key binary, members binary")
        found = found.join(keys, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])
        return self.ws.keep(found.select(F.col("doc_id").alias("rep"), "members"), f"sets-{label}")

    def confirmed(self, pairs: list[DataFrame], label: str) -> DataFrame:
        """The candidates (u, v) that reach the threshold by their full sets."""
        likely = self.ws.keep(functools.reduce(DataFrame.unionByName, pairs).distinct(), f"likely-{label}")
        wanted = self.ws.keep(likely.select(F.col("u").alias("rep")).unionByName(likely.select(F.col("v").alias("rep"))).distinct(), f"wanted-{label}")
        sets = self.sets(wanted, label)
        full = lambda end: sets.select(F.col("rep").alias(end), F.col("members").alias(f"set_{end}"))
        links = likely.join(full("u"), "u").join(full("v"), "v").select("u", "v", "set_u", "set_v").mapInArrow(_confirm(self.rule), "u long, v long")
        links = self.ws.keep(links, f"links-{label}")
        self.ws.drop(f"sets-{label}", f"likely-{label}", f"wanted-{label}")
        return links

    def conflicts(self, rows: DataFrame, label: str) -> DataFrame:
        """Rows (bucket, rep, comp, n) of buckets that hold several components, with the bucket's size m,
        the component ``main`` of one of its members, how many members ``o`` are of others, and in how many
        blocks of bytes the full sets of all (``all_blocks``) and of those others (``other_blocks``) go."""
        size = F.sum(8 * F.col("n") + 2 * BUCKETS)
        held = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"), F.min(F.xxhash64("rep", "bucket")).alias("h"), size.alias("b"))
        main = held.groupBy("bucket").agg(F.sum("c").alias("m"), F.sum("b").alias("b"), F.min(F.struct("h", "comp", "c", "b")).alias("s"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        blocks = lambda b: F.ceil(F.greatest(b, F.lit(1)) / BLOCK_BYTES).cast("int")
        main = main.where("low <> high").select(
            "bucket", F.col("s.comp").alias("main"), "m", (F.col("m") - F.col("s.c")).alias("o"), blocks(F.col("b")).alias("all_blocks"), blocks(F.col("b") - F.col("s.b")).alias("other_blocks")
        )
        rows = rows.join(main, "bucket").withColumn("other", F.col("comp") != F.col("main"))
        return self.ws.keep(rows, f"rows-{label}")

    def dealt(self, rows: DataFrame, chosen: Column, once: bool, label: str) -> DataFrame:
        """Candidates between the ``chosen`` rows of a bucket, which are few, and all of its rows, block by block."""
        nx = F.ceil(F.col("m") / BLOCK_ROWS).cast("int")
        rows = self.signed(rows.select(*COLUMNS, nx.alias("nx"), chosen.alias("chosen")))  # signed once, then dealt to several blocks
        own = F.struct(F.lit(False).alias("other"), F.pmod(F.xxhash64("rep"), F.col("nx")).cast("int").alias("x"))
        every = F.transform(F.sequence(F.lit(0), F.col("nx") - 1), lambda x: F.struct(F.lit(True).alias("other"), x.alias("x")))
        out = rows.select(*COLUMNS, "sig", F.inline(F.when(F.col("chosen"), F.concat(F.array(own), every)).otherwise(F.array(own))))
        out = out.repartition("bucket", "x").sortWithinPartitions("bucket", "x")
        return self.ws.keep(out.mapInArrow(_few_apart(self.rule, once), "u long, v long"), label)

    def near_pairs(self, rows: DataFrame, label: str) -> list[DataFrame]:
        """Candidates of the buckets that are small, or in which few members are apart."""
        small = self.signed(rows.where(F.col("m") <= CROWD).select(*COLUMNS)).repartition("bucket").sortWithinPartitions("bucket")
        crowds = self.ws.keep(small.mapInArrow(_crowds(self.rule), "u long, v long"), f"crowds-{label}")
        return [crowds, self.dealt(rows.where((F.col("m") > CROWD) & (F.col("o") <= CROWD)), F.col("other"), True, f"few-{label}")]

    def settled(self, roots: DataFrame, links: DataFrame, label: str) -> DataFrame:
        """(node, root) after further links."""
        tree = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).where("u <> v")
        return self.ws.keep(components(self.ws, tree.unionByName(links), label), f"roots-{label}")

    def apart(self, rows: DataFrame, roots: DataFrame) -> DataFrame:
        """(node, root) after the links between components within buckets, from rows (bucket, rep, n)."""
        ws, rule = self.ws, self.rule
        bare = ["bucket", "rep", "n"]

        def placed(r: DataFrame) -> DataFrame:
            return r.select(*bare).join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*bare, F.coalesce("root", "rep").alias("comp"))

        many = (F.col("m") > CROWD) & (F.col("o") > CROWD)
        rows = self.conflicts(placed(rows), "first")
        pairs = self.near_pairs(rows, "first")
        crowded = bool(rows.where(many).limit(1).count())
        if crowded:  # a few members of each bucket, drawn at random, with all of it
            rows = ws.keep(rows.where(many), "many")
            drawn = rows.groupBy("bucket", F.pmod(F.xxhash64("rep"), F.lit(PIVOTS))).agg(F.min(F.struct(F.xxhash64("rep", "bucket"), "rep")).getField("rep").alias("rep"))
            pivots = drawn.select("bucket", "rep", F.lit(True).alias("pivot"))
            pairs.append(self.dealt(rows.join(pivots, ["bucket", "rep"], "left"), F.coalesce("pivot", F.lit(False)), False, "pivots"))
        roots = self.settled(roots, self.confirmed(pairs, "second"), "second")
        if not crowded:
            return roots
        pairs, links = [], []
        rows = self.conflicts(placed(rows), "crowded")
        for depth in range(WIDE_ROUNDS + 1):
            pairs += self.near_pairs(rows, str(depth))
            links.append(self.in_blocks(rows.where(many & (F.col("m") <= WIDE_FROM)), f"{depth}-small"))
            rest = rows.where(many & (F.col("m") > WIDE_FROM))
            if not rest.limit(1).count():
                break
            if depth == WIDE_ROUNDS:
                links.append(self.in_blocks(rest, str(depth)))
                break
            signed = self.signed(rest.select(*COLUMNS))
            wide = ws.keep(signed.mapInArrow(_wide_bands(depth), "parent long, bucket long, rep long, comp long, n long"), f"wide-{depth}")
            parts = wide.groupBy("parent", "bucket").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high"))
            parts = ws.keep(parts.where("low <> high").drop("low", "high"), f"parts-{depth}")
            left = parts.groupBy("parent").agg(F.sum(F.col("size").cast("double") * (F.col("size") - 1)).alias("left"))
            dense = rest.groupBy(F.col("bucket").alias("parent")).agg(F.first("m").cast("double").alias("m")).join(left, "parent")
            dense = ws.keep(dense.where(F.col("left") * THINNING > F.col("m") * F.col("m")).select("parent"), f"dense-{depth}")
            links.append(self.in_blocks(rest.join(dense.withColumnRenamed("parent", "bucket"), "bucket", "left_semi"), str(depth)))
            sparse = parts.join(dense, "parent", "left_anti").select("bucket")
            rows = self.conflicts(wide.select(*COLUMNS).join(sparse, "bucket", "left_semi"), str(depth))
            ws.drop(f"wide-{depth}", f"parts-{depth}")
        out = self.confirmed(pairs, "third")
        for x in links:
            out = out.unionByName(x)
        return self.settled(roots, out, "third")

    def in_blocks(self, rows: DataFrame, depth: str) -> DataFrame:
        """Links of crowded buckets that stay alike, from whole buckets of ``conflicts``."""
        ws = self.ws
        rows = rows.select("bucket", "rep", "comp", (F.col("comp") != F.col("main")).alias("other"), F.col("all_blocks").alias("nx"), F.col("other_blocks").alias("ny"))
        if not rows.limit(1).count():
            return self.src.sparkSession.createDataFrame([], "u long, v long")
        rows = ws.keep(rows, f"crowded-{depth}")
        sets = self.sets(ws.keep(rows.select("rep").distinct(), f"members-{depth}"), f"crowded-{depth}")
        facts = sets.join(self.classes.select("rep", "n", "sig"), "rep")
        place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
        every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        at = lambda side, x, y: F.struct(F.lit(side).alias("side"), x.alias("x"), y.alias("y"))
        left, right = F.transform(every("ny"), lambda y: at(0, place("nx"), y)), F.transform(every("nx"), lambda x: at(1, x, place("ny")))
        # a member meets its set once and is dealt to several blocks then
        dealt = (
            rows.join(facts, "rep")
            .select("bucket", "rep", "comp", "n", "sig", "members", F.inline(F.when(F.col("other"), F.concat(left, right)).otherwise(left)))
            .repartition(F.col("bucket"), F.col("x"), F.col("y"))
            .sortWithinPartitions("bucket", "x", "y")
        )
        out = ws.keep(dealt.mapInArrow(_blocks(self.rule), "u long, v long"), f"blocks-{depth}")
        ws.drop(f"sets-crowded-{depth}", f"crowded-{depth}", f"members-{depth}")
        return out


def near_duplicates(docs: DataFrame, rule: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept, class_id.

    component_id is the smallest doc_id reachable over links of at least
    ``rule.percent`` hundredths, class_id the smallest doc_id with the same
    shingle set, kept says that the document is its component's first.
    Other columns of ``docs`` are not read, so their names cannot clash.

    A null text counts as empty; an empty set is linked with nothing.  A null id
    takes no part: its component_id and class_id are null and it is kept.  Rows
    that repeat an id are separate texts; each gets a row.  No input, no rows.
    """
    ws = Workspace(docs.sparkSession, "neardup")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = ws.keep(src.mapInArrow(_sign(rule), "doc_id long, n long, key binary, sig binary"), "signed")
    classes = ws.keep(
        signed.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("sig").alias("sig")), "classes"
    )
    banded = ws.keep(classes.where(F.col("n") >= rule.least).select("rep", "n", "sig").mapInArrow(_bands, "bucket long, rep long, n long"), "banded")
    sketch = ws.keep(classes.select("rep", "n", "sig").mapInArrow(_sketch, "rep long, n long, s0 long, s1 long"), "sketch")
    heads = banded.groupBy("bucket").agg(F.min("rep").alias("head"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("size")).where("size > 1")
    heads = ws.keep(heads, "heads")
    # a bucket of two is a pair without looking its members up
    shared = banded.join(heads.where("size > 2").select("bucket", "head"), "bucket")
    shared = ws.keep(shared, "shared")
    ws.drop("banded")
    search = _Search(ws, rule, src, classes)

    # round 1: every member with the smallest of its bucket; a pair that shares many bands is looked at once
    twos = heads.where("size = 2").select("head", F.col("last").alias("rep"))
    met = twos.unionByName(shared.select("head", "rep")).where("rep <> head").distinct()
    first = sketch.select(F.col("rep").alias("head"), *[F.col(c).alias(f"h_{c}") for c in ("n", "s0", "s1")])
    bits = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"h_{c}"))) for c in ("s0", "s1")), F.lit(0))
    fits = (100 * F.least("n", "h_n") >= rule.percent * F.greatest("n", "h_n")) & (bits <= differing(rule.percent))
    pairs = met.join(sketch, "rep").join(first, "head").where(fits).select(F.col("head").alias("u"), F.col("rep").alias("v"))
    links = search.confirmed([search.promising(pairs)], "first")
    roots = ws.keep(components(ws, links, "first"), "roots")

    # round 2: what its bucket still holds apart
    roots = search.apart(shared.select("bucket", "rep", "n"), roots)
    ws.drop("shared", "heads", "sketch")

    found = classes.select("key", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("root"))
    out = signed.select("doc_id", "n", "key").join(found, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
    )


def keep_first(docs: DataFrame, rule: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are their component's first, with all their columns; null ids stay."""
    ws = Workspace(docs.sparkSession, "kept")
    others = near_duplicates(docs, rule, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    others = ws.keep(others, "gone")
    if others.count() <= BROADCAST_IDS:  # the texts are not shuffled
        others = F.broadcast(others)
    return docs.join(others, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
