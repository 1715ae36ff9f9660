"""Vector codes: each part of a vector as the number of its nearest codebook entry, with codebooks from delta-maintained Lloyd rounds.

Vectors become integers, so sums and distances are exact in any order.  Every round reads the
table of vectors with their previous assignments once, assigns the parts anew and writes both.  Of parts whose
assignment changed, the same pass sends their components to the sums of the entry they came to, and takes them from
those of the entry they left; parts that stayed send nothing.  These contributions, added up within each task, are
all that is shuffled.  The driver holds the running sums, one for each entry, and derives the next codebooks from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, trim

#: Vectors whose distances are held at once, and groups of so many rows that one task should not have them alone.
BLOCK, HOT = 2048, 4096


@dataclass(frozen=True)
class Coding:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    #: Components are multiplied by it and rounded down.
    scale: int = 1024

    def __post_init__(self) -> None:
        if self.parts < 1 or not 1 <= self.entries <= 256 or self.rounds < 0 or self.scale < 1:
            raise ValueError("at least one part and up to 256 entries")


@dataclass
class Codebooks:
    """``books[part, entry]`` are components; ``sums`` and ``counts`` belong to the parts that are assigned to each entry."""

    books: np.ndarray
    sums: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, first: np.ndarray, parts: int) -> Codebooks:
        books = np.ascontiguousarray(first.reshape(len(first), parts, -1).swapaxes(0, 1))
        return cls(books, np.zeros_like(books), np.zeros(books.shape[:2], np.int64))

    def add(self, part: int, entry: int, n: int, sums: list[int]) -> None:
        self.counts[part, entry] += n
        self.sums[part, entry] += np.array(sums, np.int64)

    def step(self) -> None:
        """Each entry to the mean of its parts, rounded down; an unused one stays."""
        used = self.counts > 0
        self.books[used] = self.sums[used] // self.counts[used][:, None]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def finite(vector: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    v = vector.cast("array<double>")
    return F.coalesce(vector.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row of integers; equal distances go to the lower entry."""
    peak = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    at, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    exact = 4 * x.shape[1] * peak * peak < 1 << 53  # then all sums of products are whole numbers that a double holds
    step = BLOCK if exact else max(1, BLOCK // 32)
    for a in range(0, len(x), step):
        y = x[a : a + step]
        if exact:
            z, b = y.astype(np.float64), book.astype(np.float64)
            d = (b * b).sum(1) - 2 * (z @ b.T)
            at[a : a + step] = best = d.argmin(1)
            far[a : a + step] = (z * z).sum(1) + d[np.arange(len(y)), best]
        else:
            d = ((y[:, None, :] - book[None]) ** 2).sum(2)
            at[a : a + step] = best = d.argmin(1)
            far[a : a + step] = d[np.arange(len(y)), best]
    return at, far


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes as bytes by part, squared distance summed over parts)."""
    cut = x.astype(np.int64).reshape(len(x), len(books), -1)
    found = [nearest(cut[:, i], b) for i, b in enumerate(books)]
    return np.stack([f[0] for f in found], 1).astype(np.uint8), np.sum([f[1] for f in found], 0)


def _codes(column: pa.Array, parts: int) -> np.ndarray | None:
    return None if column.null_count else np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, parts)


def _round(books: np.ndarray):
    """State rows with new codes, and at the end of the task a row for each entry whose sums change."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        kinds: dict[str, pa.DataType] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = {n: batch.schema.field(n).type for n in ("id", "label", "x", "codes")}
            x = _rows(batch.column("x")).astype(np.int64)
            was, (now, _) = _codes(batch.column("codes"), parts), assigned(x, books)
            cut = x.reshape(len(x), parts, width)
            for i in range(parts):
                moved = np.ones(len(x), bool) if was is None else was[:, i] != now[:, i]
                np.add.at(sums[i], now[moved, i], cut[moved, i])
                counts[i] += np.bincount(now[moved, i], minlength=entries)
                if was is not None:
                    np.subtract.at(sums[i], was[moved, i], cut[moved, i])
                    counts[i] -= np.bincount(was[moved, i], minlength=entries)
            n = len(x)
            yield pa.RecordBatch.from_pydict({
                "kind": np.zeros(n, np.int32), **{k: batch.column(k) for k in ("id", "label", "x")}, "codes": pa.array([c.tobytes() for c in now], pa.binary()),
                "part": pa.nulls(n, pa.int32()), "entry": pa.nulls(n, pa.int32()), "n": pa.nulls(n, pa.int64()), "sums": pa.nulls(n, pa.list_(pa.int64())),
            })
        p, e = np.nonzero((counts != 0) | (sums != 0).any(2))
        if len(p):
            yield pa.RecordBatch.from_pydict({
                "kind": np.ones(len(p), np.int32), **{k: pa.nulls(len(p), kinds[k]) for k in kinds}, "part": p.astype(np.int32), "entry": e.astype(np.int32),
                "n": counts[p, e], "sums": pa.array(sums[p, e].tolist(), pa.list_(pa.int64())),
            })
        trim()

    return run


def _final(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, error = assigned(_rows(batch.column("x")), books)
                yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "label": batch.column("label"), "code": [c.tobytes().hex() for c in codes], "error": error})

    return run


def _floors(scale: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            if batch.num_rows:
                whole = pa.array(np.floor(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).astype(np.int64)).cast(kind)
                x = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * (len(whole) // len(v))), whole)
                yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "label": batch.column("label"), "x": x, "codes": pa.nulls(len(v), pa.binary())})

    return run


def summed(coded: DataFrame, ws: Workspace, key: str, value: str, out: str) -> DataFrame:
    """``coded`` with ``value`` summed over all rows of equal ``key``, nulls together.

    Sums are added up before they are shuffled.  Keys of more than a ``HOT``-th of all rows, of which there are fewer than
    ``HOT``, are joined back by broadcast; the rows of the others are shuffled, and no key has many of them.
    """
    sums = ws.keep(coded.groupBy(F.col(key).alias("__key")).agg(F.sum(value).alias(out), F.count(F.lit(1)).alias("__n")), "sums")
    total = sums.agg(F.sum("__n")).first()[0] or 0
    hot, cold = (sums.where(F.col("__n") * HOT > total).drop("__n"), sums.where(F.col("__n") * HOT <= total).drop("__n"))
    same = F.col(key).eqNullSafe(F.col("__key"))
    rare = coded.join(F.broadcast(hot), same, "left_anti").join(cold, same)
    return coded.join(F.broadcast(hot), same).unionByName(rare).drop("__key")


def encode(vectors: DataFrame, rule: Coding = Coding(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code, error, label_error) of each vector that can be coded, and the codebooks.

    Vectors that are null or hold null or non-finite components take no part, nor do those of another length than the most
    usual one, or empty ones.  Codebooks begin as the vectors of the smallest ids (then of the smallest components; a null id comes last); with fewer
    vectors than entries they have fewer entries.  A repeated row is coded each time.  Null labels make one group.  A length that the parts do not
    divide, and components so large that sums leave 64 bits, raise ValueError.  No vectors, no rows and no codebooks.
    """
    ws = Workspace(vectors.sparkSession, "vectorcode")
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(finite(F.col("v")) & (F.size("v") > 0))
    peak = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    usual = base.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(peak).alias("peak")).orderBy(F.desc("n"), "d").first()
    if usual is None:
        empty = base.limit(0).select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty, None
    dims, most = usual["d"], int(usual["peak"] * rule.scale) + 1
    if dims % rule.parts:
        raise ValueError(f"vectors of {dims} components cannot be cut into {rule.parts} equal parts")
    if dims * 4 * (most + 1) ** 2 >= 1 << 63 or usual["n"] * most >= 1 << 63:
        raise ValueError(f"components of up to {usual['peak']} times {rule.scale} leave 64 bits")
    base = base.where(F.size("v") == dims)
    small = base.orderBy(F.col("id").asc_nulls_last(), "v").limit(rule.entries).select("v").toArrow().column("v").combine_chunks()
    books = Codebooks.of(np.floor(_rows(small).astype(np.float64) * rule.scale).astype(np.int64), rule.parts)

    whole, arrow = ("int", pa.int32()) if most < 1 << 31 else ("long", pa.int64())
    label = base.schema["label"].dataType.simpleString()
    columns = f"id long, label {label}, x array<{whole}>, codes binary"
    state = base.mapInArrow(_floors(rule.scale, arrow), columns)
    path = ""
    for k in range(rule.rounds):
        both = state.mapInArrow(_round(books.books), f"kind int, {columns}, part int, entry int, n long, sums array<long>")
        old, path = path, ws.path(f"round{k}")
        both.write.partitionBy("kind").option("compression", "zstd").parquet(path)
        written = vectors.sparkSession.read.schema(both.schema).parquet(path)
        width = dims // rule.parts
        moved = written.where("kind = 1").groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
        for r in moved.collect():  # a row for each entry at most
            books.add(r["part"], r["entry"], r["n"], list(r[3:]))
        books.step()
        state = written.where("kind = 0").select("id", "label", "x", "codes")
        if old:
            ws._delete(old)
        ws.release()
    coded = ws.keep(state.mapInArrow(_final(books.books), f"id long, label {label}, code string, error long"), "coded")
    if path:
        ws._delete(path)
    return summed(coded, ws, "label", "error", "label_error"), books
