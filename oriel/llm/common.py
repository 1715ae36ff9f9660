"""Shared helpers: table access, materialised intermediates, group iteration, UDF-side arrays."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words in every operator here.
WHITE = " \t\n\x0b\x0c\r"
#: The same class for Java regular expressions.
WHITE_RE = r"[\x20\x09-\x0D]+"

#: Bytes of an Arrow batch that Spark hands to Python.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a new local one where it is unset and Spark runs on one machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="oriel-"))
    return sc.getCheckpointDir().rstrip("/")


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once a session, however the driver came by it."""
    sc = spark.sparkContext
    if getattr(sc, "_oriel_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="oriel-ship-")) / "oriel.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(target))
    sc._oriel_shipped = True


class Workspace:
    """Intermediate results as parquet tables in the shared folder.

    A written table cuts lineage and survives lost executors; it is also the
    smallest form in which an intermediate can be kept.  ``drop`` removes one
    as soon as nothing reads it; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/oriel-{label}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[str, str] = {}
        ship(spark)
        # rows differ a thousandfold in size: batches for Python are bounded by bytes, not rows
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        atexit.register(self._clear)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:6]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[name] = path
        self.release()
        return out

    def release(self) -> None:
        """Let shuffle files of finished jobs go, which wait for the JVM to collect the plans that made them."""
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass


def word_count(text) -> F.Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column; null counts as no text."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WHITE_RE, -1))).cast("long")


def in_batches(columns: dict[str, pa.DataType], rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches from row tuples."""
    names, kinds, held = list(columns), list(columns.values()), []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield flush()
            held = []
    if held:
        yield flush()


def in_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys, from batches sorted by the keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = np.zeros(batch.num_rows, bool)
        for k in keys:
            col = batch.column(k).to_numpy(zero_copy_only=False)
            cuts[1:] |= col[1:] != col[:-1]
        starts = [0, *np.flatnonzero(cuts).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            part = batch.slice(a, b - a)
            if held and any(held[-1].column(k)[0] != part.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def text_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, offsets, bytes) of runs of rows of about ``most`` bytes; a null text is empty.

    One text longer than ``most`` makes a run of its own; texts are never cut.
    """
    col = batch.column(column).cast(pa.large_string())
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    if col.null_count:  # offsets may skip bytes under a null
        filled = col.fill_null("")
        offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + n + 1]
        data = np.frombuffer(filled.buffers()[2], np.uint8) if filled.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b - a, offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
        a = b


def trim() -> None:
    """Hand freed memory back to the system: a worker process outlives its task and idles beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (multiply and shift, as in public splitmix generators)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 19)
            with np.errstate(over="ignore"):
                for name, b in (("up", self.base), ("down", self.inverse)):
                    p = np.full(n, b, np.uint64)
                    p[0] = 1
                    setattr(self, name, np.cumprod(p, dtype=np.uint64))
        return self.up, self.down


POWERS = _Powers()
BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64))
IS_WHITE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def word_bounds(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word, in order; words end at document bounds."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none
    solid = ~IS_WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, 64-bit hash) of each word, in order; words end at document bounds."""
    n = len(data)
    starts, ends = word_bounds(offsets, data)
    if not n:
        return starts, ends, starts.astype(np.uint64)
    up, down = POWERS.get(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODE[data] * up[:n], out=total[1:])
        words = mix64((total[ends] - total[starts]) * down[starts])
    return starts, ends, words


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document index, 64-bit hash) of each word, in order."""
    starts, _, words = word_spans(offsets, data)
    return np.searchsorted(offsets, starts, "right") - 1, words
