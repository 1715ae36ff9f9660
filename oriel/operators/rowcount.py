"""Row counts: exact, sampled, from statistics, or a mix of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Defaults of the four methods."""

    method: str = "HYBRID"
    small: int = 100_000
    exact_quota: int = 10
    percent: float = 0.1
    stale_above: float = 1.0


@dataclass
class Statistics:
    """What a catalog knows of a table."""

    num_rows: int | None = None
    modifications: int | None = None
    bytes: int | None = None
    avg_row_len: int | None = None
    blocks: int | None = None


def stale(s: Statistics, above: float = 1.0) -> bool:
    """Statistics are stale if they are missing or too much has changed since."""
    if s.num_rows is None or s.modifications is None:
        return True
    return s.modifications > 0 if s.num_rows == 0 else s.modifications / s.num_rows > above


def from_segment(s: Statistics) -> int | None:
    """Bytes by row length, else the catalog's count, else four fifths of the blocks."""
    if s.bytes and s.avg_row_len:
        return s.bytes // s.avg_row_len
    if s.num_rows is not None:
        return s.num_rows
    return int(s.blocks * 8192 * 0.8 // s.avg_row_len) if s.blocks and s.avg_row_len else None


def exact(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def sampled(df: DataFrame, percent: float, seed: int = 42) -> DataFrame:
    """An estimate from a share of the rows, in percent between 0.1 and 100."""
    share = min(max(percent, 0.1), 100.0)
    return df.sample(share / 100, seed).agg(F.round(F.count(F.lit(1)) * (100 / share)).cast("long").alias("n_rows"))


class Counter:
    """Counts tables one after the other under one set of settings and one quota of exact counts."""

    def __init__(self, settings: Settings = Settings()):
        self.settings, self.exact_left = settings, settings.exact_quota

    def choose(self, s: Statistics) -> str:
        c = self.settings
        if c.method == "EXACT_COUNT":
            return "exact" if self.exact_left > 0 else "sample"
        if c.method == "STATISTICS_ONLY":
            return "statistics"
        if c.method == "SAMPLING":
            return "sample"
        if not stale(s, c.stale_above):
            return "statistics"
        guess = from_segment(s)
        return "exact" if (guess is None or guess <= c.small) and self.exact_left > 0 else "sample"

    def count(self, df: DataFrame, s: Statistics = Statistics()) -> DataFrame:
        """One row: n_rows, method."""
        how = self.choose(s)
        if how == "statistics":
            out = df.sparkSession.range(1).select(F.lit(s.num_rows or 0).cast("long").alias("n_rows"))
        elif how == "exact":
            self.exact_left -= 1
            out = exact(df)
        else:
            out = sampled(df, self.settings.percent)
        return out.withColumn("method", F.lit(how))
