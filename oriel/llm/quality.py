"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for each document; the ledger stores the bits of
the rules that failed beside the measurements they rest on.  A policy is a
versioned mask over those bits, so changing a policy reads the ledger and never
the text, and ablations are bitwise aggregations of the counts per bit pattern.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WHITE_RE


@dataclass(frozen=True)
class Rule:
    """A name and the SQL condition on measurements under which a document fails."""

    name: str
    fails: str


#: A rule's bit is its place in this list; append only.
RULES: tuple[Rule, ...] = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("bullet_lines", "100 * n_bullet_lines > 90 * n_lines"),
    Rule("open_lines", "100 * n_open_lines > 50 * n_lines"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: Policies by version; a document is kept if none of the mask's rules failed.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["duplicate_lines"] | BIT["short_words"] | BIT["long_words"],
    "v2": (1 << len(RULES)) - 1,
}
MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bullet_lines", "n_open_lines")


def measured(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with the measurements in one struct column ``__m``; a null text has no words."""
    blank = F.lit(WHITE)
    df = df.withColumn("__t", F.coalesce(text, F.lit("")))
    df = df.withColumn("__trim", F.trim("__t", blank))
    df = df.withColumn("__w", F.when(F.col("__trim") == "", F.array().cast("array<string>")).otherwise(F.split("__trim", WHITE_RE, -1)))
    df = df.withColumn("__l", F.filter(F.split("__t", "\n", -1), lambda x: F.trim(x, blank) != ""))
    # three-word windows as (hash << b | start), b bits for the start: a primitive sort brings equal windows together.
    # What is left of the hash only says where to look: neighbours count as equal if their words are.
    df = df.withColumn("__n", F.size("__w")).withColumn("__b", F.length(F.bin(F.col("__n").cast("long"))))
    df = df.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    df = df.withColumn(
        "__g",
        F.expr(
            "sort_array(if(__n < 3, cast(array() as array<bigint>), transform(sequence(0, greatest(__n, 3) - 3),"
            " i -> coalesce(shiftleft(xxhash64(__h[i], __h[i + 1], __h[i + 2]), __b) | cast(i as bigint), 0L))))"
        ),
    )
    start = lambda x: f"cast({x} & (shiftleft(1L, __b) - 1) as int)"

    def equal(step: int) -> str:
        other = f"get(__g, i + {step})"
        words = " and ".join(f"get(__w, {start(other)} + {k}) = get(__w, {start('x')} + {k})" for k in range(3))
        return f"(shiftright({other}, __b) = shiftright(x, __b) and {words})"

    # two to each side: a window of other words with the same rest of a hash may lie between
    near = " or ".join(equal(step) for step in (-1, 1, -2, 2))
    df = df.withColumn("__r", F.expr(f"sort_array(transform(filter(__g, (x, i) -> {near}), x -> x & (shiftleft(1L, __b) - 1)))"))
    covered = F.expr(
        "aggregate(__r, named_struct('at', -3L, 'n', 0L), (s, x) -> named_struct('at', x, 'n', s.n + least(3L, x - s.at)), s -> s.n)"
    )
    count = lambda pattern: F.size(F.filter("__l", lambda x: x.rlike(pattern))).cast("long")
    # a condition that depends on the row's place, though always true, keeps the optimiser from pulling
    # the measurements, each of which the rules name many times, into filters above
    return df.withColumn(
        "__m",
        F.when(F.monotonically_increasing_id() >= 0, F.struct(
            F.col("__n").cast("long").alias("n_words"),
            F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
            covered.alias("n_repeat_words"),
            F.size("__l").cast("long").alias("n_lines"),
            count(r"^\s*(?:[-*•]\s|\d+[.)]\s)").alias("n_bullet_lines"),
            count(r"(?:\.\.\.|…)\s*$").alias("n_open_lines"),
        )),
    ).drop("__t", "__trim", "__w", "__l", "__n", "__b", "__h", "__g", "__r")


def failure_bits(measures: str = "__m") -> Column:
    """The bits of all failed rules, from a struct of measurements."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        condition = re.sub(rf"\b({'|'.join(MEASUREMENTS)})\b", rf"{measures}.\1", rule.fails)
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, every measurement, failure_bits.

    Null and empty texts have no words and fail ``few_words``.  Ids may be null
    or repeat; every row is judged by itself.  Other columns are not read.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    return measured(src, F.col("__text")).select("doc_id", "__m.*", failure_bits().alias("failure_bits"))


def judge(entries: DataFrame, version: str = "v1") -> DataFrame:
    """A ledger with base_failed, kept and the policy version, without touching the texts."""
    return entries.withColumns(
        {
            "base_failed": F.col("failure_bits").bitwiseAND(F.lit(BASE)) != 0,
            "kept": F.col("failure_bits").bitwiseAND(F.lit(POLICIES[version] | BASE)) == 0,
            "policy": F.lit(version),
        }
    )


def ablations(entries: DataFrame, version: str = "v1") -> DataFrame:
    """For each rule of a policy: documents it fails, fails alone, and those kept without it.

    One count per bit pattern (at most 2 to the number of rules), then bitwise sums over those.
    """
    mask = POLICIES[version]
    by_bits = entries.groupBy("failure_bits").count()
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("count"))), F.lit(0)).cast("long")
    hit = F.col("failure_bits").bitwiseAND(F.lit(mask))
    rows = [
        F.struct(
            F.lit(r.name).alias("rule"),
            total(hit.bitwiseAND(F.lit(b)) != 0).alias("n_failed"),
            total(hit == b).alias("n_failed_alone"),
            total(hit.bitwiseAND(F.lit(~b)) == 0).alias("n_kept_without"),
        )
        for r in RULES
        if (b := BIT[r.name]) & mask
    ]
    return by_bits.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def keep_good(docs: DataFrame, version: str = "v1", text_col: str = "text") -> DataFrame:
    """The documents a policy keeps, with all their columns."""
    mask = F.lit(POLICIES[version] | BASE)
    judged = measured(docs.select(F.struct("*").alias("__row"), F.col(text_col).cast("string").alias("__text")), F.col("__text"))
    return judged.where(failure_bits().bitwiseAND(mask) == 0).select("__row.*")
