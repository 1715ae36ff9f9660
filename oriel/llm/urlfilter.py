"""URL filters, in DataFrame functions only.

Pattern rules are indexed by their rarest literal token, the one that fewest
URLs hold.  The tokens are derived from the pattern: those that every match holds whole.  A URL's distinct tokens fetch candidate rules by an equi-join, and
only candidates run their regular expression.  A verdict depends on nothing but
the URL, so URLs are judged once each, however many rows hold them.  Host rules with a
path prefix are indexed by host: every distinct host looks up itself and its parent
domains by an equi-join, and of its rules the longest that fits the path wins.

Rules are tables, read from files or given as tuples; those of at most
``BROADCAST_BYTES`` are broadcast, larger ones are joined by a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

#: Bytes of text in a rule table that is broadcast; larger tables are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over the lower-cased URL; ``tokens`` are literals that each match holds as whole tokens, all that can be
    derived unless some are named."""

    verdict: str
    pattern: str
    tokens: tuple[str, ...] = ()

    @property
    def literals(self) -> tuple[str, ...]:
        derived = literal_tokens(self.pattern)
        if unsure := set(self.tokens) - set(derived):
            raise ValueError(f"not every match of {self.pattern} holds {', '.join(sorted(unsure))}")
        if not derived:
            raise ValueError(f"a pattern needs literal tokens: {self.pattern}")
        return self.tokens or derived


def _is_token(code: int) -> bool:
    return 97 <= code <= 122 or 48 <= code <= 57


def _clean(items: list, at_end: bool) -> bool | None:
    """Whether what the items match never begins (or ends) with a token's character; None if they may match nothing."""
    for op, arg in reversed(items) if at_end else items:
        name = str(op)
        if name == "LITERAL":
            return not _is_token(arg)
        if name == "IN":
            if str(arg[0][0]) == "NEGATE":
                held = {c for o, a in arg[1:] for c in (range(a[0], a[1] + 1) if str(o) == "RANGE" else [a] if str(o) == "LITERAL" else [])}
                return all(c in held for c in range(128) if _is_token(c))
            return not any(str(o) not in ("LITERAL", "RANGE") or any(_is_token(c) for c in (range(a[0], a[1] + 1) if str(o) == "RANGE" else [a])) for o, a in arg)
        if name == "SUBPATTERN":
            inner = _clean(list(arg[3]), at_end)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            inner = _clean(list(arg[2]), at_end)
            if inner is not False and arg[0] == 0:
                inner = None
        elif name == "BRANCH":
            sides = [_clean(list(x), at_end) for x in arg[1]]
            inner = False if False in sides else None if None in sides else True
        elif name == "AT":  # the ends of the text; elsewhere an anchor says nothing of its neighbour
            return str(arg) in ("AT_BEGINNING", "AT_BEGINNING_STRING", "AT_END_STRING") or False
        else:
            return False
        if inner is not None:
            return inner
    return None


def literal_tokens(pattern: str) -> tuple[str, ...]:
    """The runs of letters and digits that each match of a pattern holds, with something else or the text's end on both sides.

    Only what the pattern demands outside choices and repeats counts, so a pattern may have none.
    """
    flat: list = []

    def open_groups(items: list) -> None:
        for op, arg in items:
            if str(op) == "SUBPATTERN":
                open_groups(list(arg[3]))
            elif str(op) in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] == arg[1] == 1:
                open_groups(list(arg[2]))
            else:
                flat.append((op, arg))

    open_groups(list(re._parser.parse(pattern)))
    out, i = [], 0
    while i < len(flat):
        j = i
        while j < len(flat) and str(flat[j][0]) == "LITERAL" and _is_token(flat[j][1]):
            j += 1
        if j > i and _clean(flat[:i], True) and _clean(flat[j:], False):
            out.append("".join(chr(c) for _, c in flat[i:j]))
        i = max(j, i + 1)
    return tuple(dict.fromkeys(out))


HOST_RULES = (
    HostRule("block", "net", "/"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)
#: Exceptions ("allow") override blocks.
PATTERN_RULES = tuple(
    PatternRule(verdict, pattern)
    for verdict, pattern in (
        ("block", r"://([^/?#]*\.)?casino-[a-z0-9-]+\."),
        ("block", r"://([^/?#]*\.)?[a-z0-9]+-casino\."),
        ("block", r"://([^/?#]*\.)?free-bets\."),
        ("block", r"://([^/?#]*\.)?free-(spins|chips|coins)\."),
        ("block", r"://([^/?#]*\.)?cheap-pills\."),
        ("block", r"://([^/?#]*\.)?buy-[a-z0-9-]+-online\."),
        ("block", r"://([^/?#]*\.)?spam-[a-z0-9-]+\."),
        ("block", r"://([^/?#]*\.)?adult-[a-z0-9-]+\."),
        ("block", r"://([^/?#]*\.)?xxx[.-]"),
        ("block", r"://([^/?#]*\.)?porn[.-]"),
        ("block", r"[?&/]doubleclick[/.=]"),
        ("block", r"/affiliate/click\?id=[0-9]+"),
        ("block", r"[?&]utm_campaign=(casino|bets)(&|#|$)"),
        ("allow", r"://([^/?#]*\.)?spam-policy\."),
        ("allow", r"://([^/?#]*\.)?spam-report\."),
    )
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://``, and path up to ``?`` or ``#``; empty without ``://``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^[^?#]*", 0)
    return F.translate(host, upper, lower), path


def host_table(spark: SparkSession, rules: tuple[HostRule, ...] | DataFrame) -> DataFrame:
    """(host, path, verdict) of host rules."""
    if isinstance(rules, DataFrame):
        return rules.select("host", F.coalesce("path", F.lit("/")).alias("path"), "verdict")
    return _literal(spark, ("host", "path", "verdict"), [(r.host, r.path, r.verdict) for r in rules])


def pattern_table(spark: SparkSession, rules: tuple[PatternRule, ...] | DataFrame) -> DataFrame:
    """(pattern, verdict, token), a row for each token of each rule; a rule without literal tokens is refused."""
    if isinstance(rules, DataFrame):
        bad = F.coalesce(F.size("tokens") < 1, F.lit(True)) | F.exists("tokens", lambda t: ~F.coalesce(t.rlike(f"^{TOKEN}$"), F.lit(False)))
        checked = F.when(bad, F.raise_error(F.concat(F.lit("a pattern needs literal tokens: "), "pattern"))).otherwise(F.col("tokens"))
        return rules.select("pattern", "verdict", F.explode(checked).alias("token"))
    return _literal(spark, ("pattern", "verdict", "token"), [(r.pattern, r.verdict, t) for r in rules for t in r.literals])


def _literal(spark: SparkSession, names: tuple[str, ...], rows: list[tuple[str, ...]]) -> DataFrame:
    if not rows:
        return spark.range(0).select(*[F.lit("").alias(n) for n in names])
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, row)]) for row in rows])))


def read_host_rules(spark: SparkSession, path: str) -> DataFrame:
    """Host rules from JSON lines with host, path and verdict."""
    return spark.read.schema("host string, path string, verdict string").json(path)


def read_pattern_rules(spark: SparkSession, path: str) -> DataFrame:
    """Pattern rules from JSON lines with verdict, pattern and tokens."""
    return spark.read.schema("verdict string, pattern string, tokens array<string>").json(path)


def _small(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if its text is within the bound."""
    size = table.select(F.sum(sum((F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in table.columns), F.lit(0)).cast("long"))).first()[0]
    return F.broadcast(table) if (size or 0) <= BROADCAST_BYTES else table


def rule_index(urls: DataFrame, named: DataFrame) -> DataFrame:
    """(token, pattern, verdict), each rule under that of its tokens which the fewest URLs hold.

    One count a distinct token that any rule names; ``urls`` has columns url, tokens.
    """
    only = _small(named.select("token").distinct())
    counts = urls.select(F.explode("tokens").alias("token")).join(only, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))
    return named.join(counts, "token", "left").groupBy("pattern", "verdict").agg(best.getField("token").alias("token")).select("token", "pattern", "verdict")


def host_verdicts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each host that a rule covers, the rules of itself and its parent domains."""
    most = rules.select(F.max(F.size(F.split("host", "[.]")))).first()[0] or 1  # no longer name can be a rule's
    names = F.expr(f"transform(sequence(greatest(size(labels) - {most - 1}, 1), size(labels)), i -> array_join(slice(labels, i, {most}), '.'))")
    hosts = hosts.withColumn("labels", F.split("host", "[.]"))
    fits = hosts.where("host <> ''").select("host", F.explode(names).alias("suffix")).join(_small(rules.withColumnRenamed("host", "suffix")), "suffix")
    rule = F.struct(F.length("suffix").alias("hl"), F.length("path").alias("pl"), F.concat("suffix", "path").alias("name"), "path", "verdict")
    return fits.groupBy("host").agg(F.collect_set(rule).alias("rules"))


def judge(
    pages: DataFrame,
    host_rules: tuple[HostRule, ...] | DataFrame = HOST_RULES,
    pattern_rules: tuple[PatternRule, ...] | DataFrame = PATTERN_RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict.

    ``rule`` is the host rule that decides, or null; without one the pattern
    rules decide: blocked if a block pattern and no allow pattern matches,
    else allowed.  A null url, or one without ``://``, has an empty host and path and
    is allowed.  Ids may be null or repeat; each row gets its own result.
    Rules that name one host and path twice are one, the verdict that sorts last being its own.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "urls")
    hosts_, patterns = host_table(spark, host_rules), pattern_table(spark, pattern_rules)
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    urls = src.where("url is not null").select("url").distinct().select("url", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    urls = ws.keep(urls, "urls")
    covered = ws.keep(host_verdicts(urls.select("host").distinct(), hosts_), "hosts")
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r.path))
    ruled = ws.keep(urls.join(_small(covered), "host", "left").select("url", "host", "path", F.array_max(fits).alias("r")), "ruled")
    # the patterns are asked about URLs that no host rule decides, once for each
    tokens = ruled.where("r is null").select("url", F.lower("url").alias("low")).withColumn("tokens", F.array_distinct(F.expr(f"regexp_extract_all(low, '{TOKEN}', 0)")))
    index = ws.keep(rule_index(tokens, patterns), "index")
    found = tokens.select("url", "low", F.explode("tokens").alias("token")).join(_small(index), "token").where(F.expr("low rlike pattern"))
    found = found.groupBy("url").agg(F.min(F.col("verdict") == "block").alias("blocked"))
    decided = ruled.join(found, "url", "left").select(
        "url", "host", "path", F.col("r.name").alias("rule"), F.coalesce("r.verdict", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict")
    )
    # rows without a URL have one verdict, and join nothing
    out = src.where("url is not null").join(decided, "url").unionByName(src.where("url is null"), allowMissingColumns=True)
    return out.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
