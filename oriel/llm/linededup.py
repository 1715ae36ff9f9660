"""Repeated runs of lines by winnowing over line hashes, in DataFrame functions only.

Of every ``window`` consecutive lines the least hash selects a position, so two equal
runs of that length select the same line; a document's selected positions are its
fingerprints, about half as many as its windows.  Fingerprints are joined on their hash: one
that the corpus has once drops its windows at once.  The windows of those that recur are verified against all their
lines and find the earliest place that has them.  A line of ``long_words`` words or more is a fingerprint and
a window by itself; one of ``short_words`` or more is where exact counts show that it recurs.
Adjoining matches merge, are extended line by line in both directions up to the first line in which
the places differ, and the later place's lines go.  Lines count as equal if two independent 64-bit hashes of them are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WHITE, Workspace, word_count

#: Runs that name one partner and are extended beside one copy of its lines.
RUNS_BESIDE = 512
#: Lines that are compared before all that remain, most runs being short.
STEP = 8


@dataclass(frozen=True)
class Winnow:
    """Lines in a window, and the words from which one line counts as a window.

    Shorter lines of ``short_words`` words or more (0: none) count as windows too if they have
    ``places`` places in all and these are in two documents at least.
    """

    window: int = 3
    long_words: int = 10
    short_words: int = 0
    places: int = 3


#: For corpora: lines of a few words that come again and again, such as notices, go as well.
CORPUS = Winnow(short_words=3)


def _sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document: place, two hashes and words of every line that has a word."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    src = src.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("t").alias("th"), F.split("t", "\n", -1).alias("raw"))
    lines = F.filter(
        F.transform("raw", lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), F.trim(x, F.lit(WHITE)).alias("s"))),
        lambda x: x.s != "",
    )
    src = src.select("d", "th", lines.alias("ls"))
    words = F.transform("ls", lambda x: word_count(x.s))
    return src.select("d", "th", F.col("ls.at").alias("at"), F.col("ls.h").alias("h"), F.col("ls.g").alias("g"), words.alias("w")).dropDuplicates(["d", "th"])


def _selected(t: int) -> str:
    """The line that the window from line i selects: the last of its least hashes."""
    return f"i + {t} - cast(array_position(reverse(slice(h, i + 1, {t})), array_min(slice(h, i + 1, {t}))) as int)"


def _starts(t: int) -> str:
    return f"if(size(h) < {t}, cast(array() as array<int>), sequence(0, greatest(size(h), {t}) - {t}))"


def fingerprints(sketch: DataFrame, rule: Winnow) -> DataFrame:
    """(d, th, k, h, picked, w): lines that a window selects (``picked``), and those that are long enough to count alone."""
    least = min(rule.short_words or rule.long_words, rule.long_words)
    picks = sketch.where(F.size("h") > 0).withColumn("picks", F.expr(f"array_distinct(transform({_starts(rule.window)}, i -> {_selected(rule.window)}))"))
    alone = F.expr(f"filter(sequence(0, size(h) - 1), k -> w[k] >= {least})")
    rows = picks.select("d", "th", "h", "w", "picks", F.explode(F.array_union("picks", alone)).alias("k"))
    return rows.select("d", "th", "k", F.expr("h[k]").alias("h"), F.array_contains("picks", F.col("k")).alias("picked"), F.expr("w[k]").alias("w"))


def repeated_lines(docs: DataFrame, rule: Winnow = Winnow(), id_col: str = "doc_id", text_col: str = "text", ws: Workspace | None = None) -> DataFrame:
    """(d, th, gone, n_runs): documents that lose lines, and the places of those lines.

    d is the id (nulls sort before all others), th the text's hash; together
    they name a text, so rows that repeat an id and a text are one document.
    """
    ws = ws or Workspace(docs.sparkSession, "lines")
    t = rule.window
    least = min(rule.short_words or rule.long_words, rule.long_words)
    sketch = ws.keep(_sketch(docs, id_col, text_col), "sketch")
    prints = ws.keep(fingerprints(sketch, rule), "prints")
    known = prints.groupBy("h").agg(F.min(F.struct("d", "th", "k")).alias("p"), F.max(F.struct("d", "th")).alias("last"), F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = ws.keep(prints.join(known, "h"), "shared")

    # lines that count alone: all their places are fingerprints, so the earliest is known
    recurs = (F.col("w") >= rule.long_words) | (F.col("c") >= rule.places) & (F.struct("p.d", "p.th") < F.col("last"))
    alone = shared.where((F.col("w") >= least) & recurs & (F.struct("d", "th", "k") > F.col("p")))
    place = ["d", "th", "k", "n", "pd", "pth", "shift"]
    alone = alone.select("d", "th", "k", F.lit(1).alias("n"), F.col("p.d").alias("pd"), F.col("p.th").alias("pth"), (F.col("k") - F.col("p.k")).alias("shift"))
    # windows whose selected line recurs, each with the earliest that has all its lines
    ours = shared.where("picked").groupBy("d", "th").agg(F.collect_set("k").alias("ks")).join(sketch.select("d", "th", "h", "g"), ["d", "th"])
    key = lambda c: f"array({', '.join(f'{c}[i + {j}]' for j in range(t))})"
    starts = F.expr(f"transform(filter({_starts(t)}, i -> array_contains(ks, {_selected(t)})), i -> named_struct('k', i, 'hs', {key('h')}, 'gs', {key('g')}))")
    windows = ws.keep(ours.select("d", "th", F.explode(starts).alias("x")).select("d", "th", "x.*"), "windows")
    firsts = windows.groupBy("hs", "gs").agg(F.min(F.struct("d", "th", "k")).alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    hits = windows.join(firsts, ["hs", "gs"]).where(F.struct("d", "th", "k") > F.col("p"))
    hits = hits.select("d", "th", "k", F.lit(t).alias("n"), F.col("p.d").alias("pd"), F.col("p.th").alias("pth"), (F.col("k") - F.col("p.k")).alias("shift"))
    hits = hits.select(place).unionByName(alone.select(place))

    # windows of one document, partner and shift that adjoin or overlap are one run
    along = Window.partitionBy("d", "th", "pd", "pth", "shift").orderBy("k", "n")
    hits = hits.withColumn("reach", F.max(F.col("k") + F.col("n")).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    hits = hits.withColumn("run", F.sum(F.when(F.col("k") <= F.col("reach"), 0).otherwise(1)).over(along))
    runs = hits.groupBy("d", "th", "pd", "pth", "shift", "run").agg(F.min("k").alias("a"), F.max(F.col("k") + F.col("n")).alias("z")).drop("run")
    runs = ws.keep(runs, "runs")
    ws.drop("prints", "shared", "windows")

    # both ways, up to the first line in which the places differ; a partner's lines are copied once for so many runs
    named = runs.groupBy("pd", "pth").agg(F.ceil(F.count(F.lit(1)) / RUNS_BESIDE).cast("int").alias("beside"))
    partners = sketch.select(F.col("d").alias("pd"), F.col("th").alias("pth"), F.col("h").alias("ph"), F.col("g").alias("pg")).join(named, ["pd", "pth"])
    partners = partners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("beside") - 1))).drop("beside")
    own = runs.join(named, ["pd", "pth"]).withColumn("salt", F.pmod(F.xxhash64("d", "th", "shift"), F.col("beside")).cast("int")).drop("beside")
    own = own.join(partners, ["pd", "pth", "salt"]).drop("pd", "pth", "salt")
    own = own.join(sketch.select("d", "th", "h", "g", "at"), ["d", "th"])
    own = own.withColumns({"room_a": F.least("a", F.col("a") - F.col("shift")), "room_z": F.least(F.size("h") - F.col("z"), F.size("ph") - (F.col("z") - F.col("shift")))})

    def agree(room: str, mine: str, theirs: str) -> Column:
        """Lines, counted from 1, before the first that differs: looked for in the first few, then in all."""
        first = lambda most: f"array_min(filter(sequence(1, greatest({most}, 1)), i -> h[{mine}] <> ph[{theirs}] or g[{mine}] <> pg[{theirs}]))"
        found = f"coalesce({first(f'least({room}, {STEP})')}, if({room} > {STEP}, {first(room)}, null))"
        return F.expr(f"if({room} < 1, 0, coalesce({found} - 1, {room}))").cast("int")

    own = own.withColumns({"back": agree("room_a", "a - i", "a - shift - i"), "onward": agree("room_z", "z + i - 1", "z - shift + i - 1")})
    spans = own.select("d", "th", F.expr("slice(at, a - back + 1, z + onward - a + back)").alias("places"))
    return spans.groupBy("d", "th").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("gone"), F.count(F.lit(1)).alias("n_runs"))


def line_dedup(docs: DataFrame, rule: Winnow = Winnow(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated runs of lines removed from the text; two columns are added in front.

    Result: ``__n_removed`` (lines) and ``__n_runs`` beside all of the
    documents' columns, the text being what is left.  Documents without a
    repeated run keep their text byte for byte, null texts stay null, and no row
    is dropped, not even one that has lost all its lines.  Of equal places the one with
    the smallest (doc_id, text hash, line) stays; a null id sorts first.
    Lines without a word are never removed and never part of a run.  Columns of the
    documents that are named like the two that are added are replaced by them.
    """
    docs = docs.drop("__n_removed", "__n_runs")
    gone = repeated_lines(docs, rule, id_col, text_col)
    text = F.col("__row").getField(text_col).cast("string")
    rows = docs.select(F.struct("*").alias("__row"))
    rows = rows.select("__row", F.coalesce(F.col("__row").getField(id_col).cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"))
    rows = rows.join(gone, ["d", "th"], "left")
    lines = F.split(text, "\n", -1)
    left = F.expr("array_except(sequence(0, size(__lines) - 1), gone)")
    rows = rows.withColumn("__lines", F.when(F.col("gone").isNotNull(), lines)).withColumn("__left", F.when(F.col("gone").isNotNull(), left))
    cleaned = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform("__left", lambda i: F.col("__lines")[i]), "\n"))
    return rows.select(
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("__n_removed"),
        F.coalesce("n_runs", F.lit(0)).cast("long").alias("__n_runs"),
        F.col("__row").withField(text_col, cleaned).alias("__row"),
    ).select("__n_removed", "__n_runs", "__row.*")
