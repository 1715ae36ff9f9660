"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words.  Sources share a budget by weight;
what a source cannot use is shared among the others.  Whole rounds over a
source fill its target as far as they go; for the rest, documents are counted by
exact length, what exceeds the program's table is filled in proportion to those counts, and
a bounded-knapsack dynamic program over lengths fills what remains as well as the
lengths still open allow, however long they are.  Which documents of a length are
taken is decided by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, word_count

#: Bytes of a plan that is broadcast; a larger one, of very many sources, is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Places that the documents of one source and length are dealt to.
BUCKETS = 1024


@dataclass(frozen=True)
class Mix:
    """Weights in the order of the sources' code points, repeating; the share of all words; rounds at most."""

    weights: tuple[float, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    seed: int = 7
    #: Budget up to which the dynamic program runs, in words, or twice the longest document that
    #: fits where that is more; what lies above is filled before.
    table: int = 1 << 16


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, table: int) -> np.ndarray:
    """How many documents of each length to take so that their words come near to ``budget`` from below.
    A budget of up to ``table`` words, or twice the longest length that fits, is met as nearly as any choice can;
    above that a proportional fill comes first, and the rest is met as nearly as what it leaves allows.
    No document left out would still fit.  Lengths are distinct and positive; no count is exceeded."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    # long documents compete too: twice the longest that fits is left to the table, so budgets up to that are met exactly
    table = max(table, 2 * int(lengths[lengths <= budget].max(initial=0)))
    taken = counts * max(budget - table, 0) // max(total, 1)  # the same share of each length
    left = budget - int((lengths * taken).sum())
    # down to the table: longest first, one document at a time of each length
    for i in np.argsort(-lengths):
        if left <= table:
            break
        n = min(int(counts[i] - taken[i]), (left - table) // int(lengths[i]))
        taken[i] += n
        left -= n * int(lengths[i])
    for i in np.argsort(lengths):  # then shortest first, should long ones not fit
        if left <= table:
            break
        n = min(int(counts[i] - taken[i]), (left - table) // int(lengths[i]))
        taken[i] += n
        left -= n * int(lengths[i])
    top = left  # by now less than the table and one document
    if top <= 0:
        return taken
    # bounded knapsack: copies of a length in binary bundles; a bit for each reachable sum
    first = np.full(top + 1, -1, np.int32)
    reach, bundles = 1, []
    for i in np.flatnonzero((lengths <= top) & (counts > taken)):
        spare, size = min(int(counts[i] - taken[i]), top // int(lengths[i])), 1
        while spare:
            n = min(size, spare)
            spare, size = spare - n, size * 2
            w = n * int(lengths[i])
            new = ((reach << w) & ((1 << (top + 1)) - 1)) & ~reach
            if new:
                reach |= new
                bits = np.unpackbits(np.frombuffer(new.to_bytes(top // 8 + 1, "little"), np.uint8), bitorder="little")[: top + 1]
                first[np.flatnonzero(bits)] = len(bundles)
            bundles.append((int(i), n, w))
        if reach >> top & 1:
            break
    at = reach.bit_length() - 1
    while at:
        i, n, w = bundles[first[at]]
        taken[i] += n
        at -= w
    return taken


def targets(sizes: Iterable[float], weights: Iterable[float], budget: float, most: float) -> list[float]:
    """Shares of a budget by weight, none above ``most`` times its size; the excess goes round again."""
    sizes, weights = list(sizes), list(weights)
    out, open_ = [0.0] * len(sizes), {i for i in range(len(sizes)) if weights[i] > 0}
    left = float(budget)
    while open_:
        w = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / w >= most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def _shares(sources: DataFrame, rule: Mix) -> DataFrame:
    """(key, source_size, target) from (key, source_size): the water level found by passes over a table
    of one row a source, each pass closing every source that its share would overfill."""
    order = sources.orderBy(F.col("key") == "", "key")
    weights = rule.weights
    ranked = order.rdd.zipWithIndex().map(lambda x: (x[0]["key"], x[0]["source_size"], float(weights[x[1] % len(weights)])))
    ranked = sources.sparkSession.createDataFrame(ranked, "key string, source_size long, weight double")
    budget = float(rule.share) * float(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, cap = None, F.col("source_size") * F.lit(float(rule.most))
    while True:
        # sources whose cap is at or below the level are full
        full = (cap <= F.col("weight") * F.lit(level)) if level is not None else F.lit(False)
        spent, weight = ranked.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        ).first()
        new = (budget - spent) / weight if weight else float("inf")
        if level is not None and (new <= level or not weight):
            break
        level = new
        if not weight:
            break
    target = F.least(cap, F.col("weight") * F.lit(level)) if np.isfinite(level) else cap
    return ranked.select("key", "source_size", target.alias("target"))


def _sized(docs: DataFrame, rule: Mix, id_col: str, text_col: str, source_col: str, *more: str | Column) -> DataFrame:
    """doc_id, key, size, turn, bucket of every row; sources as keys that are never null: "=" and the name, or nothing."""
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    src = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), word_count(F.col(text_col).cast("string")).alias("size"), *more)
    src = src.withColumn("turn", F.xxhash64(F.lit(rule.seed), _name()))
    return src.withColumn("bucket", F.pmod("turn", F.lit(BUCKETS)).cast("int"))


def _name() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def _planned(docs: DataFrame, rule: Mix, id_col: str, text_col: str, source_col: str) -> tuple[Workspace, DataFrame, DataFrame, DataFrame]:
    """The sized rows, the sources' shares, and by source and length the whole rounds and how many documents go once more."""
    ws = Workspace(docs.sparkSession, "mix")
    sized = ws.keep(_sized(docs, rule, id_col, text_col, source_col), "sized")
    by_length = ws.keep(sized.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    sources = by_length.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    shares = ws.keep(_shares(ws.keep(sources, "sources"), rule), "shares")
    whole = F.when(F.col("source_size") > 0, F.floor(F.round("target", 6) / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    plan = by_length.join(shares.withColumn("rounds", whole), "key").select(
        "key", "size", "n", "rounds", (F.floor(F.round("target", 6)) - F.col("rounds") * F.col("source_size")).cast("long").alias("rest")
    )

    def extra(group: pd.DataFrame) -> pd.DataFrame:
        size, n = group["size"].to_numpy(), group["n"].to_numpy()
        chosen = np.zeros(len(group), np.int64)
        some = np.flatnonzero(size > 0)
        some = some[np.argsort(size[some])]
        chosen[some] = fit(size[some], n[some], int(group["rest"].iloc[0]), rule.table)
        return group.assign(extra=chosen)[["key", "size", "rounds", "extra"]]

    plan = ws.keep(plan.groupBy("key").applyInPandas(extra, "key string, size long, rounds int, extra long"), "plan")
    return ws, sized, plan, shares


def _by_bucket(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """By source, length and bucket: n documents, of which m go once more; the first by turn, bucket after bucket."""
    per = sized.groupBy("key", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(plan, ["key", "size"])
    return per.select("key", "size", "bucket", "rounds", "n", F.least(F.greatest(F.col("extra") - F.col("before"), F.lit(0)), F.col("n")).alias("m"))


def _turns(ws: Workspace, sized: DataFrame, plan: DataFrame, shares: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row with the copies that the mix holds of it."""
    rows = sized.join(_by_bucket(sized, plan), ["key", "size", "bucket"])
    rank = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("turn", _name()))
    parts = [
        rows.where("m = 0 or m = n").withColumn("more", F.col("m") > 0),
        rows.where("m > 0 and m < n").withColumn("more", rank <= F.col("m")),
    ]
    rows = parts[0].unionByName(parts[1]).withColumn("copies", F.col("rounds") + F.col("more").cast("int"))
    return rows, shares


def _cuts(ws: Workspace, sized: DataFrame, plan: DataFrame) -> DataFrame:
    """By source and length: rounds, and the place (bucket, turn, name) up to which documents go once more.

    Of the ``same`` rows at that place itself ``among`` go; the place of a whole bucket has no turn.
    """
    per = ws.keep(_by_bucket(sized, plan).where("m > 0"), "per")
    last = per.groupBy("key", "size").agg(F.max(F.struct("bucket", "m", "n")).alias("l")).select("key", "size", "l.*")
    part = last.where("m < n").select("key", "size", "bucket", "m")
    rows = sized.join(part, ["key", "size", "bucket"]).select("key", "size", "bucket", "m", "turn", _name().alias("name"))
    # rows alike are one entry with a count, so the place is found on distinct ids
    alike = rows.groupBy("key", "size", "bucket", "m", "turn", "name").agg(F.count(F.lit(1)).alias("same"))
    running = F.sum("same").over(Window.partitionBy("key", "size", "bucket").orderBy("turn", "name"))
    alike = alike.withColumn("upto", running).where((F.col("upto") >= F.col("m")) & (F.col("upto") - F.col("same") < F.col("m")))
    at = alike.select("key", "size", "turn", "name", "same", (F.col("m") - F.col("upto") + F.col("same")).alias("among"))
    cuts = plan.select("key", "size", "rounds").join(last.select("key", "size", F.col("bucket").alias("cut_bucket")), ["key", "size"], "left")
    return ws.keep(cuts.join(at.withColumnsRenamed({"turn": "cut_turn", "name": "cut_name"}), ["key", "size"], "left"), "cuts")


def mix(docs: DataFrame, rule: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken, copies.

    ``copies`` says how often the mix holds the document, ``taken`` how many words
    that makes; it is at most ``rule.most`` rounds.  A null source is a source of its
    own, the last in order; a null text has no words and is never taken.  Null and
    repeated ids are allowed: rows alike in id, size and source get their turns
    in an order that only they share.  The same rows give the same mix on every run.
    """
    rows, shares = _turns(*_planned(docs, rule, id_col, text_col, source_col))
    out = rows.join(shares, "key")
    return out.select(
        "doc_id", F.when(F.col("key") != "", F.expr("substring(key, 2)")).alias("source"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies",
    )


def mixed(docs: DataFrame, rule: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the documents' rows and columns, each row as often as the mix holds it."""
    ws, sized, plan, _ = _planned(docs, rule, id_col, text_col, source_col)
    cuts = _cuts(ws, sized, plan)
    # a row tells by itself whether it goes once more: the documents are not shuffled
    small = (cuts.agg(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("cut_name"), F.lit(0)) + F.lit(64))).first()[0] or 0) <= BROADCAST_BYTES
    wrapped = docs.select(F.struct("*").alias("__row"))
    part = lambda c: F.col("__row").getField(c)
    rows = wrapped.select("__row", part(id_col).alias("__id"), part(text_col).alias("__text"), part(source_col).alias("__source"))
    rows = _sized(rows, rule, "__id", "__text", "__source", "__row").join(F.broadcast(cuts) if small else cuts, ["key", "size"])
    at, cut = F.struct("turn", _name()), F.struct("cut_turn", "cut_name")
    more = (
        F.when(F.col("cut_bucket").isNull() | (F.col("bucket") > F.col("cut_bucket")), 0)
        .when((F.col("bucket") < F.col("cut_bucket")) | F.col("cut_turn").isNull() | (at < cut), 1)
        .when(at == cut, F.when(F.col("same") == F.col("among"), 1))  # else some of these rows: null
        .otherwise(0)
    )
    rows = rows.withColumn("more", more)
    out = rows.where("more is not null").select("__row", (F.col("rounds") + F.col("more")).alias("copies"))
    if cuts.where("same > among").limit(1).count():  # rows alike take their turns by their texts
        text = F.col("__row").getField(text_col).cast("string")
        rank = F.row_number().over(Window.partitionBy("key", "size").orderBy(F.xxhash64(text), text))
        some = rows.where("more is null").withColumn("more", (rank <= F.col("among")).cast("int"))
        out = out.unionByName(some.select("__row", (F.col("rounds") + F.col("more")).alias("copies")))
    return out.where("copies > 0").select("__row", F.explode(F.expr("sequence(1, copies)")).alias("__turn")).select("__row.*")
