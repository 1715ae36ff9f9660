"""From raw documents to packed sequences: rules, lines, near duplicates, mix, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.llm import hyperminhash, linededup, mixing, packing, quality
from oriel.llm.common import Workspace, word_count


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy keeps."""
    return quality.keep_good(docs, "v1")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier place has; what has lost all its words goes."""
    out = linededup.line_dedup(docs, linededup.CORPUS)
    emptied = (F.col("__n_removed") > 0) & (word_count(F.col("text")) == 0)
    out = out.where(~emptied).drop("__n_removed", "__n_runs")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return hyperminhash.keep_first(docs, hyperminhash.NearDup(shingle=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it."""
    return mixing.mixed(docs, mixing.Mix())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    return packing.pack(docs, packing.Packing(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]
#: Token ids and the subset-sum program have no SQL form: tests/llm/test_pipeline_rows.py compares the rows of every
#: stage and of run() with plain Python on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's rows written before the next reads them."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = ws.keep(docs, name)
            if i:
                ws.drop(STAGES[i - 1][0])
    return docs
