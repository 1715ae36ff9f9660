"""The corpus pipeline, stage by stage, against what its operators promise."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
from oriel.llm import hyperminhash, quality
from tokenizers import Tokenizer

from .helpers import corpus

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = seen["quality_rules"]
    kept = {r.doc_id for r in quality.judge(quality.ledger(before)).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept
    before, after = seen["line_dedup"]
    assert after.count() <= before.count() and all(r.n_chars == len(r.text) for r in after.collect())
    before, after = seen["near_dedup"]
    groups = hyperminhash.near_duplicates(before, hyperminhash.NearDup(5, 80)).collect()
    assert {r.doc_id for r in after.collect()} == {r.component_id for r in groups}
    before, after = seen["mix_sources"]
    copies = Counter(r.doc_id for r in after.collect())
    assert max(copies.values()) <= 2 and set(copies) <= {r.doc_id for r in before.collect()}
    before, after = seen["best_fit_packing"]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect())
    got = after.collect()
    assert sum(r.length for r in got) == tokens
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096 and len(fill) <= -(-tokens // 4096) * 1.1 + 1


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns[:3] == ["doc_id", "piece", "start"]


def test_stages_bear_awkward_rows(spark):
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in corpus()] + [(None, "a row without an id and many other words " * 9, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema) if name != "best_fit_packing" else stage(spark, docs, SF)
        assert docs.columns[:3] == ["doc_id", "piece", "start"]
        docs.collect()
