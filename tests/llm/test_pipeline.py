from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from mediamill.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_registered():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names) and "pipeline" in entry.queries()


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    from test_text_operators import plain_hits

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10_000, None, None, None, None), (10_001, "", "en", "s", 0), (10_002, "password=7602ad27cf5550de1c", "en", "s", 27)], docs.schema)
    docs = docs.unionByName(odd)
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() <= before.count()
        if name == "minhash_near_dedup":
            texts = [r.text for r in docs.collect()]
            assert len({t for t in texts if t}) == len([t for t in texts if t])
        if name == "benchmark_decontamination":
            assert all(n == 0 for _, n, _ in plain_hits([r.text for r in docs.collect()], items))
            assert docs.count() == before.count()
        if name == "secret_scan":
            assert all("7602ad27cf5550de1c" not in (r.text or "") and r.n_chars == (None if r.text is None else len(r.text)) for r in docs.collect())
    rows = docs.collect()
    assert {10_000, 10_001, 10_002} <= {r.doc_id for r in rows} and all(r.n_tokens == len(r.ids) for r in rows)


def test_stages_on_odd_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    texts = [None, "", " ", "a b c d e f g", "a b c d e f g", "x " * 20_000]
    docs = spark.createDataFrame([(i, t, "en", "s", None, "e") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", None, "e")], schema)
    want = {"toxicity": [0, 1, 2, 3, 3, 4, 5], "minhash_near_dedup": [0, 1, 2, 3, 3, 5], "benchmark_decontamination": [0, 1, 2, 3, 3, 4, 5], "secret_scan": [0, 1, 2, 3, 3, 4, 5], "bpe_round_trip": [0, 1, 2, 3, 3, 4, 5]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe_round_trip":
            assert out.columns == docs.columns
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == want[name]
        assert stage(spark, docs.limit(0), SF).count() == 0
