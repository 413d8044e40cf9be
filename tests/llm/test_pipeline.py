"""The pipeline stage by stage, and its behaviour on empty tables."""

import pytest

pytest.importorskip("veldspar.llm.registry")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "benchmark_free", "mixture", "shards"]
    from veldspar.llm._store import materialize

    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), "test")
        seen[name] = out.count()
        if name != "shards":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        docs = out
    assert 0.9 * n <= seen["language"] <= n
    assert seen["near_copies"] < seen["language"] and seen["benchmark_free"] <= seen["near_copies"]
    assert seen["shards"] == seen["mixture"] > 0


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
