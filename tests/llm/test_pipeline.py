"""The pipeline over the smallest tables, stage by stage."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from tessera.llm.jaccard import jaccard_components

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="needs the given tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names = docs.columns
    kept = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, D)
        out.write.parquet(f"file://{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"file://{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == names
            assert docs.join(before, names, "left_semi").count() == docs.count()
            kept.append(docs.count())
        if i == 2:
            assert jaccard_components(docs, 5, 80).where("doc_id != component_id").isEmpty()
    assert sorted(kept, reverse=True) == kept
    assert kept[-1] > 0.5 * kept[0]
    assert docs.select("doc_id").distinct().count() == kept[-1]


def test_clashing_columns(spark):
    """Input columns named as the stages' own keep their values, and rows without an id are judged too."""
    docs = spark.read.parquet(f"{D}/documents.parquet").selectExpr("*", "'mine' quality_score", "'mine' toxic_score", "1 stats", "2 component_id")
    odd = docs.limit(3)
    docs = docs.union(odd).union(odd.selectExpr("cast(null as long)", *docs.columns[1:]))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.select("quality_score", "toxic_score", "stats", "component_id").distinct().collect()} == {("mine", "mine", 1, 2)}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), D).count() == 0
