"""What the pipeline holds in memory where it finds rows by key."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tests.test_queries import SF


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_copies, corpus_pipeline.drop_leaks])
def test_texts_are_not_sorted_to_find_rows(spark, tmp_path, stage):
    rows = [(i, " ".join(f"{i}w{k}" for k in range(20)), "en", "x", 0) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), SF)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin [key" not in plan and "ShuffledHashJoin [key" in plan
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == list(range(40))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
