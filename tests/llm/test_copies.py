"""Copies among rows with repeated ids and rows without."""

from __future__ import annotations

import corpus_pipeline


def test_each_group_keeps_one_row_whatever_its_ids(spark, tmp_path):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(20)) for x in "abcd")
    rows = [(1, a), (1, b), (2, a), (3, b), (None, c), (None, c), (None, d), (4, d), (None, ""), (None, None), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.drop_copies(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(1, a), (1, b), (None, c), (4, d), (None, ""), (None, None), (5, None)], key=repr)
