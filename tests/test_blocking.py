"""Best references by cosine against the plain join of all candidates."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.operators import blocking, compete


@pytest.mark.parametrize("block", [50_000, 7])
def test_best_by_cosine_equals_the_join(spark, block):
    rng = np.random.default_rng(3)

    def rows(n):
        return [(i, f"w{t}", float(w)) for i in range(n) for t, w in zip(rng.choice(40, 6, replace=False), rng.choice([0.25, 0.5, 0.125], 6), strict=True)]

    q = spark.createDataFrame(rows(90), "qid long, token string, w double")
    t = spark.createDataFrame(rows(150) + [(900, "other", 1.0), (901, "w1", 1.0)], "tid long, token string, w double")
    makers = q.select("token").distinct().where("token NOT IN ('w1', 'w2', 'w3')")
    want = compete.top_k(blocking.cosine_all_tokens(t, q, makers), "tid", 4, F.desc("score"), F.asc("qid"))
    got = blocking.best_by_cosine(t, q, makers, 4, block)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select("tid", "qid", "score").collect())) == Counter(map(tuple, want.select("tid", "qid", "score").collect()))


def test_only_the_best_of_each_token_move(spark, monkeypatch):
    q = spark.range(400).selectExpr("id AS qid", "'w' AS token", "1D AS w")
    t = spark.range(500).selectExpr("id AS tid", "'w' AS token", "1D AS w")
    seen = []
    monkeypatch.setattr(compete, "top_k", lambda df, *a: seen.append(df.count()) or df)
    blocking.best_by_cosine(t, q, q.select("token").distinct(), 3).count()
    assert seen == [1500]
