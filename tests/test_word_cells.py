"""Blocks of words against all candidates, and how many rows leave them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kinloom.operators import blocking
from tests.test_cells import frames, plain


@pytest.mark.parametrize("rows", [2_000, 7])
def test_blocks_of_words_find_the_best_of_all_candidates(spark, monkeypatch, rows):
    monkeypatch.setattr(blocking.WordCell, "ROWS", rows)
    sides, q, t = frames(spark, 1)
    sides = {k: [(i, "x", h) for i, co, h in v if co in "xy"] for k, v in sides.items()}
    q, t = (x.where("co IN ('x', 'y')").withColumn("co", F.lit("x")) for x in (q, t))
    got = {(r.tid, r.qid): r.score for r in blocking.best_by_words(t, q, blocking.field_idf(q, t, 4), 3).collect()}
    want = {key: x[-1] for key, x in plain(sides, 1, 4, 3).items()}
    assert got.keys() == want.keys() and len(want) > 50
    assert got == pytest.approx(want, abs=1.5e-6)
