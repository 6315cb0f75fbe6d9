"""The best of all references by sets of tokens against all pairs, however common the tokens are."""

from __future__ import annotations

import math
import random

import pytest

from kinloom.operators import blocking


@pytest.mark.parametrize("longest", [8, 2, 0])
def test_best_by_sets_are_those_of_all_pairs(spark, longest):
    r = random.Random(2)

    def rows(n, first):
        return {first + i: {f"w{min(40, int(r.paretovariate(0.5)))}" for _ in range(r.randint(1, 5))} for i in range(n)}

    refs, targets = rows(150, 0), rows(200, 1000) | {5000: {"only here"}, 5001: {"w1"}}
    q, t = (spark.createDataFrame([(i, w) for i, x in v.items() for w in x], f"{c} long, token string") for v, c in ((refs, "qid"), (targets, "tid")))
    df = {}
    for x in refs.values():
        for w in x:
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(151 / (n + 1)) + 1 for w, n in df.items()}
    norm = lambda x: math.sqrt(sum(idf[w] ** 2 for w in x if w in idf))
    want = {}
    for i, x in targets.items():
        scores = [(-round(sum(idf[w] ** 2 for w in x & y) / norm(x) / norm(y), 6), j) for j, y in refs.items() if x & y]
        want |= {(i, j): -s for s, j in sorted(scores)[:5]}
    got = blocking.best_by_sets(t, q, blocking.smoothed_idf(q, "qid").select("token", "idf"), 5, longest)
    got = {(x.tid, x.qid): x.score for x in got.collect()}
    assert got.keys() == want.keys() and len(want) > 900
    assert got == pytest.approx(want, abs=1.5e-6)


def test_common_words_make_candidates_of_the_recall():
    from kinloom.plans import catalogue

    assert "makes" not in catalogue.oracle_sql()["block_recall_at_k"] and "2000" not in catalogue.oracle_sql()["block_recall_at_k"]
