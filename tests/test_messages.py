"""Messages between targets: the cases of the reference's graph."""

from __future__ import annotations

import pytest

from kinloom.operators import graph


def posteriors(spark, p, links):
    """(posterior, outside) of each (tid, qid); p: (tid, qid) to p, links both ways."""
    pairs = spark.createDataFrame([(*k, x) for k, x in p.items()], "tid long, qid long, p double")
    edges = spark.createDataFrame([(x, y, 1.0) for a, b in links for x, y in ((a, b), (b, a))], "src long, dst long, weight double")
    return {(r.tid, r.qid): (r.posterior, r.outside) for r in graph.propagate(pairs, edges).collect()}


def test_two_seeds_reinforce_and_no_edge_echoes(spark):
    got = posteriors(spark, {(0, 7): 0.3, (1, 7): 0.98, (2, 7): 0.98}, [(0, 1), (0, 2)])
    # Both say 3, the mean is cut at 2: odds of 3/7 times exp(0.35 * 0.8 * 2).
    assert got[0, 7][0] == pytest.approx(1 - 1 / (1 + 3 / 7 * 2.718281828459045**0.56))
    assert got[1, 7][0] == got[2, 7][0] == pytest.approx(0.98)


def test_a_single_seed_or_neighbour_raises_nothing(spark):
    p = {(0, 7): 0.99, (1, 7): 0.4, (2, 7): 0.4, (3, 7): 0.4, (4, 7): 0.4}
    got = posteriors(spark, p, [(0, 1), (1, 2), (1, 3), (2, 4), (3, 4)])
    assert all(got[k][0] <= p[k] + 1e-12 for k in p)
    one = posteriors(spark, {(0, 7): 0.99, (1, 7): 0.4}, [(0, 1)])
    assert one[1, 7][0] == pytest.approx(0.4)


def test_neighbours_against_raise_the_mass_outside(spark):
    got = posteriors(spark, {(0, 7): 0.8, (1, 7): 0.08, (2, 7): 0.08, (0, 9): 0.2}, [(0, 1), (0, 2)])
    assert got[0, 7][1] > 1 / (1 + 4 + 0.25) and got[0, 7][0] < 4 / 5.25
    assert got[0, 7][0] + got[0, 9][0] + got[0, 7][1] == pytest.approx(1)
