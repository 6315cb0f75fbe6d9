"""Operators against enumeration, invariants and edge cases."""

from __future__ import annotations

from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinloom.functions import similarity, text
from kinloom.operators import compete, decide, graph, relational
from kinloom.plans.registry import Registry
from kinloom.plans.registry import settings as configured


def enumerated(p: list[float]) -> int:
    """The best prefix by all outcomes."""
    best, k_best = -1.0, 0
    for k in range(len(p) + 1):
        u = 0.0
        for outcome in product((0, 1), repeat=len(p)):
            chance = 1.0
            for x, y in zip(p, outcome, strict=True):
                chance *= x if y else 1 - x
            hits, deg = sum(outcome[:k]), sum(outcome)
            u += chance * ((1.0 if k == 0 else 0.0) if deg == 0 else 1.25 * hits / (k + 0.25 * deg))
        if u > best + 1e-12:
            best, k_best = u, k
    return k_best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=6))
def test_expected_f_is_the_best_of_all_outcomes(p):
    p = sorted(p, reverse=True)
    assert decide.prefix_utility(p) == enumerated(p)


def subsequence_brute(a: str, b: str) -> int:
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcé ", max_size=12), st.text("abcé ", max_size=12))
def test_common_subsequence(a, b):
    assert similarity.common_subsequence(a, b) == subsequence_brute(a, b)
    assert similarity.indel(a, b) == similarity.indel(b, a)
    assert 0 <= similarity.partial(a, b) <= 100


def test_ratio_edges():
    assert similarity.indel("", "") == 100 and similarity.token_set("", "x") == 0
    assert similarity.token_set("acme inc", "acme inc london") == 100
    assert similarity.token_sort("a b", "b a") == 100
    assert similarity.subsequence("ace", "abcde") and not similarity.subsequence("aec", "abcde")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.floats(0.1, 5)), min_size=1, max_size=12))
def test_isotonic_rises_and_keeps_the_mean(points):
    v, w = zip(*points, strict=True)
    fit = decide.isotonic(list(v), list(w))
    assert all(a <= b + 1e-12 for a, b in zip(fit, fit[1:], strict=False))
    assert sum(a * b for a, b in zip(fit, w, strict=True)) == pytest.approx(sum(a * b for a, b in zip(v, w, strict=True)))


def test_ownership_sums_to_one_and_order_does_not_matter(spark):
    rows = [(t, q, (t * 7 + q * 3) % 10 / 10) for t in range(20) for q in range(4)]
    a = spark.createDataFrame(rows, "tid long, qid long, p double")
    b = spark.createDataFrame(rows[::-1], a.schema)
    out = compete.ownership(a, "tid", "p")
    total = out.groupBy("tid").agg((F.sum("prior") + F.max("outside")).alias("s"))
    assert total.where("abs(s - 1) > 1e-9").isEmpty()
    assert sorted(compete.winners(a.withColumn("raw", F.lit(0.0))).collect()) == sorted(compete.winners(b.withColumn("raw", F.lit(0.0))).collect())


def test_winner_ties_go_to_raw_then_smaller_id(spark):
    rows = [(0, 0, 0.7, 0.8), (1, 0, 0.7, 0.9), (2, 1, 0.99, 0.99), (5, 1, 0.99, 0.99)]
    won = compete.winners(spark.createDataFrame(rows, "qid long, tid long, p double, raw double"))
    assert {(r.qid, r.tid) for r in won.collect()} == {(1, 0), (2, 1)}


def test_messages_reinforce_and_an_edge_does_not_echo(spark):
    pairs = spark.createDataFrame([(1, 1, 0.95), (2, 1, 0.95), (3, 1, 0.5)], "tid long, qid long, p double")
    edges = spark.createDataFrame([(1, 3, 1.0), (3, 1, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "src long, dst long, weight double")
    with_edges = {r.tid: r.posterior for r in graph.propagate(pairs, edges).collect()}
    without = {r.tid: r.posterior for r in graph.propagate(pairs, edges.limit(0)).collect()}
    assert with_edges[3] > without[3]
    lone = spark.createDataFrame([(1, 1, 0.95)], pairs.schema)
    one = spark.createDataFrame([(1, 9, 1.0)], edges.schema)
    assert graph.propagate(lone, one).first().posterior == pytest.approx(graph.propagate(lone, one.limit(0)).first().posterior)


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "src long, dst long")
    got = {r.id: r.component for r in graph.components(chain).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_zero_degree_references_stay_in_the_mean(spark):
    refs = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "qid long, deg int")
    accepted = spark.createDataFrame([(2, 1), (3, 0)], "qid long, y int")
    assert decide.macro(refs, accepted).first().f == pytest.approx((1 + 1 + 0) / 3)


def test_unknown_country_is_an_error(spark):
    with pytest.raises(ValueError, match="xx"):
        decide.country_cuts(spark.createDataFrame([("xx", 0.9)], "co string, p double"), {"de": 0.5})


def test_declared_cardinality(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b")], "k int, x string")
    assert relational.joined(left, left.limit(1).select("k"), ["k"]).count() == 2
    with pytest.raises(ValueError, match="share"):
        relational.joined(left, left, ["k"])


def test_text_edges(spark):
    rows = spark.createDataFrame([("000 main", "phth"), ("", "aei"), ("12-14 x", "a1"), (None, None)], "ad string, w string")
    got = rows.select(text.house(F.col("ad")), text.skeleton(F.col("w")), text.house_range(F.col("ad"), 2), text.basic(F.col("ad"))).collect()
    assert [tuple(r) for r in got] == [("0", "ft", None, "000 main"), ("", "a", None, ""), ("12", "1", 14, "12 14 x"), (None, None, None, None)]
    folded = rows.limit(1).select(text.folded(F.lit("École, S.A.S.")), text.basic(text.compatible(F.lit("ＡＢ　ß")))).first()
    assert tuple(folded) == ("ecole s a s", "ab ss")


def test_registry_and_settings():
    parts = Registry()
    parts.register("a")(len)
    with pytest.raises(ValueError, match="taken"):
        parts.register("a")(len)
    with pytest.raises(KeyError, match="expected"):
        parts["b"]
    named = {"base": {"k": {"x": 1, "y": 2}}, "own": {"extends": "base", "k": {"y": 3}}, "new": {"extends": "base", "k": {"_replace": True, "z": 1}}}
    assert configured(named, "own", k__x=9) == {"k": {"x": 9, "y": 3}}
    assert configured(named, "new") == {"k": {"z": 1}}
    assert named["base"]["k"] == {"x": 1, "y": 2}
