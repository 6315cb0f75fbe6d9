"""Transfer, repair and strict reading, against plain versions and injected faults."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.functions import records
from kinloom.operators import adapt, decide, evidence, repair
from kinloom.plans import resolution
from kinloom.sources import files


def expected(p, k):
    """Expected F0.5 of the first k by enumeration of all outcomes."""
    total = 0.0
    for right in itertools.product((0, 1), repeat=len(p)):
        w = np.prod([x if r else 1 - x for x, r in zip(p, right, strict=True)])
        deg, tp = sum(right), sum(right[:k])
        total += w * ((k == 0) if deg == 0 else 5 * tp / (4 * k + deg) if tp else 0.0)
    return total


def test_prefixes_are_exact_at_any_length():
    rng = np.random.default_rng(1)
    for _ in range(30):
        p = np.sort(rng.random(rng.integers(1, 9)))[::-1].tolist()
        utility = [expected(p, k) for k in range(len(p) + 1)]
        assert utility[decide.prefix_utility(p)] == pytest.approx(max(utility))
        assert decide.prefix_utility(p, 0.5) <= sum(x >= 0.5 for x in p)
    many = np.sort(rng.random(90))[::-1].tolist()
    trials = rng.random((20_000, 90)) < np.array(many)
    mean = [np.where(trials.any(1), 5 * trials[:, :k].sum(1) / np.maximum(4 * k + trials.sum(1), 1), k == 0).mean() for k in range(91)]
    assert mean[decide.prefix_utility(many)] == pytest.approx(max(mean), abs=2e-3)


def test_strict_reader_names_what_is_wrong(spark, tmp_path):
    good = "a\tb\n1\t\n2\tx\n"
    (tmp_path / "1.tsv").write_text(good)
    assert sorted(map(tuple, files.read_tsv(spark, f"{tmp_path}/1.tsv", ["a", "b"]).collect())) == [("1", ""), ("2", "x")]
    for bad, what in (("a\tb\n1\n", "fields"), ("a\tb\n1\t2\t3\n", "fields"), ("b\ta\n1\t2\n", "header")):
        (tmp_path / "2.tsv").write_text(bad)
        with pytest.raises(ValueError, match=what):
            files.read_tsv(spark, f"{tmp_path}/*.tsv", ["a", "b"])


def test_label_shift_finds_the_share(spark):
    rng = np.random.default_rng(0)

    def rows(co, n, share):
        y = rng.random(n) < share
        p = np.clip(np.where(y, rng.normal(0.8, 0.1, n), rng.normal(0.35, 0.1, n)), 0.01, 0.99)
        return [(co, float(a), int(b)) for a, b in zip(p, y, strict=True)]

    source = spark.createDataFrame(rows("s", 4000, 0.5), "co string, p double, y int")
    target = spark.createDataFrame(rows("t", 4000, 0.2), "co string, p double, y int")
    out = adapt.label_shift(source, target.drop("y"), adapt.logit_edges(0.1, 0.9, 15))
    assert out["t"]["share"] == pytest.approx(0.2, abs=0.03) and out["t"]["distance"] > 0.9


def test_curves_rise_and_low_scores_never_gain(spark):
    source, target = resolution.split_by_country(spark, "/root/testdata/sf0.001")
    curves = adapt.density_transfer(source, target, resolution.EDGES, 50)
    assert set(curves) == {r.co for r in target.select("co").distinct().collect()}
    assert all(a <= b + 1e-12 for v in curves.values() for a, b in itertools.pairwise(v)) and all(0 <= x <= 1 for v in curves.values() for x in v)
    low = target.limit(1).select(F.lit(0.01).alias("p"), "co").withColumn("q", adapt.apply_curve(F.col("p"), F.col("co"), curves, resolution.EDGES, 0.02)).first()
    assert low.q <= low.p


def test_weights_have_a_mean_of_one(spark):
    got = resolution.domain_weights(spark, "/root/testdata/sf0.001").agg(F.avg("weight"), F.min("weight"), F.max("weight")).first()
    assert got[0] == pytest.approx(1, abs=0.02) and got[1] >= 0.2 and got[2] <= 5


def test_splitmix(spark):
    def plain(x):
        z = (x + 0x9E3779B97F4A7C15) % 2**64
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        return z ^ z >> 31

    ids = [0, 1, 2**40, -1, -(2**63)]
    got = spark.createDataFrame([(i,) for i in ids], "x long").select("x", records.splitmix(F.col("x")).alias("z")).collect()
    assert {r.x: r.z % 2**64 for r in got} == {i: plain(i % 2**64) for i in ids}


def test_own_swaps_are_left_out(spark):
    swaps = spark.createDataFrame([(1, 10, "a", "b"), (1, 11, "a", "b"), (2, 12, "a", "b"), (2, 13, "b", "a")], "qid long, tid long, old string, new string")
    got = {r.tid: (r.forward, r.backward) for r in evidence.swap_support_without_owner(swaps, "qid").collect()}
    assert got == {10: (1, 1), 11: (1, 1), 12: (2, 0), 13: (0, 2)}


def test_ambiguous_proposals_are_left_out(spark):
    proposals = spark.createDataFrame([(1, 5, 1), (1, 6, 1), (2, 5, 2), (2, 7, 1), (3, 8, 1)], "tid long, qid long, rank int")
    current = spark.createDataFrame([(2, 5), (3, 8)], "tid long, qid long")
    got = {r.tid: (r.qid, r.action) for r in repair.repair_actions(proposals, current).collect()}
    assert got == {2: (7, "move"), 3: (8, "same")}
