"""Decisions: score blends, thresholds, expected-F sets, action policies, metrics, calibration."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.operators import compete


def logit(p: Column, floor: float = 1e-6) -> Column:
    return F.ln(compete.odds(p, floor))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit_blend(a: Column, b: Column, weight: float) -> Column:
    """Mean of the log odds with this weight of a."""
    return sigmoid(weight * logit(a) + (1 - weight) * logit(b))


def available_mean(scores: dict[str, float]) -> Column:
    """Weighted mean of the scores that are there; null if none is."""
    total = sum(((F.coalesce(F.col(c), F.lit(0.0)) * w) for c, w in scores.items()), F.lit(0.0))
    weight = sum((F.col(c).isNotNull().cast("double") * w for c, w in scores.items()), F.lit(0.0))
    return F.try_divide(total, weight)


def times_odds(p: Column, k: float) -> Column:
    return k * p / (k * p + 1 - p)


def selective(score: Column, gate: Column, low: float, high: float) -> Column:
    """The costly score where the gate is undecided, else the gate."""
    return F.when((gate >= low) & (gate <= high), score).otherwise(gate)


def country_cuts(winners: DataFrame, cuts: dict[str, float]) -> DataFrame:
    """Winners at or above their country's cut; a country without a cut is an error."""
    unknown = winners.where(~F.col("co").isin(*cuts)).select("co").first()
    if unknown:
        raise ValueError(f"no cut for {unknown.co}")
    cut = F.element_at(F.create_map(*[F.lit(x) for kv in cuts.items() for x in kv]), F.col("co"))
    return winners.where(F.col("p") >= cut)


def prefix_utility(p: list[float], floor: float = 0.0) -> int:
    """The number of first candidates with the greatest expected F0.5; the least on ties.

    p is in falling order; each candidate is right independently. Taking none is right when all are wrong. Candidates
    below the floor are never taken. The expectation is exact for any number of candidates.
    """
    n, p = len(p), np.asarray(p, np.float64)
    best, k_best = float(np.prod(1 - p)), 0
    rest = [np.ones(1)]  # distribution of the right ones among the last i candidates
    for x in p[::-1]:
        rest.append(np.convolve(rest[-1], [1 - x, x]))
    head = np.ones(1)
    for k, x in enumerate(p, 1):
        if x < floor:
            break
        head = np.convolve(head, [1 - x, x])
        h, m = np.arange(1, k + 1)[:, None], np.arange(n - k + 1)[None]
        u = float((head[1:, None] * (5 * h / (4 * k + h + m)) * rest[n - k][None]).sum())
        if u > best + 1e-12:
            best, k_best = u, k
    return k_best


def expected_f(pairs: DataFrame, floor: float = 0.0) -> DataFrame:
    """The accepted pairs: winners, and of each reference the first ones with the greatest expected F0.5."""

    @F.pandas_udf(T.IntegerType())
    def prefix_length(lists: pd.Series) -> pd.Series:
        return lists.map(lambda p: prefix_utility(p, floor))

    won = compete.winners(pairs)
    lists = won.groupBy("qid").agg(F.sort_array(F.collect_list("p"), False).alias("ps")).select("qid", prefix_length("ps").alias("k"))
    return compete.ranked(won.join(lists, "qid"), "qid", F.desc("p"), F.asc("tid"), name="_r").where("_r <= k").drop("_r", "k")


def f_half(tp: Column, n: Column, deg: Column) -> Column:
    """F0.5 of one reference; without true targets 1 if nothing was accepted, else 0."""
    return F.when(deg == 0, (n == 0).cast("double")).when(tp > 0, 1.25 * tp / (n + 0.25 * deg)).otherwise(0.0)


def macro(refs: DataFrame, accepted: DataFrame) -> DataFrame:
    """macro F0.5 over all references (qid, deg), precision and recall of accepted pairs (qid, y)."""
    own = accepted.groupBy("qid").agg(F.sum("y").alias("tp"), F.count("*").alias("n"))
    rows = refs.join(own, "qid", "left").na.fill(0, ["tp", "n"])
    return rows.agg(
        F.round(F.avg(f_half(F.col("tp"), F.col("n"), F.col("deg"))), 9).alias("f"),
        F.round(F.try_divide(F.sum("tp").cast("double"), F.sum("n").cast("double")), 9).alias("precision"),
        F.round(F.try_divide(F.sum("tp").cast("double"), F.sum("deg").cast("double")), 9).alias("recall"),
        F.count("*").alias("refs"),
    )


def threshold_curve(refs: DataFrame, won: DataFrame) -> DataFrame:
    """(p, f, tp, n): macro F0.5, hits and accepted pairs when all winners with at least this p are accepted.

    Each winner adds the change of its reference's F0.5; changes are summed for equal scores before they run on.
    """
    w = Window.partitionBy("qid").orderBy(F.desc("p"), "tid").rowsBetween(Window.unboundedPreceding, 0)
    rows = won.select("qid", "tid", "p", "y").join(refs.select("qid", "deg"), "qid")
    rows = rows.withColumn("tp", F.sum("y").over(w)).withColumn("n", F.count("*").over(w))
    after = f_half(F.col("tp"), F.col("n"), F.col("deg"))
    before = f_half(F.col("tp") - F.col("y"), F.col("n") - 1, F.col("deg"))
    steps = rows.groupBy("p").agg(F.sum(after - before).alias("d"), F.sum("y").alias("y"), F.count("*").alias("k"))
    base = refs.agg(F.sum((F.col("deg") == 0).cast("double")).alias("s"), F.count("*").alias("r")).first()
    run = compete.running(steps, "p", ["d", "y", "k"])
    return run.select(
        "p",
        F.round((F.lit(float(base.s or 0)) + F.col("d")) / max(1, base.r), 9).alias("f"),
        F.col("y").alias("tp"),
        F.col("k").alias("n"),
    )


def best_cut(curve: DataFrame, precision: float = 0.0) -> DataFrame:
    """The point of greatest macro F0.5, then precision, then threshold, among those precise enough; no row without one."""
    p = F.round(F.col("tp") / F.col("n"), 9)
    rows = curve.withColumn("precision", p).where(F.col("precision") >= precision)
    return rows.agg(F.max(F.struct("f", "precision", F.col("p").alias("cut"), "tp", "n")).alias("b")).where("b IS NOT NULL").select("b.*")


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of a share."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def remove_gain(tp: Column, n: Column, deg: Column, y: Column) -> Column:
    """Change of F0.5 when one accepted pair goes."""
    return f_half(tp - y, n - 1, deg) - f_half(tp, n, deg)


def add_gain(tp: Column, n: Column, deg: Column, y: Column) -> Column:
    """Change of F0.5 when one pair is added."""
    return f_half(tp + y, n + 1, deg) - f_half(tp, n, deg)


def switched(accepted: DataFrame, offers: DataFrame, least: float, margin: float) -> DataFrame:
    """accepted (tid, qid, p) with owners replaced by offers (tid, qid, p) that are sure and ahead enough."""
    best = compete.top_k(offers, "tid", 1, F.desc("p"), F.asc("qid")).select("tid", F.col("qid").alias("q2"), F.col("p").alias("p2"))
    rows = accepted.join(best, "tid", "left")
    go = F.coalesce((F.col("p2") >= least) & (F.col("p2") - F.col("p") >= margin) & (F.col("q2") != F.col("qid")), F.lit(False))
    return rows.select("tid", F.when(go, F.col("q2")).otherwise(F.col("qid")).alias("qid"), go.alias("moved"))


def additions(accepted: DataFrame, offers: DataFrame, least: float) -> DataFrame:
    """The best sure offer of each target that has no owner."""
    free = offers.where(F.col("p") >= least).join(accepted, "tid", "left_anti")
    return compete.top_k(free, "tid", 1, F.desc("p"), F.asc("qid"))


def bins(p: Column, edges: list[float]) -> Column:
    """The number of edges at or below the value, as a left-closed bin from 0 to len(edges)."""
    return sum((F.when(p >= e, 1).otherwise(0) for e in edges), F.lit(0))


def isotonic(values: list[float], weights: list[float]) -> list[float]:
    """Weighted rising fit by pooling neighbours; for a few bins on the driver."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools[-1]
            total = w1 + w2
            pools[-1] = [(v1 * w1 + v2 * w2) / total if total else (v1 + v2) / 2, total, n1 + n2]
    return [v for v, _, n in pools for _ in range(n)]


def interpolated(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear curve through the points, flat outside."""
    out = F.when(x <= xs[0], F.lit(ys[0]))
    for (x0, x1), (y0, y1) in zip(pairwise(xs), pairwise(ys), strict=True):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(ys[-1]))
