"""Similarity graphs: confident seeds, mutual nearest neighbours, messages, components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators import compete


def seeds(pairs: DataFrame, least: float, lead: float) -> DataFrame:
    """(tid, qid): the best candidate of a target, if it is sure and well ahead of the second."""
    out = compete.margin_to_other(pairs, "tid", "p", "qid", 0.0)
    return out.where((F.col("p") >= least) & (F.col("margin") >= lead)).select("tid", "qid")


def mutual_neighbours(edges: DataFrame, k: int) -> DataFrame:
    """Directed edges (src, dst, weight) that are among the k strongest of both ends."""
    near = compete.top_k(edges, "src", k, F.desc("weight"), F.asc("dst"))
    return near.join(near.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi")


def block_edges(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Directed edges between rows (id, source, tokens) of a block: different sources, weight = Jaccard of tokens.

    A block of more than ``most`` rows makes no edges: that bound belongs to the operator.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select(key)
    own = rows.join(sizes, key)
    other = own.select(key, F.col("id").alias("dst"), F.col("source").alias("s2"), F.col("tokens").alias("t2"))
    pairs = own.join(other, key).where("source <> s2")
    both = F.size(F.array_intersect("tokens", "t2"))
    return pairs.select(F.col("id").alias("src"), "dst", F.round(both / (F.size("tokens") + F.size("t2") - both), 6).alias("weight"))


def summed(messages: DataFrame, by: str, clip: float) -> DataFrame:
    """Signals, weights, neighbours and original seeds that arrive at by, for each owner."""
    logit = F.greatest(F.lit(-clip), F.least(F.lit(clip), F.ln(compete.odds(F.col("message"), 1e-5))))
    return messages.groupBy(by, "qid").agg(
        F.sum(logit * F.col("weight")).alias("signal"), F.sum("weight").alias("heavy"), F.count("*").alias("n"), F.sum("seed").alias("seeds")
    )


def shifted(signal: Column, heavy: Column, n: Column, seeds: Column, most: float) -> Column:
    """Weighted mean within +-most; 0 with fewer than two neighbours, and if positive with fewer than two seeds."""
    mean = signal / F.greatest(heavy, F.lit(1e-9))
    return F.when((n >= 2) & ((mean <= 0) | (seeds >= 2)), F.greatest(F.lit(-most), F.least(F.lit(most), mean))).otherwise(0.0)


def propagate(
    pairs: DataFrame, edges: DataFrame, rounds: int = 3, strength: float = 0.8, damping: float = 0.35, clip: float = 3.0,
    most: float = 2.0, sure: float = 0.8,
) -> DataFrame:
    """Ownership after messages along edges; each message leaves out what came back over its own edge.

    pairs: (tid, qid, p). A message over src to dst is src's share of an owner, at first that of p; a round moves
    it, damped, towards the share after what src's other neighbours say. They say the weighted mean of their log
    odds, each within +-clip and the mean within +-most; fewer than two neighbours say nothing, and nothing in
    favour unless two of them were sure at the start. All owners of a target send; checkpoints cut lineage. Returns (tid, qid, prior,
    posterior, outside); posteriors of a target and the mass outside sum to 1.
    """
    base = compete.ownership(pairs.select("tid", "qid", "p"), "tid", "p").select("tid", "qid", compete.odds(F.col("p")).alias("odds"), F.col("prior").alias("share")).checkpoint()
    first = base.withColumnRenamed("tid", "src")
    messages = edges.select("src", "dst", "weight").join(first, "src").select(
        "src", "dst", "qid", "weight", "odds", F.col("share").alias("message"), (F.col("share") >= sure).cast("long").alias("seed")
    ).checkpoint()
    sums = ("signal", "heavy", "n", "seeds")
    for _ in range(rounds):
        incoming = summed(messages, "dst", clip).withColumnRenamed("dst", "src")
        back = summed(messages.withColumn("edge", F.struct("src", "dst")), "edge", clip)
        back = back.select(F.col("edge.dst").alias("src"), F.col("edge.src").alias("dst"), "qid", *[F.col(c).alias(f"own_{c}") for c in sums])
        out = messages.join(incoming, ["src", "qid"], "left").join(back, ["src", "dst", "qid"], "left").na.fill(0, [*sums, *[f"own_{c}" for c in sums]])
        moved = F.col("odds") * F.exp(strength * shifted(*[F.col(c) - F.col(f"own_{c}") for c in sums], most))
        out = out.withColumn("moved", moved)
        share = F.col("moved") / (1 + F.sum("moved").over(Window.partitionBy("src", "dst")))
        messages = out.select("src", "dst", "qid", "weight", "odds", ((1 - damping) * F.col("message") + damping * share).alias("message"), "seed").checkpoint()
    incoming = summed(messages, "dst", clip).withColumnRenamed("dst", "tid")
    out = base.join(incoming, ["tid", "qid"], "left").na.fill(0, [*sums])
    after = F.col("odds") * F.exp(damping * strength * shifted(*map(F.col, sums), most))
    out = out.select("tid", "qid", (F.col("odds") / (1 + F.col("odds"))).alias("start"), (after / (1 + after)).alias("p"))
    return compete.ownership(out, "tid", "p").select("tid", "qid", F.col("start").alias("prior"), F.col("prior").alias("posterior"), "outside")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable over edges (src, dst), by labels that jump to their label's label.

    Lineage is cut by a checkpoint in the folder that all executors share.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    labels = both.groupBy(F.col("src").alias("id")).agg(F.least(F.col("id"), F.min("dst")).alias("component"))
    while True:
        beside = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        joined = labels.join(beside, "id").join(jump, "component")
        after = joined.select("id", "component", F.least("near", "far").alias("next")).checkpoint()
        labels = after.select("id", F.col("next").alias("component"))
        if after.where("next < component").isEmpty():
            return labels


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
