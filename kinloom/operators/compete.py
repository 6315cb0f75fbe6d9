"""Competition between candidates: ranks, gaps, margins, odds and entropy, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: str | list[str], *order: Column, name: str = "rank") -> DataFrame:
    """Place from 1 within the group; the order must end with an id, so that ties have one answer."""
    keys = [by] if isinstance(by, str) else by
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_k(df: DataFrame, by: str | list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group."""
    return ranked(df, by, *order, name="_rank").where(F.col("_rank") <= k).drop("_rank")


def winners(pairs: DataFrame) -> DataFrame:
    """Best candidate of each target: probability, then raw score, then smallest reference."""
    return top_k(pairs, "tid", 1, F.desc("p"), F.desc("raw"), F.asc("qid"))


def context(df: DataFrame, by: str, score: str, key: str) -> DataFrame:
    """n (candidates), best, gap to it, place, and place by value alone (ties share the least)."""
    w = Window.partitionBy(by)
    return (
        df.withColumn("n", F.count("*").over(w))
        .withColumn("best", F.max(score).over(w))
        .withColumn("gap", F.col("best") - F.col(score))
        .withColumn("place", F.row_number().over(w.orderBy(F.desc(score), key)))
        .withColumn("shared_place", F.rank().over(w.orderBy(F.desc(score))))
    )


def margin_to_other(df: DataFrame, by: str, score: str, key: str, alone: float) -> DataFrame:
    """Score less the best score of any other row of the group; a single row is compared with alone."""
    w = Window.partitionBy(by)
    out = df.withColumn("_r", F.row_number().over(w.orderBy(F.desc(score), key)))
    first = F.max(F.when(F.col("_r") == 1, F.col(score))).over(w)
    second = F.coalesce(F.max(F.when(F.col("_r") == 2, F.col(score))).over(w), F.lit(alone))
    return out.withColumn("margin", F.col(score) - F.when(F.col("_r") == 1, second).otherwise(first)).drop("_r")


def near_ties(df: DataFrame, by: str, score: str, within: float) -> DataFrame:
    """How many rows of the group are within so much of its best."""
    w = Window.partitionBy(by)
    out = df.withColumn("_best", F.max(score).over(w))
    return out.withColumn("ties", F.sum((F.col(score) >= F.col("_best") - within).cast("long")).over(w)).drop("_best")


def leave_one_out(df: DataFrame, by: str, value: str) -> DataFrame:
    """Sum of the group without the row itself."""
    return df.withColumn("others", F.sum(value).over(Window.partitionBy(by)) - F.col(value))


def odds(p: Column, floor: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(floor)), F.lit(1 - floor))
    return q / (1 - q)


def ownership(df: DataFrame, by: str, score: str) -> DataFrame:
    """Share of each candidate against the others and an owner outside the list (odds 1), and that one's share."""
    o = odds(F.col(score))
    total = F.lit(1.0) + F.sum(o).over(Window.partitionBy(by))
    return df.withColumn("prior", o / total).withColumn("outside", 1 / total)


def entropy(df: DataFrame, by: str) -> DataFrame:
    """Entropy of a group's priors with the mass outside."""
    def term(x: Column) -> Column:
        return F.when(x > 0, -x * F.ln(x)).otherwise(0.0)

    return df.withColumn("entropy", F.sum(term(F.col("prior"))).over(Window.partitionBy(by)) + term(F.col("outside")))


def within_budget(df: DataFrame, cost: str, budget: float, *order: Column, by: list[str] | None = None) -> DataFrame:
    """Rows in order as long as the sum of their cost stays within the budget (of each group, if given)."""
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def adaptive(df: DataFrame, by: str, score: str, key: str, floor: float, k: int) -> DataFrame:
    """The best row of each group, and the next ones with at least the floor, k at most."""
    r = ranked(df, by, F.desc(score), F.asc(key), name="_r")
    return r.where((F.col("_r") == 1) | ((F.col("_r") <= k) & (F.col(score) >= floor))).drop("_r")


def candidate_filter(df: DataFrame, by: str, score: str, key: str, k: int, share: float) -> DataFrame:
    """The first k rows of each group, those below a share of its best left out."""
    r = ranked(df, by, F.desc(score), F.asc(key), name="_r").withColumn("_best", F.max(score).over(Window.partitionBy(by)))
    return r.where((F.col("_r") <= k) & (F.col(score) >= share * F.col("_best"))).drop("_r", "_best")


def running(df: DataFrame, by: str, columns: list[str], bins: int = 1000) -> DataFrame:
    """df with each of the columns summed over all rows whose ``by`` (0 to 1, distinct) is at least the row's own.

    Rows are summed within bins of by, and the bins' totals, one row for each, run on in one place; so no task
    holds all rows.
    """
    binned = df.withColumn("_b", F.floor(F.col(by) * bins))
    totals = binned.groupBy("_b").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    above = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_b", *[F.coalesce(F.sum(f"_{c}").over(above), F.lit(0)).alias(f"_{c}") for c in columns])
    within = Window.partitionBy("_b").orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, 0)
    out = binned.join(before, "_b")
    return out.withColumns({c: F.col(f"_{c}") + F.sum(c).over(within) for c in columns}).drop("_b", *[f"_{c}" for c in columns])
