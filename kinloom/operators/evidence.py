"""Evidence from how records change between sources: word swaps, siblings, rivals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_word_swaps(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    """Pairs whose token arrays differ by one word for one other: the columns of pairs with old and new."""
    gone, new = F.array_except(a, b), F.array_except(b, a)
    return pairs.where((F.size(gone) == 1) & (F.size(new) == 1)).withColumns({"old": F.get(gone, F.lit(0)), "new": F.get(new, F.lit(0))})


def swap_support(swaps: DataFrame) -> DataFrame:
    """For each (old, new): how often it was seen, how often the other way, and the smoothed share of this way."""
    way = swaps.groupBy("old", "new").agg(F.count("*").alias("n"))
    back = way.select(F.col("old").alias("new"), F.col("new").alias("old"), F.col("n").alias("back"))
    both = way.join(back, ["old", "new"], "left").na.fill(0, ["back"])
    return both.withColumn("share", (F.col("n") + 1) / (F.col("n") + F.col("back") + 2))


def swap_support_without_owner(swaps: DataFrame, owner: str) -> DataFrame:
    """Each swap with the support of (old, new) less what its own owner's rows add, both ways."""
    own = swaps.groupBy(owner, "old", "new").agg(F.count("*").alias("own"))
    own_back = own.select(owner, F.col("old").alias("new"), F.col("new").alias("old"), F.col("own").alias("own_back"))
    rows = swaps.join(swap_support(swaps).select("old", "new", "n", "back"), ["old", "new"]).join(own, [owner, "old", "new"])
    rows = rows.join(own_back, [owner, "old", "new"], "left").na.fill(0, ["own_back"])
    f, r = F.col("n") - F.col("own"), F.col("back") - F.col("own_back")
    return rows.select(*swaps.columns, f.alias("forward"), r.alias("backward"), ((f + 1) / (f + r + 2)).alias("ratio"))


def drop_unlikely_swaps(matches: DataFrame, swaps: DataFrame, least: int, share: float, keys: list[str]) -> DataFrame:
    """Matches without those whose only change is a swap seen mostly the other way: least times in all, below this share."""
    support = swap_support(swaps)
    doubtful = support.where((F.col("n") + F.col("back") >= least) & (F.col("n") / (F.col("n") + F.col("back")) < share))
    return matches.join(swaps.join(doubtful.select("old", "new"), ["old", "new"], "left_semi").select(*keys), keys, "left_anti")


def word_classes(swaps: DataFrame, least: int) -> DataFrame:
    """Each word by its balance over swaps: rare (seen less than least times), old or new side (3 in 4), else both."""
    sides = swaps.groupBy(F.col("old").alias("word")).agg(F.count("*").alias("gone")).join(
        swaps.groupBy(F.col("new").alias("word")).agg(F.count("*").alias("came")), "word", "full"
    )
    n = F.col("gone") + F.col("came")
    kind = F.when(n < least, "rare").when(4 * F.col("gone") >= 3 * n, "old").when(4 * F.col("came") >= 3 * n, "new").otherwise("both")
    return sides.na.fill(0, ["gone", "came"]).withColumn("kind", kind)


def rivals(pairs: DataFrame) -> DataFrame:
    """Each pair with the best other candidate of its target (null if alone): rival and rival_p."""
    w = Window.partitionBy("tid").orderBy(F.desc("p"), "qid")
    ranked = pairs.withColumn("_r", F.row_number().over(w))
    every = Window.partitionBy("tid")
    first = F.max(F.when(F.col("_r") == 1, F.struct("qid", "p"))).over(every)
    second = F.max(F.when(F.col("_r") == 2, F.struct("qid", "p"))).over(every)
    other = F.when(F.col("_r") == 1, second).otherwise(first)
    return ranked.withColumns({"rival": other["qid"], "rival_p": other["p"]}).drop("_r")


def contrast(own: Column, rival: Column, target: Column) -> dict[str, Column]:
    """What a target shares with its candidate and not with the rival, as token arrays."""
    only, other = F.array_except(F.array_intersect(own, target), rival), F.array_except(F.array_intersect(rival, target), own)
    n = F.size(target)
    return {
        "distinct": F.size(only),
        "against": F.size(other),
        "support": F.size(only) - F.size(other),
        "coverage": F.when(n > 0, F.size(F.array_intersect(own, target)) / n).otherwise(0.0),
        "conflict": F.size(F.array_except(own, target)),
    }


def sibling_seeds(accepted: DataFrame, most: int) -> DataFrame:
    """The first accepted targets of each reference, by falling probability and then by id; most a reference, as a feature."""
    w = Window.partitionBy("qid").orderBy(F.desc("p"), "tid")
    return accepted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
