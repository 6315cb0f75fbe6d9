"""Joins with declared cardinality, set operations, aggregates and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their number of rows; empty when the keys are unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows; an error if two share the keys."""
    if not duplicates(df, keys).isEmpty():
        raise ValueError(f"rows share {keys}")
    return df


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "m:1") -> DataFrame:
    """Equi-join; the sides marked 1 in validate must be unique on the keys."""
    for side, df in zip(validate.split(":"), (left, right), strict=True):
        if side == "1":
            assert_unique(df, on)
    return left.join(right, on, how)


def blend_full(left: DataFrame, right: DataFrame, on: list[str], scores: list[str], missing: float) -> DataFrame:
    """Full outer join on coalesced keys; a score that one side lacks gets the default."""
    out = left.join(right, on, "full")
    return out.select(*on, *[F.coalesce(s, F.lit(missing)).alias(s) for s in scores])


def swapped(df: DataFrame, a: str, b: str, *values: str) -> DataFrame:
    """Self-join of each direction a to b with the reverse b to a; values of the reverse are named ``back_``."""
    back = df.select(F.col(b).alias(a), F.col(a).alias(b), *[F.col(v).alias(f"back_{v}") for v in values])
    return df.join(back, [a, b], "left")


def siblings(df: DataFrame, owner: str, member: str) -> DataFrame:
    """Ordered pairs of different members with the same owner, as (owner, member, sibling)."""
    other = df.select(owner, F.col(member).alias("sibling"))
    return df.select(owner, member).join(other, owner).where(F.col(member) != F.col("sibling"))


def set_arms(base: DataFrame, drops: DataFrame, adds: DataFrame, keys: list[str]) -> DataFrame:
    """base without drops, with adds whose target is free: (base - drops) + adds."""
    left = base.join(drops, keys, "left_anti")
    return left.unionByName(adds.join(left, keys, "left_anti")).distinct()


def difference_audit(a: DataFrame, b: DataFrame, keys: list[str], by: str) -> DataFrame:
    """By stratum: pairs in both, in a only, in b only."""
    flagged = a.select(*keys, by, F.lit(True).alias("in_a")).join(b.select(*keys, by, F.lit(True).alias("in_b")), [*keys, by], "full")
    side = F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "only_a").otherwise("only_b")
    return flagged.groupBy(by, side.alias("side")).agg(F.count("*").alias("n"))


def id_lists(refs: DataFrame, links: DataFrame, key: str, value: str, name: str = "ids") -> DataFrame:
    """One row for each reference: its sorted distinct ids joined by commas, empty if it has none."""
    lists = links.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias(name))
    return refs.select(key).join(lists, key, "left").select(key, F.coalesce(name, F.lit("")).alias(name))


def exploded_ids(lists: DataFrame, key: str, ids: str, value: str) -> DataFrame:
    """One row for each id of a comma list; empty and null lists have none."""
    return lists.select(key, F.explode(F.split(F.coalesce(ids, F.lit("")), ",")).alias(value)).where(F.col(value) != "")


def nearest_rank(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentiles (an observed value each), the maximum and the mean."""
    names = [F.expr(f"percentile_disc({s}) WITHIN GROUP (ORDER BY {value})").cast(df.schema[value].dataType).alias(f"p{round(s * 100)}") for s in shares]
    return df.groupBy(*(by or [])).agg(*names, F.max(value).alias("max"), F.avg(value).alias("mean"))


def top_two(df: DataFrame, by: str, value: str) -> DataFrame:
    """Best and runner-up value of each group; null without a second."""
    two = F.slice(F.sort_array(F.collect_list(value), False), 1, 2)
    top = df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value)))).where("_r <= 2")
    return top.groupBy(by).agg(two.alias("two")).select(by, F.get("two", F.lit(0)).alias("best"), F.get("two", F.lit(1)).alias("second"))


def with_frequency(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Each row with the number of rows that share its keys."""
    return df.join(df.groupBy(*keys).agg(F.count("*").alias(name)), keys)


def bucket(key: Column, parts: int) -> Column:
    """Multiplicative hash of ids below 2 ** 31 into parts: ``((id * 2654435761) >> 13) % parts``."""
    return F.pmod(F.shiftrightunsigned(key.cast("long") * F.lit(2654435761), 13), F.lit(parts)).cast("int")


def stratified_folds(df: DataFrame, strata: list[str], key: str) -> DataFrame:
    """fold 0 and 1: a tenth of each stratum each (rounded down), in the order of the id's bucket; fold 2: the rest."""
    w = Window.partitionBy(*strata)
    r = F.row_number().over(w.orderBy(bucket(F.col(key), 1 << 20), key))
    tenth = F.floor(F.count("*").over(w) / 10)
    return df.withColumn("fold", F.when(r <= tenth, 0).when(r <= 2 * tenth, 1).otherwise(2))


def scoped(left: DataFrame, right: DataFrame, scope: str, key: str) -> DataFrame:
    """left with the keys of its scope in right; rows whose scope right doesn't know get the scope ``*``."""
    known = right.select(scope).distinct().withColumn("known", F.lit(True))
    return left.join(known, scope, "left").select(key, F.when(F.col("known"), F.col(scope)).otherwise("*").alias("scope"))


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all, by column name; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
