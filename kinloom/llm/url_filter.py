"""URL filter: a blocked Bloom filter in front of an exact hash join. DataFrame functions only.

A list has rows (host, path, verdict). An entry fits a URL when the URL's host is the entry's host or
below it and the URL's path starts with the entry's path; the longest entry decides. The canonical form
of an entry is ``host + path``; each URL has one canonical form for every entry that could fit it. The
Bloom filter, built from the whole list, drops the forms that are certainly not listed; an exact join on
the remaining forms removes its false positives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import LOWER, UPPER

#: Bits that one key sets in its 64-bit block, and the 6-bit slices of the second hash that name them.
SLICES = (0, 6, 12, 18)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    second = F.xxhash64(key, F.lit("mask"))
    bits = [
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, s).bitwiseAND(63).cast("int"))
        for s in SLICES
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def bloom_words(keys: DataFrame, key: str, bits_per_key: int, max_bits: int) -> list[int]:
    """The filter as 64-bit blocks. Its size is at most max_bits, however long the list is.

    A list with more than max_bits / bits_per_key entries only has more false positives, which the exact
    join removes; the result stays the same.
    """
    wanted = keys.count() * bits_per_key
    blocks = 16
    while blocks * 64 < min(wanted, max_bits):
        blocks *= 2
    filled = (
        keys.select(_block(F.col(key), blocks).alias("b"), _mask(F.col(key)).alias("m"))
        .groupBy("b")
        .agg(F.bit_or("m").alias("m"))
    )
    words = [0] * blocks
    for row in filled.collect():
        words[row.b] = row.m
    return words


def might_hold(words: list[int], key: Column) -> Column:
    """True when all bits of the key are set in its block."""
    bits = F.array(*[F.lit(w).cast("long") for w in words]) if len(words) <= 64 else F.lit(words).cast("array<long>")
    mask = _mask(key)
    return F.get(bits, _block(key, len(words))).bitwiseAND(mask) == mask


def filter_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", bits_per_key: int = 16, max_bits: int = 1 << 23
) -> DataFrame:
    """Judge every row of pages (page_id, url) by the list rules (host, path, verdict).

    Returns page_id, host, path, rule (the longest fitting entry as ``host + path``, else null) and
    verdict (that entry's, else the default). A null URL or one without ``://`` has an empty host and
    path and fits no entry. Repeated pages each keep their row. Of entries with the same canonical form
    the verdict that sorts first counts; entries with a null host or path are ignored. An empty list
    gives every row the default; an empty table gives no rows.
    """
    listed = (
        rules.where("host IS NOT NULL AND path IS NOT NULL")
        .select(F.translate("host", UPPER, LOWER).alias("h"), F.col("path").alias("p"), "verdict")
        .groupBy(F.concat("h", "p").alias("rule"), "h", "p")
        .agg(F.min("verdict").alias("listed_verdict"))
    )
    shape = listed.agg(
        F.max(F.size(F.split("h", r"\."))).alias("labels"), F.array_sort(F.collect_set(F.length("p"))).alias("lengths")
    ).first()
    url = F.col("url")
    parts = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    if not shape.labels:
        return parts.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    words = bloom_words(listed, "rule", bits_per_key, max_bits)

    labels = F.split("host", r"\.")
    depth = F.least(F.size(labels), F.lit(shape.labels))
    hosts = F.transform(
        F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")
    )
    starts = F.transform(
        F.filter(F.array(*map(F.lit, shape.lengths)), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    forms = F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda s: F.concat(h, s))))
    judged = parts.withColumn(
        "hits",
        F.when(F.col("host") != "", F.array_distinct(F.filter(forms, lambda k: might_hold(words, k)))).otherwise(
            F.array().cast("array<string>")
        ),
    )

    # One entry for each distinct URL with a possible hit, so that a URL that many rows share is joined once.
    exact = (
        judged.where(F.size("hits") > 0)
        .select("url", F.explode("hits").alias("rule"))
        .distinct()
        .join(listed.select("rule", "listed_verdict"), "rule")
        .groupBy(F.col("url").alias("hit_url"))
        .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "listed_verdict")).alias("best"))
    )
    # Rows without a hit get keys that match nothing but are spread over the partitions.
    spread = F.concat(F.lit("no hit "), F.xxhash64("page_id", "url").cast("string"))
    return (
        judged.withColumn("join_url", F.when(F.size("hits") > 0, F.col("url")).otherwise(spread))
        .join(exact, F.col("join_url") == F.col("hit_url"), "left")
        .select(
            "page_id",
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce("best.listed_verdict", F.lit(default)).alias("verdict"),
        )
    )
