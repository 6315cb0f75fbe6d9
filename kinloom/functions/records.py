"""Views of a record's name and address, and what one view says about another, as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.functions import text

#: Components of an address that say nothing.
BLANK = ["", "n/a", "na", "none", "null", "unknown"]
#: Words of an address that are left out of its tokens.
FILLER = ["near", "opposite", "behind", "the", "of"]


def plain(value: Column) -> Column:
    """Transliterated to unaccented letters of any script, lower case, single spaces."""
    return text.folded(value)


def glued(address: Column) -> Column:
    """Lower case with / and - kept inside tokens, other punctuation to spaces."""
    kept = F.regexp_replace(F.lower(address), r"[!-,.:-@\[-`{-~]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, r"\s*([/-])\s*", "$1"), r"\s+", " "))


def name_views(name: Column) -> dict[str, Column]:
    """core (tokens that are no legal form and no stop word), legal (distinct, sorted), full (no stop words),
    skeletons of the core, and compact (the core without spaces)."""
    tokens = text.words(text.basic(name))
    full = F.filter(tokens, lambda t: ~t.isin(*text.NAME_STOP))
    core = F.filter(full, lambda t: ~t.isin(*text.LEGAL))
    return {
        "core": F.array_join(core, " "),
        "legal": F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(tokens, lambda t: text.lookup(t, text.LEGAL)), lambda t: t.isNotNull()))), " "),
        "full": F.array_join(full, " "),
        "skel": F.array_join(F.transform(core, text.skeleton), " "),
        "compact": F.array_join(core, ""),
    }


def address_views(address: Column) -> dict[str, Column]:
    """From the parts between commas that say something: city (the last one), street tokens in short form, numbers."""
    parts = F.filter(F.transform(F.split(F.lower(F.coalesce(address, F.lit(""))), ","), lambda x: F.trim(x)), lambda x: ~x.isin(*BLANK))
    rest = F.when(F.size(parts) > 1, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)
    tokens = F.filter(text.words(text.basic(F.array_join(rest, " "))), lambda t: ~t.isin(*FILLER))
    return {
        "city": F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(""),
        "street": F.array_join(F.transform(tokens, text.address_token), " "),
        "nums": F.array_join(F.filter(F.transform(tokens, text.address_token), lambda t: t.rlike("^[0-9]+$")), " "),
    }


def learned(tokens: Column, table: dict[str, str]) -> Column:
    """Tokens with those that a learned dictionary knows replaced."""
    return F.transform(tokens, lambda t: F.coalesce(text.lookup(t, table), t))


def identity(name: Column, address: Column) -> dict[str, Column]:
    """Signatures for exact identity: sorted distinct name tokens with dotted legal forms folded, and whether each side is
    long enough to tell records apart (four letters; eight letters, two words and a digit)."""
    undotted = F.regexp_replace(F.lower(name), r"(?<=\b[a-z])\.(?=[a-z]\b|\s|$)", "")
    tokens = text.words(text.basic(undotted))
    letters = lambda c: F.length(F.regexp_replace(F.lower(c), "[^a-z]", ""))
    ad = text.basic(F.coalesce(address, F.lit("")))
    return {
        "signature": F.array_join(F.array_sort(F.array_distinct(F.transform(tokens, lambda t: F.coalesce(text.lookup(t, text.LEGAL), t)))), " "),
        "name_valid": letters(name) >= 4,
        "address_valid": (letters(ad) >= 8) & (F.size(text.words(ad)) >= 2) & ad.rlike("[0-9]"),
    }


def house_change(a: Column, b: Column) -> dict[str, Column]:
    """How two house numbers (digits) differ: log gap, differing digits, first differing place, equal length, a within b."""
    n = F.greatest(F.length(a), F.length(b))
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    differs = F.filter(at, lambda i: F.substring(F.rpad(a, 12, "_"), i, F.lit(1)) != F.substring(F.rpad(b, 12, "_"), i, F.lit(1)))
    return {
        "log_gap": F.ln(1 + F.abs(a.cast("long") - b.cast("long"))),
        "digits": F.size(differs),
        "first": F.coalesce(F.array_min(differs), F.lit(0)),
        "alike": F.length(a) == F.length(b),
        "within": F.contains(b, a),
    }


def change_kind(a: Column, b: Column) -> Column:
    """What happened to the tokens a on the way to b: same, reorder, add, drop, typo or swap (one for one), else other."""
    gone, new = F.array_except(a, b), F.array_except(b, a)
    one = (F.size(gone) == 1) & (F.size(new) == 1)
    near = F.levenshtein(F.get(gone, F.lit(0)), F.get(new, F.lit(0))) <= 2
    return (
        F.when(a == b, "same")
        .when((F.size(gone) == 0) & (F.size(new) == 0), "reorder")
        .when(F.size(gone) == 0, "add")
        .when(F.size(new) == 0, "drop")
        .when(one & near, "typo")
        .when(one, "swap")
        .otherwise("other")
    )


def legal_position(tokens: Column, word: Column) -> Column:
    """Where a word stands to the first legal form of its tokens: before, after, end (last, with no legal form), inside or none."""
    at = F.array_position(tokens, word)
    legal = F.array_min(F.filter(F.transform(tokens, lambda t, i: F.when(t.isin(*text.LEGAL), i + 1)), lambda x: x.isNotNull()))
    return (
        F.when(at == 0, "none")
        .when(legal.isNull(), F.when(at == F.size(tokens), "end").otherwise("inside"))
        .when(at < legal, "before")
        .when(at > legal, "after")
        .otherwise("inside")
    )


@F.pandas_udf(T.LongType())
def splitmix(x: pd.Series) -> pd.Series:
    """The SplitMix64 finaliser of a 64-bit number; Spark's own products stop at 63 bits, numpy's wrap."""
    # The increment and the multipliers of SplitMix64.
    z = x.to_numpy(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return pd.Series((z ^ (z >> np.uint64(31))).view(np.int64))
