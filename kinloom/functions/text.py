"""Normalisation of names and addresses as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Short tables, in natural order. DIGRAPHS and ALIKE are those that skeletons must agree on; the others are our own.
LEGAL = {
    "company": "co", "co": "co", "corporation": "corp", "corp": "corp", "gmbh": "gmbh", "incorporated": "inc", "inc": "inc",
    "limited": "ltd", "ltd": "ltd", "llc": "llc", "plc": "plc", "private": "pvt", "pvt": "pvt", "sa": "sa", "sarl": "sarl",
}
NAME_STOP = ["and", "der", "die", "el", "la", "le", "of", "the", "und"]
STREET = {"avenue": "ave", "boulevard": "blvd", "building": "bldg", "drive": "dr", "floor": "fl", "highway": "hwy", "lane": "ln", "road": "rd", "street": "st", "suite": "ste"}
DIGRAPHS = [("ph", "f"), ("sh", "s"), ("ch", "c"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("kh", "k"), ("gh", "g"), ("ck", "k")]
#: Letters that sound alike, and what stands for them.
ALIKE = ("cqgdbwz", "kkktpvs")


def basic(text: Column) -> Column:
    """Lower case, ASCII punctuation to spaces, runs of white space to one, trimmed."""
    plain = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


@F.pandas_udf(T.StringType())
def compatible(text: pd.Series) -> pd.Series:
    """NFKC and case folding, for which Spark has no function."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def unaccented(text: pd.Series) -> pd.Series:
    """NFKD without combining marks."""
    return text.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)), na_action="ignore")


def folded(text: Column) -> Column:
    """Unaccented letters and digits of any script, parted by single spaces."""
    return F.trim(F.regexp_replace(F.lower(unaccented(text)), r"[^\p{L}\p{N}]+", " "))


def words(text: Column) -> Column:
    """The words of a normalised text; none for an empty one."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def skeleton(token: Column) -> Column:
    """Consonants of a token: digraphs and like letters folded, vowels, h and y dropped, repeats collapsed.

    Tokens of digits alone stay; a token that loses all letters keeps its first.
    """
    out = token
    for a, b in DIGRAPHS:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.replace(F.translate(out, *ALIKE), F.lit("x"), F.lit("ks"))
    out = F.regexp_replace(F.regexp_replace(out, "[aeiouyh]", ""), r"(.)\1+", "$1")
    return F.when(token.rlike("^[0-9]+$"), token).when(out == "", F.left(token, F.lit(1))).otherwise(out)


def lookup(token: Column, table: dict[str, str]) -> Column:
    """The table's value for a token, else null. For short tables only."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), token)


def kind(token: Column) -> Column:
    """1 for a legal form, 2 for a stop word, else 0."""
    return F.when(token.isin(*LEGAL), 1).when(token.isin(*NAME_STOP), 2).otherwise(0)


def address_token(token: Column) -> Column:
    """Ordinals and numbers to digits without leading zeros, street words to their short form."""
    digits = F.regexp_extract(token, r"^0*(\d+)(st|nd|rd|th)?$", 1)
    return F.when(digits != "", digits).otherwise(F.coalesce(lookup(token, STREET), token))


def numbers(text: Column) -> Column:
    """All digit runs without leading zeros; a run of zeros is 0."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), _unpadded)


def _unpadded(n: Column) -> Column:
    bare = F.regexp_replace(n, "^0+", "")
    return F.when(bare == "", "0").otherwise(bare)


def house(text: Column) -> Column:
    """The first number of an address, empty without one."""
    found = F.regexp_extract(text, r"(\d+)", 1)
    return F.when(found == "", "").otherwise(_unpadded(found))


def house_segment(a: Column, b: Column) -> Column:
    """0 if the house numbers agree, 1 if they conflict, 2 if one is unknown."""
    x, y = house(a), house(b)
    return F.when((x == "") | (y == ""), 2).when(x == y, 0).otherwise(1)


def house_range(text: Column, side: int) -> Column:
    """First or second number of ``a - b``, by its last 12 digits; null without a range."""
    found = F.regexp_extract(text, r"(\d+)\s*-\s*(\d+)", side)
    return F.when(found != "", F.right(found, F.lit(12)).cast("long"))


def domain(text: Column) -> Column:
    """Host of a web address without www, else empty."""
    return F.regexp_replace(F.regexp_extract(F.lower(text), r"https?://([^/\s?#:]+)", 1), r"^www\.", "")


def sorted_tokens(text: Column) -> Column:
    """The distinct words in order, joined by spaces."""
    return F.array_join(F.array_sort(F.array_distinct(words(text))), " ")


def initials(text: Column) -> Column:
    """First letters of the words."""
    return F.array_join(F.transform(words(text), lambda w: F.left(w, F.lit(1))), "")
