"""Text helpers as Column functions. Patterns carry (?U): classes are Unicode, as the data is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def words(x: Column) -> Column:
    """Words between white space; none in a null."""
    return F.coalesce(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""), F.array().cast("array<string>"))


def word_count(x: Column) -> Column:
    return F.size(words(x))


def collapsed(x: Column) -> Column:
    """One space wherever there is white space, none at the ends."""
    return F.array_join(words(x), " ")


def plain(x: Column) -> Column:
    """Lower case, punctuation as spaces, collapsed; empty for a null."""
    return collapsed(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)[^\w\s]", " "))


def blank(x: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(trimmed(x) == "", F.lit(True))


def shortened(x: Column, limit: int) -> Column:
    """Collapsed and cut to a limit with three dots; empty for a null."""
    tidy = F.coalesce(collapsed(x), F.lit(""))
    return F.when(F.length(tidy) <= limit, tidy).otherwise(F.concat(F.substring(tidy, 1, limit - 3), F.lit("...")))


def readable_id(prefix: str, x: Column) -> Column:
    """prefix, the first 44 characters of the slug, and 8 hex digits of the whole text's SHA-1."""
    text = F.coalesce(x, F.lit(""))
    slug = F.regexp_replace(F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), 1, 44), "^_+|_+$", "")
    return F.concat(F.lit(f"{prefix}_"), slug, F.lit("_"), F.substring(F.sha1(text.cast("binary")), 1, 8))


def fixed(x: Column, digits: int) -> Column:
    """Decimals with half-even rounding of the exact double, without thousands separators."""
    return F.regexp_replace(F.format_number(x, digits), ",", "")


def tidy_number(x: Column) -> Column:
    """Thousands separators; decimals only below 1,000 and only if there are any."""
    whole = F.format_number(x, 0)
    return F.when(x == F.floor(x), whole).when(F.abs(x) < 1000, F.format_number(x, 2)).otherwise(whole)
