"""Column expressions for text, keys and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIMESTAMP_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ssXXX")


def squeeze_lower(c: Column) -> Column:
    """White space runs become one space; then trimmed and lower-cased."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def trim_lower(c: Column) -> Column:
    return F.lower(F.trim(c))


def not_blank(c: Column) -> Column:
    """True if there is more than U+0020; tabs count as content."""
    return c.isNotNull() & (F.trim(c) != "")


def parse_timestamp(c: Column) -> Column:
    """Microseconds, then offset, then Spark's own parser; null for anything else."""
    text = c.cast("string")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in TIMESTAMP_FORMATS), F.try_to_timestamp(text))


def tokens(c: Column) -> Column:
    """Split at runs of non-word characters; empty tokens at the ends stay, null gives null."""
    return F.split(F.lower(c), r"\W+")


def first_line(c: Column) -> Column:
    return F.split_part(c, F.lit("\n"), F.lit(1))


def surrogate_key(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def fallback_key(source: Column, key: Column, *others: Column) -> Column:
    """sha256 of source and key; where key is null, of source and the hash of source and the other fields."""
    low = lambda c: F.lower(F.coalesce(c.cast("string"), F.lit("")))
    rest = F.sha2(F.concat_ws("||", low(source), *(low(c) for c in others)), 256)
    return F.sha2(F.concat_ws("||", low(source), F.coalesce(key.cast("string"), rest)), 256)
