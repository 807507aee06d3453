"""Column expressions for text: cleaning, tokens, fallbacks, scores.

All are built-in functions, so they stay in the JVM.  White space is what
Python's ``str.strip`` and ``str.split`` take, i.e. Unicode's plus U+001C-1F.
"""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: What separates words: white space and these marks.
MARKS = "?,"
_SEPARATOR = rf"[\s\x1c-\x1f{MARKS}]+"
SHORTEST = 2


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_WS))


def safe_text(c: Column) -> Column:
    """Null is empty; else the stripped text of the value."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def tokens(query: str) -> list[str]:
    """Lower-cased words of two code points or more; ? and , separate; repeats stay."""
    pieces = re.split(_SEPARATOR, query.lower())
    return list(filter(lambda w: len(w) >= SHORTEST, pieces))


def tokens_col(c: Column) -> Column:
    """``tokens`` as a column; null gives no tokens."""
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), f"(?U){_SEPARATOR}")
    return F.filter(words, lambda w: F.length(w) >= SHORTEST)


def contains_any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def hits(c: Column, words: list[str]) -> Column:
    """How many of the words (repeats count) the text contains; unrolled, so it stays in generated code."""
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(w)).cast("int") for w in words], F.lit(0)).cast("int")


def first_existing(df: DataFrame, chain, default="") -> Column:
    """The first column of the chain that the schema has, else the default: a test of schema, not of values."""
    return next((F.col(f"`{c}`") for c in chain if c in df.columns), F.lit(default))


def value_or(a: Column, b: Column) -> Column:
    """a unless it is null or empty, else b: a test of values."""
    return F.coalesce(F.nullif(a, F.lit("")), b)


def available(df: DataFrame, wanted) -> list[str]:
    """The wanted columns that exist, in the wanted order."""
    return [c for c in wanted if c in df.columns]
