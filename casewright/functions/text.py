"""Tests of a text against fixed word lists, as expressions that compile with the rest of a stage."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of the words; false for null. A search of bytes for each word, which costs less than an alternation that tries all words at each place."""
    return F.coalesce(reduce(or_, (F.contains(text, F.lit(w)) for w in words)), F.lit(False))


def count_of(text: Column, words: list[str]) -> Column:
    """How many of the words a text holds; 0 for null."""
    return reduce(add, (F.coalesce(F.contains(text, F.lit(w)), F.lit(False)).cast("int") for w in words), F.lit(0))


def percent(x: Column) -> Column:
    """A share from 0 to 1 in whole percent, halves to the even number."""
    hundred = x * 100
    whole = F.floor(hundred)
    left = hundred - whole
    return F.concat((whole + ((left > 0.5) | ((left == 0.5) & (whole % 2 == 1))).cast("int")).cast("string"), F.lit("%"))
