"""Column helpers that treat white space and letters as Unicode does."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_left(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def squash(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(c, SPACE, " "))


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, "")


def word_count(c: Column) -> Column:
    s = squash(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, " ")))


def has_letter(c: Column) -> Column:
    return c.rlike(r"\p{IsAlphabetic}")


def path_tokens(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.split(F.lower(F.btrim(F.regexp_replace(c, "[^A-Za-z0-9]+", " "))), " ")


def any_of(tokens: Column, *words: str) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def points(*rules: tuple[Column, int]) -> Column:
    """Sum of the points of the conditions that hold."""
    return reduce(lambda a, b: a + b, (F.when(cond, n).otherwise(0) for cond, n in rules))
