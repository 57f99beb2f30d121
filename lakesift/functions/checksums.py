"""Checksums as Column functions: no Python runs per row.

Each takes a string, looks at its digits only and returns a non-null boolean; null, empty and
non-ASCII digits give false.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakesift.functions.matching import once


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def _of_digits(c: Column, length: int, test: Callable[[Column], Column]) -> Column:
    """``test`` of the numbers of ``length`` digits, which are worked out once."""
    numbers = lambda s: F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.substr(s, i, F.lit(1)).try_cast("int"))
    checked = once(digits(c), lambda s: F.when(F.length(s) == length, once(numbers(s), test)))
    return F.coalesce(checked, F.lit(False))


def _total(numbers: Column, weights: Sequence[int]) -> Column:
    """Sum of products with ``weights``; null where a digit is missing."""
    return sum((F.get(numbers, F.lit(i)) * w for i, w in enumerate(weights)), F.lit(0))


def luhn_valid(c: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""

    def check(s: Column) -> Column:
        n = F.length(s)
        digit = lambda i: F.substr(s, i, F.lit(1)).try_cast("int")
        # the second digit from the right and every other one before it are doubled
        doubled = F.transform(F.sequence(n - 1, F.lit(1), F.lit(-2)), lambda i: once(digit(i), lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)))
        plain = F.transform(F.sequence(n, F.lit(1), F.lit(-2)), digit)
        total = F.aggregate(F.concat(plain, doubled), F.lit(0), lambda a, d: a + d)
        return F.when(n.between(13, 19), total % 10 == 0)

    return F.coalesce(once(digits(c), check), F.lit(False))


def snils_valid(c: Column) -> Column:
    """11 digits; the last two are the weighted sum of the first nine, modulo 101, with 100 as 0."""
    return _of_digits(c, 11, lambda d: _total(d, range(9, 0, -1)) % 101 % 100 == F.get(d, F.lit(9)) * 10 + F.get(d, F.lit(10)))


# Weights of the taxpayer numbers' check digits.
INN10_WEIGHTS = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_WEIGHTS = ((7, 2, 4, 10, 3, 5, 9, 4, 6, 8), (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8))


def inn10_valid(c: Column) -> Column:
    return _of_digits(c, 10, lambda d: _total(d, INN10_WEIGHTS) % 11 % 10 == F.get(d, F.lit(9)))


def inn12_valid(c: Column) -> Column:
    def check(d: Column) -> Column:
        one, two = (_total(d, weights) % 11 % 10 == F.get(d, F.lit(at)) for at, weights in zip((10, 11), INN12_WEIGHTS))
        return one & two

    return _of_digits(c, 12, check)


def inn_valid(c: Column) -> Column:
    return inn10_valid(c) | inn12_valid(c)
