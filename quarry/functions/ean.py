"""Product number check digits, validity, and corrections, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(digits12: Column) -> Column:
    """Weights 1 and 3 in turn over the first 12 digits."""
    figure = lambda i: F.substring(digits12, i, 1).cast("int") * (1 if i % 2 == 1 else 3)
    return sum((figure(i) for i in range(2, 13)), figure(1))


def check_digit(digits12: Column) -> Column:
    return ((10 - _total(digits12) % 10) % 10).cast("string")


def is_valid(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]{13}$"), check_digit(c) == F.substring(c, 13, 1)).otherwise(F.lit(False))


def correction_candidates(c: Column) -> Column:
    """Valid numbers one wrong digit or one swap of neighbours away: by place and digit, swaps last.

    13 digits have one right digit at each place (weights 1 and 3 have inverses modulo 10), so no wrong ones are made and checked.
    """
    off = F.pmod(_total(c) + F.substring(c, 13, 1).cast("int"), F.lit(10))
    digit = lambda i: F.substring(c, i, F.lit(1)).cast("int")
    odd = lambda i: i % 2 == 1

    def right(e: Column) -> Column:
        fixed = F.transform(F.sequence(F.lit(1), F.lit(13)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.pmod(digit(i) - e * F.when(odd(i), 1).otherwise(7), F.lit(10)).cast("string"), F.substring(c, i + 1, F.lit(13))))
        fits = F.filter(F.sequence(F.lit(1), F.lit(12)), lambda i: (digit(i) != digit(i + 1)) & (F.pmod(e + (digit(i + 1) - digit(i)) * F.when(odd(i), -2).otherwise(2), F.lit(10)) == 0))
        swapped = F.transform(fits, lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.lit(1)), F.substring(c, i, F.lit(1)), F.substring(c, i + 2, F.lit(13))))
        return F.concat(F.when(e != 0, fixed).otherwise(F.array().cast("array<string>")), swapped)

    return F.when(c.rlike("^[0-9]{13}$"), F.flatten(F.transform(F.array(off), right))).otherwise(_checked_candidates(c))


def _checked_candidates(c: Column) -> Column:
    """The same of any text: every digit at every place and every swap, checked."""
    places = F.sequence(F.lit(1), F.lit(13))
    figures = F.sequence(F.lit(0), F.lit(9))
    changed = F.flatten(F.transform(places, lambda i: F.transform(figures, lambda d: F.concat(F.substring(c, F.lit(1), i - 1), d.cast("string"), F.substring(c, i + 1, F.lit(13))))))
    swapped = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.lit(1)), F.substring(c, i, F.lit(1)), F.substring(c, i + 2, F.lit(13))))
    return F.array_distinct(F.filter(F.concat(changed, swapped), lambda x: (x != c) & is_valid(x)))


def variants(c: Column) -> Column:
    """Numbers that a 12, 13 or 14 digit string may stand for."""
    none = F.array().cast("array<string>")
    only = lambda x: F.when(is_valid(x), F.array(x)).otherwise(none)
    return (
        F.when(c.rlike("^[0-9]{13}$"), F.when(is_valid(c), F.array(c)).otherwise(correction_candidates(c)))
        .when(c.rlike("^[0-9]{12}$"), F.array_distinct(F.concat(only(F.concat(F.lit("0"), c)), F.array(F.concat(c, check_digit(c))))))
        .when(c.rlike("^[0-9]{14}$"), F.array_distinct(F.concat(only(F.substring(c, 2, 13)), only(F.substring(c, 1, 13)))))
        .otherwise(none)
    )
