"""Numeric functions and statistics across arguments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def round_unit(x, unit: float = 1) -> Column:
    """To the nearest multiple of unit (not: decimal places)."""
    return F.round(_col(x) / unit) * unit


def int_(x) -> Column:
    """Toward zero."""
    return F.when(_col(x) < 0, F.ceil(_col(x))).otherwise(F.floor(_col(x)))


def mod(a, b) -> Column:
    """With the sign of the dividend; missing for a zero divisor."""
    return F.try_mod(_col(a), _col(b))


def divide(a, b) -> Column:
    return F.try_divide(_col(a), _col(b))


def n_of(*xs) -> Column:
    return reduce(lambda a, b: a + b, (_col(x).isNotNull().cast("int") for x in xs))


def nmiss_of(*xs) -> Column:
    return len(xs) - n_of(*xs)


def sum_of(*xs) -> Column:
    """Missing arguments are left out; all missing: missing."""
    total = reduce(lambda a, b: a + b, (F.coalesce(_col(x), F.lit(0)) for x in xs))
    return F.when(n_of(*xs) > 0, total)


def mean_of(*xs) -> Column:
    return F.try_divide(sum_of(*xs), n_of(*xs))


def max_of(*xs) -> Column:
    return F.greatest(*map(_col, xs))


def min_of(*xs) -> Column:
    return F.least(*map(_col, xs))


def range_of(*xs) -> Column:
    return max_of(*xs) - min_of(*xs)


def css_of(*xs) -> Column:
    mean = mean_of(*xs)
    return F.when(n_of(*xs) > 0, reduce(lambda a, b: a + b, (F.coalesce((_col(x) - mean) * (_col(x) - mean), F.lit(0.0)) for x in xs)))


def var_of(*xs) -> Column:
    return F.when(n_of(*xs) > 1, F.try_divide(css_of(*xs), n_of(*xs) - 1))


def std_of(*xs) -> Column:
    return F.sqrt(var_of(*xs))


def ordered(*xs) -> Column:
    return F.sort_array(F.filter(F.array(*(_col(x).cast("double") for x in xs)), lambda v: v.isNotNull()))


def smallest(k: int, *xs) -> Column:
    return F.try_element_at(ordered(*xs), F.lit(k))


def largest(k: int, *xs) -> Column:
    return F.try_element_at(ordered(*xs), F.lit(-k))


def median_of(*xs) -> Column:
    s, n = ordered(*xs), n_of(*xs)
    lo, hi = F.floor((n + 1) / 2).cast("int"), F.floor(n / 2).cast("int") + 1
    return F.when(n > 0, (F.try_element_at(s, F.greatest(lo, F.lit(1))) + F.try_element_at(s, F.greatest(hi, F.lit(1)))) / 2)


def missing(x, character: bool = False) -> Column:
    """1 for missing; a blank counts as missing in a character."""
    c = _col(x)
    return (c.isNull() | (F.trim(c) == "") if character else c.isNull()).cast("int")


def ifn(condition: Column, yes, no, when_missing=None) -> Column:
    return F.when(condition.isNull(), _col(when_missing) if when_missing is not None else _col(no)).when(condition, _col(yes)).otherwise(_col(no))


def comb(n: int, k: int) -> int:
    import math

    return math.comb(n, k)


def fact(x) -> Column:
    return F.factorial(_col(x))


def geodist_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance by the haversine formula."""
    a, b, c, d = (F.radians(_col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.sin((c - a) / 2) ** 2 + F.cos(a) * F.cos(c) * F.sin((d - b) / 2) ** 2
    return 2 * 6371.0 * F.asin(F.sqrt(h))


def pmt(rate: float, periods: int, present) -> Column:
    """Payment of an annuity."""
    return _col(present) * rate / (1 - (1 + rate) ** -periods)


def npv(rate: float, *flows) -> Column:
    return reduce(lambda a, b: a + b, (F.coalesce(_col(x), F.lit(0)) / (1 + rate) ** (k + 1) for k, x in enumerate(flows)))


def compound(present, rate: float, periods: int) -> Column:
    return _col(present) * (1 + rate) ** periods
