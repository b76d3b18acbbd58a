"""Salary text (FN-13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedmatch import dims


def _amount(v: Column) -> Column:
    """A positive number truncated to an integer; 0 < v < 1 counts as missing."""
    return F.nullif(F.when(v > 0, F.floor(v).cast("bigint")), F.lit(0))


def format_salary(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """"USD 90,000–125,000 / year" from whichever bounds are real positive numbers."""
    lo, hi = _amount(low), _amount(high)
    fmt = lambda n: F.format_number(n, 0)
    figure = F.when(lo.isNotNull() & hi.isNotNull() & (lo != hi),
                    F.concat(fmt(lo), F.lit("–"), fmt(hi))).otherwise(fmt(F.coalesce(lo, hi)))
    code = F.upper(F.coalesce(F.trim(currency), F.lit("")))
    text = F.trim(F.concat(code, F.lit(" "), figure))
    units = F.create_map(*[F.lit(x) for kv in dims.SALARY_UNITS.items() for x in kv])
    unit = F.try_element_at(units, F.lower(F.trim(F.coalesce(period, F.lit("")))))
    out = F.when(unit.isNotNull(), F.concat(text, F.lit(" / "), unit)).otherwise(text)
    return F.when(lo.isNotNull() | hi.isNotNull(), out)
