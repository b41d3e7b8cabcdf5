from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Whole-number division."""
    return F.call_function("div", a, b)


def as_units(value: Column, scale: int) -> Column:
    """A positive value as a whole number of 10**-scale units (half rounds up)."""
    return F.floor(value * F.lit(float(10**scale)) + F.lit(0.5)).cast("bigint")


def exact_mean(
    value: Column, digits: int = 2, scale: int = 4, over: WindowSpec | None = None
) -> Column:
    """Mean of values >= 0, rounded half-up to `digits`, free of floating-point drift.

    Values are taken at `scale` decimals (scale >= digits) as whole units, and these are summed and divided as
    decimals, so the result does not depend on the order in which partial sums meet. NULL, NaN, infinite values and
    values of 28 digits or more in units are left out. Ten billion of the largest values still add up; a sum beyond 38 digits
    gives NULL.
    """
    units = F.when(~F.isnan(value), (value * F.lit(float(10**scale))).try_cast("decimal(28,0)"))
    total, rows = F.try_sum(units), F.count(units)
    if over is not None:
        total, rows = total.over(over), rows.over(over)
    step = (F.nullif(rows, F.lit(0)) * F.lit(10 ** (scale - digits))).cast("decimal(20,0)")
    # the part that is left over decides the last digit, so nothing is rounded before
    rest = total % step
    whole = ((total - rest) / step).cast("decimal(30,0)") + F.when(rest >= step - rest, 1).otherwise(0)
    return (whole / F.lit(10**digits)).cast("double")


def signed_round(value: Column, digits: int) -> Column:
    """round() that never yields a negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def pct_off(value: Column, base: Column) -> Column:
    """How far a value lies from its base, in percent of the base; NULL when the base is 0."""
    return F.try_divide(value - base, base) * F.lit(100.0)


def fixed(value: Column, digits: int, signed: bool = False) -> Column:
    """Text of a number with a fixed count of decimals, optionally always with its sign."""
    flag = "+" if signed else ""
    return F.format_string(f"%{flag}.{digits}f", signed_round(value, digits))
