"""Column expressions over one field's pixel array (row-major array<double>): no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def bind(value: Column, use) -> Column:
    """use(value), the value computed once a row. Inside the function of an array's element a plain column expression is
    computed for every element anew; a variable bound here is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _between(ordered: Column, q: float) -> Column:
    at = (F.size(ordered) - 1).cast("double") * F.lit(float(q))
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return a + (b - a) * (at - low)


def quantiles(data: Column, *qs: float) -> Column:
    """Array of quantiles by linear interpolation between order statistics; one sort."""
    return bind(F.sort_array(data), lambda s: F.array(*(_between(s, q) for q in qs)))


def quantile(data: Column, q: float) -> Column:
    return F.get(quantiles(data, q), F.lit(0))


def total(data: Column) -> Column:
    return F.aggregate(data, F.lit(0.0), lambda a, x: a + x)


def mean(data: Column) -> Column:
    return F.try_divide(total(data), F.size(data).cast("double"))


def variance(data: Column) -> Column:
    """Population variance."""
    squares = bind(mean(data), lambda m: F.aggregate(data, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
    return F.try_divide(squares, F.size(data).cast("double"))


def rescale(data: Column, limits: Column, smallest: float = 1e-8, clipped: bool = False) -> Column:
    """(v - low) / (high - low) for limits = array(low, high); zeros where the range is below smallest."""
    scale = (lambda v: clip(v)) if clipped else (lambda v: v)

    def by(r):
        low, span = F.get(r, F.lit(0)), F.get(r, F.lit(1)) - F.get(r, F.lit(0))
        return F.when(span < smallest, F.transform(data, lambda v: F.lit(0.0))).otherwise(F.transform(data, lambda v: scale(F.try_divide(v - low, span))))

    return bind(limits, by)


def guarded(numerator: Column, denominator: Column, otherwise: float = 0.0) -> Column:
    """Ratio in double precision; otherwise where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(otherwise))


def round_even(x: Column, digits: int) -> Column:
    """x to digits, half to even, the half judged in double precision as in SQL; bround judges it on the shortest decimals."""
    return F.rint(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def round_away(x: Column, digits: int) -> Column:
    """x to digits, half away from 0, the half judged in double precision as in SQL; round judges it on the shortest decimals."""
    return F.round(x * F.lit(10.0**digits), 0) / F.lit(10.0**digits)


def ramp_above(x: Column, limit: float, width: float) -> Column:
    """0 up to limit, rising to 1 over width; a null signal gives 0."""
    if width <= 0:
        return F.lit(0.0)
    return F.coalesce(clip((x - F.lit(limit)) / F.lit(width)), F.lit(0.0))


def ramp_below(x: Column, limit: float, width: float) -> Column:
    if width <= 0:
        return F.lit(0.0)
    return F.coalesce(clip((F.lit(limit) - x) / F.lit(width)), F.lit(0.0))
