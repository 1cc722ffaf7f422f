"""Column building blocks over arrays of observations and over aggregates. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0
OBSERVATION = "struct<t:double,m:double,sigma:double,band:string>"


def div(a: Column, b: Column) -> Column:
    """``a / b``; null where b is 0 (ANSI mode would raise)."""
    return a / F.nullif(b, F.lit(ZERO))


def total(series: Column, term: Callable[[Column], Column]) -> Column:
    """Sum of a term over a series."""
    return F.aggregate(series, F.lit(ZERO), lambda acc, x: acc + term(x))


def count_where(series: Column, condition: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(series, condition)).cast("double")


def largest(series: Column, term: Callable[[Column], Column]) -> Column:
    return F.array_max(F.transform(series, term))


def smallest(series: Column, term: Callable[[Column], Column]) -> Column:
    return F.array_min(F.transform(series, term))


def middle(ordered: Column) -> Column:
    """Median of a sorted array; null if it is empty."""
    n = F.size(ordered)
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor(n / 2).cast("int") + 1
    return (F.try_element_at(ordered, F.greatest(low, F.lit(1))) + F.try_element_at(ordered, high)) / 2


def hazen(ordered: Column, q: float) -> Column:
    """Hazen quantile of a sorted array: place n*q + 1/2, clamped, linear between neighbours."""
    n = F.size(ordered).cast("double")
    h = F.least(F.greatest(n * F.lit(float(q)) + F.lit(0.5), F.lit(1.0)), n)
    k = F.floor(h).cast("int")
    at = lambda i: F.try_element_at(ordered, F.greatest(i, F.lit(1)))
    low = at(k)
    return low + (h - k) * (F.coalesce(at(k + 1), low) - low)


def steps(series: Column) -> Column:
    """``struct<dt, dm>`` between successive observations."""
    n = F.size(series)
    count = F.greatest(n - 1, F.lit(0))
    return F.zip_with(F.slice(series, 2, count), F.slice(series, 1, count), lambda b, a: F.struct((b["t"] - a["t"]).alias("dt"), (b["m"] - a["m"]).alias("dm")))


def finite(value: Column) -> Column:
    """Null in place of NaN and infinities."""
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)
