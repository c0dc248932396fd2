"""Algebra on sets of closed intervals, held as sorted disjoint array<struct<lo:double,hi:double>> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLACK = 1e-12
TYPE = "array<struct<lo:double,hi:double>>"


def contains(s: Column, x: Column | float) -> Column:
    x = x if isinstance(x, Column) else F.lit(x)
    return F.exists(s, lambda p: (p.lo - SLACK <= x) & (x <= p.hi + SLACK))


def hull(s: Column) -> Column:
    return F.struct(F.element_at(s, 1).lo.alias("lo"), F.element_at(s, -1).hi.alias("hi"))


def width(s: Column) -> Column:
    return F.element_at(s, -1).hi - F.element_at(s, 1).lo


def measure(s: Column) -> Column:
    return F.aggregate(s, F.lit(0.0), lambda t, p: t + p.hi - p.lo)


def shift(s: Column, by: Column | float) -> Column:
    return F.transform(s, lambda p: F.struct((p.lo + by).alias("lo"), (p.hi + by).alias("hi")))


def negate(s: Column) -> Column:
    return F.reverse(F.transform(s, lambda p: F.struct((-p.hi).alias("lo"), (-p.lo).alias("hi"))))


def normalise(s: Column, slack: float = 1e-9) -> Column:
    """Sorts and merges parts whose distance is ``slack`` at most."""
    def add(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last.lo.alias("lo"), F.greatest(last.hi, p.hi).alias("hi"))))
        return F.when((F.size(acc) > 0) & (p.lo <= F.try_element_at(acc, F.lit(-1)).hi + slack), joined).otherwise(F.concat(acc, F.array(F.struct(p.lo.alias("lo"), p.hi.alias("hi")))))

    return F.aggregate(F.array_sort(s), F.array().cast(TYPE), add)


def union(a: Column, b: Column) -> Column:
    return normalise(F.concat(a, b))
