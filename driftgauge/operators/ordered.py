"""Ranks, running sums and medians without a window over a whole group.

Rows are dealt to ranges of their order, whose ends Spark draws from a sample of the data, so values of any type and however close
spread evenly. Sums by range are few and are added up in order; the rows of one range are ordered by themselves. So neither a group nor
the whole table meets in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, few


def _dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` dealt to ranges of their order, numbered in ``__range``; kept, so that ranges stay as they are."""
    return cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))


def _here(by: list[str]) -> Column:
    """A row's range and group are those of a row of sums (``__of``, ``__by_``)."""
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by], F.col("__range") == F.col("__of"))


def running(rows: DataFrame, by: list[str], at: str, amounts: dict[str, str], ties: list[str] | None = None) -> DataFrame:
    """``rows`` and, under each name, the sum of a column over the rows of the group up to this one, in the order of ``at`` (nulls first) and then ``ties``.

    Rows that are equal in both are taken in any order: aggregate them before. ``rows`` is read twice, once for the sample.
    """
    order = [at, *(ties or [])]
    placed = _dealt(rows, [*by, *order])
    sums = placed.groupBy(*by, "__range").agg(*[F.sum(c).alias(f"__{n}") for n, c in amounts.items()])
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sums = sums.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__range").alias("__of"), *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in amounts])
    inside = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(sums, _here(by)).withColumns({n: F.col(f"__{n}") + F.sum(c).over(inside) for n, c in amounts.items()})
    return out.select(*rows.columns, *amounts)


def medians(rows: DataFrame, by: list[str], value: str, name: str = "median", times: str | None = None) -> DataFrame:
    """(by, name): the exact median of each group's values that aren't null, between the middle two where they are even. ``times``: how often a row counts.

    Only the ranges in which the middle lies are put in order.
    """
    counted = F.count(F.lit(1)) if times is None else F.sum(times)
    placed = _dealt(rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(counted.alias("__c")), [*by, value])
    sums = placed.groupBy(*by, "__range").agg(F.sum("__c").alias("__s"))
    upto, whole = (Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, Window.unboundedFollowing))  # one row per range
    sums = sums.withColumns({"__before": F.sum("__s").over(upto) - F.col("__s"), "__n": F.sum("__s").over(whole)})
    low, high = F.floor((F.col("__n") + 1) / 2), F.floor(F.col("__n") / 2) + 1
    middle = sums.where((F.col("__before") < high) & (F.col("__before") + F.col("__s") >= low))
    middle = few(cut(middle.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__range").alias("__of"), "__before", "__n")))
    inside = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = placed.join(middle, _here(by)).withColumn("__upto", F.col("__before") + F.sum("__c").over(inside))
    holds = lambda r: (F.col("__upto") - F.col("__c") < r) & (F.col("__upto") >= r)
    found = ((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2).alias(name)
    return both.groupBy(*by).agg(found) if by else both.agg(found)
