"""Tests for unusual drift of single items, with the false discovery rate controlled over the whole grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import tail_p, wald_z
from ..session import cut
from .ordered import running


def benjamini_hochberg(tests: DataFrame, alpha: float = 0.05, p: str = "p", by: list[str] | None = None) -> DataFrame:
    """``tests`` with ``rejected``, over all rows or each group ``by``.

    A p-value's rank is the number of values up to it. Equal values are counted first, and ranks are running sums over ranges of
    values, so no task orders the whole grid. Values above alpha can't be rejected and come after all that can: they are counted, not ranked.
    Rejection by the cutoff's value is safe under ties. ``tests`` is read four times: cut it if p is costly.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must be in (0, 1)")
    by = by or []
    counts = tests.where(F.col(p).isNull() | (F.col(p) <= alpha)).groupBy(*by, p).agg(F.count(F.lit(1)).alias("c"))
    total = tests.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    ranked = running(counts, by, p, {"k": "c"})
    ranked = ranked.join(total, by) if by else ranked.crossJoin(F.broadcast(total))  # one row
    cut = ranked.groupBy(*by).agg(F.max(F.when(F.col(p) <= alpha * F.col("k") / F.col("n"), F.col(p))).alias("cutoff"))
    joined = tests.join(total.join(cut, by, "left").drop("n"), by) if by else tests.crossJoin(F.broadcast(cut))  # one row
    return joined.withColumn("rejected", F.coalesce(F.col(p) <= F.col("cutoff"), F.lit(False))).drop("cutoff")


def wald_tests(drift: DataFrame, source: str | int, alpha: float = 0.05, language: str = "language") -> DataFrame:
    """Drift (delta, se) with z, p and rejected; the source is never tested (z 0, p 1)."""
    is_source = F.col(language) == F.lit(source)
    z = wald_z(F.col("delta"), F.col("se"))
    tested = drift.where(~is_source).withColumn("z", z).withColumn("__x", F.abs("z") / F.sqrt(F.lit(2.0))).withColumn("p", tail_p(F.col("__x"))).drop("__x")
    tested = benjamini_hochberg(cut(tested), alpha)
    return tested.unionByName(drift.where(is_source).withColumn("z", F.lit(0.0)).withColumn("p", F.lit(1.0)).withColumn("rejected", F.lit(False)))


def rejections(tests: DataFrame, source: str | int, language: str = "language") -> DataFrame:
    """(language, n_tested, n_rejected, frac_rejected) of every tested language, and with language null over all."""
    return tests.where(F.col(language) != F.lit(source)).rollup(language).agg(F.count(F.lit(1)).alias("n_tested"), F.sum(F.col("rejected").cast("int")).alias("n_rejected"), F.avg(F.col("rejected").cast("double")).alias("frac_rejected"))
