"""Identification of gaps under unseen uniform drift: identified sets, anchors, bounds and break-even drift.

Fitted drift is (item, language, delta); gaps are (model, language, gap). A language's drift is known up to a shift c.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals
from ..functions.stats import logistic, needed
from ..session import cut
from .ordered import medians, running

MERGE = 1e-9


def _check(pi: float, tau: float, inflate: float = 0.0) -> None:
    if not 0 < pi <= 1:
        raise ValueError("pi must be in (0, 1]")
    if not (0 <= tau < float("inf") and 0 <= inflate < float("inf")):
        raise ValueError("tau and inflate must be finite and not negative")


def checked(drift: DataFrame, delta: str = "delta") -> DataFrame:
    """``drift``, whose values fail when they are read if one is null, NaN or infinite; a part of the value, so that no other filter runs before."""
    fine = F.coalesce(F.abs(F.col(delta)) < float("inf"), F.lit(False))
    return drift.withColumn(delta, F.when(fine, F.col(delta)).otherwise(F.raise_error(F.lit("drift must be finite"))))


def alike(drift: DataFrame, by: str = "language", delta: str = "delta") -> DataFrame:
    """(by, delta, times): how many items have each drift, from one pass. Drift of a margins fit has no more values than pairs of scores, whatever the items."""
    return cut(drift.groupBy(by, delta).agg(F.count(F.lit(1)).alias("times")))


def stabbed_parts(drift: DataFrame, pi: float, tau: float, by: str = "language", delta: str = "delta", times: str | None = None) -> DataFrame:
    """(by, lo, hi): the maximal stretches of u where at least ceil(pi n) of the intervals delta -+ tau overlap, by an event sweep.

    Opening ends sort before closing ones at the same place, so closed intervals that touch overlap. Equal ends are counted first (``times``: how often a row counts);
    how many intervals are open is a running sum over ranges of places, so a language isn't ordered in one task. The ends of stretches are few.
    """
    _check(pi, tau)
    each = F.lit(1) if times is None else F.col(times)
    k = drift.groupBy(by).agg(needed(pi, F.sum(each)).alias("k"))
    events = checked(drift, delta).select(by, each.alias("each"), F.explode(F.array(F.struct((F.col(delta) - tau).alias("pos"), F.lit(1).alias("kind")), F.struct((F.col(delta) + tau).alias("pos"), F.lit(-1).alias("kind")))).alias("e")).select(by, "each", "e.*")
    events = cut(events.groupBy(by, "pos", "kind").agg(F.sum(F.col("kind") * F.col("each")).alias("c")).withColumn("turn", -F.col("kind")))
    run = running(events, [by], "pos", {"open": "c"}, ["turn"]).join(k, by)
    before = F.col("open") - F.col("c")
    ends = run.where(((before < F.col("k")) & (F.col("open") >= F.col("k"))) | ((before >= F.col("k")) & (F.col("open") < F.col("k"))))
    # the n-th place where enough intervals are open and the n-th where they no longer are make a part
    numbered = ends.withColumn("nth", F.row_number().over(Window.partitionBy(by, "kind").orderBy("pos")))
    return numbered.groupBy(by, "nth").agg(F.max(F.when(F.col("kind") == 1, F.col("pos"))).alias("lo"), F.max(F.when(F.col("kind") == -1, F.col("pos"))).alias("hi")).drop("nth")


def merged_parts(parts: DataFrame, by: str = "language", slack: float = MERGE) -> DataFrame:
    """Parts whose distance is ``slack`` at most become one: islands by a running maximum. The parts of one set are few: they become one row."""
    before = Window.partitionBy(by).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(by).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = F.coalesce((F.col("lo") > F.max("hi").over(before) + slack).cast("int"), F.lit(1))
    return parts.withColumn("new", new).withColumn("island", F.sum("new").over(upto)).groupBy(by, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def identified_sets(drift: DataFrame, pi: float, tau: float, by: str = "language", source: str | None = None, delta: str = "delta", times: str | None = None) -> DataFrame:
    """(by, parts, n_parts, lo, hi, width, measure, refuted): the sharp set of each language's shift; the source's is {0}.

    A language whose assumption no shift meets is ``refuted`` and has no parts. ``times``: how often a row counts.
    """
    rest = drift if source is None else drift.where(F.col(by) != F.lit(source))
    found = merged_parts(stabbed_parts(rest, pi, tau, by, delta, times), by).groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col("hi")).alias("lo"), (-F.col("lo")).alias("hi")))).alias("parts"))
    langs = rest.groupBy(by).agg(F.max(F.abs(F.col(delta))).alias("most"))
    flat = F.array(F.struct(F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")))
    sets = langs.join(found, by, "left").select(by, F.when(F.col("most") <= 1e-8, flat).otherwise(F.coalesce("parts", F.array().cast(intervals.TYPE))).alias("parts"))
    if source is not None:
        sets = sets.unionByName(drift.where(F.col(by) == F.lit(source)).select(by).distinct().withColumn("parts", flat))
    s = F.col("parts")
    some = F.size(s) > 0
    return sets.select(
        by, "parts", F.size(s).alias("n_parts"),
        F.when(some, F.try_element_at(s, F.lit(1))["lo"]).alias("lo"), F.when(some, F.try_element_at(s, F.lit(-1))["hi"]).alias("hi"),
        F.when(some, F.try_element_at(s, F.lit(-1))["hi"] - F.try_element_at(s, F.lit(1))["lo"]).alias("width"),
        F.when(some, intervals.measure(s)).alias("measure"), (~some).alias("refuted"),
    )


def require_unrefuted(sets: DataFrame, by: str = "language") -> DataFrame:
    """Strict mode: an empty set is an error."""
    bad = sets.where("refuted").limit(1).collect()
    if bad:
        raise ValueError(f"no shift meets the assumption for {bad[0][by]}: lower pi or raise tau")
    return sets


def gap_bounds(gaps: DataFrame, sets: DataFrame, inflate: float = 0.0, by: str = "language") -> DataFrame:
    """(gaps' columns, bound_lo, bound_hi): a gap less the ends of its language's set, widened."""
    _check(1.0, 0.0, inflate)
    ends = sets.select(by, F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
    return gaps.join(ends, by).withColumn("bound_lo", F.col("gap") - F.col("__hi") - inflate).withColumn("bound_hi", F.col("gap") - F.col("__lo") + inflate).drop("__lo", "__hi")


def bound_summary(bounds: DataFrame, by: str = "language") -> DataFrame:
    """Means of the bounds over models; zero is contained if the extremes over models enclose it."""
    return bounds.groupBy(by).agg(F.avg("bound_lo").alias("bound_lo"), F.avg("bound_hi").alias("bound_hi"), F.avg(F.col("bound_hi") - F.col("bound_lo")).alias("interval_width"), ((F.min("bound_lo") <= 0) & (F.max("bound_hi") >= 0)).alias("contains_zero"))


def median_anchor(drift: DataFrame, by: str = "language", source: str | None = None, delta: str = "delta", times: str | None = None) -> DataFrame:
    """(by, c): the shift that gives each language's drift a median of 0; exact, 0 for the source. ``times``: how often a row counts."""
    c = -F.col("__m")
    return medians(checked(drift, delta), [by], delta, "__m", times).select(by, (c if source is None else F.when(F.col(by) == F.lit(source), 0.0).otherwise(c)).alias("c"))


def certified_anchor(drift: DataFrame, certified: DataFrame, by: str = "language", delta: str = "delta") -> DataFrame:
    """(by, c): the shift that gives the certified items (by, item) of each language a mean drift of 0."""
    return drift.join(certified.select(by, "item").distinct(), [by, "item"], "left_semi").groupBy(by).agg((-F.avg(delta)).alias("c"))


def stabbing_counts(points: DataFrame, drift: DataFrame, tau: float, by: str = "language", delta: str = "delta") -> DataFrame:
    """(by, c, n): how many items of its language each shift (by, c) leaves within tau, that is whose drift is from -tau - c to tau - c, ends included.

    A sweep: the drifts up to the upper end less those before the lower one, from one running sum over ranges of places; no shift is compared with each drift.
    Drift that isn't finite is within nothing; a shift that comes twice counts twice.
    """
    _check(1.0, tau)
    held = drift.where(F.abs(delta) < float("inf")).groupBy(by, F.col(delta).cast("double").alias("pos")).agg(F.count(F.lit(1)).alias("hits"))
    end = lambda side: F.struct((side * tau - F.col("c")).alias("pos"), F.lit(side).alias("side"))
    ends = points.select(by, "c", F.explode(F.array(end(-1), end(1))).alias("e")).select(by, "c", "e.*", F.lit(0).cast("long").alias("hits"))
    swept = running(ends.unionByName(held.withColumn("side", F.lit(0)), allowMissingColumns=True), [by], "pos", {"upto": "hits"}, ["side"])
    return swept.where("side <> 0").groupBy(by, "c").agg(F.sum(F.col("side") * F.col("upto")).alias("n"))


def anchored_gaps(gaps: DataFrame, anchors: DataFrame, by: str = "language") -> DataFrame:
    return gaps.join(anchors.select(by, "c"), by).withColumn("gap_anchored", F.col("gap") - F.col("c")).drop("c")


def breakeven(gaps: DataFrame, drift: DataFrame, by: str = "language", weight: str | None = None) -> DataFrame:
    """(by, breakeven, drift_sd, ratio): the uniform drift that erases the mean gap, in units of the visible drift's noise-corrected sd; infinite if that is 0. ``drift`` has ``se``."""
    mean = F.avg("gap") if weight is None else F.try_divide(F.sum(F.col(weight) * F.col("gap")), F.sum(weight))
    sd = F.sqrt(F.greatest(F.var_pop("delta") - F.avg(F.col("se") * F.col("se")), F.lit(0.0)))
    both = gaps.groupBy(by).agg(mean.alias("breakeven")).join(drift.groupBy(by).agg(sd.alias("drift_sd")), by)
    return both.withColumn("ratio", F.when(F.col("drift_sd") > 0, F.abs("breakeven") / F.col("drift_sd")).otherwise(F.lit(float("inf"))))


def predictor(cells: DataFrame, ability: DataFrame, difficulty: DataFrame, drift: DataFrame) -> DataFrame:
    """Cells (model, item, language) with eta = a (theta - b - delta), a = 1 if drift has none. Parameters join on their keys; small ones broadcast by size."""
    out = cells.join(ability.select("model", "language", "theta"), ["model", "language"]).join(difficulty.select("item", "b"), "item")
    out = out.join(drift.select("item", "language", "delta", *(["a"] if "a" in drift.columns else [])), ["item", "language"])
    eta = F.col("theta") - F.col("b") - F.col("delta")
    return out.withColumn("eta", F.col("a") * eta if "a" in drift.columns else eta)


def drift_se(predicted: DataFrame, *kept: str) -> DataFrame:
    """(item, language, se, kept): from the Fisher information of each cell's models; ``kept`` are columns that don't differ between models."""
    p = logistic(F.col("eta"))
    info = F.sum(p * (1 - p))
    if "a" in predicted.columns:
        info = info * F.first("a") * F.first("a")
    return predicted.groupBy("item", "language").agg((1 / F.sqrt(F.greatest(info, F.lit(1e-12)))).alias("se"), *[F.first(c).alias(c) for c in kept])


def centred(values: DataFrame, value: str, *by: str) -> DataFrame:
    """``value`` less its mean over each group: difference in differences, sum-zero drift. Means are aggregated and joined back, so a hot group isn't gathered."""
    means = values.groupBy(*by).agg(F.avg(value).alias("__mean"))
    return values.join(means, list(by)).withColumn(value, F.col(value) - F.col("__mean")).drop("__mean")


def normalised(ability: DataFrame, difficulty: DataFrame, drift: DataFrame, source: str | int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ability, difficulty, drift) under one normalisation that keeps every logit: drift (item, language, delta) is 0 at the source and has mean 0
    in each language, and source abilities have mean 0.

    Drift at the source moves into difficulty, each language's mean drift into its abilities, and the mean source ability into difficulty.
    """
    is_source = F.col("language") == F.lit(source)
    base = drift.where(is_source).select("item", F.col("delta").alias("__base"))
    d = drift.join(base, "item", "left").withColumn("delta", F.col("delta") - F.coalesce("__base", F.lit(0.0))).drop("__base")
    b = difficulty.join(base, "item", "left").withColumn("b", F.col("b") + F.coalesce("__base", F.lit(0.0))).drop("__base")
    means = d.groupBy("language").agg(F.avg("delta").alias("__mean"))
    d = d.join(means, "language").withColumn("delta", F.when(is_source, 0.0).otherwise(F.col("delta") - F.col("__mean"))).drop("__mean")
    a = ability.join(means, "language", "left").withColumn("theta", F.col("theta") - F.coalesce("__mean", F.lit(0.0))).drop("__mean")
    centre = F.broadcast(a.where(is_source).agg(F.avg("theta").alias("__centre")))  # one row
    return a.crossJoin(centre).withColumn("theta", F.col("theta") - F.col("__centre")).drop("__centre"), b.crossJoin(centre).withColumn("b", F.col("b") - F.col("__centre")).drop("__centre"), d


def rescaled(ability: DataFrame, difficulty: DataFrame, drift: DataFrame, source: str | int, floor: float = 1e-3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A two-parameter fit with source abilities of unit sample sd: abilities, difficulty and drift divided by it, ``a`` multiplied, so that logits stay."""
    sd = F.broadcast(ability.where(F.col("language") == F.lit(source)).agg(F.greatest(F.stddev_samp("theta"), F.lit(floor)).alias("__sd")))  # one row
    by = lambda t, *cols: t.crossJoin(sd).withColumns({c: F.col(c) * F.col("__sd") if c == "a" else F.col(c) / F.col("__sd") for c in cols}).drop("__sd")
    return by(ability, "theta"), by(difficulty, "b"), by(drift, "delta", "a")
