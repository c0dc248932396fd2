"""Robustness reports from fitted or given parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.drift import breakeven, drift_se
from ..operators.ordered import medians, running
from ..operators.panel import common_panel
from ..operators.scores import degenerate
from ..session import cut, few


def agreement(drift_a: DataFrame, drift_b: DataFrame, gaps_a: DataFrame, gaps_b: DataFrame) -> DataFrame:
    """Two scoring modes on the same cells: correlation of drift per language (mean, least), of mean gaps, and their mean distance. The source is left out by the caller."""
    r = drift_a.select("item", "language", F.col("delta").alias("x")).join(drift_b.select("item", "language", F.col("delta").alias("y")), ["item", "language"]).groupBy("language").agg(F.corr("x", "y").alias("r"))
    mean = lambda g, c: g.groupBy("language").agg(F.avg("gap").alias(c))
    g = mean(gaps_a, "a").join(mean(gaps_b, "b"), "language")
    first = r.agg(F.avg("r").alias("drift_corr_mean"), F.min("r").alias("drift_corr_min"))
    second = g.agg(F.count(F.lit(1)).alias("n_languages"), F.corr("a", "b").alias("gap_corr"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("gap_mean_abs_diff"), F.avg("a").alias("gap_a_mean"), F.avg("b").alias("gap_b_mean"))
    return first.crossJoin(second)  # one row each


def dispersion(drift: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per translation arm (``arm`` in drift, and in gaps if it has one): items, mean drift sd, mean gap, median break-even in sd."""
    sd = F.sqrt(F.greatest(F.var_pop("delta") - F.avg(F.col("se") * F.col("se")), F.lit(0.0)))
    by = ["arm", "language"] if "arm" in gaps.columns else ["language"]
    per = drift.groupBy("arm", "language").agg(F.count(F.lit(1)).alias("n"), sd.alias("sd")).join(gaps.groupBy(*by).agg(F.avg("gap").alias("gap")), by)
    ratio = F.when(F.col("sd") > 0, F.abs("gap") / F.col("sd")).otherwise(F.lit(float("inf")))
    return per.groupBy("arm").agg(F.max("n").alias("n_items"), F.avg("sd").alias("drift_sd_mean"), F.avg("gap").alias("gap_mean"), F.median(ratio).alias("breakeven_in_sd_median"))


def dispersion_ratio(arms: DataFrame, over: str = "machine", under: str = "human") -> DataFrame:
    of = lambda a: F.max(F.when(F.col("arm") == a, F.col("drift_sd_mean")))
    return arms.agg((of(over) / F.greatest(of(under), F.lit(1e-9))).alias("ratio"))


def position_bias(shares: DataFrame, worst: int = 3) -> DataFrame:
    """One row: mean modal share, its sd across languages, the share of collapsed cells, the worst languages (ties by name)."""
    by_language = shares.groupBy("language").agg(F.avg("mode_share").alias("m"))
    first = shares.agg(F.avg("mode_share").alias("mode_share_mean"), F.avg(degenerate(F.col("mode_share")).cast("double")).alias("frac_degenerate"))
    spread = by_language.agg(F.stddev_pop("m").alias("mode_share_by_language_sd"))
    top = by_language.orderBy(F.desc("m"), "language").limit(worst).agg(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("k"), "language"))).alias("w"))
    return first.crossJoin(spread).crossJoin(top).withColumn("worst_languages", F.transform("w", lambda x: x["language"])).drop("w")


def kendall(values: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, tau): Kendall's tau-b of each group's rows, corrected for ties; null where x or y doesn't vary. Rows that lack x or y don't count.

    Pairs are counted, not formed: two ranks of y differ first in one binary digit, so each row stands once per digit in the group of the digits before it, and
    meets there the rows of smaller x as a running sum. Rows grow as n log n, and no task holds a group.
    """
    cells = cut(values.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("c")))
    places = running(cells.select(*by, "y").distinct().withColumn("one", F.lit(1)), by, "y", {"place": "one"})
    digits = int(places.agg(F.max("place")).first()[0] or 1).bit_length()
    rows = cells.join(places.select(*by, "y", "place"), [*by, "y"]).withColumn("digit", F.explode(F.sequence(F.lit(0), F.lit(digits - 1))))
    rows = rows.withColumns({"before": F.expr("shiftright(place, digit + 1)"), "own": F.expr("shiftright(place, digit) & 1")})
    met = rows.groupBy(*by, "digit", "before", "x").agg(F.sum(F.when(F.col("own") == 1, F.col("c")).otherwise(0)).alias("ones"), F.sum(F.when(F.col("own") == 0, F.col("c")).otherwise(0)).alias("zeros"))
    run = running(met, [*by, "digit", "before"], "x", {"upto_ones": "ones", "upto_zeros": "zeros"})
    agree = F.col("ones") * (F.col("upto_zeros") - F.col("zeros")) - F.col("zeros") * (F.col("upto_ones") - F.col("ones"))
    score = run.groupBy(*by).agg(F.sum(agree).alias("score"))
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    apart = score
    for side in ("x", "y"):
        ties = cells.groupBy(*by, side).agg(F.sum("c").alias("n")).groupBy(*by).agg(F.sum(pairs("n")).alias("tied"), F.sum("n").alias("n"))
        apart = apart.join(ties.select(*by, (pairs("n") - F.col("tied")).alias(f"apart_{side}")), by)
    return apart.select(*by, F.try_divide("score", F.sqrt(F.col("apart_x") * F.col("apart_y"))).alias("tau"))


def scoring_modes(first: DataFrame, second: DataFrame, source: str, **kw) -> DataFrame:
    """``agreement`` of two response tables on their common models and languages, after fitting both."""
    from .fit import fit

    a, b = common_panel(first, second, "model", "language", least={"model": 4, "language": 3})
    fa, fb = fit(a, source, **kw), fit(b, source, **kw)
    rest = lambda d: d.where(F.col("language") != F.lit(source))
    return agreement(rest(fa.drift), rest(fb.drift), rest(fa.gaps), rest(fb.gaps))


def breakeven_of_modes(modes: dict[str, DataFrame], source, n_boot: int = 20, tau: float = 0.30, seed: int = 0) -> DataFrame:
    """One row per scoring mode, on the models and languages that both modes have: the report's break-even with bootstrap errors.

    (mode, n_models, n_languages, median_ratio over finite ratios, n_below_1sd, drift_sd, mean_gap, median_delta_se, tau_effective).
    """
    from .fit import drift_with_errors, fit, point

    (name_a, a), (name_b, b) = modes.items()
    a, b = common_panel(a, b, "model", "language", least={"model": 1, "language": 1})
    out = None
    for name, cells in ((name_a, a), (name_b, b)):
        boot = fit(cells, source, n_boot, seed)
        rest = lambda d: d.where(F.col("language") != F.lit(source))
        d, g = cut(rest(drift_with_errors(boot)).withColumn("se", F.greatest("se", F.lit(1e-6)))), rest(point(boot).gaps)
        ratio = F.when(F.col("ratio") < float("inf"), F.col("ratio"))
        per = breakeven(g, d).agg(F.count(F.lit(1)).alias("n_languages"), F.median(ratio).alias("median_ratio"), F.count(F.when(F.col("ratio") < 1, 1)).alias("n_below_1sd"), F.avg("drift_sd").alias("drift_sd"))
        row = g.agg(F.count_distinct("model").alias("n_models"), F.avg("gap").alias("mean_gap")).crossJoin(per).crossJoin(medians(d, [], "se", "median_delta_se"))
        row = row.select(F.lit(name).alias("mode"), "n_models", "n_languages", "median_ratio", "n_below_1sd", "drift_sd", "mean_gap", "median_delta_se", (tau + 2 * F.col("median_delta_se")).alias("tau_effective"))
        out = row if out is None else out.union(row)
    return out


def translation_arms(arms: dict[str, DataFrame], source) -> DataFrame:
    """``dispersion`` of two translations of a benchmark on their common models and languages (items differ), each fitted by itself, with analytic errors of drift."""
    from .fit import fit, point

    (name_a, a), (name_b, b) = arms.items()
    a, b = common_panel(a, b, "model", "language", least={"model": 4, "language": 3})
    drifts = gaps = None
    for name, cells in ((name_a, a), (name_b, b)):
        one = point(fit(cells, source))
        # an item's models are added by a broadcast, so its cells are summed where they are made
        cells = one.both.join(few(one.ability), "language").withColumn("eta", F.col("theta") - F.col("b") - F.col("delta"))
        rest = lambda d: d.where(F.col("language") != F.lit(source)).withColumn("arm", F.lit(name))  # noqa: B023, E731
        d, g = rest(drift_se(cells, "delta")), rest(one.gaps)
        drifts, gaps = (d, g) if drifts is None else (drifts.union(d), gaps.union(g))
    return dispersion(drifts, gaps)


def benchmark_wins(losses: DataFrame) -> DataFrame:
    """Cross-validation records: losses (benchmark, seed, irt_model, loss) to means per class, gain and winner."""
    of = lambda m: F.avg(F.when(F.col("irt_model") == m, F.col("loss")))
    out = losses.groupBy("benchmark").agg(of("rasch").alias("loss_rasch"), of("2pl").alias("loss_2pl"))
    return out.withColumn("gain", F.col("loss_rasch") - F.col("loss_2pl")).withColumn("winner", F.when(F.col("gain") > 0, "2pl").otherwise("rasch")).withColumn("wins_2pl", F.sum((F.col("gain") > 0).cast("int")).over(Window.partitionBy()))
