"""The flagship report: from crossed responses, or from shards, to what of each language gap is identified."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dif, drift, panel, scores
from ..session import cut, few
from ..sources import shards as S
from ..sources.specs import BenchmarkSpec
from .fit import drift_with_errors, fit, gap_errors, point


@dataclass(frozen=True)
class Report:
    rows: DataFrame
    summary: DataFrame


def analyse(responses: DataFrame, source, shares: DataFrame | None = None, pi: float = 0.5, tau: float = 0.30, alpha: float = 0.05, n_boot: int = 20, seed: int = 0) -> Report:
    """Per language and over all. ``responses`` is crossed (model, item, language, correct); ``shares`` has mode_share by (model, language).

    The source must be there and the panel crossed, or the report fails before anything is fitted. The tolerance and the bounds' widening
    absorb estimation noise: tau + 2 median(se of non-source drift), and 2 median(se of mean gaps, the source's 0 among them).
    """
    boot = fit(responses, source, n_boot, seed)
    one = point(boot)
    gap_se = cut(gap_errors(boot))
    rest = F.col("language") != F.lit(source)
    d = cut(drift_with_errors(boot).withColumn("se", F.greatest("se", F.lit(1e-6))))
    half, wide = (t.first()[0] for t in (panel_median(d.where(rest), "se"), panel_median(gap_se, "gap_se")))
    tau_used, inflate = tau + 2 * half, 2 * wide
    tests = dif.wald_tests(d.select("language", "delta", "se"), source, alpha)
    counts = tests.where(rest).groupBy("language").agg(F.sum(F.col("rejected").cast("long")).alias("dif_rejected"), F.avg(F.col("rejected").cast("double")).alias("dif_frac"), F.count(F.lit(1)).alias("dif_tested"))
    values = drift.alike(d)
    sets = few(cut(drift.identified_sets(values, pi, tau_used, source=source, times="times")))
    gaps = cut(one.gaps)
    bounds = drift.bound_summary(drift.gap_bounds(gaps, sets.where(~F.col("refuted")), inflate))
    anchored = drift.anchored_gaps(gaps, drift.median_anchor(values, source=source, times="times")).groupBy("language").agg(F.avg("gap_anchored").alias("gap_median_anchored"))
    acc = scores.source_gap(boot.margins.select("model", "language", (F.col("score") / F.col("n")).alias("accuracy")), "accuracy", source)
    accuracy = acc.groupBy("language").agg(F.avg(F.col("accuracy") + F.col("gap")).alias("acc_source"), F.avg("accuracy").alias("acc_target"), F.avg("gap").alias("raw_acc_gap"))
    if shares is None:
        shares = gaps.select("model", "language", F.lit(None).cast("double").alias("mode_share"))
    ok = ~scores.degenerate(F.col("mode_share"))
    robust = gaps.join(shares, ["model", "language"], "left").groupBy("language").agg(
        F.avg("mode_share").alias("mode_share_mean"), F.sum((~ok).cast("long")).alias("n_degenerate"), F.sum(ok.cast("long")).alias("n_nondegenerate"), scores.robust_mean(ok, F.col("gap")).alias("breakeven_robust")
    )
    be = drift.breakeven(gaps, d).select("language", F.col("breakeven").alias("breakeven_drift"), F.col("drift_sd").alias("observed_drift_sd"), F.col("ratio").alias("breakeven_in_sd"))
    rows = be.where(rest)
    # a row per language each: worked out by itself and broadcast, so that no task sorts for all the joins at once
    for other in (accuracy, anchored, counts, robust, gap_se, sets.select("language", F.col("lo").alias("c_set_lo"), F.col("hi").alias("c_set_hi"), "refuted")):
        rows = rows.join(few(cut(other)), "language")
    rows = rows.join(few(cut(bounds)), "language", "left").withColumn("irt_gap_naive", F.col("breakeven_drift"))
    rows = cut(rows.withColumn("breakeven_robust_in_sd", F.when(F.col("observed_drift_sd") > 0, F.abs("breakeven_robust") / F.col("observed_drift_sd")).otherwise(F.lit(float("inf")))))
    below = lambda c: F.sum((F.col(c) < 1).cast("long"))
    zero = F.sum(F.coalesce(F.col("contains_zero"), F.lit(False)).cast("long"))
    cells = F.sum(F.col("n_degenerate") + F.col("n_nondegenerate"))
    summary = rows.agg(
        F.count(F.lit(1)).alias("n_languages_tested"), F.lit(pi).alias("pi"), F.lit(tau).alias("tau_nominal"), F.lit(tau_used).alias("tau_effective"), F.lit(inflate).alias("inflate"), F.lit(alpha).alias("alpha"), F.lit(n_boot).alias("n_boot"),
        F.lit(half).alias("median_delta_se"), F.sum("dif_rejected").alias("dif_n_rejected"), F.sum("dif_tested").alias("dif_n_tested"), (F.sum("dif_rejected") / F.sum("dif_tested")).alias("dif_frac_rejected"),
        zero.alias("n_languages_gap_contains_zero"), (zero / F.count(F.lit(1))).alias("frac_languages_gap_contains_zero"), F.avg("interval_width").alias("mean_interval_width"), (F.sum("n_degenerate") / cells).alias("frac_shards_degenerate"),
        F.median("breakeven_in_sd").alias("median_breakeven_in_sd"), below("breakeven_in_sd").alias("n_gaps_breakeven_below_1sd"), below("breakeven_robust_in_sd").alias("n_gaps_breakeven_robust_below_1sd"),
        F.median("breakeven_robust_in_sd").alias("median_breakeven_robust_in_sd"),
    )
    return Report(rows, summary)


def panel_median(table: DataFrame, value: str) -> DataFrame:
    """One row: the exact median over all rows."""
    from ..operators.ordered import medians

    return medians(table, [], value)


def latex_table(rows: DataFrame) -> DataFrame:
    """One row with a LaTeX tabular body, languages in order; a dagger marks bounds that contain zero."""
    line = F.format_string("%s & %.3f & %.3f & [%.2f, %.2f]%s & %.2f \\\\", F.col("language").cast("string"), "raw_acc_gap", "irt_gap_naive", "bound_lo", "bound_hi", F.when(F.col("contains_zero"), "$^\\dagger$").otherwise(""), "breakeven_in_sd")
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col("language").cast("string").alias("k"), line.alias("line")))), lambda x: x["line"])
    return rows.agg(F.array_join(lines, "\n").alias("latex"))


# from shards ---------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Assembled:
    """The cells (model, item, language, correct) and shares (model, language, mode_share) of one benchmark, one row about its shards, and those that are missing."""

    responses: DataFrame
    shares: DataFrame
    status: DataFrame
    missing: DataFrame


def assemble(rows: DataFrame, meta: DataFrame | None = None) -> Assembled:
    """A crossed panel from shard rows (model, language, item_id, correct, predicted) of one benchmark and mode; items are matched by id, so their order in a shard doesn't matter.

    All shards must hold the item set of the first one by model, then language: else a ``ValueError`` names the first that doesn't. Shares come
    from ``meta`` (model, language, mode_share) where it has them (NaN: options mean nothing), else from the predictions.
    """
    rows = rows.select("model", "language", "item_id", "correct", "predicted")
    done = cut(rows.select("model", "language").distinct())
    first = done.orderBy("model", "language").first()
    reference = rows.where((F.col("model") == first.model) & (F.col("language") == first.language)) if first else rows
    if not panel.same_sets(rows, done, "item_id"):
        differing = panel.set_differences(rows, reference, "item_id").where("extra > 0 OR missing > 0").orderBy("model", "language").first()
        raise ValueError(f"shard {differing.model}/{differing.language} has other items than {first.model}/{first.language}: {differing.extra} extra, {differing.missing} missing")
    missing = panel.missing_cells(done, "model", "language")
    shares = scores.mode_share(rows, "model", "language").select("model", "language", "mode_share")
    if meta is not None:
        known = meta.where("mode_share IS NOT NULL").select("model", "language", F.col("mode_share").alias("known")).distinct()
        shares = shares.join(known, ["model", "language"], "left").select("model", "language", F.coalesce("known", "mode_share").alias("mode_share"))
    status = done.agg(F.count(F.lit(1)).alias("n_shards"), F.count_distinct("model").alias("n_models"), F.count_distinct("language").alias("n_languages"))
    status = status.crossJoin(reference.agg(F.count_distinct("item_id").alias("n_items"))).withColumn("n_expected", F.col("n_models") * F.col("n_languages"))
    return Assembled(rows.select("model", F.col("item_id").alias("item"), "language", "correct"), shares, status, missing)


def completed(found: Assembled) -> Assembled:
    """The panel with every answer of a missing shard counted as wrong and its share as 1, as an incomplete analysis has it."""
    ids = found.responses.select("item").distinct()
    more = found.missing.crossJoin(ids).select("model", "item", "language", F.lit(0).cast(found.responses.schema["correct"].dataType).alias("correct"))
    return Assembled(found.responses.union(more), found.shares.union(found.missing.select("model", "language", F.lit(1.0))), found.status, found.missing)


def analyse_shards(rows: DataFrame, spec: BenchmarkSpec, meta: DataFrame | None = None, allow_incomplete: bool = False, **kw) -> tuple[Assembled, Report]:
    """``assemble`` and ``analyse`` of one benchmark. A missing shard, or source language, is a ``ValueError``; ``allow_incomplete`` lets missing shards pass (``completed``)."""
    found = assemble(rows, meta)
    if some := found.missing.orderBy("model", "language").limit(5).collect():
        if not allow_incomplete:
            raise ValueError(f"{spec.name} is incomplete, without " + ", ".join(f"{r.model}/{r.language}" for r in some))
        found = completed(found)
    panel.require_source(found.shares, spec.source_language)
    return found, analyse(found.responses, spec.source_language, found.shares, **kw)


def record(spec: BenchmarkSpec, found: Assembled, report: Report) -> DataFrame:
    """One row: the benchmark, its axes, the summary and the languages' rows as an array."""
    axes = found.shares.agg(F.array_sort(F.collect_set("model")).alias("models"), F.array_sort(F.collect_set("language")).alias("languages"))  # small dimensions
    rows = report.rows.agg(F.array_sort(F.collect_list(F.struct("language", *[c for c in report.rows.columns if c != "language"]))).alias("rows"))
    return found.status.crossJoin(axes).crossJoin(report.summary).crossJoin(rows).withColumn("benchmark", F.lit(spec.name)).withColumn("source_language", F.lit(spec.source_language))


def analyse_all(spark: SparkSession, path: str, specs: dict[str, BenchmarkSpec], out: str, mode: str = "letter", names: list[str] | None = None, allow_incomplete: bool = False, archives: bool = False, **kw) -> DataFrame:
    """Each benchmark's shards under ``path`` to a JSON record and a LaTeX table under ``out``, and all records together to ``out/summary``.

    Returns (benchmark, status, reason): analysed, skipped (no shards) or refused. Generative benchmarks are read in their own mode. Benchmarks and their
    shards meet by name; the loop is over specifications, which are few.
    """
    wanted = [specs[n] for n in names] if names else list(specs.values())
    states, done = [], []
    known = None if archives else {r.benchmark for r in S.catalogue(spark, path).select("benchmark").distinct().collect()}
    for spec in wanted:
        how = "generative" if spec.task == "generative" else mode
        if known is not None and spec.name not in known:
            states.append((spec.name, "skipped", "no shards"))
            continue
        rows = S.with_meta(cut(S.read_archives(spark, path, spec.name, how))) if archives else S.read(spark, path, spec.name, how)
        if rows.isEmpty():
            states.append((spec.name, "skipped", "no shards"))
            continue
        meta = rows.select("model", "language", "meta.mode_share").distinct() if archives else None
        try:
            found, report = analyse_shards(rows, spec, meta, allow_incomplete, **kw)
        except ValueError as e:
            states.append((spec.name, "refused", str(e)))
            continue
        one = cut(record(spec, found, report))
        one.coalesce(1).write.mode("overwrite").json(f"{out}/{spec.name}")
        latex_table(report.rows).coalesce(1).write.mode("overwrite").text(f"{out}/tables/{spec.name}")
        states.append((spec.name, "analysed", None))
        done.append(one)
    if done:
        every = done[0]
        for d in done[1:]:
            every = every.unionByName(d, allowMissingColumns=True)
        every.write.mode("overwrite").json(f"{out}/summary")
    return spark.createDataFrame(states, "benchmark string, status string, reason string")


def as_json(records: DataFrame) -> DataFrame:
    """(benchmark, json): records as JSON text."""
    return records.select("benchmark", F.to_json(F.struct(*records.columns)).alias("json"))

