"""Work that must grow no faster than the tables: spread over tasks, and not shuffled by cell."""

import contextlib
import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftgauge.functions import stats
from driftgauge.operators import dif, drift, ordered, panel
from driftgauge.plans import ablations, fit, joint, report, steps
from driftgauge.plans import queries as Q
from driftgauge.sources import views as V


@contextlib.contextmanager
def no_own_broadcast(spark):
    """Small tables stand for large ones: Spark broadcasts nothing of its own accord."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_common_panel_shuffles_no_cells(spark, sf):
    y = V.crossed(spark, sf)
    with no_own_broadcast(spark):
        a, b = panel.common_panel(y, y.where("model < 20 AND language < 4"), "model", "language", least={"model": 4, "language": 3})
        assert "SortMergeJoin" not in plan(a) and "SortMergeJoin" not in plan(b)
    assert a.count() == b.count() == y.where("model < 20 AND language < 4").count()


def test_replicates_are_looked_up_and_not_shuffled(spark, sf):
    with no_own_broadcast(spark):
        f = fit.fit(V.crossed(spark, sf), 0, n_boot=2)
        assert "SortMergeJoin" not in plan(f.drift) and "SortMergeJoin" not in plan(f.both)
    one = {(r.item, r.language): r for r in fit.drift_with_errors(f).collect()}
    se = {(r.item, r.language): r.se for r in fit.bootstrap_errors(f)[0].collect()}
    assert set(one) == set(se) and all(one[k].se == pytest.approx(se[k]) for k in se)
    assert all(one[r.item, r.language].delta == pytest.approx(r.delta) for r in fit.point(f).drift.collect())


def test_more_models_than_bits(spark):
    y = spark.range(70).crossJoin(spark.range(3).toDF("item")).crossJoin(spark.range(2).toDF("language")).select(F.col("id").alias("model"), "item", "language", ((F.col("id") * 7 + F.col("item") * 3 + F.col("language")) % 2).alias("correct"))
    assert fit.fit(y, 0).gaps.count() == 140
    twice = y.where("model <> 69 OR item <> 1 OR language <> 1").union(y.where("model = 68 AND item = 1 AND language = 1"))  # a model twice, another not at all
    with pytest.raises(ValueError, match="isn't crossed"):
        fit.fit(twice, 0)


def test_arms_shuffle_no_cells(spark, sf, monkeypatch):
    kept = []
    monkeypatch.setattr(ablations, "dispersion", lambda d, g: kept.append(d) or d)
    y = V.crossed(spark, sf)
    with no_own_broadcast(spark):
        ablations.translation_arms({"machine": y.where("item % 2 = 0"), "human": y.where("item % 2 = 1")}, 0)
        assert "SortMergeJoin" not in plan(kept[0])


def test_same_sets(spark):
    cells = spark.range(130).crossJoin(spark.range(4).toDF("item_id")).select(F.col("id").alias("model"), (F.col("id") % 3).alias("language"), "item_id")
    shards = cells.select("model", "language").distinct()
    assert panel.same_sets(cells, shards) and panel.same_sets(cells.union(cells), shards)
    assert not panel.same_sets(cells.where("model <> 127 OR item_id <> 2"), shards)
    more = cells.union(spark.createDataFrame([(5, 2, 9)], cells.schema))
    assert not panel.same_sets(more, shards)


def test_shards_are_compared_without_their_rows(spark, sf, monkeypatch):
    def refuse(*a, **k):
        raise AssertionError("rows of shards that agree were compared one by one")

    monkeypatch.setattr(panel, "set_differences", refuse)
    rows = V.crossed(spark, sf).select("model", "language", F.col("item").cast("string").alias("item_id"), "correct", (F.col("item") % 4).cast("smallint").alias("predicted"))
    found = report.assemble(rows)
    assert found.status.first().n_shards == 125 and found.missing.isEmpty()


def test_items_stop_when_they_are_done():
    rng = np.random.default_rng(1)
    y = (rng.random((6, 8, 3)) < 0.5).astype(float)
    y[5] = 1.0  # goes on to the bound
    w, theta, push = np.ones_like(y), rng.normal(size=(8, 3)), np.array([0.0, 0.1, -0.1])
    whole = joint.solve_items(y, w, theta, push, 1e-3, 0)
    for i in range(6):
        for a, b in zip(whole, joint.solve_items(y[i : i + 1], w[i : i + 1], theta, push, 1e-3, 0), strict=True):
            assert (a[i] == b[0]).all()


def test_cells_are_made_in_many_tasks_by_item(spark, sf):
    y = V.crossed(spark, sf)
    assert y.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert y.select("item", F.spark_partition_id().alias("p")).distinct().groupBy("item").count().where("count > 1").isEmpty()


def test_drift_comes_with_difficulty(spark, sf):
    with no_own_broadcast(spark):
        assert "SortMergeJoin" not in plan(Q.QUERIES["rasch_drift"](spark, sf))


def test_score_equations_join_no_cells(spark, sf):
    with no_own_broadcast(spark):
        text = plan(Q.QUERIES["score_equations"](spark, sf))
    assert "SortMergeJoin [item" not in text and "sha2" not in text


def test_drift_is_made_in_many_tasks_and_meets_models_last(spark, sf):
    assert V.drift(spark, sf).select(F.spark_partition_id().alias("p")).distinct().count() > 4
    with no_own_broadcast(spark):
        text = plan(Q.QUERIES["fisher_se"](spark, sf))
    # items meet their difficulty before the models make cells of them: no sort holds cells
    assert text.index("BroadcastNestedLoopJoin") >= 0 and text.index("BroadcastHashJoin [language") < text.index("SortMergeJoin [item")


def test_decomposition_sorts_no_cells(spark, sf):
    with no_own_broadcast(spark):
        text = plan(Q.QUERIES["accuracy_decomposition"](spark, sf))
    assert text.index("BroadcastHashJoin [language") < text.index("SortMergeJoin [item")


def test_manifest_groups_items_in_many_tasks(spark, sf, monkeypatch):
    seen = []
    real = panel.select_items
    monkeypatch.setattr(panel, "select_items", lambda items, *a, **k: seen.append(items) or real(items, *a, **k))
    assert Q.QUERIES["manifest"](spark, sf).first().n_items == 40
    assert seen[0].select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_whole_benchmarks_keeps_no_rows_besides_the_sinks(spark, sf, monkeypatch):
    kept = []
    monkeypatch.setattr(Q, "cut", lambda d, real=Q.cut: kept.append(d.columns) or real(d))
    assert Q.QUERIES["whole_benchmarks"](spark, sf).first().benchmark == "exam"
    assert kept == [["benchmark", "mode", "model", "language"]]


def counted(spark, cells, column):
    """``cells`` whose ``column`` goes through a function that counts in the accumulator how often it is made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def once(x):
        made.add(1)
        return x

    return cells.withColumn(column, once(column)), made


def grid(spark, models=6, items=8, languages=3):
    y = spark.range(models).crossJoin(spark.range(items).toDF("item")).crossJoin(spark.range(languages).toDF("language"))
    return y.select(F.col("id").cast("int").alias("model"), "item", F.col("language").cast("int").alias("language"), ((F.col("id") * 7 + F.col("item") * 5 + F.col("language") * 3) % 4 < 2).cast("int").alias("correct"))


def test_common_panel_passes_over_each_panel_once(spark):
    a, made_a = counted(spark, grid(spark), "model")
    b, made_b = counted(spark, grid(spark).where("model < 5"), "model")
    panel.common_panel(a, b, "model", "language", least={"model": 4, "language": 3})
    assert (made_a.value, made_b.value) == (144, 120)


def test_fit_makes_cells_once(spark):
    y, made = counted(spark, grid(spark), "correct")
    f = fit.fit(y, 0, n_boot=3)
    f.drift.collect(), f.gaps.collect(), f.margins.collect(), fit.drift_with_errors(f).collect()
    assert made.value == 144


def test_fit_refuses_what_is_neither_right_nor_wrong(spark):
    with pytest.raises(ValueError, match="neither 0 nor 1"):
        fit.fit(grid(spark).withColumn("correct", F.col("correct") * 2), 0)


def test_replicates_are_kept_as_bits(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(fit, "cut", lambda d, real=fit.cut: kept.append(d) or real(d))
    f = fit.fit(grid(spark), 0, n_boot=5)
    assert all(t.dataType.typeName() != "array" for d in kept if "item" in d.columns for t in d.schema)
    assert "Generate" not in plan(f.drift)  # no item's scores are unrolled from an array


def test_mask_makes_no_numbers_of_digests(spark):
    cells = grid(spark, items=60).crossJoin(spark.range(2).select(F.col("id").cast("int").alias("seed")))
    assert "conv(" not in plan(cells.select(fit.kept(0.1)))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", "seed", "model", "item", "language")), 1, 8), 16, 10).cast("long") / float(1 << 32)
    for holdout in (0.0, 0.1, 0.25, 1 / 3, 0.999999):
        assert cells.where(fit.kept(holdout) != (u >= holdout)).isEmpty()


def test_weights_of_replicates_count_bits(spark):
    y = grid(spark, models=70, items=5).withColumn("correct", ((F.col("model") * 31 + F.col("item") * 17 + F.col("language") * 5) % 7 < 3).cast("int"))
    f = fit.fit(y, 0, n_boot=1, seed=3)
    cells = y.toPandas().merge(fit.resamples(list(range(70)), 1, 3), on="model")
    score = (cells.correct * cells.weight).groupby([cells.rep, cells.item, cells.language]).sum()
    for rep in range(2):
        for language in range(3):
            weight = cells[(cells.rep == rep) & (cells.language == language)].drop_duplicates("model").sort_values("model")
            people = y.where(F.col("language") == language).groupBy("model").agg(F.sum("correct").alias("s")).orderBy("model").toPandas()
            _, beta = fit.solve_margins(people.s.to_numpy(float), weight.weight.to_numpy(float), score[rep].unstack()[language].to_numpy(float))
            if language == 0:
                base = beta
            got = f.drift.where((F.col("rep") == rep) & (F.col("language") == language)).orderBy("item").toPandas().delta
            assert np.allclose(got, beta - base, atol=1e-8)


def test_alike_items_are_counted_before_models(spark, sf):
    text = plan(Q.QUERIES["score_equations"](spark, sf))
    assert any("keys=[language" in x and ", b" in x and ", delta" in x for x in text.splitlines())


def test_grouping_sets_expand_sums_and_not_cells(spark, sf):
    text = plan(Q.QUERIES["accuracy_grouping_sets"](spark, sf))
    assert text.index("Expand") < text.index("sha2")
    assert "HashAggregate" in text[text.index("Expand") : text.index("sha2")]


def test_two_parameter_steps_over_blocks_are_the_dense_fits(spark, monkeypatch):
    y = grid(spark, models=7, items=40).where("(model + 2 * item + 3 * language) % 5 > 0").withColumn("correct", ((F.col("model") * 31 + F.col("item") * 17 + F.col("language") * 5) % 7 < 3).cast("int"))
    cells = y.crossJoin(spark.range(2).select(F.col("id").cast("int").alias("seed"))).withColumn("keep", fit.kept(0.2))
    monkeypatch.setattr(steps, "_ITEMS", 8)
    one = {r.seed: r for r in steps.held_out(cells, 1, 60).collect()}  # blocks in one worker
    monkeypatch.setattr(steps, "_FEW", 0)
    monkeypatch.setattr(steps, "_KEEP", 25)
    assert {r.seed: r for r in steps.held_out(cells, 1, 60).collect()} == one  # blocks dealt over workers: the same sums in the same order
    for seed, f in cells.toPandas().groupby("seed"):
        at = tuple(f[c].to_numpy() for c in ("model", "item", "language"))
        right, keep, held = np.zeros((7, 40, 3)), np.zeros((7, 40, 3), bool), np.zeros((7, 40, 3), bool)
        right[at], keep[at], held[at] = f.correct, f.keep, ~f.keep
        d = fit.adam(right, keep, model="2pl", source=1, steps=60)
        e = d.eta()[held]
        assert one[seed].steps == d.steps == 60 and one[seed].loss == pytest.approx(np.mean(np.logaddexp(0, e) - right[held] * e), abs=1e-9)


def test_two_parameter_fits_stop_by_themselves(spark, monkeypatch):
    cells = grid(spark).crossJoin(spark.range(2).select(F.col("id").cast("int").alias("seed"))).withColumn("keep", fit.kept(0.2))
    monkeypatch.setattr(steps, "descend", lambda *a, real=steps.descend: real(*a, tol=6e-3))
    monkeypatch.setattr(steps, "_ITEMS", 2)
    monkeypatch.setattr(steps, "_FEW", 0)
    taken = {r.seed: r.steps for r in steps.held_out(cells, 0, 60).collect()}
    for seed, f in cells.toPandas().groupby("seed"):
        at = tuple(f[c].to_numpy() for c in ("model", "item", "language"))
        right, keep = np.zeros((6, 8, 3)), np.zeros((6, 8, 3), bool)
        right[at], keep[at] = f.correct, f.keep
        assert taken[seed] == fit.adam(right, keep, model="2pl", steps=60, tol=6e-3).steps < 60


def test_each_seed_takes_its_steps_in_a_task_of_its_own(spark):
    seeds = spark.range(4).select(F.col("id").cast("int").alias("seed"))
    cells = grid(spark).crossJoin(seeds).withColumn("keep", fit.kept(0.2))
    tasks = [r.task for r in steps.held_out(cells, 0, 2).withColumn("task", F.spark_partition_id()).collect()]
    assert len(tasks) == len(set(tasks)) == 4


def test_cells_of_equally_many_are_computed_together():
    r = np.random.default_rng(0)
    item, at = np.nonzero(r.random((300, 21)) < 0.5)
    keep, y = r.random(len(at)) < 0.9, r.random(len(at)) < 0.5
    b = steps.block(0, 0, pd.Series(item), at, y, keep, 3)
    assert len(b.wide()) <= 7 and sum(x[1].size for x in b.wide()) == keep.sum()  # as many as there are numbers of cells, not of slots
    got = {(b.slot[of][j], x) for of, x_at, _, _ in b.wide() for x_of in x_at for j, x in enumerate(x_of)}
    assert got == set(zip((item * 3 + at % 3)[keep], at[keep], strict=True))
    right = {(b.slot[of][j], x_of[j]) for of, x_at, half, _ in b.wide() for x_of, h in zip(x_at, half, strict=True) for j in np.flatnonzero(h > 0)}
    assert right == set(zip((item * 3 + at % 3)[keep & y], at[keep & y], strict=True))


def test_threads_and_blocks_do_not_change_the_steps():
    r = np.random.default_rng(1)
    item, at = np.nonzero(r.random((200, 21)) < 0.5)
    y, keep = r.random(len(at)) < 0.5, r.random(len(at)) < 0.9

    def taken(order: list[int], threads: int):
        blocks = [steps.block(0, i, pd.Series(item[item % 4 == i]), at[item % 4 == i], y[item % 4 == i], keep[item % 4 == i], 3) for i in order]
        with ThreadPoolExecutor(threads) as pool:
            each = lambda f, told: list(pool.map(lambda b: ((b.panel, b.number), f(b, told[b.panel])), blocks))
            return steps.descend(each, each, {0: int(keep.sum())}, {0: 200}, 7, 3, 1, 300)[0]

    assert taken([0, 1, 2, 3], 1) == taken([2, 0, 3, 1], 3)


def test_crossval_works_its_responses_out_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(c):
        made.add(1)
        return c

    y = grid(spark).withColumn("correct", F.udf(counted, "int")("correct"))
    rows = y.count()
    made.value = 0
    assert len(fit.crossval(y, 0, seeds=(0, 1), steps=2).collect()) == 4 and made.value == rows


@pytest.mark.parametrize("models", [6, 70])
def test_errors_are_looked_up_without_a_row_per_replicate(spark, monkeypatch, models):
    y = grid(spark, models=models, items=40).withColumn("correct", ((F.col("model") * 31 + F.col("item") * 17 + F.col("language") * 5) % 7 < 3).cast("int")).withColumn("language", F.concat(F.lit("l"), F.col("language").cast("string")))
    f = fit.fit(y, "l0", n_boot=5)
    d = fit.drift_with_errors(f)
    assert "rep#" not in plan(d) and "Aggregate" not in plan(d) and "Exchange" not in plan(d)
    got = {(r.item, r.language): r for r in d.collect()}
    rows = f.drift.toPandas().set_index(["item", "language"])
    assert len(got) == 120
    for k, r in rows.groupby(level=[0, 1]):
        assert got[k].delta == pytest.approx(r.delta[r.rep == 0].item(), abs=1e-12) and got[k].se == pytest.approx(r.delta[r.rep > 0].std(ddof=1), abs=1e-12)
    monkeypatch.setattr(fit, "_LOOKED_UP", 0)  # very many solutions
    for r in fit.drift_with_errors(fit.fit(y, "l0", n_boot=5)).collect():
        assert (r.delta, r.se) == (pytest.approx(got[r.item, r.language].delta, abs=1e-12), pytest.approx(got[r.item, r.language].se, abs=1e-12))
    assert all(r.se is None for n in (0, 1) for r in fit.drift_with_errors(fit.fit(y, "l0", n_boot=n)).collect())


def test_only_what_can_be_rejected_is_ranked(spark, monkeypatch):
    ranked = []
    monkeypatch.setattr(dif, "running", lambda rows, *a, real=dif.running: ranked.append(rows) or real(rows, *a))
    p = [0.001, 0.002, 0.002, 0.03, 0.04, 0.06, 0.5, 0.9, 1.0, None]
    rows = spark.createDataFrame([(g, x) for g in "ab" for x in (p if g == "a" else [0.3, 0.7])], "g string, p double")
    got = dif.benjamini_hochberg(rows, 0.05, by=["g"]).collect()
    assert ranked[0].where("p > 0.05").isEmpty() and ranked[0].count() == 5
    assert len(got) == 12 and sorted(r.p for r in got if r.rejected) == [0.001, 0.002, 0.002]  # a group without any keeps its rows


def test_medians_order_only_the_middle(spark, monkeypatch):
    rows = spark.range(4000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 4001).cast("double").alias("x"), (F.col("id") % 4).alias("times"))
    held = []
    monkeypatch.setattr(ordered, "few", lambda d, real=ordered.few: held.append(d) or real(d))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.g: r["median"] for r in ordered.medians(rows, ["g"], "x").collect()}
        often = {r.g: r["median"] for r in ordered.medians(rows, ["g"], "x", times="times").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(h.count() <= 6 for h in held) and len(held) == 2
    for g, f in rows.toPandas().groupby("g"):
        assert got[g] == np.median(f.x) and often[g] == np.median(np.repeat(f.x, f.times))


def test_equal_drift_is_counted_once(spark):
    d = spark.range(900).select((F.col("id") % 3).cast("int").alias("language"), (((F.col("id") * 7) % 20) / 10.0 - 1).cast("double").alias("delta"))
    one = drift.alike(d)
    assert one.count() == 60 and one.agg(F.sum("times")).first()[0] == 900
    assert sorted(map(repr, drift.identified_sets(one, 0.5, 0.3, source=0, times="times").collect())) == sorted(map(repr, drift.identified_sets(d, 0.5, 0.3, source=0).collect()))
    assert sorted(drift.median_anchor(one, source=0, times="times").collect()) == sorted(drift.median_anchor(d, source=0).collect())


def test_p_values_are_made_in_generated_code(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(dif, "cut", lambda d, real=dif.cut: kept.append(plan(d)) or real(d))
    z = [0.0, 1e-9, 0.4, 0.66, 0.67, 1.0, 3.0, 5.6, 5.7, 9.0, 20.0, 37.0]
    rows = dif.wald_tests(spark.createDataFrame([(1, s * x, 1.0) for x in z for s in (1.0, -1.0)] + [(0, 0.0, 1.0)], "language int, delta double, se double"), 0).where("language = 1").collect()
    assert "transform(" not in kept[0] and len(rows) == 24
    assert all(r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-12) for r in rows)
    odd = spark.createDataFrame([(x,) for x in (float("inf"), float("nan"), None)], "x double").select(stats.tail_p(F.col("x"))).collect()
    assert [r[0] for r in odd] == [0.0, 1.0, 1.0]
