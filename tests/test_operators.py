"""Panels, scores, identified sets and tests against small known cases and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgauge.operators import dif, drift, panel, scores
from driftgauge.operators.ordered import medians, running


def stabbing_set(d, pi, tau):
    """The shifts c for which at least ceil(pi n) of d + c are within tau, by ranks: between sorted d[j] and d[j + k - 1]."""
    d, k, out = np.sort(d), int(np.ceil(pi * len(d) - 1e-9)), []
    for j in range(len(d) - k + 1):
        lo, hi = d[j + k - 1] - tau, d[j] + tau
        if lo <= hi:
            if out and lo <= out[-1][1] + 1e-9:
                out[-1] = (out[-1][0], max(hi, out[-1][1]))
            else:
                out.append((lo, hi))
    return [(-b, -a) for a, b in reversed(out)]


def ids(spark, **langs):
    return spark.createDataFrame([(lang, i) for lang, xs in langs.items() for i in xs], "lang string, item_id string")


def selected(spark, cap, seed=1, **langs):
    return sorted(r[0] for r in panel.select_items(ids(spark, **langs), cap, seed)[0].collect())


def test_selection(spark):
    hundred = [f"i{n}" for n in range(100)]
    assert selected(spark, None, en="abc", sw="ab") == ["a", "b"]
    assert selected(spark, 2, en="abcd", fr="dcba") == selected(spark, 2, en="dcba", fr="abcd")
    one, two = selected(spark, 10, 1, en=hundred, fr=hundred), selected(spark, 10, 2, en=hundred, fr=hundred)
    assert one == selected(spark, 10, 1, en=hundred, fr=hundred) and one != two and len(one) == 10
    assert set(selected(spark, 5, 1, en=hundred, fr=hundred)) < set(one)
    assert selected(spark, 999, en="abc", fr="abc") == ["a", "b", "c"]
    with pytest.raises(ValueError):
        panel.select_items(ids(spark, en="a", fr="b"), None, 1)


def test_coverage(spark):
    covered = panel.select_items(ids(spark, en="abc", sw="ab"), None, 1)[1]
    assert {r.lang: (r.n_total, r.n_unshared) for r in covered.collect()} == {"en": (3, 1), "sw": (2, 0)}
    with pytest.raises(ValueError, match="en"):
        panel.check_parallel(covered)


def test_malformed(spark):
    rows = [(lang, i, lang == "fr" and i == 7) for lang in ("en", "fr") for i in range(100)]
    df = spark.createDataFrame(rows, "lang string, item_id int, malformed boolean")
    assert panel.drop_malformed(df).count() == 198
    with pytest.raises(ValueError):
        panel.drop_malformed(df.withColumn("malformed", F.col("item_id") < 3))


def test_design(spark):
    df = spark.createDataFrame([("a", "en"), ("a", "fr"), ("b", "en")], "model string, language string")
    assert [tuple(r) for r in panel.missing_cells(df, "model", "language").collect()] == [("b", "fr")]
    grid = spark.createDataFrame([(c,) for c in "dacb"], "m string")
    assert sorted(r[0] for r in panel.grid_slice(grid, ["m"], 1, 2).collect()) == ["b", "d"]
    last = panel.last_rows(spark.createDataFrame([("en", "x", 1, "old"), ("en", "x", 2, "new")], "lang string, item_id string, n int, v string"), "n")
    assert last.first().v == "new"
    a = spark.createDataFrame([(m, x) for m in "abcd" for x in ("en", "fr", "de")], "model string, language string")
    first, second = panel.common_panel(a, a.where("model <> 'a'"), "model", "language", least={"model": 3, "language": 3})
    assert first.count() == second.count() == 9
    with pytest.raises(ValueError):
        panel.common_panel(a, a.where("model <> 'a'"), "model", least={"model": 4})


def test_mode_share(spark):
    rows = [("letter", "a", 0)] * 9 + [("letter", "b", -1)] * 2 + [("letter", "c", 1), ("letter", "c", 1), ("letter", "c", 2), ("letter", "c", -1)] + [("generative", "d", 1)] * 3
    df = spark.createDataFrame(rows, "mode string, model string, predicted int")
    got = {r.model: r.mode_share for r in scores.mode_share(df, "model", "mode", mode="mode").collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": pytest.approx(2 / 3), "d": None}
    flagged = spark.createDataFrame([(0.95,), (0.9,), (float("nan"),), (None,)], "s double").select(scores.degenerate(F.col("s"))).collect()
    assert [r[0] for r in flagged] == [True, False, False, False]


def test_option_scores(spark):
    inf = float("-inf")
    rows = [([1.0, 3.0, 3.0], 1), ([inf, inf], -1), ([inf, -2.0], 1), ([], -1), ([None, 0.5], 1)]
    df = spark.createDataFrame(rows, "s array<double>, want int")
    assert all(r.want == r.got for r in df.withColumn("got", scores.first_best(F.col("s"))).collect())
    r = spark.sql("SELECT array(-1D, -2D, -4D) AS lp").select(scores.continuation_mean(F.col("lp"), 1), scores.continuation_mean(F.col("lp"), 3), scores.group_best(F.col("lp"), [[0, 1], [2]])).first()
    assert (r[0], r[1], r[2]) == (-3.0, inf, [-1.0, -4.0])


def test_scorer(spark):
    df = spark.createDataFrame([("x", "en", "q\nAnswer:", ["a", "b"])], "item_id string, language string, prompt string, options array<string>")
    made = lambda: lambda f: f.assign(predicted=0)[["item_id", "predicted"]]
    assert scores.scored(df, made, "item_id string, predicted int").collect()[0].predicted == 0
    with pytest.raises(Exception, match="fewer than two"):
        scores.scored(df.withColumn("options", F.array(F.lit("a"))), made, "item_id string, predicted int").collect()
    with pytest.raises(ValueError):
        scores.scored(df, made, "item_id string", mode="other")
    assert [r.prompt for r in scores.option_rows(df).orderBy("option").collect()] == ["q\nAnswer: a", "q\nAnswer: b"]


def test_generative_marks(spark):
    df = spark.createDataFrame([("so 42.", "42"), ("41", "42"), ("none", "42")], "t string, g string")
    assert [(r.predicted, r.correct) for r in scores.marked_numbers(df, "t", "g").collect()] == [(1, 1), (0, 0), (-1, 0)]


def test_identified_sets_against_ranks(spark):
    rng = np.random.default_rng(5)
    d = {k: rng.normal(0, 0.5, 80) for k in range(1, 4)}
    d[3] = np.concatenate((np.full(40, -1.0), np.full(40, 1.0)))  # two parts
    d[4] = np.arange(30.0)  # refuted
    rows = [(k, float(x)) for k, xs in d.items() for x in xs] + [(0, 0.0)] * 5
    got = {r.language: r for r in drift.identified_sets(spark.createDataFrame(rows, "language int, delta double"), 0.4, 0.3, source=0).collect()}
    for k, xs in d.items():
        want = stabbing_set(xs, 0.4, 0.3)
        assert len(want) == got[k].n_parts and all(abs(a - b.lo) < 1e-9 and abs(c - b.hi) < 1e-9 for (a, c), b in zip(want, got[k].parts, strict=True))
    assert got[4].refuted and got[3].n_parts == 2 and (got[0].lo, got[0].hi) == (0.0, 0.0)
    with pytest.raises(ValueError):
        drift.require_unrefuted(drift.identified_sets(spark.createDataFrame(rows, "language int, delta double"), 0.4, 0.3, source=0))
    with pytest.raises(ValueError):
        drift.stabbed_parts(spark.createDataFrame(rows, "language int, delta double"), 0.0, 0.3)


def test_bounds_and_anchor(spark):
    gaps = spark.createDataFrame([("m", 1, 0.5), ("n", 1, 0.9)], "model string, language int, gap double")
    sets = spark.createDataFrame([(1, -0.2, 0.6)], "language int, lo double, hi double")
    s = drift.bound_summary(drift.gap_bounds(gaps, sets, 0.1)).first()
    assert (s.bound_lo, s.bound_hi, s.contains_zero) == (pytest.approx(0.0), pytest.approx(1.0), True)
    d = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 4.0), (1, 10.0), (0, 5.0)], "language int, delta double")
    assert {r.language: r.c for r in drift.median_anchor(d, source=0).collect()} == {1: -3.0, 0: 0.0}
    flat = spark.createDataFrame([(1, 0.0, 0.1), (1, 0.0, 0.1)], "language int, delta double, se double")
    assert drift.breakeven(gaps, flat).first().ratio == float("inf")


def test_benjamini_hochberg(spark):
    rng = np.random.default_rng(1)
    p = np.round(np.concatenate((rng.uniform(0, 0.01, 20), rng.uniform(0, 1, 80))), 3)
    order, n = np.sort(p), len(p)
    k = np.flatnonzero(order <= 0.05 * np.arange(1, n + 1) / n)
    cut = order[k[-1]] if len(k) else -1
    got = dif.benjamini_hochberg(spark.createDataFrame([(float(x),) for x in p], "p double")).collect()
    assert sum(r.rejected for r in got) == (p <= cut).sum() and all(r.rejected == (r.p <= cut) for r in got)
    assert dif.benjamini_hochberg(spark.createDataFrame([], "p double")).count() == 0


def test_ranks_and_medians(spark):
    rng = np.random.default_rng(4)
    xs = {"a": np.round(rng.normal(0, 1, 301), 1), "b": np.array([0.0, -0.0, 5e-324, -1e300, 1e300, 7.0]), "c": 10.0 ** rng.uniform(-20, 20, 200) * rng.choice([-1, 1], 200), "d": np.array([3.0])}
    rows = [(g, float(x), 1) for g, v in xs.items() for x in v] + [("e", None, 1)]
    df = spark.createDataFrame(rows, "g string, x double, one int")
    got = {r.g: r["median"] for r in medians(df, ["g"], "x").collect()}
    assert got == {g: np.median(v) for g, v in xs.items()}
    assert medians(df.where("g = 'a'"), [], "x").first()[0] == np.median(xs["a"])
    counted = df.where("x IS NOT NULL").groupBy("g", "x").agg(F.count(F.lit(1)).alias("c"))
    for r in running(counted, ["g"], "x", {"upto": "c", "twice": "c"}).collect():
        assert r.upto == r.twice == (xs[r.g] <= r.x).sum()


def test_ranks_of_close_values_and_of_text_are_spread(spark):
    n, conf = 100_000, "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        base = spark.range(n).select("id", F.lit(1).alias("one"))
        close = base.withColumn("x", 5 + F.col("id") / (1000.0 * n))
        seconds = base.withColumn("x", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 86_400))
        text = base.withColumn("x", F.format_string("item %07d", "id"))
        for rows in (close, text, seconds):
            done = running(rows, [], "x", {"upto": "one"}, ["id"])
            plan = done._jdf.queryExecution().executedPlan().toString()
            assert "__range" in plan
            got = done.groupBy().agg(F.min("upto"), F.max("upto"), F.count_distinct("upto")).first()
            assert tuple(got) == (1, n, n)
        parts = close.repartitionByRange("x").groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) == 4 and max(r["count"] for r in parts) < n / 2
        order = running(text, [], "x", {"upto": "one"}).select("id", "upto").where("id + 1 <> upto")
        assert order.isEmpty()
    finally:
        spark.conf.set(conf, before)


def test_kendall_counts_pairs_without_forming_them(spark):
    from driftgauge.plans.ablations import kendall

    rng = np.random.default_rng(8)
    groups = {"ties": (rng.integers(0, 9, 400), rng.integers(0, 5, 400)), "wide": (rng.normal(size=300), rng.normal(size=300)), "same": (np.arange(50), np.arange(50)), "turned": (np.arange(50), -np.arange(50)), "flat": (np.ones(9), np.arange(9)), "one": (np.ones(1), np.ones(1))}
    rows = [(g, float(a), float(b)) for g, (x, y) in groups.items() for a, b in zip(x, y, strict=True)] + [("ties", None, 1.0), ("ties", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r.tau for r in kendall(df, "x", "y", ["g"]).collect()}
    for g, (x, y) in groups.items():
        s, t = np.sign(np.subtract.outer(x, x)), np.sign(np.subtract.outer(y, y))
        down = np.sqrt(np.abs(s).sum() * np.abs(t).sum())
        assert got[g] is None if down == 0 else got[g] == pytest.approx((s * t).sum() / down), g
    assert kendall(df.where("g = 'ties'"), "x", "y", ["g"]).count() == 1 and kendall(df.limit(0), "x", "y", ["g"]).count() == 0


def test_language_sets(spark):
    rows = [("en", "a"), ("en", "a"), ("en", "b"), ("fr", "a"), ("fr", "c"), (None, "a"), ("en", None)]
    df = spark.createDataFrame(rows, "lang string, item_id string")
    sets = panel.language_sets(df)
    assert [r.item_id for r in panel.shared_of(sets).collect()] == ["a"]
    assert {(r.lang, r.n_total, r.n_unshared) for r in panel.coverage_of(sets).collect()} == {("en", 3, 1), ("fr", 2, 1)}
    assert panel.coverage_of(panel.language_sets(df.limit(0))).count() == 0


def test_no_window_over_a_whole_language(spark):
    d = spark.createDataFrame([(i, i % 3, float(i % 50), 0.1) for i in range(3000)], "item int, language int, delta double, se double")
    for df in (dif.wald_tests(d, 0), drift.median_anchor(d, source=0), drift.stabbed_parts(d, 0.5, 0.3), drift.centred(d, "delta", "language"), scores.source_gap(d.withColumn("model", F.col("item")), "delta", 0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # windows are over the sums of ranges, over the rows of one range, or over the few ends of stretches
        assert all("__range" in line or "kind" in line for line in plan.split("\n") if "Window [" in line), plan


def test_normal_tail_is_accurate(spark):
    import math

    from driftgauge.functions import stats

    z = [0.0, 1e-8, 0.1, 0.5, 1.0, 1.96, 2.5, 2.83, 3.0, 5.0, 8.0, 12.0, 25.0, -4.0]
    for r in spark.createDataFrame([(x,) for x in z], "z double").select("z", stats.two_sided_p(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-11)
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "z double").select(stats.two_sided_p(F.col("z")).alias("p")).collect()
    assert [r.p for r in odd] == [1.0, 1.0, 0.0] and stats.minimax_floor(0.3) == 0.3
    with pytest.raises(ValueError):
        stats.minimax_floor(-1)


def test_arguments_are_checked(spark):
    d = spark.createDataFrame([(1, 0.0), (1, float("nan"))], "language int, delta double")
    for bad in ((0.0, 0.3), (1.5, 0.3), (0.5, -0.1), (0.5, float("inf")), (0.5, float("nan"))):
        with pytest.raises(ValueError):
            drift.stabbed_parts(d, *bad)
    with pytest.raises(ValueError):
        drift.gap_bounds(d, d, -1.0)
    for bad in (float("nan"), float("inf"), None):
        rows = spark.createDataFrame([(1, 0.0), (1, bad)], "language int, delta double")
        with pytest.raises(Exception, match="finite"):
            drift.median_anchor(rows).collect()
        with pytest.raises(Exception, match="finite"):
            drift.stabbed_parts(rows, 0.5, 0.3).collect()


def test_gates(spark):
    cells = spark.createDataFrame([(m, lang, i) for m in "ab" for lang in ("en", "fr") for i in range(3) if (m, lang, i) != ("b", "fr", 2)], "model string, language string, item int")
    panel.require_source(cells, "en")
    with pytest.raises(ValueError, match="de"):
        panel.require_source(cells, "de")
    with pytest.raises(ValueError, match="model b, language fr, item 2"):
        panel.require_complete(cells, "model", "language", "item")
    panel.require_complete(cells.where("item < 2"), "model", "language", "item")
    lone = cells.where("NOT (model = 'b' AND language = 'fr')")
    assert sorted(r.item for r in panel.missing_cells(lone, "model", "language", "item").collect()) == [0, 1, 2]


def test_letter_tokens(spark):
    shown = [(1, "A"), (2, "\u2581A"), (3, " A"), (4, "\u010aA"), (5, "\u0120B"), (6, "AB"), (7, "a"), (8, "\u2581\u2581B"), (9, None), (10, "\nC ")]
    vocabulary = spark.createDataFrame(shown, "id int, token string")
    assert [(r.option, r.letter, r.ids) for r in scores.letter_tokens(vocabulary, 2).orderBy("option").collect()] == [(0, "A", [1, 2, 3, 4]), (1, "B", [5, 8])]
    with pytest.raises(ValueError, match="no token for C, D"):
        scores.letter_tokens(vocabulary, 4)
    with pytest.raises(ValueError):
        scores.letter_tokens(vocabulary, 0)


def test_stabbing_counts_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    data = [(lang, float(x)) for lang in ("fr", "de") for x in np.round(rng.normal(0, 1, 300), 1)]
    bad = [("fr", None), ("fr", float("nan")), ("fr", float("inf")), ("de", float("-inf"))]
    shifts = [("fr", float(c)) for c in np.arange(-16, 17) / 8] + [("de", 0.0), ("de", 0.0), ("sw", 0.0), ("fr", None)]
    points = spark.createDataFrame(shifts, "language string, c double")
    got = {(r.language, r.c): r.n for r in drift.stabbing_counts(points, spark.createDataFrame(data + bad, "language string, delta double"), 0.25).collect()}
    for lang, c in set(shifts):
        want = 0 if c is None else sum(-0.25 - c <= d <= 0.25 - c for x, d in data if x == lang)
        assert got[lang, c] == want * shifts.count((lang, c))
    assert len(got) == len(set(shifts)) and max(got.values()) > 20
