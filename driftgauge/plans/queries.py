"""The engine's own queries over the test tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import items as I
from ..functions import numerals
from ..functions.stats import erfc_sql, log_loss, logistic
from ..operators import dif, drift, panel, scores
from ..session import cut, few, spread
from ..sources import views as V
from . import oracles as O
from .claims import CLAIMS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PI, TAU = 0.5, 0.3


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r6(c: str | F.Column) -> F.Column:
    return F.round(c, 6)


def long(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# responses ---------------------------------------------------------------------------------------------------------
@query(f"""WITH a AS (SELECT model, language, avg(correct) AS acc FROM {V.crossed_sql()} GROUP BY 1, 2), g AS (SELECT *, max(CASE WHEN language = 0 THEN acc END) OVER (PARTITION BY model) - acc AS gap FROM a)
  SELECT language, round(avg(acc), 6) AS accuracy, round(avg(gap), 6) AS raw_gap, count(*) AS n_models FROM g GROUP BY 1""")
def acc_by_language(spark, sf):
    acc = cut(scores.accuracy(V.crossed(spark, sf), "model", "language"))
    return scores.source_gap(acc, "accuracy", V.SOURCE).groupBy("language").agg(r6(F.avg("accuracy")).alias("accuracy"), r6(F.avg("gap")).alias("raw_gap"), F.count(F.lit(1)).alias("n_models"))


@query(f"""WITH a AS (SELECT model, language, avg(correct) AS acc, count(*) AS n_items FROM {V.crossed_sql()} GROUP BY 1, 2)
  SELECT model, language, round(acc, 6) AS accuracy, n_items, round(acc - avg(acc) OVER (PARTITION BY language), 6) + 0.0 AS centred FROM a""")
def acc_by_model_language(spark, sf):
    acc = cut(scores.accuracy(V.crossed(spark, sf), "model", "language")).withColumn("centred", F.col("accuracy"))
    return drift.centred(acc, "centred", "language").select("model", "language", r6("accuracy").alias("accuracy"), "n_items", (r6("centred") + F.lit(0.0)).alias("centred"))


@query(f"""WITH c AS (SELECT model, language, predicted, count(*) AS c FROM {V.PREDICTIONS} GROUP BY ALL)
  SELECT model, language, round(coalesce(max(CASE WHEN predicted >= 0 THEN c END) / sum(CASE WHEN predicted >= 0 THEN c END), 1.0), 6)::DOUBLE AS mode_share, coalesce(sum(CASE WHEN predicted >= 0 THEN c END), 0)::BIGINT AS n_valid,
  coalesce(max(CASE WHEN predicted >= 0 THEN c END) / sum(CASE WHEN predicted >= 0 THEN c END), 1.0) > 0.9 AS degenerate FROM c GROUP BY 1, 2""")
def mode_share(spark, sf):
    m = scores.mode_share(V.predictions(spark, sf), "model", "language")
    return m.select("model", "language", r6("mode_share").alias("mode_share"), long("n_valid").alias("n_valid"), scores.degenerate(F.col("mode_share")).alias("degenerate"))


@query(f"SELECT model, language, round(avg(CASE WHEN predicted < 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS unparseable, avg(CASE WHEN predicted < 0 THEN 1.0 ELSE 0.0 END) > 0.15 AS flagged FROM {V.PREDICTIONS} GROUP BY 1, 2")
def unparseable_rate(spark, sf):
    return scores.unparseable_rate(V.predictions(spark, sf), "model", "language").select("model", "language", r6("unparseable").alias("unparseable"), (F.col("unparseable") > scores.UNPARSEABLE).alias("flagged"))


@query(f"""WITH m AS (SELECT model, language, max(CASE WHEN predicted >= 0 THEN c END) / sum(CASE WHEN predicted >= 0 THEN c END) AS s FROM (SELECT model, language, predicted, count(*) AS c FROM {V.PREDICTIONS} GROUP BY ALL) GROUP BY 1, 2),
  l AS (SELECT language, avg(coalesce(s, 1.0)) AS by_language FROM m GROUP BY 1)
  SELECT round((SELECT avg(coalesce(s, 1.0)) FROM m), 6) AS mode_share_mean, round((SELECT stddev_pop(by_language) FROM l), 6) AS by_language_sd, round((SELECT avg(CASE WHEN coalesce(s, 1.0) > 0.9 THEN 1.0 ELSE 0.0 END) FROM m), 6)::DOUBLE AS frac_degenerate, (SELECT string_agg(language, ',' ORDER BY by_language DESC, language) FROM (SELECT * FROM l ORDER BY by_language DESC, language LIMIT 3)) AS worst""")
def position_bias(spark, sf):
    from .ablations import position_bias as report

    out = report(scores.mode_share(V.predictions(spark, sf), "model", "language"))
    return out.select(r6("mode_share_mean").alias("mode_share_mean"), r6("mode_share_by_language_sd").alias("by_language_sd"), r6("frac_degenerate").alias("frac_degenerate"), F.array_join("worst_languages", ",").alias("worst"))


# items -------------------------------------------------------------------------------------------------------------
_SHARED = f"SELECT item_id FROM {V.IDS} GROUP BY 1 HAVING count(DISTINCT lang) = (SELECT count(DISTINCT lang) FROM {V.IDS})"


@query(_SHARED)
def shared_items(spark, sf):
    return panel.shared_ids(V.ids_by_language(spark, sf))


@query(f"SELECT lang, count(*) AS n_total, count(DISTINCT CASE WHEN s.item_id IS NULL THEN i.item_id END) AS n_unshared, count(DISTINCT CASE WHEN s.item_id IS NULL THEN i.item_id END) > 0.01 * count(*) AS refused FROM {V.IDS} i LEFT JOIN ({_SHARED}) s USING (item_id) GROUP BY 1")
def coverage(spark, sf):
    ids = V.ids_by_language(spark, sf)
    c = panel.coverage_of(panel.language_sets(ids))
    return c.withColumn("refused", F.col("n_unshared") > panel.MAX_UNSHARED * F.col("n_total"))


@query("SELECT p_partkey::VARCHAR AS item_id FROM part ORDER BY sha256('20260803:' || p_partkey::VARCHAR) LIMIT 100")
def capped_items(spark, sf):
    return panel.capped(V.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("item_id")), 100, 20260803)


@query(f"SELECT m.model, l.language, i.item FROM (SELECT DISTINCT model FROM {V.OBSERVED}) m, (SELECT DISTINCT language FROM {V.OBSERVED}) l, (SELECT DISTINCT item FROM {V.OBSERVED}) i WHERE NOT EXISTS (SELECT 1 FROM {V.OBSERVED} o WHERE o.model = m.model AND o.language = l.language AND o.item = i.item)")
def missing_cells(spark, sf):
    return panel.missing_cells(V.observed(spark, sf), "model", "language", "item")


_BAD = "(SELECT p_partkey AS item_id, r_regionkey AS lang, (p_partkey * 31 + r_regionkey * 17) % 997 = 0 AS malformed FROM part, region)"


@query(f"SELECT item_id, lang FROM {_BAD} WHERE item_id NOT IN (SELECT item_id FROM {_BAD} WHERE malformed)")
def malformed_excluded(spark, sf):
    p, r = V.table(spark, sf, "part"), V.table(spark, sf, "region")
    items = p.crossJoin(F.broadcast(r)).select(F.col("p_partkey").alias("item_id"), F.col("r_regionkey").alias("lang"), ((F.col("p_partkey") * 31 + F.col("r_regionkey") * 17) % 997 == 0).alias("malformed"))
    return panel.drop_malformed(items).drop("malformed")


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN CASE WHEN l_quantity::BIGINT % 5 < 4 THEN l_quantity::BIGINT % 5 END WHEN 1 THEN CASE WHEN l_quantity::BIGINT % 6 BETWEEN 1 AND 4 THEN l_quantity::BIGINT % 6 - 1 END ELSE CASE WHEN l_quantity::BIGINT % 6 < 4 THEN l_quantity::BIGINT % 6 END END::INT AS answer FROM lineitem""")
def answers_normalised(spark, sf):
    q = F.col("l_quantity").cast("long")
    kind = F.col("l_linenumber") % 3
    raw = F.when(kind == 0, F.substring(F.lit("aBcDE"), (q % 5 + 1).cast("int"), F.lit(1))).when(kind == 1, (q % 6).cast("string")).otherwise(F.concat(F.lit(" "), (q % 6).cast("string")))
    li = V.table(spark, sf, "lineitem").withColumn("raw", raw)
    four = F.lit(4)
    return li.select("l_orderkey", "l_linenumber", F.when(kind == 1, I.answer_index(F.col("raw"), 1, four)).otherwise(I.answer_index(F.col("raw"), 0, four)).cast("int").alias("answer"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand || '|' || p_type WHEN p_size % 3 = 1 THEN p_brand || '|' || p_type || '|' || p_name ELSE p_brand || '||' || p_name END AS options, p_size % 3 = 2 AS hole FROM part""")
def options_stripped(spark, sf):
    k = F.col("p_size") % 3
    third = F.when(k == 0, F.lit("  ")).otherwise(F.col("p_name"))
    p = V.table(spark, sf, "part").withColumn("a", F.col("p_brand")).withColumn("b", F.when(k == 2, "").otherwise(F.col("p_type"))).withColumn("c", third).withColumn("d", F.lit(None).cast("string"))
    o = I.options_of({"options": ["a", "b", "c", "d"]})
    return p.select("p_partkey", F.array_join(I.stripped_options(o), "|").alias("options"), I.has_hole(o).alias("hole"))


@query("""SELECT p_partkey, sha256(p_type || chr(10) || chr(10) || 'What was the cause of this?' || chr(10) || 'A. ' || p_name || chr(10) || 'B. ' || p_brand || chr(10) || 'Answer with a single letter from A to B.' || chr(10) || 'Answer:') AS prompt_sha FROM part""")
def prompts(spark, sf):
    p = V.table(spark, sf, "part").withColumn("asked", F.lit(" Cause"))
    question, context = I.question_of({"premise": "p_type", "question": "asked"})
    return p.select("p_partkey", F.sha2(I.choice_prompt(question, I.options_of({"options": ["p_name", "p_brand"]}), context), 256).alias("prompt_sha"))


@query(f"SELECT o_orderkey, number FROM {V.NUMERALS}")
def final_numbers(spark, sf):
    return V.numerals(spark, sf).select("o_orderkey", numerals.final_number(F.col("text")).alias("number"))


@query(f"SELECT o_orderkey, CASE WHEN number IS NULL THEN -1 WHEN abs(number - price) <= 1e-4 * greatest(1.0, abs(price)) THEN 1 ELSE 0 END::SMALLINT AS predicted FROM {V.NUMERALS}")
def tolerance_match(spark, sf):
    rows = V.numerals(spark, sf).withColumn("gold", F.format_string("%.2f", "price"))
    return scores.marked_numbers(rows, "text", "gold").select("o_orderkey", "predicted")


# option scores -----------------------------------------------------------------------------------------------------
@query("""SELECT vec_id, (list_position(s, list_max(s)) - 1)::SMALLINT AS predicted FROM (SELECT vec_id, list_transform([0, 1, 2, 3], lambda k: list_max(embedding[k * 16 + 1:k * 16 + 16])) AS s FROM embeddings)""")
def letter_argmax(spark, sf):
    e = V.table(spark, sf, "embeddings")
    return e.select("vec_id", scores.first_best(scores.group_best(F.col("embedding"), [list(range(k, k + 16)) for k in range(0, 64, 16)])).alias("predicted"))


@query("""WITH v AS (SELECT doc_id % 4 AS mark, substr(trim(text), 1, 1) AS c, min(doc_id) AS id FROM documents GROUP BY 1, 2), g AS (SELECT strpos('ABCDE', c) - 1 AS option, c AS letter, list(id ORDER BY id) AS ids FROM v WHERE c BETWEEN 'A' AND 'E' AND length(c) = 1 AND ascii(c) < 128 GROUP BY c)
  SELECT option::INT AS option, letter, array_to_string(ids, ',') AS ids FROM g""")
def letter_tokens(spark, sf):
    """The tokens that stand for each letter, of a vocabulary of the documents' first letters behind no mark, a blank, or the marks of a line break or a word; a token's id is its least document."""
    docs = V.table(spark, sf, "documents")
    mark = F.get(F.array(*[F.lit(m) for m in ("", " ", "\u010a", "\u2581")]), (F.col("doc_id") % 4).cast("int"))
    vocabulary = docs.groupBy(F.concat(mark, F.substring(F.trim("text"), 1, 1)).alias("token")).agg(F.min("doc_id").alias("id"))
    return scores.letter_tokens(vocabulary, 5).select("option", "letter", F.array_join("ids", ",").alias("ids"))


@query("""SELECT vec_id, (list_position(s, list_max(s)) - 1)::SMALLINT AS predicted, round(list_max(s), 6) AS best FROM (SELECT vec_id, list_transform([0, 1, 2, 3], lambda k: list_sum(list_transform(embedding[k * 16 + 5:k * 16 + 16], lambda x: x::DOUBLE)) / 12) AS s FROM embeddings)""")
def loglik_argmax(spark, sf):
    each = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: scores.continuation_mean(F.slice("embedding", k * 16 + 1, F.lit(16)), 4))
    e = V.table(spark, sf, "embeddings").withColumn("s", each)
    return e.select("vec_id", scores.first_best(F.col("s")).alias("predicted"), r6(F.array_max("s")).alias("best"))


# drift -------------------------------------------------------------------------------------------------------------
@query(f"SELECT language, round(CASE WHEN language = 0 THEN 0 ELSE -median(delta) END, 6) + 0.0 AS c FROM {V.DRIFT} GROUP BY 1")
def median_anchor(spark, sf):
    return drift.median_anchor(V.drift(spark, sf), source=V.SOURCE).select("language", (r6("c") + F.lit(0.0)).alias("c"))


@query(f"WITH c AS (SELECT language, CASE WHEN language = 0 THEN 0 ELSE -median(delta) END AS c FROM {V.DRIFT} GROUP BY 1) SELECT model, language, round(gap - c, 6) + 0.0 AS gap_anchored FROM {V.GAPS} JOIN c USING (language)")
def anchored_gap(spark, sf):
    g = drift.anchored_gaps(V.gaps(spark, sf), drift.median_anchor(V.drift(spark, sf), source=V.SOURCE))
    return g.select("model", "language", (r6("gap_anchored") + F.lit(0.0)).alias("gap_anchored"))


_BE = f"""(SELECT language, breakeven, robust, n_ok, drift_sd FROM (SELECT language, avg(gap) AS breakeven, coalesce(avg(CASE WHEN share <= 0.9 THEN gap END), avg(gap)) AS robust, count(CASE WHEN share <= 0.9 THEN 1 END) AS n_ok FROM {V.GAPS} GROUP BY 1) JOIN (SELECT language, sqrt(greatest(var_pop(delta) - avg(se * se), 0)) AS drift_sd FROM {V.DRIFT} GROUP BY 1) USING (language) WHERE language <> 0)"""


@query(f"SELECT language, round(breakeven, 6) AS breakeven, round(robust, 6) AS robust, n_ok, round(drift_sd, 6) AS drift_sd, round(abs(breakeven) / drift_sd, 6) AS ratio FROM {_BE}")
def breakeven(spark, sf):
    g, d = V.gaps(spark, sf).where(F.col("language") != V.SOURCE), V.drift(spark, sf).where(F.col("language") != V.SOURCE)
    ok = ~scores.degenerate(F.col("share"))
    robust = g.groupBy("language").agg(scores.robust_mean(ok, F.col("gap")).alias("robust"), F.sum(ok.cast("long")).alias("n_ok"))
    return drift.breakeven(g, d).join(robust, "language").select("language", *[r6(c).alias(c) for c in ("breakeven", "robust")], "n_ok", *[r6(c).alias(c) for c in ("drift_sd", "ratio")])


@query(f"SELECT count(*) AS n_gaps, round(median(abs(breakeven) / drift_sd), 6) AS median_ratio, count(CASE WHEN abs(breakeven) / drift_sd < 1 THEN 1 END) AS below_1sd, count(CASE WHEN abs(robust) / drift_sd < 1 THEN 1 END) AS robust_below_1sd FROM {_BE}")
def breakeven_summary(spark, sf):
    b = breakeven(spark, sf)
    ratio = F.when(F.col("ratio") < float("inf"), F.col("ratio"))
    return b.agg(F.count(F.lit(1)).alias("n_gaps"), r6(F.median(ratio)).alias("median_ratio"), F.count(F.when(F.col("ratio") < 1, 1)).alias("below_1sd"), F.count(F.when(F.abs("robust") < F.col("drift_sd"), 1)).alias("robust_below_1sd"))


_ETA = f"(SELECT a.model, d.item, a.language, a.theta - b.b - d.delta AS eta FROM {V.ABILITY} a JOIN {V.DRIFT} d USING (language) JOIN {V.DIFFICULTY} b USING (item))"


@query(f"SELECT item, language, round(1 / sqrt(greatest(sum(p * (1 - p)), 1e-12)), 6) AS se FROM (SELECT item, language, 1 / (1 + exp(-eta)) AS p FROM {_ETA}) GROUP BY 1, 2")
def fisher_se(spark, sf):
    ability, b = V.parameters(spark, sf)
    cells = V.drift(spark, sf).join(b, "item").join(F.broadcast(ability), "language").withColumn("eta", F.col("theta") - F.col("b") - F.col("delta"))
    return drift.drift_se(cells).select("item", "language", r6("se").alias("se"))


@query(f"WITH y AS {V.crossed_sql()} SELECT language, round(avg(greatest(eta, 0) + ln(1 + exp(-abs(eta))) - correct * eta), 6) AS log_loss FROM y JOIN {_ETA} e USING (model, item, language) WHERE (model * 31 + item * 17 + language * 7) % 10 = 0 GROUP BY 1")
def heldout_logloss(spark, sf):
    ability, b = V.parameters(spark, sf)
    held = V.crossed(spark, sf).where((F.col("model") * 31 + F.col("item") * 17 + F.col("language") * 7) % 10 == 0)  # the 10 % that a fit wouldn't see
    e = drift.predictor(held, ability, b, V.drift(spark, sf))
    return e.groupBy("language").agg(r6(F.avg(log_loss(F.col("eta"), F.col("correct")))).alias("log_loss"))


_Z = f"(SELECT item, language, delta / se AS z, {erfc_sql('(abs(delta / se) / sqrt(2.0))')} AS p FROM {V.DRIFT} WHERE language <> 0)"
_BH = f"(SELECT *, p <= coalesce((SELECT max(CASE WHEN p <= 0.05 * k / n THEN p END) FROM (SELECT p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM {_Z})), -1) AS rejected FROM {_Z})"


@query(f"SELECT item, language, round(z, 6) + 0.0 AS z, round(p, 6) AS p, rejected FROM {_BH}")
def bh_rejections(spark, sf):
    t = dif.wald_tests(V.drift(spark, sf), V.SOURCE).where(F.col("language") != V.SOURCE)
    return t.select("item", "language", (r6("z") + F.lit(0.0)).alias("z"), r6("p").alias("p"), "rejected")


@query(f"SELECT language, count(*) AS n_tested, sum(rejected::INT)::BIGINT AS n_rejected, round(avg(rejected::INT), 6) AS frac_rejected FROM {_BH} GROUP BY ROLLUP (language)")
def dif_counts(spark, sf):
    t = dif.rejections(dif.wald_tests(V.drift(spark, sf), V.SOURCE), V.SOURCE)
    return t.select("language", "n_tested", long("n_rejected").alias("n_rejected"), r6("frac_rejected").alias("frac_rejected"))


_PARTS = O.parts(V.DRIFT, str(PI), str(TAU), V.SOURCE)


@query(f"SELECT language, count(*) AS n_parts, round(min(lo), 6) + 0.0 AS lo, round(max(hi), 6) + 0.0 AS hi, round(sum(hi - lo), 6) AS measure FROM {_PARTS} GROUP BY 1")
def identified_set(spark, sf):
    s = drift.identified_sets(V.drift(spark, sf), PI, TAU, source=V.SOURCE).where((F.col("language") != V.SOURCE) & ~F.col("refuted"))
    return s.select("language", long("n_parts").alias("n_parts"), (r6("lo") + F.lit(0.0)).alias("lo"), (r6("hi") + F.lit(0.0)).alias("hi"), r6("measure").alias("measure"))


@query(f"""WITH s AS (SELECT language, min(lo) AS lo, max(hi) AS hi FROM {_PARTS} GROUP BY 1 UNION ALL SELECT 0, 0, 0), b AS (SELECT language, gap - s.hi - 0.05 AS l, gap - s.lo + 0.05 AS h FROM {V.GAPS} JOIN s USING (language))
  SELECT language, round(avg(l), 6) + 0.0 AS bound_lo, round(avg(h), 6) + 0.0 AS bound_hi, round(avg(h - l), 6) AS interval_width, min(l) <= 0 AND max(h) >= 0 AS contains_zero FROM b GROUP BY 1""")
def gap_bounds(spark, sf):
    sets = drift.identified_sets(V.drift(spark, sf), PI, TAU, source=V.SOURCE).where(~F.col("refuted"))
    b = drift.bound_summary(drift.gap_bounds(V.gaps(spark, sf), sets, 0.05))
    return b.select("language", (r6("bound_lo") + F.lit(0.0)).alias("bound_lo"), (r6("bound_hi") + F.lit(0.0)).alias("bound_hi"), r6("interval_width").alias("interval_width"), "contains_zero")


@query(f"SELECT model, language, round(gap - avg(gap) OVER (PARTITION BY language), 6) + 0.0 AS did FROM {V.GAPS}")
def did(spark, sf):
    return drift.centred(V.gaps(spark, sf), "gap", "language").select("model", "language", (r6("gap") + F.lit(0.0)).alias("did"))


_SECOND = f"(SELECT item, language, delta * 0.8 + ((item * 13 + language * 7) % 21 - 10) / 100.0::DOUBLE AS delta FROM {V.DRIFT})"


@query(f"""WITH c AS (SELECT a.language, corr(a.delta, b.delta) AS r FROM {V.DRIFT} a JOIN {_SECOND} b USING (item, language) WHERE language <> 0 GROUP BY 1), g AS (SELECT language, avg(gap) AS a, avg(gap) * 0.9 + language / 50.0::DOUBLE AS b FROM {V.GAPS} WHERE language <> 0 GROUP BY 1)
  SELECT round((SELECT avg(r) FROM c), 6) AS drift_corr_mean, round((SELECT min(r) FROM c), 6) AS drift_corr_min, round((SELECT corr(a, b) FROM g), 6) AS gap_corr, round((SELECT avg(abs(a - b)) FROM g), 6) AS gap_mean_abs_diff""")
def scoring_agreement(spark, sf):
    from .ablations import agreement

    first = V.drift(spark, sf).where(F.col("language") != V.SOURCE)
    second = first.withColumn("delta", F.col("delta") * 0.8 + ((F.col("item") * 13 + F.col("language") * 7) % 21 - 10) / 100.0)
    g = V.gaps(spark, sf).where(F.col("language") != V.SOURCE).groupBy("language").agg(F.avg("gap").alias("gap"))
    out = agreement(first, second, g, g.withColumn("gap", F.col("gap") * 0.9 + F.col("language") / 50.0))
    return out.select(*[r6(c).alias(c) for c in ("drift_corr_mean", "drift_corr_min", "gap_corr", "gap_mean_abs_diff")])


@query(f"""WITH a AS (SELECT CASE WHEN item % 2 = 0 THEN 'machine' ELSE 'human' END AS arm, * FROM {V.DRIFT} WHERE language <> 0), b AS (SELECT arm, language, count(*) AS n, sqrt(greatest(var_pop(delta) - avg(se * se), 0)) AS sd FROM a GROUP BY 1, 2), g AS (SELECT language, avg(gap) AS gap FROM {V.GAPS} GROUP BY 1)
  SELECT arm, max(n) AS n_items, round(avg(sd), 6) AS drift_sd_mean, round(median(abs(gap) / sd), 6) AS breakeven_in_sd_median FROM b JOIN g USING (language) GROUP BY 1""")
def arm_dispersion(spark, sf):
    from .ablations import dispersion

    d = V.drift(spark, sf).where(F.col("language") != V.SOURCE).withColumn("arm", F.when(F.col("item") % 2 == 0, "machine").otherwise("human"))
    out = dispersion(d, V.gaps(spark, sf).where(F.col("language") != V.SOURCE))
    return out.select("arm", "n_items", r6("drift_sd_mean").alias("drift_sd_mean"), r6("breakeven_in_sd_median").alias("breakeven_in_sd_median"))


@query(f"""WITH g AS (SELECT language, model, gap, ((model * 17 + language * 5) % 23) AS other FROM {V.GAPS} WHERE language <> 0), p AS (SELECT a.language, sign(a.gap - b.gap) AS s, sign(a.other - b.other) AS t FROM g a JOIN g b ON a.language = b.language AND a.model < b.model)
  SELECT language, round(sum(s * t) / sqrt(sum(abs(s))::DOUBLE * sum(abs(t))), 6) AS tau FROM p GROUP BY 1""")
def kendall_tau(spark, sf):
    from .ablations import kendall

    g = V.gaps(spark, sf).where(F.col("language") != V.SOURCE).withColumn("other", (F.col("model") * 17 + F.col("language") * 5) % 23)
    return kendall(g, "gap", "other", ["language"]).select("language", r6("tau").alias("tau"))


@query(f"SELECT language, round(regr_slope(gap, model), 6) AS slope, round(sqrt(avg(gap * gap)), 6) AS rmse, round(avg(CASE WHEN gap BETWEEN -0.4 AND 0.4 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS covered, round(abs(avg(gap)), 6) AS floor FROM {V.GAPS} GROUP BY 1")
def slope_rmse_coverage(spark, sf):
    return V.gaps(spark, sf).groupBy("language").agg(r6(F.regr_slope("gap", F.col("model").cast("double"))).alias("slope"), r6(F.sqrt(F.avg(F.col("gap") * F.col("gap")))).alias("rmse"), r6(F.avg(F.col("gap").between(-0.4, 0.4).cast("double"))).alias("covered"), r6(F.abs(F.avg("gap"))).alias("floor"))


#: A tokenizer for tests: parts of words of at most four characters.
_PIECE = r"[^\x20\x09-\x0D]{1,4}"


def _pieces():
    import re

    piece = re.compile(_PIECE)
    return lambda text: len(piece.findall(text))


@query(rf"""WITH t AS (SELECT lang, len(regexp_extract_all(coalesce(text, ''), '{_PIECE}')) AS n FROM documents)
  SELECT lang, round(avg(n), 6) AS mean_tokens, round(avg(n) / (SELECT avg(n) FROM t WHERE lang = 'en'), 6) AS ratio FROM t GROUP BY 1""")
def token_fertility(spark, sf):
    """Mean tokens by language against the base language, by an injected tokenizer."""
    d = scores.token_counts(V.table(spark, sf, "documents").select("lang", "text"), _pieces).drop("text")
    return rounded(scores.length_ratio(d, "en", length="n_tokens").select("lang", F.col("mean_length").alias("mean_tokens"), "ratio"), "mean_tokens", "ratio")


class _ByLength:
    """A scorer for tests: the option is told by the prompt's length."""

    def __call__(self, rows):
        return rows.assign(predicted=(rows["prompt"].fillna("").str.len() % 4 - 1).astype("int16"))[["benchmark", "mode", "model", "language", "item_id", "predicted", "answer_index"]]


@query("""SELECT 'docs' AS benchmark, 'letter' AS mode, source AS model, lang AS language, count(*) AS n_items, round(avg((length(coalesce(text, '')) % 4 - 1 = doc_id % 3)::INT), 6) AS accuracy, round(avg((length(coalesce(text, '')) % 4 = 0)::INT), 6) AS unparseable FROM documents GROUP BY ALL""")
def scored_shards(spark, sf):
    """A scoring run over all shards, and a second one that finds them done."""
    from ..session import scratch
    from ..sources import shards as S
    from .scoring import score_shards

    d, path = V.table(spark, sf, "documents"), scratch(spark, "scored")
    items = d.select(F.lit("docs").alias("benchmark"), F.col("source").alias("model"), F.col("lang").alias("language"), F.col("doc_id").cast("string").alias("item_id"), F.col("text").alias("prompt"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("options"), (F.col("doc_id") % 3).cast("int").alias("answer_index"))
    for _ in range(2):
        score_shards(items, path, _ByLength)
    rows = S.read(spark, path, "docs", "letter")
    by = S.KEY
    return rounded(scores.accuracy(rows, *by).join(scores.unparseable_rate(rows, *by), by), "accuracy", "unparseable")


@query("SELECT lang, round(avg(length(text)), 6) AS mean_length, round(avg(length(text)) / (SELECT avg(length(text)) FROM documents WHERE lang = 'en'), 6) AS ratio FROM documents GROUP BY 1")
def fertility(spark, sf):
    d = V.table(spark, sf, "documents").select("lang", F.length("text").alias("n_chars"))
    return scores.length_ratio(d, "en").select("lang", r6("mean_length").alias("mean_length"), r6("ratio").alias("ratio"))


@query(f"SELECT model, language, count(DISTINCT item) AS n_items, (SELECT count(DISTINCT item) FROM {V.OBSERVED}) - count(DISTINCT item) AS missing FROM {V.OBSERVED} GROUP BY 1, 2")
def shard_differences(spark, sf):
    o = V.observed(spark, sf)
    d = panel.set_differences(o, o.select("item"), "item")
    n = o.groupBy("model", "language").agg(F.count_distinct("item").alias("n_items"))
    return d.join(n, ["model", "language"]).select("model", "language", "n_items", long("missing").alias("missing"))


@query("SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS one_key, count(DISTINCT l_orderkey || '␟' || l_linenumber) AS both_keys, count(DISTINCT l_orderkey) >= 0.9 * count(*) AS one_ok, count(DISTINCT l_orderkey || '␟' || l_linenumber) >= 0.9 * count(*) AS both_ok FROM lineitem")
def identifier_check(spark, sf):
    li = V.table(spark, sf, "lineitem")
    out = li.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(I.item_id("l_orderkey")).alias("one_key"), F.count_distinct(I.item_id(["l_orderkey", "l_linenumber"])).alias("both_keys"))
    return out.withColumn("one_ok", F.col("one_key") >= 0.9 * F.col("n_rows")).withColumn("both_ok", F.col("both_keys") >= 0.9 * F.col("n_rows"))


@query("SELECT l_partkey, max_by(l_quantity, l_orderkey * 1000 + l_linenumber * 100 + l_quantity) AS quantity, l_returnflag FROM lineitem GROUP BY l_partkey, l_returnflag")
def last_rows(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", F.col("l_quantity").alias("quantity"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity")).alias("turn"))
    return panel.last_rows(li, "turn", "l_partkey", "l_returnflag").drop("turn")


@query(f"SELECT DISTINCT n_nationkey AS model, r_regionkey AS language FROM nation, region WHERE (n_nationkey + r_regionkey) % 3 <> 0")
def outstanding_shards(spark, sf):
    every = V.gaps(spark, sf).select("model", "language")
    return panel.outstanding(every, every.where((F.col("model") + F.col("language")) % 3 == 0), "model", "language")


@query("SELECT n_nationkey AS model, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_name, n_nationkey) - 1 AS place FROM nation) WHERE place % 4 = 1")
def grid_slice(spark, sf):
    return panel.grid_slice(V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("model"), "n_name"), ["n_name", "model"], 1, 4)


@query(f"SELECT model, language, item, n FROM (SELECT model, language, item, count(*) AS n FROM {V.OBSERVED} GROUP BY ALL) WHERE n > 1")
def duplicate_cells(spark, sf):
    return panel.duplicates(V.observed(spark, sf), "model", "language", "item")


@query(f"SELECT benchmark, language, round(avg(correct), 6) AS accuracy, count(*) AS n FROM (SELECT *, 'crossed' AS benchmark FROM {V.crossed_sql()}) GROUP BY GROUPING SETS ((benchmark, language), (benchmark), ())")
def accuracy_grouping_sets(spark, sf):
    """Per language, per benchmark and over all in one pass."""
    y = V.crossed(spark, sf).withColumn("benchmark", F.lit("crossed"))
    b, lang = F.col("benchmark"), F.col("language")
    sums = y.groupBy(b, lang).agg(F.sum("correct").alias("right"), F.count("correct").alias("marked"), F.count(F.lit(1)).alias("n"))  # else each cell is made and grouped once per set
    return sums.groupingSets([[b, lang], [b], []], b, lang).agg(r6(F.try_divide(F.sum("right"), F.sum("marked"))).alias("accuracy"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select("benchmark", "language", "accuracy", "n")


@query(f"""SELECT language, round(avg(w) * avg(gap) + avg(w * d), 6) AS total FROM (SELECT a.language, p * (1 - p) AS w, d, gap FROM (SELECT item, e.language, avg(1 / (1 + exp(-eta))) AS p FROM {_ETA} e GROUP BY 1, 2) a JOIN (SELECT item, language, delta AS d FROM {V.DRIFT}) USING (item, language) JOIN (SELECT language, avg(gap) AS gap FROM {V.GAPS} GROUP BY 1) USING (language)) GROUP BY 1""")
def accuracy_decomposition(spark, sf):
    ability, b = V.parameters(spark, sf)
    d = V.drift(spark, sf)
    cells = d.join(b, "item").join(F.broadcast(ability), "language").withColumn("p", logistic(F.col("theta") - F.col("b") - F.col("delta")))
    p = cells.groupBy("item", "language").agg(F.avg("p").alias("p"), F.first("delta").alias("d"))
    g = V.gaps(spark, sf).groupBy("language").agg(F.avg("gap").alias("gap"))
    w = F.col("p") * (1 - F.col("p"))
    return p.join(g, "language").groupBy("language").agg(r6(F.avg(w) * F.avg("gap") + F.avg(w * F.col("d"))).alias("total"))


# fits: the SQL solves the same score equations by its own recursion --------------------------------------------------
MODELS = list(range(25))  # fixed value: the keys of nation
_SHARES = f"(SELECT model, language, share FROM {V.GAPS})"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) + F.lit(0.0) for n in names})


@query(f"WITH RECURSIVE {O.fit_ctes(V.crossed_sql())} SELECT model, language, round(gap, 6) + 0.0 AS gap FROM gaps")
def rasch_gap(spark, sf):
    """Fitted gap of each model and language."""
    from .fit import fit, point

    return rounded(point(fit(V.crossed(spark, sf), V.SOURCE)).gaps.select("model", "language", "gap"), "gap")


@query(O.joint_gap_sql(V.crossed_sql(), "0"))
def joint_gap(spark, sf):
    """Fitted gap of each model and language under the gradient fit's penalty, all languages in one system."""
    from .joint import fit_joint

    return rounded(fit_joint(V.crossed(spark, sf), V.SOURCE).gaps.select("model", "language", "gap"), "gap")


@query(f"WITH RECURSIVE {O.fit_ctes(V.crossed_sql())} SELECT item, language, round(delta, 6) + 0.0 AS delta, round(b, 6) + 0.0 AS b FROM drift JOIN difficulty USING (rep, item)")
def rasch_drift(spark, sf):
    """Fitted drift and difficulty of each item, centred by language, source abilities with mean 0."""
    from .fit import fit, point

    one = point(fit(V.crossed(spark, sf), V.SOURCE))
    return rounded(one.both.select("item", "language", "delta", "b"), "delta", "b")


@query(f"SELECT model, language, sum(correct)::BIGINT AS score, 0.0::DOUBLE AS residual FROM {V.crossed_sql()} GROUP BY 1, 2")
def score_equations(spark, sf):
    """What is left of each model's penalised score equation at the fit, to five digits: 0."""
    from .fit import fit, point

    one = point(fit(V.crossed(spark, sf), V.SOURCE))
    alike = one.both.groupBy("language", "b", "delta").agg(F.count(F.lit(1)).alias("times"))  # no more rows than pairs of scores, whatever the items
    cells = alike.join(few(one.ability), "language")  # all models, as the panel is crossed
    found = cells.groupBy("model", "language").agg(F.sum(F.col("times") * logistic(F.col("theta") - F.col("b") - F.col("delta"))).alias("expected"), F.first("theta").alias("theta"))
    left = one.margins.join(found, ["model", "language"]).withColumn("left", F.col("score") - F.col("expected"))
    left = drift.centred(left.withColumn("off", F.col("theta")), "off", "language")
    return left.select("model", "language", "score", (F.round(F.col("left") - 2e-4 * F.col("n") * F.col("off"), 5) + F.lit(0.0)).alias("residual"))


@query(f"WITH RECURSIVE {O.fit_ctes(V.crossed_sql(), 20, MODELS)}, {O.boot_ctes()} SELECT item, language, round(se, 6) + 0.0 AS se FROM se")
def boot_se(spark, sf):
    """Bootstrap errors of drift over 20 resamples of the models."""
    from .fit import bootstrap_errors, fit

    return rounded(bootstrap_errors(fit(V.crossed(spark, sf), V.SOURCE, n_boot=20))[0].select("item", "language", "se"), "se")


def _report(spark, sf):
    from .report import analyse

    return analyse(V.crossed(spark, sf), V.SOURCE, V.gaps(spark, sf).select("model", "language", F.col("share").alias("mode_share")))


@query(f"WITH RECURSIVE {O.report_ctes(V.crossed_sql(), _SHARES, MODELS)} SELECT {', '.join(O.WHOLE)}, {O.rounded(O.ROUNDED)} FROM rows")
def analysis_report(spark, sf):
    """The flagship report on the crossed panel."""
    return rounded(_report(spark, sf).rows, *O.ROUNDED).select(*O.WHOLE, *O.ROUNDED)


@query(f"WITH RECURSIVE {O.report_ctes(V.crossed_sql(), _SHARES, MODELS)} {O.summary()}")
def analysis_summary(spark, sf):
    return rounded(_report(spark, sf).summary, *O.SUMMARY_ROUNDED)


_SECOND_CELLS = V.crossed_sql("second")


@query(f"""WITH RECURSIVE {O.fit_ctes(V.crossed_sql(), x="a_")}, {O.fit_ctes(_SECOND_CELLS, x="b_")}, c AS (SELECT a.language, corr(a.delta, b.delta) AS r FROM a_drift a JOIN b_drift b USING (item, language) WHERE a.language <> 0 GROUP BY 1),
  g AS (SELECT language, avg(a.gap) AS a, avg(b.gap) AS b FROM a_gaps a JOIN b_gaps b USING (model, language) WHERE language <> 0 GROUP BY 1)
  SELECT round((SELECT avg(r) FROM c), 6) AS drift_corr_mean, round((SELECT min(r) FROM c), 6) AS drift_corr_min, (SELECT count(*) FROM g) AS n_languages, round(corr(a, b), 6) AS gap_corr, round(avg(abs(a - b)), 6) AS gap_mean_abs_diff, round(avg(a), 6) AS gap_a_mean, round(avg(b), 6) AS gap_b_mean FROM g""")
def scoring_modes(spark, sf):
    """Agreement of two fitted panels of the same cells."""
    from .ablations import scoring_modes as report

    return rounded(report(V.crossed(spark, sf), V.crossed(spark, sf, "second"), V.SOURCE), "drift_corr_mean", "drift_corr_min", "gap_corr", "gap_mean_abs_diff", "gap_a_mean", "gap_b_mean")


# of the second panel models 20 and more, and language 4, are left out, so that the modes share a part
_FEWER = f"(SELECT * FROM {V.crossed_sql()} WHERE model < 20 AND language < 4)"
_FEWER_SECOND = f"(SELECT * FROM {_SECOND_CELLS} WHERE model < 20 AND language < 4)"


def _mode_sql(name: str, x: str) -> str:
    return f"""SELECT '{name}' AS mode, (SELECT count(DISTINCT model) FROM {x}g) AS n_models, count(*) AS n_languages, round(median(CASE WHEN sd > 0 THEN abs(gap) / sd END), 6) AS median_ratio, count(CASE WHEN sd > 0 AND abs(gap) / sd < 1 THEN 1 END) AS n_below_1sd, round(avg(sd), 6) AS drift_sd, round((SELECT avg(gap) FROM {x}g WHERE language <> 0), 6) AS mean_gap,
      round((SELECT median(se) FROM {x}d WHERE language <> 0), 6) AS median_delta_se, round(0.3 + 2 * (SELECT median(se) FROM {x}d WHERE language <> 0), 6) AS tau_effective
      FROM (SELECT language, avg(gap) AS gap FROM {x}g GROUP BY 1) JOIN (SELECT language, sqrt(greatest(var_pop(delta) - avg(se * se), 0)) AS sd FROM {x}d GROUP BY 1) USING (language) WHERE language <> 0"""


@query(f"WITH RECURSIVE {O.fit_ctes(_FEWER, 20, MODELS[:20], 'a_')}, {O.boot_ctes('a_')}, {O.fit_ctes(_FEWER_SECOND, 20, MODELS[:20], 'b_')}, {O.boot_ctes('b_')} {_mode_sql('letter', 'a_')} UNION ALL {_mode_sql('loglik', 'b_')}")
def breakeven_of_modes(spark, sf):
    """Break-even under two scoring modes, on the models and languages that both have."""
    from .ablations import breakeven_of_modes as report

    second = V.crossed(spark, sf, "second").where("model < 20 AND language < 4")
    return rounded(report({"letter": V.crossed(spark, sf), "loglik": second}, V.SOURCE, n_boot=20), "median_ratio", "drift_sd", "mean_gap", "median_delta_se", "tau_effective")


def _arm_ctes(name: str, x: str, cells: str) -> str:
    return f"""{O.fit_ctes(cells, x=x)}, {x}n AS (SELECT item, d.language, 1 / sqrt(greatest(sum(p * (1 - p)), 1e-12)) AS se, any_value(delta) AS delta FROM (SELECT d.item, d.language, delta, 1 / (1 + exp(b + delta - theta)) AS p FROM {x}drift d JOIN {x}ability USING (language) JOIN {x}difficulty f ON f.item = d.item) d GROUP BY 1, 2),
      {x}row AS (SELECT '{name}' AS arm, max(n) AS n_items, round(avg(sd), 6) AS drift_sd_mean, round(avg(gap), 6) AS gap_mean, round(median(CASE WHEN sd > 0 THEN abs(gap) / sd ELSE 'inf'::DOUBLE END), 6) AS breakeven_in_sd_median FROM (SELECT language, count(*) AS n, sqrt(greatest(var_pop(delta) - avg(se * se), 0)) AS sd FROM {x}n GROUP BY 1) JOIN (SELECT language, avg(gap) AS gap FROM {x}gaps GROUP BY 1) USING (language) WHERE language <> 0)"""


@query(f"WITH RECURSIVE {_arm_ctes('machine', 'a_', f'(SELECT * FROM {_FEWER} WHERE item % 2 = 0)')}, {_arm_ctes('human', 'b_', f'(SELECT * FROM {_FEWER_SECOND} WHERE item % 2 = 1)')} SELECT * FROM a_row UNION ALL SELECT * FROM b_row")
def translation_arms(spark, sf):
    """Two translations with items of their own, fitted on common models and languages, with analytic errors."""
    from .ablations import translation_arms as report

    human = V.crossed(spark, sf, "second").where("model < 20 AND language < 4 AND item % 2 = 1")
    return rounded(report({"machine": V.crossed(spark, sf).where("item % 2 = 0"), "human": human}, V.SOURCE), "drift_sd_mean", "gap_mean", "breakeven_in_sd_median")


@query(f"SELECT seed, count(CASE WHEN u < 0.1 THEN 1 END) AS held_out, count(CASE WHEN u >= 0.1 THEN 1 END) AS kept FROM (SELECT seed, ('0x' || substr(md5(seed || ':' || model || ':' || item || ':' || language), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM {V.crossed_sql()}, (SELECT unnest([0, 1, 2]) AS seed)) GROUP BY 1")
def holdout_mask(spark, sf):
    """How many cells each seed's mask holds out."""
    from .fit import kept

    seeds = spark.range(3).select(F.col("id").cast("int").alias("seed"))
    cells = V.crossed(spark, sf).crossJoin(F.broadcast(seeds)).withColumn("k", kept(0.1))  # three rows
    return cells.groupBy("seed").agg(F.count(F.when(~F.col("k"), 1)).alias("held_out"), F.count(F.when(F.col("k"), 1)).alias("kept"))


_OBSERVED_ONCE = f"(SELECT model, item, language, max(correct) AS correct FROM {V.OBSERVED} GROUP BY ALL)"


@query(O.held_out_sql(_OBSERVED_ONCE, "'click'"))
def crossval_rasch(spark, sf):
    """Held-out log loss of Rasch fits of the incomplete panel of events, all seeds fitted together."""
    from .fit import crossval

    cells = V.observed(spark, sf).groupBy("model", "item", "language").agg(F.max("correct").alias("correct"))
    return rounded(crossval(cells, "click", models=("rasch",)), "loss")


@query()
def crossval_losses(spark, sf):
    """Held-out log loss of both model classes on the incomplete panel of events; fits run until they converge, up to ``crossval``'s 4,000 steps."""
    from .fit import crossval

    seen = V.observed(spark, sf)
    first = seen.agg(F.min("language")).first()[0]
    return crossval(seen.groupBy("model", "item", "language").agg(F.max("correct").alias("correct")), first)


_LOSSES = f"(SELECT 'b' || model AS benchmark, language AS seed, 'rasch' AS irt_model, abs(gap) AS loss FROM {V.GAPS} UNION ALL SELECT 'b' || model, language, '2pl', abs(gap - 0.1) FROM {V.GAPS})"


@query(f"SELECT *, winner = '2pl' AS won, sum((winner = '2pl')::INT) OVER ()::BIGINT AS wins_2pl FROM (SELECT benchmark, round(r, 6) AS loss_rasch, round(t, 6) AS loss_2pl, round(r - t, 6) + 0.0 AS gain, CASE WHEN r - t > 0 THEN '2pl' ELSE 'rasch' END AS winner FROM (SELECT benchmark, avg(CASE WHEN irt_model = 'rasch' THEN loss END) AS r, avg(CASE WHEN irt_model = '2pl' THEN loss END) AS t FROM {_LOSSES} GROUP BY 1))")
def benchmark_wins(spark, sf):
    """Cross-validation records by benchmark, with the winning model class."""
    from .ablations import benchmark_wins as report

    g = V.gaps(spark, sf).select(F.concat(F.lit("b"), "model").alias("benchmark"), F.col("language").alias("seed"), "gap")
    losses = g.select("benchmark", "seed", F.lit("rasch").alias("irt_model"), F.abs("gap").alias("loss")).union(g.select("benchmark", "seed", F.lit("2pl"), F.abs(F.col("gap") - 0.1)))
    return rounded(report(losses), "loss_rasch", "loss_2pl", "gain").withColumn("won", F.col("winner") == "2pl").withColumn("wins_2pl", long("wins_2pl"))


# sets, anchors, normalisation ----------------------------------------------------------------------------------------
@query(f"SELECT language, count(*) AS n_points, sum(n)::BIGINT AS total, max(n) AS most FROM (SELECT language, c, count(CASE WHEN abs(delta + c) <= 0.3 + 1e-9 THEN 1 END) AS n FROM {V.DRIFT}, (SELECT unnest(range(-8, 9)) / 8.0::DOUBLE AS c) GROUP BY 1, 2) GROUP BY 1")
def stabbing_counts(spark, sf):
    """How many drifts each of 17 shifts brings within the tolerance."""
    d = V.drift(spark, sf)
    points = d.select("language").distinct().crossJoin(F.broadcast(spark.range(-8, 9).select((F.col("id") / 8).alias("c"))))  # 17 rows
    return drift.stabbing_counts(points, d, TAU + 1e-9).groupBy("language").agg(F.count(F.lit(1)).alias("n_points"), F.sum("n").alias("total"), F.max("n").alias("most"))


@query(f"SELECT language, round(-avg(delta), 6) + 0.0 AS c FROM {V.DRIFT} WHERE item % 3 = 0 GROUP BY 1")
def certified_anchor(spark, sf):
    d = V.drift(spark, sf)
    return rounded(drift.certified_anchor(d, d.where("item % 3 = 0").select("language", "item")), "c")


@query(" UNION ALL ".join(f"SELECT 'pi = {p}' AS series, language, {t}::DOUBLE AS tau, round(max(hi) - min(lo), 6) AS width FROM {O.parts(V.DRIFT, str(p), str(t), V.SOURCE)} GROUP BY language" for p in (0.3, 0.6) for t in (0.2, 0.4)))
def set_widths(spark, sf):
    """The series of the figure of identified widths."""
    from .claims import set_widths as series

    return rounded(series(V.drift(spark, sf).where(F.col("language") != V.SOURCE), (0.3, 0.6), (0.2, 0.4)), "width")


@query(f"""WITH s AS (SELECT language, list({{'lo': lo, 'hi': hi}} ORDER BY lo) AS p FROM {_PARTS} GROUP BY 1), e AS (SELECT *, p[1].lo AS lo, p[len(p)].hi AS hi, list_sum(list_transform(p, lambda x: x.hi - x.lo)) AS m, len(list_filter(p, lambda x: x.lo <= 0 AND x.hi >= 0)) > 0 AS zero FROM s)
  SELECT language, zero AS contains_zero, round(lo, 6) + 0.0 AS hull_lo, round(hi, 6) + 0.0 AS hull_hi, round(hi - lo, 6) AS width, round(m, 6) AS measure, round(lo + 0.25, 6) + 0.0 AS shifted_lo, round(hi + 0.25, 6) + 0.0 AS shifted_hi, round(-hi, 6) + 0.0 AS negated_lo, round(-lo, 6) + 0.0 AS negated_hi,
  round(CASE WHEN -lo < lo THEN greatest(m, 0) + m WHEN -hi > hi THEN 2 * m ELSE NULL END, 6) AS apart FROM e""")
def interval_algebra(spark, sf):
    """Hull, width, measure, shift and mirror image of identified sets; the union of a set with its mirror image has twice its measure where they are apart."""
    from ..functions import intervals as S

    p = F.col("parts")
    s = drift.identified_sets(V.drift(spark, sf), PI, TAU, source=V.SOURCE).where((F.col("language") != V.SOURCE) & ~F.col("refuted"))
    both = S.measure(S.union(p, S.negate(p)))
    apart = (S.hull(p)["lo"] > -S.hull(p)["lo"]) | (S.hull(p)["hi"] < -S.hull(p)["hi"])
    return rounded(
        s.select("language", S.contains(p, 0.0).alias("contains_zero"), S.hull(p)["lo"].alias("hull_lo"), S.hull(p)["hi"].alias("hull_hi"), S.width(p).alias("width"), S.measure(p).alias("measure"), S.hull(S.shift(p, 0.25))["lo"].alias("shifted_lo"), S.hull(S.shift(p, 0.25))["hi"].alias("shifted_hi"),
                 S.hull(S.negate(p))["lo"].alias("negated_lo"), S.hull(S.negate(p))["hi"].alias("negated_hi"), F.when(apart, both).alias("apart")),
        "hull_lo", "hull_hi", "width", "measure", "shifted_lo", "shifted_hi", "negated_lo", "negated_hi", "apart",
    )


# drift that isn't normalised: the source's isn't 0, nor are the means
_LOOSE = f"(SELECT item, language, delta + item % 7 / 10.0::DOUBLE + language AS delta FROM {V.DRIFT})"


@query(f"""WITH l AS {_LOOSE}, s AS (SELECT item, delta AS base FROM l WHERE language = 0), d AS (SELECT item, language, delta - base AS delta FROM l JOIN s USING (item)), m AS (SELECT language, avg(delta) AS mean FROM d GROUP BY 1), a AS (SELECT model, language, theta - mean AS theta FROM {V.ABILITY} JOIN m USING (language)), c AS (SELECT avg(theta) AS centre, stddev_samp(theta) AS sd FROM a WHERE language = 0)
  SELECT language, round(avg(delta - mean), 6) + 0.0 AS mean_drift, round(stddev_pop(delta), 6) AS drift_sd, round(stddev_pop(delta) / any_value(sd), 6) AS scaled_drift_sd, round(any_value(ab) - any_value(centre), 6) + 0.0 AS mean_ability, round((any_value(ab) - any_value(centre)) / any_value(sd), 6) + 0.0 AS scaled_ability, round(any_value(db) - any_value(centre), 6) + 0.0 AS mean_difficulty, round(any_value(sd) * 1.25, 6) AS scaled_a
  FROM d JOIN m USING (language) JOIN (SELECT language, avg(theta) AS ab FROM a GROUP BY 1) USING (language), c, (SELECT avg(b + base) AS db FROM {V.DIFFICULTY} JOIN s USING (item)) GROUP BY language""")
def normalisation(spark, sf):
    """Drift, abilities and difficulties brought to the fits' normalisation, and to unit spread of source abilities."""
    ability, b = V.parameters(spark, sf)
    loose = V.drift(spark, sf).select("item", "language", (F.col("delta") + F.col("item") % 7 / 10.0 + F.col("language")).alias("delta"))
    a, f, d = drift.normalised(ability, b, loose, V.SOURCE)
    ra, _, rd = drift.rescaled(a, f, d.withColumn("a", F.lit(1.25)), V.SOURCE)
    per = lambda t, c, n, g: t.groupBy("language").agg(g(c).alias(n))
    out = per(d, "delta", "mean_drift", F.avg).join(per(d, "delta", "drift_sd", F.stddev_pop), "language").join(per(rd, "delta", "scaled_drift_sd", F.stddev_pop), "language").join(per(a, "theta", "mean_ability", F.avg), "language")
    out = out.join(per(ra, "theta", "scaled_ability", F.avg), "language").join(per(rd, "a", "scaled_a", F.max), "language").crossJoin(F.broadcast(f.agg(F.avg("b").alias("mean_difficulty"))))  # one row
    return rounded(out, "mean_drift", "drift_sd", "scaled_drift_sd", "mean_ability", "scaled_ability", "mean_difficulty", "scaled_a")


@query(f"SELECT a.model, a.language, count(*) AS n FROM (SELECT DISTINCT model, language FROM {V.OBSERVED} WHERE model <> 3) a JOIN (SELECT DISTINCT model, language FROM {V.OBSERVED} WHERE model > 1 AND language <> 'click') b USING (model, language) GROUP BY 1, 2")
def common_panel(spark, sf):
    """The models and languages that two panels share."""
    o = V.observed(spark, sf).select("model", "language").distinct()
    a, b = panel.common_panel(o.where("model <> 3"), o.where("model > 1 AND language <> 'click'"), "model", "language", least={"model": 4, "language": 3})
    return a.join(b, ["model", "language"]).groupBy("model", "language").agg(F.count(F.lit(1)).alias("n"))


# items, prompts, numerals --------------------------------------------------------------------------------------------
_ITEM_SPEC = {"benchmarks": {"parts": {"hf_id": "org/parts", "languages": ["A", "N", "R"], "source_language": "N", "item_id_field": ["l_orderkey", "l_linenumber"], "answer_base": 0, "fields": {"question": "l_shipmode_like", "options": ["o1", "o2", "o3"], "answer": "right", "strata": ["l_linestatus", "gone"]}}}}
_ITEM_ROWS = "(SELECT l_orderkey, l_linenumber, l_returnflag AS lang, l_linestatus, 'Which is ' || l_partkey || '? ' AS q, 'a' || l_quantity::BIGINT % 9 AS o1, 'b' || l_suppkey AS o2, CASE WHEN l_linenumber % 2 = 0 THEN 'c' ELSE NULL END AS o3, l_linenumber % 4 AS answer FROM lineitem)"


def _item_rows(spark, sf):
    li = V.table(spark, sf, "lineitem")
    third = F.when(F.col("l_linenumber") % 2 == 0, "c")
    return li.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("lang"), "l_linestatus", F.lit(None).cast("string").alias("gone"), F.concat(F.lit("Which is "), "l_partkey", F.lit("? ")).alias("l_shipmode_like"),
                     F.concat(F.lit("a"), F.col("l_quantity").cast("long") % 9).alias("o1"), F.concat(F.lit("b"), "l_suppkey").alias("o2"), third.alias("o3"), (F.col("l_linenumber") % 4).cast("string").alias("right"))


def _built(spark, sf):
    from ..sources.benchmarks import build_items
    from ..sources.specs import load_specs

    return build_items(_item_rows(spark, sf), load_specs(_ITEM_SPEC)["parts"])


@query(f"""SELECT l_orderkey || '␟' || l_linenumber AS item_id, lang AS language, 2 + (o3 IS NOT NULL)::INT AS n_options, CASE WHEN answer < 2 + (o3 IS NOT NULL)::INT THEN answer END::INT AS answer_index, l_linestatus || '/' AS strata, answer >= 2 + (o3 IS NOT NULL)::INT AS malformed,
  md5(trim(q) || chr(10) || 'A. ' || o1 || chr(10) || 'B. ' || o2 || coalesce(chr(10) || 'C. ' || o3, '') || chr(10) || 'Answer with a single letter from A to ' || CASE WHEN o3 IS NULL THEN 'B' ELSE 'C' END || '.' || chr(10) || 'Answer:') AS prompt_md5 FROM {_ITEM_ROWS}""")
def items_built(spark, sf):
    """Raw rows to items: ids of two columns, options without their empty end, answers, strata, prompts; an answer out of range marks an item as malformed."""
    strata = F.concat(F.col("strata")["l_linestatus"], F.lit("/"), F.col("strata")["gone"])
    return _built(spark, sf).select("item_id", "language", F.size("options").alias("n_options"), "answer_index", strata.alias("strata"), "malformed", F.md5("prompt").alias("prompt_md5"))


@query(f"""SELECT item_id, language, option, md5(stem) AS stem_md5, md5(stem || ' ' || text) AS prompt_md5 FROM (SELECT *, unnest(range(len(o))) AS option, unnest(o) AS text FROM (SELECT l_orderkey || '␟' || l_linenumber AS item_id, lang AS language, CASE WHEN o3 IS NULL THEN [o1, o2] ELSE [o1, o2, o3] END AS o,
  trim(q) || chr(10) || 'A. ' || o1 || chr(10) || 'B. ' || o2 || coalesce(chr(10) || 'C. ' || o3, '') || chr(10) || 'Answer with a single letter from A to ' || CASE WHEN o3 IS NULL THEN 'B' ELSE 'C' END || '.' || chr(10) || 'Answer:' AS stem FROM {_ITEM_ROWS}))""")
def option_rows(spark, sf):
    """One row per item and option for scoring continuations."""
    rows = scores.option_rows(_built(spark, sf))
    return rows.select("item_id", "language", "option", F.md5("stem").alias("stem_md5"), F.md5("prompt").alias("prompt_md5"))


@query("SELECT conv_id, turn, md5(CASE WHEN contains(text, chr(10)) THEN regexp_replace(text, '\n[^\n]*$', '') ELSE text END) AS cut_md5 FROM conversations WHERE text IS NOT NULL")
def last_line_removed(spark, sf):
    c = V.table(spark, sf, "conversations").where("text IS NOT NULL")
    return c.select("conv_id", "turn", F.md5(I.without_last_line(F.col("text"))).alias("cut_md5"))


@query(f"SELECT o_orderkey, trim(o_orderpriority) || {_quoted(I.THINK)} AS prompt FROM orders")
def generative_prompts(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", I.generative_prompt(F.concat(F.lit("  "), "o_orderpriority", F.lit(" "))).alias("prompt"))


@query("SELECT o_orderkey, o_custkey::DOUBLE AS number, o_custkey::VARCHAR AS plain FROM orders")
def numerals_of_scripts(spark, sf):
    """Numbers written in the digits of six scripts, by key."""
    o = V.table(spark, sf, "orders")
    zeros = [0x660, 0x6F0, 0x966, 0x9E6, 0xE50, 0xFF10]  # Arabic-Indic, extended Arabic-Indic, Devanagari, Bengali, Thai, full width
    digits = F.col("o_custkey").cast("string")
    text = F.coalesce(*[F.when(F.col("o_orderkey") % 6 == i, F.translate(digits, "0123456789", "".join(chr(z + d) for d in range(10)))) for i, z in enumerate(zeros)])
    return o.select("o_orderkey", numerals.final_number(F.concat(F.lit("= "), text)).alias("number"), numerals.ascii_digits(text).alias("plain"))


@query("SELECT vec_id, predicted, answer_index, (predicted = answer_index)::TINYINT AS correct FROM (SELECT vec_id, (vec_id % 5 - 1)::SMALLINT AS predicted, label % 4 AS answer_index FROM embeddings WHERE vec_id % 10 <> 9)")
def marked_answers(spark, sf):
    """Predictions joined to gold answers and marked; items without a gold answer drop out."""
    e = V.table(spark, sf, "embeddings")
    gold = e.where("vec_id % 10 <> 9").select("vec_id", (F.col("label") % 4).alias("answer_index"))
    return scores.marked(e.select("vec_id", (F.col("vec_id") % 5 - 1).cast("smallint").alias("predicted")), gold, "vec_id").select("vec_id", "predicted", "answer_index", "correct")


# specifications, shards, records -------------------------------------------------------------------------------------
_SPECS = {
    "defaults": {"split": "test", "source_language": "en", "max_items": 2000, "seed": 7},
    "benchmarks": {"exam": {"hf_id": "o/exam", "languages": ["en", "fr"], "max_items": 3}, "sums": {"hf_id": "o/sums", "task": "generative", "languages": ["en"], "split": "eval", "source_language": "de", "seed": 9}, "planned": {}},
    "models": {"big": {"hf_id": "m/b", "tier": 2, "params_b": 9.2}, "small": {"hf_id": "m/s", "tier": 2, "params_b": 1.2}, "first": {"hf_id": "m/f", "tier": 1, "params_b": 7}, "other": {"tier": 3}},
}


@query("""WITH s AS (SELECT source AS name, list_sort(list(DISTINCT lang) FILTER (WHERE lang IS NOT NULL)) AS languages, count(*) AS n, CASE WHEN count(*) % 2 = 0 THEN 'generative' END AS task, CASE WHEN count(DISTINCT lang) > 1 THEN min(lang) END AS source_language FROM documents WHERE source IS NOT NULL GROUP BY 1)
  SELECT name, 'o/' || name AS hf_id, 'test' AS split, coalesce(task, 'multiple_choice') AS task, coalesce(array_to_string(languages, ','), '') AS languages, coalesce(source_language, 'en') AS source_language, least(n, 2000)::INT AS max_items, 7::BIGINT AS seed,
  coalesce(len(languages), 0) > 0 AS usable, task IS NULL AS by_letter FROM s""")
def specifications(spark, sf):
    """A benchmark specification for each source of documents, laid over defaults; which can be used, and with which scoring mode."""
    from ..sources import specs as S

    n, langs = F.count(F.lit(1)), F.collect_set("lang")
    own = V.table(spark, sf, "documents").where("source IS NOT NULL").groupBy(F.col("source").alias("name")).agg(
        F.concat(F.lit("o/"), F.first("source")).alias("hf_id"), langs.alias("languages"), F.least(n, F.lit(2000)).cast("int").alias("max_items"),
        F.when(n % 2 == 0, "generative").alias("task"), F.when(F.size(langs) > 1, F.min("lang")).alias("source_language"), n.alias("n_documents"),
    )
    frame = S.specs_over(own, {"split": "test", "source_language": "en", "max_items": 2000, "seed": 7})
    letter = S.matching_mode(frame, "letter").select("name", F.lit(True).alias("by_letter"))
    return frame.join(letter, "name", "left").withColumn("by_letter", F.coalesce("by_letter", F.lit(False))).withColumn("languages", F.array_join("languages", ","))


@query("SELECT row_number() OVER (ORDER BY coalesce(tier, 1), params_b, name) - 1 AS place, name, coalesce(tier, 1)::INT AS tier, params_b FROM (SELECT n_name AS name, nullif(n_regionkey, 0) AS tier, (n_nationkey * 7 % 11) / 2.0::DOUBLE AS params_b FROM nation) WHERE coalesce(tier, 1) IN (1, 2)")
def model_grid(spark, sf):
    """The models (nations) of tiers 1 and 2, by tier, then smallest first; without a tier they are of the first."""
    from ..sources.specs import grid_over

    return grid_over(V.table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.nullif("n_regionkey", F.lit(0)).alias("tier"), (F.col("n_nationkey") * 7 % 11 / 2.0).alias("params_b")))


def _shards(spark, sf):
    y = V.crossed(spark, sf).select(F.when(F.col("item") % 2 == 0, "exam").otherwise("sums").alias("benchmark"), F.col("model").cast("string").alias("model"), F.concat(F.lit("l"), "language").alias("language"), F.col("item").cast("string").alias("item_id"), F.col("correct").cast("tinyint").alias("correct"), (F.col("item") % 4).cast("smallint").alias("predicted"))
    return y.withColumn("mode", F.when(F.col("benchmark") == "sums", "generative").otherwise("letter"))


@query(f"SELECT benchmark, mode, model, language, n_items, round(acc, 6) AS accuracy FROM (SELECT CASE WHEN item % 2 = 0 THEN 'exam' ELSE 'sums' END AS benchmark, CASE WHEN item % 2 = 0 THEN 'letter' ELSE 'generative' END AS mode, model::VARCHAR AS model, 'l' || language AS language, count(*) AS n_items, avg(correct) AS acc FROM {V.crossed_sql()} WHERE model IN (3, 4, 5) AND language < 3 GROUP BY ALL) WHERE benchmark = 'exam'")
def shard_round_trip(spark, sf):
    """Shards written by benchmark, mode, model and language, and one benchmark, mode and some models read back by name."""
    from ..session import scratch
    from ..sources import shards as S

    path = scratch(spark, "shards")
    S.write(_shards(spark, sf).where("model IN ('3', '4', '5', '6')"), path)
    rows = S.read(spark, path, "exam", "letter", models=["3", "4", "5"], languages=["l0", "l1", "l2"])
    acc = rows.groupBy("benchmark", "mode", "model", "language").agg(F.count(F.lit(1)).alias("n_items"), F.avg("correct").alias("accuracy"))
    return rounded(acc, "accuracy")


@query(f"SELECT 'exam' AS benchmark, count(*) AS n_rows, count(DISTINCT (model, language)) AS n_shards FROM {V.crossed_sql()} WHERE item % 2 = 0")
def whole_benchmarks(spark, sf):
    """Benchmarks told as whole by a stream of the markers of shards: two runs of it, of which the first finds one benchmark short and the second completes it; the other stays short."""
    from ..session import scratch
    from ..sources import shards as S
    from ..streaming.shards import follow_complete

    folder, rows = scratch(spark, "whole"), _shards(spark, sf)
    wanted = cut(rows.select(*S.KEY).distinct())  # the sink keeps the rows that it writes: they aren't kept twice
    late = (F.col("model") == "3") & (F.col("language") == "l2")
    for part in (rows.where(~late), rows.where(late & (F.col("benchmark") == "exam"))):
        S.write(part, f"{folder}/shards")
        follow_complete(spark, f"{folder}/shards", wanted, f"{folder}/checkpoint", f"{folder}/out").awaitTermination()
    return spark.read.schema("benchmark string, n_shards long, n_rows long").parquet(f"{folder}/out")


@query("""WITH r AS (SELECT source, lang, count(*) AS n, avg(length(coalesce(text, ''))) AS mean, max(length(coalesce(text, ''))) AS longest, count(text) AS held FROM documents GROUP BY 1, 2)
  SELECT source, lang, n AS n_items, CASE WHEN held % 2 = 1 THEN round(mean, 6) END AS mode_share, held % 2 = 0 AS no_share, longest::BIGINT AS longest, 'engine,longest,mode_share,n_items' AS fields FROM r""")
def shard_records(spark, sf):
    """Records of shards as JSON text, some with a bare NaN and all with a field that the schema doesn't know, read back by path, with the names of the fields that they have."""
    from ..sources import shards as S

    d = V.table(spark, sf, "documents").withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))))
    g = d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_items"), F.avg("n_chars").alias("mean"), F.max("n_chars").cast("long").alias("longest"), F.count("text").alias("held"))
    share = F.when(F.col("held") % 2 == 1, F.col("mean")).otherwise(float("nan")).alias("mode_share")
    texts = g.select("source", "lang", F.replace(F.to_json(F.struct("n_items", share, F.struct("longest").alias("engine"))), F.lit('"NaN"'), F.lit("NaN")).alias("meta"))
    r = S.with_meta(texts)
    known = S.fields(r, "record", "source", "lang").withColumnsRenamed({"source": "__source", "lang": "__lang"})
    both = r.join(known, F.col("source").eqNullSafe(F.col("__source")) & F.col("lang").eqNullSafe(F.col("__lang")))
    got = S.field("record", "$.mode_share", "double")
    return both.select("source", "lang", S.field("record", "$.n_items", "long").alias("n_items"), r6(F.nanvl(got, F.lit(None).cast("double"))).alias("mode_share"), F.isnan(got).alias("no_share"), S.field("record", "$.engine.longest", "long").alias("longest"), F.array_join(F.regexp_extract_all("fields", F.lit(r"(\w+):")), ",").alias("fields"))


@query("SELECT * FROM (VALUES ('exam', true, 'letter', true, 'en', false, 125::BIGINT, 25::BIGINT, 5::BIGINT), ('sums', true, 'generative', true, 'de', false, 125, 25, 5), ('planned', false, NULL, NULL, 'en', false, 0, 0, 0)) t(name, usable, mode, matches, source_language, has_source, n_shards, n_models, n_languages)")
def specs_with_shards(spark, sf):
    """Every specification with what there is of its shards."""
    from ..sources import shards as S
    from ..sources.specs import load_specs, specs_frame

    return S.with_specs(_shards(spark, sf).select(*S.KEY).distinct(), specs_frame(spark, load_specs(_SPECS)))


_FROM_SHARDS = f"(SELECT model, item, language, correct FROM {V.crossed_sql()} WHERE item % 2 = 0)"
_SHARD_SHARES = f"(SELECT DISTINCT model, language, (SELECT max(c) / sum(c) FROM (SELECT count(*) AS c FROM part WHERE p_partkey % 2 = 0 GROUP BY p_partkey % 4)) AS share FROM {V.GAPS})"


@query(f"WITH RECURSIVE {O.report_ctes(_FROM_SHARDS, _SHARD_SHARES, MODELS, n_boot=20)} SELECT 'exam' AS benchmark, 125 AS n_shards, 125 AS n_expected, 'l' || language AS language, {', '.join(c for c in O.WHOLE if c != 'language')}, {O.rounded(O.ROUNDED)} FROM rows")
def shards_to_report(spark, sf):
    """From shards to the report: item sets compared, shards matched by item id, completeness and source checked, shares from predictions."""
    from ..sources.specs import BenchmarkSpec
    from .report import analyse_shards

    rows = _shards(spark, sf).where("benchmark = 'exam'").withColumn("model", F.lpad("model", 2, "0"))  # names in the order of keys, as resamples follow it
    found, report = analyse_shards(rows, BenchmarkSpec("exam", source_language="l0"), n_boot=20)
    return rounded(report.rows, *O.ROUNDED).crossJoin(F.broadcast(found.status.select("n_shards", "n_expected"))).select(F.lit("exam").alias("benchmark"), "n_shards", long("n_expected").alias("n_expected"), *O.WHOLE, *O.ROUNDED)


@query("""SELECT 'lines' AS benchmark, 'A,N,R' AS present, 'X' AS missing_languages, 'answer' AS missing_columns, (SELECT count(*) FROM lineitem) AS n_rows, (SELECT max(c) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_returnflag)) AS most_rows, (SELECT min(d >= 0.9 * c) FROM (SELECT count(*) AS c, count(DISTINCT l_orderkey) AS d FROM lineitem GROUP BY l_returnflag)) AS ids_ok""")
def source_probe(spark, sf):
    """What a source lacks of its specification."""
    from ..sources.benchmarks import probe
    from ..sources.specs import BenchmarkSpec

    spec = BenchmarkSpec("lines", languages=("A", "N", "R", "X"), item_id_field="l_orderkey", fields={"question": "l_linestatus", "answer": "answer"})
    found = probe(V.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "lang"), spec)
    return found.withColumns({c: F.array_join(c, ",") for c in ("present", "missing_languages", "missing_columns")})


@query("""WITH i AS (SELECT p_partkey AS k, r_name AS language FROM part, region WHERE (p_partkey * 7 + r_regionkey * 13) % 211 <> 0), s AS (SELECT k FROM i GROUP BY 1 HAVING count(*) = 5), c AS (SELECT k::VARCHAR AS id FROM s ORDER BY sha256('11:' || k::VARCHAR) LIMIT 40)
  SELECT 'parts' AS benchmark, 11::BIGINT AS seed, 40 AS max_items, 'ASIA' AS source_language, (SELECT count(*) FROM c) AS n_items, (SELECT string_agg(id, ',' ORDER BY id) FROM c) AS item_ids, (SELECT string_agg(language || ':' || n || ':' || u, ',' ORDER BY language) FROM (SELECT language, count(*) AS n, count(CASE WHEN s.k IS NULL THEN 1 END) AS u FROM i LEFT JOIN s USING (k) GROUP BY 1)) AS coverage""")
def manifest(spark, sf):
    """The record of a selection: items that all languages share under a cap, with each language's coverage."""
    from ..sources.benchmarks import record_of
    from ..sources.specs import BenchmarkSpec

    p, r = V.table(spark, sf, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("item_id")), V.table(spark, sf, "region")
    items = spread(p, "item_id").crossJoin(F.broadcast(r)).where((F.col("p_partkey") * 7 + F.col("r_regionkey") * 13) % 211 != 0).select("item_id", F.col("r_name").alias("language"))
    selected, covered = panel.select_items(items, 40, 11, lang="language")
    m = record_of(BenchmarkSpec("parts", max_items=40, seed=11, source_language="ASIA"), selected, covered)
    flat = F.transform(F.array_sort(F.map_entries("coverage")), lambda e: F.concat_ws(":", e["key"], e["value"]["n_total"], e["value"]["n_unshared"]))
    return m.select("benchmark", "seed", "max_items", "source_language", "n_items", F.array_join("item_ids", ",").alias("item_ids"), F.array_join(flat, ",").alias("coverage"))


@query(rf"""SELECT string_agg(language || ' & ' || printf('%.3f', g) || ' & ' || printf('%.3f', g * 2) || ' & [' || printf('%.2f', lo) || ', ' || printf('%.2f', hi) || ']' || CASE WHEN lo <= 0 AND hi >= 0 THEN '$^\dagger$' ELSE '' END || ' & ' || printf('%.2f', g / 4) || ' \\', chr(10) ORDER BY language::VARCHAR) AS latex FROM (SELECT language, avg(gap) + 0.0001 AS g, min(gap) + 0.0001 AS lo, max(gap) + 0.0001 AS hi FROM {V.GAPS} GROUP BY 1)""")
def latex_table(spark, sf):
    from .report import latex_table as table

    g = V.gaps(spark, sf).groupBy("language").agg((F.avg("gap") + 0.0001).alias("raw_acc_gap"), (F.min("gap") + 0.0001).alias("bound_lo"), (F.max("gap") + 0.0001).alias("bound_hi"))
    return table(g.withColumns({"irt_gap_naive": F.col("raw_acc_gap") * 2, "breakeven_in_sd": F.col("raw_acc_gap") / 4, "contains_zero": (F.col("bound_lo") <= 0) & (F.col("bound_hi") >= 0)}))


@query(f"SELECT '| claim | statement | predicted | measured | passed |' || chr(10) || '|-|-|-|-|-|' || chr(10) || string_agg('| G' || language || ' | gap | < 1 | ' || printf('%.4g', g) || ' | ' || CASE WHEN g < 1 THEN 'yes' ELSE 'no' END || ' |', chr(10) ORDER BY language) AS markdown FROM (SELECT language, max(gap) + 0.00012 AS g FROM {V.GAPS} WHERE language > 0 GROUP BY 1)")
def markdown_table(spark, sf):
    """Largest gaps as a ledger in Markdown."""
    from .claims import markdown

    g = V.gaps(spark, sf).where("language > 0").groupBy("language").agg((F.max("gap") + 0.00012).alias("measured"))
    return markdown(g.select(F.concat(F.lit("G"), "language").alias("claim"), F.lit("gap").alias("statement"), F.lit("< 1").alias("predicted"), "measured", (F.col("measured") < 1).alias("passed")))


@query(f"SELECT model, language, '{{\"model\":' || model || ',\"language\":' || language || ',\"gap\":' || gap || '}}' AS json, gap AS parsed FROM {V.GAPS}")
def json_records(spark, sf):
    """Records as JSON text, and read back."""
    g = V.gaps(spark, sf).select("model", "language", F.to_json(F.struct("model", "language", "gap")).alias("json"))
    return g.withColumn("parsed", F.from_json("json", "gap double", {"allowNonNumericNumbers": "true"})["gap"])


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {_quoted(s)}, '{b}', true)" for k, (s, b) in CLAIMS.items()) + ") t(claim, statement, predicted, passed)")
def claims_ledger(spark, sf):
    """The 24 claims about identification, each checked on simulated panels of known truth with the engine's operators; the SQL says that all hold."""
    from .claims import ledger

    return ledger(spark).drop("measured")


@query()
def figure_series(spark, sf):
    """What the ledger's four figures plot."""
    from .claims import figures

    return figures(spark)
