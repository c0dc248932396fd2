"""DuckDB text of the fits and of the report: an independent solver in recursive SQL, against which the engine's results are held."""

from __future__ import annotations

from ..functions.stats import erfc_sql
from .fit import resamples


def fit_ctes(cells: str, n_boot: int = 0, models: list | None = None, x: str = "", source: int = 0, ridge_theta: float = 2e-4, ridge_beta: float = 2e-3, rounds: int = 60) -> str:
    """CTEs {x}ability, {x}difficulty, {x}drift and {x}gaps, each with ``rep``, of a margins fit of ``cells`` (model, item, language, correct).

    Every (rep, language) is a row of lists: distinct item scores with their counts, and the models' scores. A round takes a Newton step for all abilities, then for
    all difficulties. Resamples are those of ``models`` in order. Begins behind ``WITH RECURSIVE``.
    """
    if n_boot:
        weights = ", ".join(f"({r.model}, {r.rep}, {r.weight})" for r in resamples(models, n_boot).itertuples())
        weights = f"(SELECT * FROM (VALUES {weights}) t(model, rep, weight))"
    else:
        weights = f"(SELECT DISTINCT model, 0 AS rep, 1 AS weight FROM {x}y)"
    sig = lambda i, j: f"1 / (1 + exp(be[{j}] - th[{i}]))"
    every_j, every_i = "range(1, len(c) + 1)", "range(1, len(r) + 1)"
    total = lambda over, v, f: f"list_sum(list_transform({over}, lambda {v}: {f}))"
    mean_t, mean_b = "list_sum(list_transform(range(1, len(r) + 1), lambda z: th[z] * w[z])) / tot", "list_sum(list_transform(range(1, len(c) + 1), lambda z: be[z] * c[z])) / n"
    step_t = f"(r[i] - {total(every_j, 'j', 'c[j] * ' + sig('i', 'j'))} - {ridge_theta} * n * (th[i] - mt)) / ({total(every_j, 'j', 'c[j] * (' + sig('i', 'j') + ') * (1 - ' + sig('i', 'j') + ')')} + {ridge_theta} * n)"
    step_b = f"({total(every_i, 'i', 'w[i] * ' + sig('i', 'j'))} - s[j] - {ridge_beta} * tot * (be[j] - mb)) / ({total(every_i, 'i', 'w[i] * (' + sig('i', 'j') + ') * (1 - ' + sig('i', 'j') + ')')} + {ridge_beta} * tot)"
    return f"""
    {x}y AS (SELECT model, item, language, correct FROM {cells}),
    {x}wt AS {weights},
    {x}it AS (SELECT rep, language, item, sum(weight * correct)::DOUBLE AS s FROM {x}y JOIN {x}wt USING (model) GROUP BY 1, 2, 3),
    {x}ic AS (SELECT rep, language, s, count(*)::DOUBLE AS c FROM {x}it GROUP BY 1, 2, 3),
    {x}pe AS (SELECT rep, language, model, weight, r FROM (SELECT model, language, sum(correct)::DOUBLE AS r FROM {x}y GROUP BY 1, 2) JOIN {x}wt USING (model) WHERE weight > 0),
    {x}st AS (SELECT rep, language, m, r, w, s, c, n, list_sum(w) AS tot FROM (SELECT rep, language, list(model ORDER BY model) AS m, list(r ORDER BY model) AS r, list(weight::DOUBLE ORDER BY model) AS w FROM {x}pe GROUP BY 1, 2)
      JOIN (SELECT rep, language, list(s ORDER BY s) AS s, list(c ORDER BY s) AS c, sum(c) AS n FROM {x}ic GROUP BY 1, 2) USING (rep, language)),
    {x}run(k, rep, language, m, r, w, s, c, n, tot, th, be) AS (
      SELECT 0, rep, language, m, r, w, s, c, n, tot, list_transform(r, lambda v: 0.0::DOUBLE), list_transform(s, lambda v: 0.0::DOUBLE) FROM {x}st
      UNION ALL
      SELECT k + 1, rep, language, m, r, w, s, c, n, tot, th, list_transform({every_j}, lambda j: be[j] + greatest(-1, least(1, {step_b}))) FROM (
        SELECT * EXCLUDE (th), {mean_b} AS mb, list_transform({every_i}, lambda i: th[i] + greatest(-1, least(1, {step_t}))) AS th FROM (SELECT *, {mean_t} AS mt FROM {x}run WHERE k < {rounds}))),
    {x}done AS (SELECT *, {mean_b} AS shift FROM {x}run WHERE k = {rounds}),
    {x}theta AS (SELECT rep, language, unnest(m) AS model, unnest(w) AS weight, unnest(th) - shift AS theta FROM {x}done),
    {x}beta AS (SELECT rep, language, item, be - shift AS beta FROM {x}it JOIN (SELECT rep, language, shift, unnest(s) AS s, unnest(be) AS be FROM {x}done) USING (rep, language, s)),
    {x}centre AS (SELECT rep, sum(theta * weight) / sum(weight) AS centre FROM {x}theta WHERE language = {source} GROUP BY 1),
    {x}ability AS (SELECT rep, model, language, theta - centre AS theta FROM {x}theta JOIN {x}centre USING (rep)),
    {x}difficulty AS (SELECT rep, item, beta - centre AS b FROM {x}beta JOIN {x}centre USING (rep) WHERE language = {source}),
    {x}gaps AS (SELECT a.rep, a.model, a.language, a.weight, b.theta - a.theta AS gap FROM {x}theta a JOIN {x}theta b ON a.rep = b.rep AND a.model = b.model AND b.language = {source}),
    {x}drift AS (SELECT a.rep, a.item, a.language, a.beta - b.beta AS delta FROM {x}beta a JOIN {x}beta b ON a.rep = b.rep AND a.item = b.item AND b.language = {source})"""


def boot_ctes(x: str = "") -> str:
    """{x}d (item, language, delta, se), {x}g (model, language, gap) and {x}gse (language, gap_se) from the fits of ``fit_ctes``."""
    return f"""
    {x}se AS (SELECT item, language, stddev_samp(delta) AS se FROM {x}drift WHERE rep > 0 GROUP BY 1, 2),
    {x}gse AS (SELECT language, stddev_samp(g) AS gap_se FROM (SELECT rep, language, sum(gap * weight) / sum(weight) AS g FROM {x}gaps WHERE rep > 0 GROUP BY 1, 2) GROUP BY 1),
    {x}d AS (SELECT item, language, delta, greatest(se, 1e-6) AS se FROM {x}drift JOIN {x}se USING (item, language) WHERE rep = 0),
    {x}g AS (SELECT model, language, gap FROM {x}gaps WHERE rep = 0)"""


def parts(drift: str, pi: str, tau: str, source: int = 0) -> str:
    """(language, lo, hi): identified sets by ranks, between the sorted drifts j and j + k - 1, with islands merged."""
    return f"""(WITH d AS (SELECT language, delta, row_number() OVER (PARTITION BY language ORDER BY delta) AS j, ceil({pi} * count(*) OVER (PARTITION BY language) - 1e-9)::BIGINT AS k FROM {drift} WHERE language <> {source}),
    s AS (SELECT a.language, b.delta - {tau} AS lo, a.delta + {tau} AS hi FROM d a JOIN d b ON a.language = b.language AND b.j = a.j + a.k - 1 WHERE b.delta - a.delta <= 2 * {tau}),
    m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY language ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-9 THEN 0 ELSE 1 END AS fresh FROM s),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY language ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT language, -max(hi) AS lo, -min(lo) AS hi FROM i GROUP BY language, island)"""


def tests(drift: str, alpha: float = 0.05, source: int = 0) -> str:
    """(item, language, rejected)."""
    z = f"(SELECT item, language, {erfc_sql('(abs(delta / se) / sqrt(2.0))')} AS p FROM {drift} WHERE language <> {source})"
    return f"(SELECT item, language, p <= coalesce((SELECT max(CASE WHEN p <= {alpha} * k / n THEN p END) FROM (SELECT p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM {z})), -1) AS rejected FROM {z})"


def report_ctes(cells: str, shares: str, models: list, n_boot: int = 20, pi: float = 0.5, tau: float = 0.3, source: int = 0) -> str:
    """CTE rows: the flagship report by language, and used (tau_used, half, inflate). ``shares``: (model, language, share)."""
    return f"""{fit_ctes(cells, n_boot, models)}, {boot_ctes()},
    used AS (SELECT half, 2 * wide AS inflate, {tau} + 2 * half AS tau_used FROM (SELECT median(se) AS half FROM d WHERE language <> {source}), (SELECT median(gap_se) AS wide FROM gse)),
    sets AS (SELECT language, min(lo) AS lo, max(hi) AS hi FROM {parts('d', str(pi), '(SELECT tau_used FROM used)')} GROUP BY 1),
    bounds AS (SELECT language, avg(l) AS bound_lo, avg(h) AS bound_hi, avg(h - l) AS interval_width, min(l) <= 0 AND max(h) >= 0 AS contains_zero FROM (SELECT language, gap - hi - inflate AS l, gap - lo + inflate AS h FROM g JOIN sets USING (language), used) GROUP BY 1),
    dif AS (SELECT language, sum(rejected::INT)::BIGINT AS dif_rejected, avg(rejected::INT) AS dif_frac, count(*) AS dif_tested FROM {tests('d')} GROUP BY 1),
    acc AS (SELECT model, language, avg(correct) AS a FROM y GROUP BY 1, 2),
    raw AS (SELECT a.language, avg(s.a) AS acc_source, avg(a.a) AS acc_target, avg(s.a - a.a) AS raw_acc_gap FROM acc a JOIN acc s ON s.model = a.model AND s.language = {source} GROUP BY 1),
    sd AS (SELECT language, sqrt(greatest(var_pop(delta) - avg(se * se), 0)) AS observed_drift_sd, -median(delta) AS c FROM d GROUP BY 1),
    rob AS (SELECT language, avg(gap) AS breakeven_drift, avg(share) AS mode_share_mean, count(CASE WHEN share > 0.9 THEN 1 END) AS n_degenerate, count(CASE WHEN share > 0.9 THEN NULL ELSE 1 END) AS n_nondegenerate, coalesce(avg(CASE WHEN share > 0.9 THEN NULL ELSE gap END), avg(gap)) AS breakeven_robust FROM g LEFT JOIN {shares} USING (model, language) GROUP BY 1),
    rows AS (SELECT language, breakeven_drift, observed_drift_sd, abs(breakeven_drift) / observed_drift_sd AS breakeven_in_sd, acc_source, acc_target, raw_acc_gap, breakeven_drift - c AS gap_median_anchored, dif_rejected, dif_frac, dif_tested, mode_share_mean, n_degenerate, n_nondegenerate, breakeven_robust, gap_se,
      lo AS c_set_lo, hi AS c_set_hi, lo IS NULL AS refuted, bound_lo, bound_hi, interval_width, contains_zero, breakeven_drift AS irt_gap_naive, abs(breakeven_robust) / observed_drift_sd AS breakeven_robust_in_sd
      FROM rob JOIN sd USING (language) JOIN raw USING (language) JOIN dif USING (language) JOIN gse USING (language) LEFT JOIN sets USING (language) LEFT JOIN bounds USING (language) WHERE language <> {source})"""


#: Columns of the report that are rounded, and those that are not.
ROUNDED = ["breakeven_drift", "observed_drift_sd", "breakeven_in_sd", "acc_source", "acc_target", "raw_acc_gap", "gap_median_anchored", "dif_frac", "mode_share_mean", "breakeven_robust", "gap_se", "c_set_lo", "c_set_hi", "bound_lo", "bound_hi", "interval_width", "irt_gap_naive", "breakeven_robust_in_sd"]
WHOLE = ["language", "dif_rejected", "dif_tested", "n_degenerate", "n_nondegenerate", "refuted", "contains_zero"]


def rounded(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


SUMMARY_ROUNDED = ["tau_effective", "inflate", "median_delta_se", "dif_frac_rejected", "frac_languages_gap_contains_zero", "mean_interval_width", "frac_shards_degenerate", "median_breakeven_in_sd", "median_breakeven_robust_in_sd"]


def summary(pi: float = 0.5, tau: float = 0.3, alpha: float = 0.05, n_boot: int = 20) -> str:
    inner = f"""SELECT count(*) AS n_languages_tested, {pi}::DOUBLE AS pi, {tau}::DOUBLE AS tau_nominal, (SELECT tau_used FROM used) AS tau_effective, (SELECT inflate FROM used) AS inflate, {alpha}::DOUBLE AS alpha, {n_boot} AS n_boot, (SELECT half FROM used) AS median_delta_se,
      sum(dif_rejected)::BIGINT AS dif_n_rejected, sum(dif_tested)::BIGINT AS dif_n_tested, sum(dif_rejected) / sum(dif_tested) AS dif_frac_rejected, count(CASE WHEN contains_zero THEN 1 END) AS n_languages_gap_contains_zero, count(CASE WHEN contains_zero THEN 1 END) / count(*) AS frac_languages_gap_contains_zero,
      avg(interval_width) AS mean_interval_width, sum(n_degenerate) / sum(n_degenerate + n_nondegenerate) AS frac_shards_degenerate, median(breakeven_in_sd) AS median_breakeven_in_sd, count(CASE WHEN breakeven_in_sd < 1 THEN 1 END) AS n_gaps_breakeven_below_1sd, count(CASE WHEN breakeven_robust_in_sd < 1 THEN 1 END) AS n_gaps_breakeven_robust_below_1sd,
      median(breakeven_robust_in_sd) AS median_breakeven_robust_in_sd FROM rows"""
    return f"SELECT * EXCLUDE ({', '.join(SUMMARY_ROUNDED)}), {rounded(SUMMARY_ROUNDED)} FROM ({inner})"


def joint_ctes(cells: str, source: str, rounds: int, over: float = 1.7) -> str:
    """CTEs c (seed, m, i, l, y) from ``cells``, which has these columns, and z (seed, kind, a, l, v), its Rasch fits: ability of model a (kind 0), difficulty of item a (1), drift (2).

    Over-relaxed Newton steps, for all abilities, then all difficulties, then all drift, and again. Penalised as by gradient: ridges on abilities and drift; drift is 0 at the
    source, and steps are shifted so that it has mean 0 in each language, and so are source abilities. Begins behind ``WITH RECURSIVE``.
    """
    shift = "sum(g / h - v) OVER (PARTITION BY seed, kind, l) / sum(1 / h) OVER (PARTITION BY seed, kind, l)"
    none = "NULL" if source.isdigit() else "''"  # the language of a difficulty, which isn't read
    return f"""c AS (SELECT seed, m, i, l, y FROM {cells}),
    dim AS (SELECT seed, count(*)::DOUBLE AS n, count(DISTINCT i) AS ni, (SELECT count(DISTINCT m) FROM c) AS nm, (SELECT count(DISTINCT l) FROM c) AS nl FROM c GROUP BY 1),
    p(k, seed, kind, a, l, v) AS (
      SELECT 0, seed, kind, a, l, 0.0::DOUBLE FROM (SELECT seed, 0 AS kind, m AS a, l FROM dim, (SELECT DISTINCT m FROM c), (SELECT DISTINCT l FROM c)
        UNION ALL SELECT DISTINCT seed, 1, i, {none} FROM c UNION ALL SELECT seed, 2, i, l FROM (SELECT DISTINCT seed, i FROM c), (SELECT DISTINCT l FROM c) WHERE l <> {source})
      UNION ALL
      SELECT k + 1, seed, kind, a, l, CASE WHEN kind = 1 THEN greatest(-10, least(10, v + coalesce(step, 0))) ELSE v + coalesce(step, 0) END FROM (
        SELECT p.*, CASE WHEN kind = k % 3 THEN {over} * greatest(-1, least(1, -(g - CASE WHEN kind = 2 OR (kind = 0 AND l = {source}) THEN {shift} ELSE 0 END) / h)) END AS step FROM (
          SELECT p.*, coalesce(s.g, 0) + 2 * r * v AS g, coalesce(s.h, 0) + 2 * r + 1e-9 AS h FROM (SELECT p.*, CASE kind WHEN 0 THEN 1e-4 * n / (nm * nl) WHEN 2 THEN 1e-3 * n / (ni * nl) ELSE 0 END AS r FROM p JOIN dim USING (seed)) p
          LEFT JOIN (SELECT seed, e.kind, CASE WHEN e.kind = 0 THEN m ELSE i END AS a, CASE WHEN e.kind = 1 THEN {none} ELSE l END AS l, sum(CASE WHEN e.kind = 0 THEN q - y ELSE y - q END) AS g, sum(q * (1 - q)) AS h FROM (
              SELECT c.*, t.k % 3 AS kind, 1 / (1 + exp(coalesce(d.v, 0) + b.v - t.v)) AS q FROM c JOIN p t ON t.seed = c.seed AND t.kind = 0 AND t.a = c.m AND t.l = c.l JOIN p b ON b.seed = c.seed AND b.kind = 1 AND b.a = c.i LEFT JOIN p d ON d.seed = c.seed AND d.kind = 2 AND d.a = c.i AND d.l = c.l) e GROUP BY ALL) s
          ON s.seed = p.seed AND s.kind = p.kind AND s.a = p.a AND s.l IS NOT DISTINCT FROM p.l) p) WHERE k < {3 * rounds}),
    z AS (SELECT * FROM p WHERE k = {3 * rounds})"""


def held_out_sql(cells: str, source: str, seeds: tuple[int, ...] = (0, 1, 2), holdout: float = 0.1, rounds: int = 120) -> str:
    """(seed, irt_model, loss) of Rasch fits of the cells that each seed keeps."""
    return f"""WITH RECURSIVE u AS (SELECT seed, model AS m, item AS i, language AS l, correct AS y, ('0x' || substr(md5(seed || ':' || model || ':' || item || ':' || language), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= {holdout} AS keep FROM {cells}, (SELECT unnest({list(seeds)}) AS seed)),
    {joint_ctes('u WHERE keep', source, rounds)}
    SELECT seed, 'rasch' AS irt_model, round(avg(greatest(e, 0) + ln(1 + exp(-abs(e))) - y * e), 6) AS loss FROM (
      SELECT u.*, t.v - coalesce(b.v, 0) - coalesce(d.v, 0) AS e FROM u JOIN z t ON t.seed = u.seed AND t.kind = 0 AND t.a = u.m AND t.l = u.l LEFT JOIN z b ON b.seed = u.seed AND b.kind = 1 AND b.a = u.i LEFT JOIN z d ON d.seed = u.seed AND d.kind = 2 AND d.a = u.i AND d.l = u.l WHERE NOT keep) GROUP BY 1"""


def joint_gap_sql(cells: str, source: str, rounds: int = 60) -> str:
    """(model, language, gap) of the Rasch fit of all cells with the gradient fit's penalty."""
    return f"""WITH RECURSIVE {joint_ctes(f'(SELECT 0 AS seed, model AS m, item AS i, language AS l, correct AS y FROM {cells})', source, rounds)}
    SELECT t.a AS model, t.l AS language, round(s.v - t.v, 6) + 0.0 AS gap FROM z t JOIN z s ON s.kind = 0 AND s.a = t.a AND s.l = {source} WHERE t.kind = 0"""
