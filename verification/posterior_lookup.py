"""Posterior draws (L), lookup table and conversion (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.functions import labels, terms
from loamline.operators import lookup, posterior
from loamline.plans import preparation
from loamline.session import scratch_path
from loamline.sources import tables
from verification import standins as S
from verification.base import R, check, grid_index_sql, suction
from verification.joins_aggregates import hdi_sql
from verification.soil_physics import TERMS_SQL, _terms
from verification.standins import EVENT_YEARS, snap, snapped

_P = ("alpha_cm", "n", "theta_r")


def _rounded(cols):
    return ", ".join(f"{R(c)} AS {c}" for c in cols)


# ---- L: posterior draws ----------------------------------------------------


@check(
    "l1_thinned",
    ("draws",),
    f"SELECT chain, iter, grp, {_rounded(_P)} FROM draws WHERE iter > 10 AND iter % 3 = 0",
)
def _(spark, sf):
    return snapped(posterior.thinned(S.draws(spark, sf), 10, 3).select("chain", "iter", "grp", *_P), *_P)


@check(
    "l2_quantile_summary",
    ("terms",),
    f"""SELECT grp, parameter, {R('AVG(x)')} AS estimate, {R('STDDEV_SAMP(x)')} AS std_error, {R('quantile_cont(x, 0.025)')} AS conf_low,
               {R('quantile_cont(x, 0.975)')} AS conf_high FROM terms GROUP BY 1, 2""",
)
def _(spark, sf):
    out = posterior.quantile_summary(posterior.terms_long(S.draws(spark, sf)), ["grp", "parameter"])
    return snapped(out, "estimate", "std_error", "conf_low", "conf_high")


HDI_SUMMARY_SQL = f"""(SELECT grp, parameter, estimate, std_error, conf_low, conf_high
   FROM (SELECT grp, parameter, AVG(x) AS estimate, STDDEV_SAMP(x) AS std_error FROM terms GROUP BY 1, 2)
   JOIN {hdi_sql('terms', ('grp', 'parameter'))} USING (grp, parameter))"""


def _hdi(spark, sf):
    return posterior.hdi_summary(posterior.terms_long(S.draws(spark, sf)), ["grp", "parameter"])


@check(
    "l3_hdi_summary",
    ("terms",),
    f"SELECT grp, parameter, {_rounded(('estimate', 'std_error', 'conf_low', 'conf_high'))} FROM {HDI_SUMMARY_SQL}",
)
def _(spark, sf):
    return snapped(_hdi(spark, sf), "estimate", "std_error", "conf_low", "conf_high")


def _r_hat_sql(source: str) -> str:
    return f"""SELECT grp, parameter, k AS n_chains, n AS n_iter,
        {R('''sqrt((2 * v * v / var_v + 3) / (2 * v * v / var_v + 1) * ((n - 1) / CAST(n AS DOUBLE) + (1 + 1.0e0 / k) * bn / w))''')} AS r_hat
      FROM (SELECT *, (n - 1) * w / n + (1 + 1.0e0 / k) * bn AS v,
                   (pow(n - 1, 2) * vs / k + pow(1 + 1.0e0 / k, 2) * 2 * pow(n * bn, 2) / (k - 1)
                    + 2.0 * (n - 1) * (1 + 1.0e0 / k) * (n / CAST(k AS DOUBLE)) * (c2 - 2 * g * c1)) / pow(n, 2) AS var_v
            FROM (SELECT grp, parameter, COUNT(*) AS k, MIN(m) AS n, AVG(s2) AS w, VAR_SAMP(mu) AS bn, VAR_SAMP(s2) AS vs, AVG(mu) AS g,
                         COVAR_SAMP(s2, mu * mu) AS c2, COVAR_SAMP(s2, mu) AS c1
                  FROM (SELECT grp, parameter, chain, COUNT(x) AS m, AVG(x) AS mu, VAR_SAMP(x) AS s2 FROM {source} GROUP BY 1, 2, 3)
                  GROUP BY 1, 2))"""


@check("l4_convergence", ("terms",), _r_hat_sql("terms"))
def _(spark, sf):
    out = posterior.convergence(posterior.terms_long(S.draws(spark, sf)), ["grp", "parameter"])
    return snapped(out, "r_hat")


@check(
    "l4_convergence_second_half",
    ("terms",),
    _r_hat_sql(
        "(SELECT t.* FROM terms t JOIN (SELECT grp, parameter, chain, MAX(iter) / 2.0 AS half FROM terms GROUP BY 1, 2, 3) h "
        "USING (grp, parameter, chain) WHERE iter > half)"
    ),
)
def _(spark, sf):
    out = posterior.convergence(posterior.terms_long(S.draws(spark, sf)), ["grp", "parameter"], burn_half=True)
    return snapped(out, "r_hat")


@check(
    "l5_term_classes",
    ("terms",),
    f"""SELECT term, CASE WHEN starts_with(term, 'E.') THEN 'population' ELSE 'treatment' END AS level,
               CASE WHEN contains(term, '[1]') THEN 'S1' WHEN contains(term, '[2]') THEN 'S4' END AS grp,
               replace(replace(replace(term, '[1]', ''), '[2]', ''), 'E.', '') AS parameter, {R('AVG(x)')} AS estimate FROM {TERMS_SQL} GROUP BY 1""",
)
def _(spark, sf):
    t = F.col("term")
    return (
        _terms(spark, sf)
        .groupBy("term")
        .agg(snap(F.avg("x")).alias("estimate"))
        .select(
            "term",
            F.when(terms.is_population(t), "population").otherwise("treatment").alias("level"),
            terms.term_group(t, ("S1", "S4")).alias("grp"),
            terms.bare_parameter(t).alias("parameter"),
            "estimate",
        )
    )


# Draws of a model with an index per depth and treatment: chains 1 and 2 stand for the depths.
_TRT_SQL = """(SELECT replace(parameter, '_', '.') || '[' || CASE chain || '_' || grp WHEN '1_S1' THEN 1 WHEN '2_S1' THEN 2
                        WHEN '1_S4' THEN 3 WHEN '2_S4' THEN 4 END || ']' AS term, x FROM terms WHERE grp <> 'site' AND chain < 3
               UNION ALL SELECT 'E.' || replace(parameter, '_', '.'), x FROM terms WHERE grp = 'site')"""


@check(
    "l5_depth_treatment_terms",
    ("terms",),
    f"""SELECT term, CASE WHEN starts_with(term, 'E.') THEN 'population' ELSE 'treatment' END AS level,
               CASE right(term, 3) WHEN '[1]' THEN '1_S1' WHEN '[2]' THEN '2_S1' WHEN '[3]' THEN '1_S4' WHEN '[4]' THEN '2_S4' END AS trt,
               CASE WHEN right(term, 3) IN ('[1]', '[3]') THEN '1' WHEN right(term, 3) IN ('[2]', '[4]') THEN '2' END AS depth,
               CASE WHEN right(term, 3) IN ('[1]', '[2]') THEN 'S1' WHEN right(term, 3) IN ('[3]', '[4]') THEN 'S4' END AS summer,
               regexp_replace(replace(term, 'E.', ''), '\\[.\\]', '') AS parameter, {R('AVG(x)')} AS estimate FROM {_TRT_SQL} GROUP BY 1""",
)
def _(spark, sf):
    long = posterior.terms_long(S.draws(spark, sf))
    dotted = F.replace(F.col("parameter"), F.lit("_"), F.lit("."))
    code = labels.level_index(labels.joined_key(F.col("chain"), F.col("grp")), labels.TRT_LEVELS)
    indexed = F.concat(dotted, F.lit("["), code.cast("string"), F.lit("]"))
    term = F.when(F.col("grp") == "site", F.concat(F.lit("E."), dotted)).otherwise(indexed)
    t, trt = F.col("term"), F.col("trt")
    return (
        long.select(term.alias("term"), "x")
        .where(F.col("term").isNotNull())
        .groupBy("term")
        .agg(snap(F.avg("x")).alias("estimate"))
        .withColumn("trt", terms.term_group(t, labels.TRT_LEVELS))
        .select(
            "term",
            F.when(terms.is_population(t), "population").otherwise("treatment").alias("level"),
            "trt",
            F.split_part(trt, F.lit("_"), F.lit(1)).alias("depth"),
            F.split_part(trt, F.lit("_"), F.lit(2)).alias("summer"),
            terms.bare_parameter(t).alias("parameter"),
            "estimate",
        )
    )


@check(
    "l6_natural_scale",
    ("draws",),
    "SELECT chain, iter, "
    + ", ".join(
        f"{R(f'exp(ln({p}))')} AS e_{p}, {R(f'abs(0.05003 - {p})')} AS sig_{p}, {R(f'log10(pow(abs(0.05003 - {p}), -2))')} AS tau_log_{p}" for p in ("alpha_cm", "n")
    )
    + f", {R('exp(ln(theta_r))')} AS e_theta_r, {R('abs(0.00501 - theta_r)')} AS sig_theta_r, {R('log10(pow(abs(0.00501 - theta_r), -2))')} AS tau_log_theta_r, {R('sigma')} AS sigma FROM draws WHERE grp = 'site'",
)
def _(spark, sf):
    d = S.draws(spark, sf).where(F.col("grp") == "site")
    logs = d.select(
        "chain",
        "iter",
        *[F.log(p).alias(f"mu_log_{p}") for p in _P],
        *[(F.lit(0.00501 if p == "theta_r" else 0.05003) - F.col(p)).alias(f"eps_{p}") for p in _P],
        F.pow(F.col("sigma"), F.lit(-2.0)).alias("tau"),
    )
    out = posterior.natural_scale(logs)
    for p in _P:
        out = out.withColumn(f"tau_log_{p}", F.log10(f"tau_log_{p}"))
    return snapped(out, *[c for c in out.columns if c not in ("chain", "iter")])


@check(
    "l7_replicates",
    ("reps",),
    f"""SELECT chain, iter, grp, COUNT(*) AS n, {R('AVG(rep)')} AS mean_rep, {R('STDDEV_SAMP(rep - mu)')} AS sd_noise, {R('MIN(rep)')} AS lo, {R('MAX(rep)')} AS hi
        FROM reps GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    pairs = posterior.replicates(S.observations(spark, sf), S.draws(spark, sf))
    out = pairs.groupBy("chain", "iter", "grp").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("rep").alias("mean_rep"),
        F.stddev_samp(F.col("rep") - F.col("mu")).alias("sd_noise"),
        F.min("rep").alias("lo"),
        F.max("rep").alias("hi"),
    )
    return snapped(out, "mean_rep", "sd_noise", "lo", "hi")


def _pairs(spark, sf):
    return posterior.replicates(S.observations(spark, sf), S.draws(spark, sf))


@check(
    "l8_predicted_quantiles",
    ("reps",),
    f"""SELECT obs_id, {R('AVG(rep)')} AS estimate, {R('STDDEV_SAMP(rep)')} AS std_error, {R('quantile_cont(rep, 0.025)')} AS conf_low,
               {R('quantile_cont(rep, 0.975)')} AS conf_high FROM reps GROUP BY 1""",
)
def _(spark, sf):
    return snapped(
        posterior.predicted_intervals(S.observations(spark, sf), S.draws(spark, sf), "quantile"), "estimate", "std_error", "conf_low", "conf_high"
    )


REP_HDI_SQL = f"""(SELECT obs_id, estimate, std_error, conf_low, conf_high
   FROM (SELECT obs_id, AVG(rep) AS estimate, STDDEV_SAMP(rep) AS std_error FROM reps GROUP BY 1) JOIN {hdi_sql('reps', ('obs_id',), 'rep')} USING (obs_id))"""


@check(
    "l8_predicted_hdi",
    ("reps",),
    f"SELECT obs_id, {_rounded(('estimate', 'std_error', 'conf_low', 'conf_high'))} FROM {REP_HDI_SQL}",
)
def _(spark, sf):
    out = posterior.predicted_intervals(S.observations(spark, sf), S.draws(spark, sf))
    return snapped(out, "estimate", "std_error", "conf_low", "conf_high")


@check(
    "l9_deviance",
    ("reps",),
    f"""SELECT chain, iter, grp, COUNT(*) AS n_obs, {R('COUNT(*) * ln(2.0 * pi() * pow(MAX(sigma), 2)) + SUM(pow(theta - mu, 2)) / pow(MAX(sigma), 2)')} AS deviance
        FROM reps GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    out = posterior.draw_measures(_pairs(spark, sf), ("chain", "iter", "grp"))
    return snapped(out.select("chain", "iter", "grp", "n_obs", "deviance"), "deviance")


@check(
    "l10_bayesian_r2",
    ("reps",),
    f"SELECT chain, iter, grp, {R('VAR_SAMP(mu) / (VAR_SAMP(mu) + pow(MAX(sigma), 2))')} AS bayes_r2 FROM reps GROUP BY 1, 2, 3",
)
def _(spark, sf):
    out = posterior.draw_measures(_pairs(spark, sf), ("chain", "iter", "grp"))
    return snapped(out.select("chain", "iter", "grp", "bayes_r2"), "bayes_r2")


@check(
    "l11_predictive_loss",
    ("reps",),
    f"SELECT chain, iter, grp, {R('SUM(pow(theta - rep, 2))')} AS d_sum FROM reps GROUP BY 1, 2, 3",
)
def _(spark, sf):
    out = posterior.draw_measures(_pairs(spark, sf), ("chain", "iter", "grp"))
    return snapped(out.select("chain", "iter", "grp", "d_sum"), "d_sum")


def _metrics_select(type_, y, x):
    return f"""SELECT {type_} AS type, {R(f'1 - (1 - REGR_R2({y}, {x})) * (COUNT(*) - 1) / (COUNT(*) - 2)')} AS adj_r2,
        {R('AVG(CASE WHEN theta BETWEEN conf_low AND conf_high THEN 1.0 ELSE 0.0 END)')} AS coverage, {R(f'REGR_SLOPE({y}, {x})')} AS slope
        FROM (SELECT o.trt, o.theta, p.* FROM obs o JOIN {REP_HDI_SQL} p USING (obs_id))"""


@check(
    "l12_fit_metrics",
    ("reps", "obs"),
    _metrics_select("trt", "estimate", "theta") + " GROUP BY trt UNION ALL " + _metrics_select("'all'", "theta", "estimate"),
)
def _(spark, sf):
    obs = S.observations(spark, sf)
    intervals = posterior.predicted_intervals(obs, S.draws(spark, sf))
    return snapped(posterior.fit_metrics(obs, intervals), "adj_r2", "coverage", "slope")


@check(
    "l13_treatment_differences",
    ("terms",),
    f"""SELECT a.parameter, a.grp AS grp_a, b.grp AS grp_b, {R('a.estimate')} AS mean_a, {R('b.estimate')} AS mean_b,
               NOT (a.estimate BETWEEN b.conf_low AND b.conf_high) AND NOT (b.estimate BETWEEN a.conf_low AND a.conf_high) AS different
        FROM {HDI_SUMMARY_SQL} a JOIN {HDI_SUMMARY_SQL} b ON a.parameter = b.parameter AND a.grp < b.grp""",
)
def _(spark, sf):
    return snapped(posterior.treatment_differences(_hdi(spark, sf)), "mean_a", "mean_b")


# ---- M: lookup table and conversion ----------------------------------------

_Q = ("q50", "q25", "q75")
_LOGQ = ", ".join(f"{R(f'log10({q})')} AS {q}" for q in _Q)
_LOGNQ = ", ".join(f"{R(f'log10(-{q})')} AS {q}" for q in _Q)


def _logs(df, sign=1):
    return df.select(
        *[snap(F.log10(sign * F.col(c))).alias(c) if c in _Q else F.col(c) for c in df.columns]
    )


def _lookup(spark, sf):
    return lookup.masked_lookup(lookup.lookup_quantiles(S.draws(spark, sf)), min_draws=100)


@check(
    "m1_swc_grid",
    ("swc_grid", "wc_days"),
    f"""SELECT g.swc_idx, {R('g.swc')} AS swc, COUNT(w.i) AS n FROM swc_grid g
        LEFT JOIN (SELECT {grid_index_sql('wc_mean')} AS i FROM wc_days) w ON w.i = g.swc_idx GROUP BY 1, 2""",
)
def _(spark, sf):
    from loamline.operators.nearest import grid_index

    used = S.wc_days(spark, sf).groupBy(grid_index(F.col("wc_mean")).alias("swc_idx")).agg(F.count(F.lit(1)).alias("n"))
    grid = lookup.swc_grid(spark).join(used, "swc_idx", "left")
    return grid.select("swc_idx", snap("swc").alias("swc"), F.coalesce("n", F.lit(0)).alias("n"))


@check("m2_lookup_quantiles", ("lookup_q",), f"SELECT swc_idx, {R('swc')} AS swc, grp, n_ok, {_LOGQ} FROM lookup_q")
def _(spark, sf):
    return _logs(snapped(lookup.lookup_quantiles(S.draws(spark, sf)), "swc"))


@check("m3_masked_lookup", ("lookup",), f"SELECT swc_idx, {R('swc')} AS swc, grp, n_ok, {_LOGNQ} FROM lookup")
def _(spark, sf):
    return _logs(snapped(_lookup(spark, sf), "swc"), -1)


_WIDE = [(g, q) for g in ("site", "S1", "S4") for q in _Q]


@check(
    "m3_wide_lookup",
    ("lookup",),
    f"""SELECT swc_idx, {R('swc')} AS swc, MAX(n_ok) FILTER (WHERE grp = 'site') AS n,
               {', '.join(f"{R(f"log10(-MAX({q}) FILTER (WHERE grp = '{g}'))")} AS {g}_{q}" for g, q in _WIDE)} FROM lookup GROUP BY swc_idx, swc""",
)
def _(spark, sf):
    wide = lookup.wide_lookup(_lookup(spark, sf))
    logs = [snap(F.log10(-F.col(f"{g}_{q}"))).alias(f"{g}_{q}") for g, q in _WIDE]
    return wide.select("swc_idx", snap("swc").alias("swc"), "n", *logs)


@check(
    "a7_saved_lookup", ("lookup",), f"SELECT swc_idx, {R('swc')} AS swc, grp, n_ok, {_LOGNQ} FROM lookup"
)
def _(spark, sf):
    path = scratch_path(spark, "lookup")
    tables.save_table(_lookup(spark, sf), path)
    return _logs(snapped(tables.load_table(spark, path), "swc"), -1)


_TRT_DRAWS_SQL = """(SELECT (chain % 2 + 1) || '_' || grp AS grp, alpha_cm, n, theta_r FROM draws WHERE grp <> 'site'
                     UNION ALL SELECT 'total', alpha_cm, n, theta_r FROM draws WHERE grp = 'site')"""


@check(
    "m4_depth_treatment_lookup",
    ("draws", "swc_grid"),
    f"""SELECT swc_idx, {R('swc')} AS swc, grp, COUNT(s) AS n_ok, {', '.join(f"{R(f'log10(quantile_cont(s, {p}))')} AS {q}" for q, p in lookup.QUANTILES.items())}
        FROM (SELECT swc_idx, swc, grp, {suction('swc', 'alpha_cm', 'n', 'theta_r')} AS s FROM swc_grid, {_TRT_DRAWS_SQL}) GROUP BY ALL""",
)
def _(spark, sf):
    trt = F.concat_ws("_", (F.col("chain") % 2 + 1).cast("string"), "grp")
    named = S.draws(spark, sf).withColumn("grp", F.when(F.col("grp") == "site", "total").otherwise(trt))
    return _logs(snapped(lookup.lookup_quantiles(named), "swc"))


_STATS = ("median", "lower", "upper")
_SWP = tuple(f"swp_{s}" for s in _STATS)
_SWP_SQL = ", ".join(f"{R(f'log10(-l.{q})')} AS swp_{s}" for s, q in lookup.STATISTICS.items())


def _log_swp(df):
    return df.select(*[snap(F.log10(-F.col(c))).alias(c) if c in _SWP else F.col(c) for c in df.columns])


_RANGE_SQL = "wc_mean < 0.0439 OR wc_mean >= 0.44"


@check(
    "m5_convert",
    ("wc_days", "lookup"),
    f"""SELECT w.date, w.plot_id, w.depth, {_SWP_SQL} FROM wc_days w
        LEFT JOIN lookup l ON l.grp = 'site' AND l.swc_idx = {grid_index_sql('w.wc_mean')}""",
)
def _(spark, sf):
    out = lookup.convert(S.wc_days(spark, sf), _lookup(spark, sf), "wc_mean", "site", _STATS)
    return _log_swp(out.select("date", "plot_id", "depth", *_SWP))


@check(
    "m6_convert_by_row",
    ("wc_days", "lookup"),
    f"""SELECT w.date, w.plot_id, w.depth, w.summer, {_SWP_SQL} FROM wc_days w
        LEFT JOIN lookup l ON l.grp = w.summer AND l.swc_idx = {grid_index_sql('w.wc_mean')}""",
)
def _(spark, sf):
    out = lookup.convert(S.wc_days(spark, sf), _lookup(spark, sf), "wc_mean", F.col("summer"), _STATS)
    return _log_swp(out.select("date", "plot_id", "depth", "summer", *_SWP))


@check(
    "m7_range_check",
    ("readings",),
    f"SELECT id, dt, {R('value')} AS value, value < 0.0439 OR value >= 0.44 AS out_of_range FROM readings WHERE variable = 'VWC'",
)
def _(spark, sf):
    vwc = S.readings(spark, sf).where(F.col("variable") == "VWC").select("id", "dt", "value")
    return snapped(vwc.withColumn("out_of_range", lookup.out_of_range(F.col("value"))), "value")


_PREDICTED_SQL = f"""(SELECT p.date, p.plot_id, p.depth, p.summer, p.wp_mean, l.q50 AS swp_median, l.q25 AS swp_lower, l.q75 AS swp_upper
    FROM paired p LEFT JOIN lookup l ON l.grp = p.summer AND l.swc_idx = {grid_index_sql('p.wc_mean')})"""


def _predicted(spark, sf):
    return lookup.convert(S.paired(spark, sf), _lookup(spark, sf), "wc_mean", F.col("summer"), _STATS)


@check(
    "m8_predicted_observed",
    ("paired", "lookup"),
    f"""SELECT date, plot_id, depth, summer, {R('wp_mean')} AS wp_mean, {', '.join(f"{R(f'log10(-{c})')} AS {c}" for c in _SWP)} FROM {_PREDICTED_SQL}""",
)
def _(spark, sf):
    out = _predicted(spark, sf).select("date", "plot_id", "depth", "summer", snap("wp_mean").alias("wp_mean"), *_SWP)
    return _log_swp(out)


@check(
    "m8_prediction_errors",
    ("paired", "lookup"),
    f"""SELECT summer, COUNT(swp_median - wp_mean) AS n, {R('AVG(swp_median - wp_mean)')} AS bias, {R('sqrt(AVG(pow(swp_median - wp_mean, 2)))')} AS rmse,
               {R('AVG(CASE WHEN wp_mean BETWEEN swp_upper AND swp_lower THEN 1.0 WHEN swp_upper IS NOT NULL AND swp_lower IS NOT NULL THEN 0.0 END)')} AS coverage
        FROM {_PREDICTED_SQL} GROUP BY 1""",
)
def _(spark, sf):
    return snapped(lookup.prediction_errors(_predicted(spark, sf)), "bias", "rmse", "coverage")


_DAY_SWP = ("swp_mean", "swp_min", "swp_max")


@check(
    "m9_daily_converted_potential",
    ("readings", "design", "seasons_ev", "lookup"),
    f"""SELECT g.id, g.date, d.summer, d.winter, {', '.join(f"{R(f'log10(-g.{c})')} AS {c}" for c in _DAY_SWP)}, s.season FROM
        (SELECT r.id, r.date, r.house, r.plot, AVG(l.q50) AS swp_mean, MIN(l.q50) AS swp_min, MAX(l.q50) AS swp_max
         FROM readings r LEFT JOIN lookup l ON l.grp = 'site' AND l.swc_idx = {grid_index_sql('r.value')}
         WHERE r.variable = 'VWC' GROUP BY ALL) g
        LEFT JOIN design d USING (house, plot) JOIN seasons_ev s ON g.date BETWEEN s.st AND s.en""",
)
def _(spark, sf):
    out = preparation.daily_converted(S.soil(spark, sf), S.design(spark, sf), _lookup(spark, sf), **EVENT_YEARS)
    logs = [snap(F.log10(-F.col(c))).alias(c) for c in _DAY_SWP]
    return out.select("id", "date", "summer", "winter", *logs, "season")
