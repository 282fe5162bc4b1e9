"""Scalar functions (H), calendar and pulse labels (I), curves (J), fitting (K)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from loamline.functions import curves, labels, terms, timekeys, units
from loamline.operators import calendar, fitting, posterior, pulses
from verification import standins as S
from verification.base import R, check, suction, theta
from verification.joins_aggregates import PULSES_SQL, _pulses
from verification.standins import LINE_YEARS, snap, snapped

# ---- H: scalar functions ---------------------------------------------------


@check(
    "h1_unit_conversions",
    ("paired",),
    f"""SELECT date, plot_id, depth, {R('wp_mean * 1.0e6 / 98.0665')} AS cm, {R('wp_mean * 1.0e6 / 98.0665 / 100')} AS m,
               {R('wp_mean')} AS mpa, {R('wc_mean * 25.4')} AS mm FROM paired""",
)
def _(spark, sf):
    cm = units.mpa_to_cm_water(F.col("wp_mean"))
    return S.paired(spark, sf).select(
        "date",
        "plot_id",
        "depth",
        snap(cm).alias("cm"),
        snap(units.cm_to_m(cm)).alias("m"),
        snap(units.cm_water_to_mpa(cm)).alias("mpa"),
        snap(units.inch_to_mm(F.col("wc_mean"))).alias("mm"),
    )


@check(
    "h2_vapour_pressure_deficit",
    ("air_clean",),
    f"SELECT dt, {R('D_inside')} AS D_inside, {R('D_outside')} AS D_outside FROM air_clean",
)
def _(spark, sf):
    from loamline.operators import rollup

    air = rollup.clean_air(S.wide_air(spark, sf))
    return snapped(air.select("dt", "D_inside", "D_outside"), "D_inside", "D_outside")


_DAYS = "(SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)"


def _days(spark, sf):
    return S.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@check(
    "h3_date_parts",
    (),
    f"""SELECT day, CAST(year(day) AS INTEGER) AS year, CAST(weekofyear(day) AS INTEGER) AS week,
               day + INTERVAL 12 HOUR AS noon, COUNT(*) AS n FROM {_DAYS} GROUP BY 1""",
)
def _(spark, sf):
    d = F.col("day")
    # Through the text form, as the raw files give it.
    read = timekeys.slash_day(F.date_format("day", "M/d/yyyy"))
    return (
        _days(spark, sf)
        .groupBy(read.alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("day", F.year(d).alias("year"), F.weekofyear(d).alias("week"), timekeys.at_hour(d, 12).alias("noon"), "n")
    )


@check(
    "h4_week_keys",
    (),
    f"""SELECT day, isoyear(day) || '_' || weekofyear(day) AS iso,
               year(day) + CASE WHEN weekofyear(day) = 1 AND month(day) = 12 THEN 1 ELSE 0 END || '_' || weekofyear(day) AS calendar,
               year(day) || '_' || weekofyear(day) AS plain, COUNT(*) AS n FROM {_DAYS} GROUP BY 1""",
)
def _(spark, sf):
    counted = _days(spark, sf).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("day", *[timekeys.year_week(F.col("day"), m).alias(m) for m in ("iso", "calendar", "plain")], "n")


# Monitored terms: population values from the site draws, indexed ones from the treatments.
TERMS_SQL = """(SELECT chain, iter, x, CASE grp WHEN 'site' THEN 'E.' || p ELSE p || CASE grp WHEN 'S1' THEN '[1]' ELSE '[2]' END END AS term
               FROM (SELECT *, CASE parameter WHEN 'alpha_cm' THEN 'alpha.cm' WHEN 'theta_r' THEN 'theta.r' ELSE 'n' END AS p FROM terms))"""


def _terms(spark, sf):
    p = labels.mapped(F.col("parameter"), {"alpha_cm": "alpha.cm", "theta_r": "theta.r", "n": "n"})
    index = labels.mapped(F.col("grp"), {"S1": "[1]", "S4": "[2]"})
    term = F.when(F.col("grp") == "site", F.concat(F.lit("E."), p)).otherwise(F.concat(p, index))
    return posterior.terms_long(S.draws(spark, sf)).select("chain", "iter", term.alias("term"), "x")


@check(
    "h5_term_names",
    ("terms",),
    f"""SELECT term, replace(replace(replace(term, '[1]', ''), '[2]', ''), 'E.', '') AS parameter, starts_with(term, 'E.') AS population,
               NOT starts_with(term, 'E.') AS treatment_level, COUNT(*) AS n FROM {TERMS_SQL} GROUP BY 1""",
)
def _(spark, sf):
    t = F.col("term")
    return (
        _terms(spark, sf)
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "term",
            terms.bare_parameter(t).alias("parameter"),
            terms.is_population(t).alias("population"),
            terms.is_treatment_level(t).alias("treatment_level"),
            "n",
        )
    )


@check(
    "h6_offset_from_name",
    ("irrigation",),
    """SELECT date + CAST(k AS INTEGER) AS date, treatment, CASE k WHEN 0 THEN 'date' ELSE 'date_' || k END AS type, CAST(k AS INTEGER) AS irig_label
       FROM irrigation, range(0, 13) t(k) WHERE irrigation_mm <> 0""",
)
def _(spark, sf):
    events = S.irrigation(spark, sf).where(F.col("irrigation_mm") != 0)
    names = ["date", *[f"date_{k}" for k in range(1, 13)]]
    wide = events.select("treatment", "date", *[F.date_add("date", k).alias(names[k]) for k in range(1, 13)])
    long = wide.unpivot(["treatment"], names, "type", "day")
    offset = timekeys.offset_of(F.col("type"))
    return long.select("treatment", F.col("day").alias("date"), "type", offset.alias("irig_label"))


@check(
    "h7_padded_week",
    (),
    f"SELECT day, lpad(CAST(weekofyear(day) AS VARCHAR), 2, '0') AS week, COUNT(*) AS n FROM {_DAYS} GROUP BY 1",
)
def _(spark, sf):
    counted = _days(spark, sf).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("day", timekeys.padded_week(F.col("day")).alias("week"), "n")


@check(
    "h8_conditional_assignment",
    ("watering",),
    "SELECT date, treatment, CASE WHEN irrigation_mm IS NULL THEN 'none' WHEN irrigation_mm > 0 THEN 'wet' ELSE 'dry' END AS state FROM watering",
)
def _(spark, sf):
    mm = F.col("irrigation_mm")
    state = F.when(mm.isNull(), "none").when(mm > 0, "wet").otherwise("dry")
    return S.watering_long(spark, sf).select("date", "treatment", state.alias("state"))


@check(
    "h9_curve_math",
    ("obs",),
    f"""SELECT obs_id, {R('ln(h_cm)')} AS log_h, {R('exp(-theta)')} AS exp_t, {R('pow(theta, 1.7)')} AS pow_t, {R('sqrt(h_cm)')} AS sqrt_h,
               {R('abs(wp_mean)')} AS abs_wp FROM obs""",
)
def _(spark, sf):
    return S.observations(spark, sf).select(
        "obs_id",
        snap(F.log("h_cm")).alias("log_h"),
        snap(F.exp(-F.col("theta"))).alias("exp_t"),
        snap(F.pow(F.col("theta"), F.lit(1.7))).alias("pow_t"),
        snap(F.sqrt("h_cm")).alias("sqrt_h"),
        snap(F.abs("wp_mean")).alias("abs_wp"),
    )


# ---- I: season, period and pulse labels ------------------------------------


@check(
    "i1_season_calendar",
    ("seasons_li",),
    """SELECT s.year, s.season, s.season_ord, s.st, s.en, COUNT(l.date) AS n FROM seasons_li s
       LEFT JOIN (SELECT CAST(l_shipdate AS DATE) AS date FROM lineitem) l ON l.date BETWEEN s.st AND s.en GROUP BY ALL""",
)
def _(spark, sf):
    seasons = calendar.season_calendar(spark, 1994, 2002)
    lines = S.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    shipped = calendar.with_season(lines, **LINE_YEARS).groupBy("year", "season").agg(F.count(F.lit(1)).alias("n"))
    joined = seasons.join(shipped, ["year", "season"], "left")
    return joined.select("year", "season", "season_ord", "st", "en", F.coalesce("n", F.lit(0)).alias("n"))


PERIODS = (
    ("Winter 1996", dt.date(1995, 11, 1), dt.date(1996, 4, 30)),
    ("Premonsoon", dt.date(1996, 5, 1), dt.date(1996, 7, 12)),
    ("S1-S4", dt.date(1996, 7, 13), dt.date(1996, 9, 30)),
    ("Winter 1997", dt.date(1996, 10, 1), dt.date(1997, 3, 6)),
)
PERIOD_CASE = (
    "CASE "
    + " ".join(f"WHEN date BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, a, b in PERIODS)
    + " END"
)


@check(
    "i2_study_period",
    ("paired",),
    f"SELECT date, plot_id, depth, {PERIOD_CASE} AS period FROM paired",
)
def _(spark, sf):
    return S.paired(spark, sf).select("date", "plot_id", "depth", timekeys.period_label(F.col("date"), PERIODS).alias("period"))


@check(
    "i3_period_bands",
    ("wc_days",),
    f"""SELECT p.period, p.st, p.en, v.var, q.plot_id, COUNT(d.date) AS n_days
        FROM (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in PERIODS)}) p(period, st, en),
             (VALUES ('Theta~(m^3~m^-3)'), ('Psi~(MPa)')) v(var), (VALUES ('3_4'), ('3_7')) q(plot_id)
        LEFT JOIN (SELECT DISTINCT date, plot_id FROM wc_days) d ON d.plot_id = q.plot_id AND d.date BETWEEN p.st AND p.en GROUP BY ALL""",
)
def _(spark, sf):
    bands = calendar.period_bands(spark, list(labels.SOIL_LABELS.values()), ["3_4", "3_7"], PERIODS)
    period = timekeys.period_label(F.col("date"), PERIODS).alias("period")
    days = S.wc_days(spark, sf).select("plot_id", "date", period).distinct().groupBy("plot_id", "period").agg(F.count("date").alias("n_days"))
    return bands.join(days, ["plot_id", "period"], "left").withColumn("n_days", F.coalesce("n_days", F.lit(0)))


BETWEEN = ((dt.date(1996, 7, 14), dt.date(1996, 10, 8)), (dt.date(1997, 7, 5), dt.date(1997, 9, 23)))
WINDOW_S1 = """(SELECT date + CAST(k AS INTEGER) AS date, CAST(MIN(k) AS INTEGER) AS off FROM irrigation, range(0, 3) t(k)
                WHERE treatment = 'S1' AND irrigation_mm <> 0 GROUP BY 1)"""
BETWEEN_SQL = " OR ".join(f"d.date BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in BETWEEN)


@check(
    "i4_since_irrigation_label",
    ("paired", "irrigation"),
    f"""SELECT d.date, d.plot_id, d.depth, COALESCE(w.off, CASE WHEN {BETWEEN_SQL} THEN 3 END) AS irig_label
        FROM paired d LEFT JOIN {WINDOW_S1} w ON w.date = d.date WHERE d.summer = 'S1'""",
)
def _(spark, sf):
    days = S.paired(spark, sf).where(F.col("summer") == "S1")
    out = pulses.with_days_since(days, S.irrigation(spark, sf), "S1", BETWEEN)
    return out.select("date", "plot_id", "depth", "irig_label")


@check(
    "i5_event_window_exclusion",
    ("paired", "irrigation"),
    """SELECT date, plot_id, depth FROM paired WHERE summer = 'S1' AND date NOT IN
       (SELECT date + CAST(k AS INTEGER) FROM irrigation, range(0, 2) t(k) WHERE treatment = 'S1' AND irrigation_mm <> 0)""",
)
def _(spark, sf):
    days = S.paired(spark, sf).where(F.col("summer") == "S1")
    return pulses.outside_windows(days, S.irrigation(spark, sf), "S1", 1).select("date", "plot_id", "depth")


@check("i6_pulse_table", ("irrigation", "seasons_li"), f"SELECT * FROM {PULSES_SQL}")
def _(spark, sf):
    return _pulses(spark, sf)


# ---- J: curves -------------------------------------------------------------


@check(
    "j1_suction_head",
    ("obs",),
    f"SELECT obs_id, {R('h_cm')} AS h_cm, {R('h_cm / 100')} AS h_m FROM obs",
)
def _(spark, sf):
    w = F.col("wp_mean")
    return S.observations(spark, sf).select("obs_id", snap(curves.suction_cm(w)).alias("h_cm"), snap(curves.suction_m(w)).alias("h_m"))


_PARAMS = "0.05e0", "1.8e0", "0.03e0"


@check("j2_forward_curve", ("obs",), f"SELECT obs_id, {R(theta('h_cm', *_PARAMS))} AS theta_hat FROM obs")
def _(spark, sf):
    hat = curves.water_content(F.col("h_cm"), F.lit(0.05), F.lit(1.8), F.lit(0.03))
    return S.observations(spark, sf).select("obs_id", snap(hat).alias("theta_hat"))


@check(
    "j3_inverse_curve",
    ("obs",),
    f"SELECT obs_id, {R('log10(s)')} AS log_mpa FROM (SELECT obs_id, {suction('theta', '0.05e0', '1.8e0', '0.08e0')} AS s FROM obs)",
)
def _(spark, sf):
    mpa = curves.suction_mpa(F.col("theta"), F.lit(0.05), F.lit(1.8), F.lit(0.08))
    return S.observations(spark, sf).select("obs_id", snap(F.log10(mpa)).alias("log_mpa"))


MEAN_DRAWS_SQL = "(SELECT grp, AVG(alpha_cm) AS a, AVG(n) AS n, AVG(theta_r) AS r FROM draws GROUP BY 1)"


def _mean_draws(spark, sf):
    return S.draws(spark, sf).groupBy("grp").agg(
        F.avg("alpha_cm").alias("a"), F.avg("n").alias("n"), F.avg("theta_r").alias("r")
    )


@check(
    "j4_forward_curve_table",
    ("draws",),
    f"""SELECT grp, CAST(h AS INTEGER) AS h_cm, {R(theta('h', 'a', 'n', 'r'))} AS theta, {R('h * 98.0665 / 1.0e6')} AS mpa
        FROM {MEAN_DRAWS_SQL}, range(1, 10001) t(h)""",
)
def _(spark, sf):
    return snapped(fitting.curve_table(_mean_draws(spark, sf), "a", "n", "r", 1, 10_000).select("grp", "h_cm", "theta", "mpa"), "theta", "mpa")


@check(
    "j5_inverse_curve_table",
    ("draws",),
    f"""SELECT grp, CAST(i AS INTEGER) AS swc_idx, {R('log10(s)')} AS log_mpa FROM
        (SELECT grp, i, {suction('(i / 10000.0e0)', 'a', 'n', 'r')} AS s FROM {MEAN_DRAWS_SQL}, range(200, 4400) t(i))""",
)
def _(spark, sf):
    points = fitting.inverse_table(_mean_draws(spark, sf), "a", "n", "r")
    return points.select("grp", "swc_idx", snap(F.log10("mpa")).alias("log_mpa"))


@check(
    "j6_residuals",
    ("obs",),
    f"SELECT obs_id, {R(f'theta - {theta('h_cm', *_PARAMS)}')} AS residual, {R(f'pow(theta - {theta('h_cm', *_PARAMS)}, 2)')} AS squared FROM obs",
)
def _(spark, sf):
    miss = curves.residual(F.col("theta"), F.col("h_cm"), F.lit(0.05), F.lit(1.8), F.lit(0.03))
    return S.observations(spark, sf).select("obs_id", snap(miss).alias("residual"), snap(miss * miss).alias("squared"))


# ---- K: grid fitting -------------------------------------------------------

ALPHA = fitting.Axis(0.01, 0.02, 10)
SHAPE = fitting.Axis(1.1, 0.2, 8)
RESIDUAL = fitting.Axis(0.01, 0.01, 5)
SIGMA = fitting.Axis(0.02, 0.02, 12)
POWER = 0.002

_POOLED = "(SELECT theta, h_cm, grp FROM obs UNION ALL SELECT theta, h_cm, 'site' FROM obs)"
SSE_SQL = f"""(SELECT grp, alpha_cm, n, theta_r, COUNT(*) AS n_obs, SUM(pow(theta - {theta('h_cm', 'alpha_cm', 'n', 'theta_r')}, 2)) AS sse
   FROM {_POOLED}, (SELECT 0.01e0 + 0.02e0 * i AS alpha_cm FROM range(0, 10) t(i)), (SELECT 1.1e0 + 0.2e0 * i AS n FROM range(0, 8) t(i)),
        (SELECT 0.01e0 + 0.01e0 * i AS theta_r FROM range(0, 5) t(i)) WHERE h_cm > 0 GROUP BY 1, 2, 3, 4)"""
_GRID_COLS = ("alpha_cm", "n", "theta_r")


def _sse(spark, sf):
    obs = fitting.with_pooled(S.observations(spark, sf).select("grp", "theta", "h_cm"))
    return fitting.grid_sse(obs, ALPHA, SHAPE, RESIDUAL)


def _rounded(cols):
    return ", ".join(f"{R(c)} AS {c}" for c in cols)


@check("k1_grid_sse", ("obs",), f"SELECT grp, {_rounded(_GRID_COLS)}, n_obs, {R('sse')} AS sse FROM {SSE_SQL}")
def _(spark, sf):
    return snapped(_sse(spark, sf), *_GRID_COLS, "sse")


@check(
    "k2_best_fit",
    ("obs",),
    f"""SELECT grp, {_rounded(_GRID_COLS)}, {R('sse')} AS sse, n_obs FROM {SSE_SQL}
        QUALIFY ROW_NUMBER() OVER (PARTITION BY grp ORDER BY sse, alpha_cm, n, theta_r) = 1""",
)
def _(spark, sf):
    return snapped(fitting.best_fit(_sse(spark, sf)), *_GRID_COLS, "sse")


POSTERIOR_SQL = f"""(SELECT *, exp(lw) / SUM(exp(lw)) OVER (PARTITION BY grp) AS weight FROM
  (SELECT *, l - MAX(l) OVER (PARTITION BY grp) AS lw FROM
    (SELECT grp, alpha_cm, n, theta_r, sigma, 0.002e0 * (-n_obs * ln(sigma) - sse / (2.0 * sigma * sigma)) AS l FROM {SSE_SQL},
            (SELECT 0.02e0 + 0.02e0 * i AS sigma FROM range(0, 12) t(i)))))"""


@check(
    "k3_grid_posterior",
    ("obs",),
    f"SELECT grp, {_rounded((*_GRID_COLS, 'sigma'))}, {R('lw')} AS log_weight, {R('weight')} AS weight FROM {POSTERIOR_SQL}",
)
def _(spark, sf):
    return snapped(fitting.grid_posterior(_sse(spark, sf), SIGMA, power=POWER), *_GRID_COLS, "sigma", "log_weight", "weight")


@check(
    "k4_posterior_summary",
    ("obs",),
    f"""SELECT grp, parameter, {R('SUM(w * x)')} AS estimate, {R('sqrt(GREATEST(0.0, SUM(w * x * x) - SUM(w * x) * SUM(w * x)))')} AS std_error,
               {R('MIN(x) FILTER (WHERE cum >= 0.025 - 1e-12)')} AS conf_low, {R('MIN(x) FILTER (WHERE cum >= 0.975 - 1e-12)')} AS conf_high
        FROM (SELECT *, SUM(w) OVER (PARTITION BY grp, parameter ORDER BY x) AS cum FROM
               (SELECT grp, parameter, x, SUM(weight) AS w FROM
                 (UNPIVOT (SELECT grp, weight, alpha_cm, n, theta_r, sigma FROM {POSTERIOR_SQL}) ON alpha_cm, n, theta_r, sigma INTO NAME parameter VALUE x)
                GROUP BY 1, 2, 3)) GROUP BY 1, 2""",
)
def _(spark, sf):
    out = fitting.weighted_summary(
        fitting.grid_posterior(_sse(spark, sf), SIGMA, power=POWER), {"conf_low": 0.025, "conf_high": 0.975}
    )
    return snapped(out, "estimate", "std_error", "conf_low", "conf_high")


_AXES = ("alpha_cm", "n", "theta_r", "sigma")
BOX_ROUNDS = 3


def _box_sql(rounds: int) -> str:
    """Posterior tables ``post_1`` to ``post_{rounds}`` on boxes that follow the mass, and their marginals."""
    cells = fitting.PRIOR_CELLS
    a, m, r, v = (cells[c] for c in _AXES)

    def edge(name: str, k: str) -> str:
        at = f"({name}_low + {name}_step * ({k}))"
        return f"exp({at})" if cells[name].log else at

    def width(name: str) -> str:
        return f"({edge(name, f'k_{name} + 1')} - {edge(name, f'k_{name}')})"

    ends = ", ".join(
        f"CAST({cells[c].range[0]!r} AS DOUBLE) AS {c}_low, CAST({(cells[c].range[1] - cells[c].range[0]) / cells[c].count!r} AS DOUBLE) AS {c}_step"
        for c in _AXES
    )
    sides = ", ".join(f"{c}_low, {c}_step" for c in _AXES)
    parts = [f"pooled AS (SELECT * FROM {_POOLED} WHERE h_cm > 0 AND theta IS NOT NULL)", f"boxes_1 AS (SELECT DISTINCT grp, {ends} FROM pooled)"]
    for k in range(1, rounds + 1):
        parts.append(f"""
sums_{k} AS (
  SELECT grp, {sides}, k_alpha_cm, k_n, alpha_cm, n, COUNT(*) AS n_obs, SUM(pow(theta - 0.44e0 * s, 2)) AS rr,
         SUM((theta - 0.44e0 * s) * (1.0 - s)) AS ro, SUM(pow(1.0 - s, 2)) AS oo
  FROM (SELECT *, pow(1 + pow(alpha_cm * h_cm, n), 1.0e0 / n - 1.0) AS s FROM
         (SELECT b.*, o.theta, o.h_cm, i.k AS k_alpha_cm, j.k AS k_n, {edge('alpha_cm', 'i.k + 0.5e0')} AS alpha_cm, {edge('n', 'j.k + 0.5e0')} AS n
          FROM pooled o JOIN boxes_{k} b USING (grp), range(0, {a.count}) i(k), range(0, {m.count}) j(k)))
  GROUP BY ALL),
raw_{k} AS (
  SELECT *, -n_obs * ln(sigma) - GREATEST(rr - 2.0 * theta_r * ro + theta_r * theta_r * oo, 0.0) / (2.0 * sigma * sigma)
            + ln({" * ".join(map(width, _AXES))}) AS raw
  FROM (SELECT s.*, i.k AS k_theta_r, j.k AS k_sigma, {edge('theta_r', 'i.k + 0.5e0')} AS theta_r, {edge('sigma', 'j.k + 0.5e0')} AS sigma
        FROM sums_{k} s, range(0, {r.count}) i(k), range(0, {v.count}) j(k))),
post_{k} AS (
  SELECT *, exp(log_weight) / SUM(exp(log_weight)) OVER (PARTITION BY grp) AS weight
  FROM (SELECT *, raw - MAX(raw) OVER (PARTITION BY grp) AS log_weight FROM raw_{k})),
marginal_{k} AS (
  {" UNION ALL ".join(f"SELECT grp, '{c}' AS parameter, k_{c} AS k, {edge(c, f'k_{c}')} AS low, {edge(c, f'k_{c} + 1')} AS high, {c} AS x, SUM(weight) AS weight FROM post_{k} GROUP BY ALL" for c in _AXES)})""")
        nexts = []
        for c in _AXES:
            least, most = cells[c].range
            first = f"(MIN(k) FILTER (WHERE parameter = '{c}' AND weight >= {fitting.TAIL!r}))"
            last = f"(MAX(k) FILTER (WHERE parameter = '{c}' AND weight >= {fitting.TAIL!r}))"
            nexts.append(
                f"GREATEST({least!r}, ANY_VALUE({c}_low) + ANY_VALUE({c}_step) * ({first} - 1)) AS {c}_from, "
                f"LEAST({most!r}, ANY_VALUE({c}_low) + ANY_VALUE({c}_step) * ({last} + 2)) AS {c}_to"
            )
        steps = ", ".join(f"{c}_from AS {c}_low, ({c}_to - {c}_from) / {cells[c].count} AS {c}_step" for c in _AXES)
        parts.append(f"""
boxes_{k + 1} AS (
  SELECT grp, {steps} FROM (SELECT grp, {", ".join(nexts)} FROM marginal_{k} JOIN boxes_{k} USING (grp) GROUP BY grp))""")
    return ", ".join(parts)


def _box(spark, sf):
    obs = fitting.with_pooled(S.observations(spark, sf).select("grp", "theta", "h_cm"))
    return fitting.box_marginals(fitting.box_posterior(obs, rounds=BOX_ROUNDS))


@check(
    "k3_prior_box_marginals",
    ("obs",),
    f"""SELECT * FROM (WITH {_box_sql(BOX_ROUNDS)}
        SELECT grp, parameter, CAST(k AS INTEGER) AS k, {_rounded(('low', 'high', 'x', 'weight'))} FROM marginal_{BOX_ROUNDS})""",
)
def _(spark, sf):
    return snapped(_box(spark, sf), "low", "high", "x", "weight")


def _reached_sql(p: float) -> str:
    at = f"low + (high - low) * (({p!r}e0 - before) / weight)"
    return R(f"MIN({at}) FILTER (WHERE before < {p!r}e0 AND upto >= {p!r}e0)")


@check(
    "k4_prior_box_summary",
    ("obs",),
    f"""SELECT * FROM (WITH {_box_sql(BOX_ROUNDS)} SELECT grp, parameter, {R('SUM(weight * x)')} AS estimate,
               {R('sqrt(GREATEST(0.0, SUM(weight * x * x) - SUM(weight * x) * SUM(weight * x)))')} AS std_error,
               {_reached_sql(0.025)} AS conf_low, {_reached_sql(0.975)} AS conf_high
        FROM (SELECT *, LAG(upto, 1, 0.0e0) OVER (PARTITION BY grp, parameter ORDER BY k) AS before FROM
              (SELECT *, SUM(weight) OVER (PARTITION BY grp, parameter ORDER BY k) AS upto FROM marginal_{BOX_ROUNDS})) GROUP BY 1, 2)""",
)
def _(spark, sf):
    out = fitting.box_summary(_box(spark, sf), {"conf_low": 0.025, "conf_high": 0.975})
    return snapped(out, "estimate", "std_error", "conf_low", "conf_high")


def _zoom_sql(rounds: int) -> str:
    """Nested rounds; each spans one step to either side of the best point so far."""
    steps = [ALPHA.step, SHAPE.step, RESIDUAL.step]
    counts = [ALPHA.count, SHAPE.count, RESIDUAL.count]
    pick = "QUALIFY ROW_NUMBER() OVER (PARTITION BY grp ORDER BY sse, alpha_cm, n, theta_r) = 1"
    best = f"(SELECT * FROM {SSE_SQL} {pick})"
    for _ in range(rounds):
        finer = [2 * s / (c - 1) for s, c in zip(steps, counts)]
        grid = ", ".join(
            f"b.{p} - {s!r}e0 + {f!r}e0 * {i}.k AS {p}" for p, s, f, i in zip(_GRID_COLS, steps, finer, ("i", "j", "l"))
        )
        best = f"""(SELECT * FROM (SELECT grp, alpha_cm, n, theta_r, COUNT(*) AS n_obs,
                      SUM(pow(theta - {theta('h_cm', 'alpha_cm', 'n', 'theta_r')}, 2)) AS sse
                    FROM {_POOLED} o JOIN (SELECT b.grp, {grid} FROM {best} b, range(0, {counts[0]}) i(k), range(0, {counts[1]}) j(k), range(0, {counts[2]}) l(k)) g
                      USING (grp) WHERE h_cm > 0 AND alpha_cm > 0 AND n > 0 GROUP BY 1, 2, 3, 4) {pick})"""
        steps = finer
    return best


@check(
    "k5_zoomed_fit",
    ("obs",),
    f"SELECT grp, {_rounded(_GRID_COLS)}, {R('sse')} AS sse, n_obs FROM {_zoom_sql(2)}",
)
def _(spark, sf):
    obs = fitting.with_pooled(S.observations(spark, sf).select("grp", "theta", "h_cm"))
    return snapped(fitting.zoomed_fit(obs, ALPHA, SHAPE, RESIDUAL, rounds=2), *_GRID_COLS, "sse")
