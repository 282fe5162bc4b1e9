"""Joins (D), aggregations (E), windows (F), sort and set operations (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.functions import curves, labels, nulls, timekeys
from loamline.operators import (
    calendar,
    intervals,
    lookup,
    nearest,
    posterior,
    pulses,
    quality,
    ranking,
    reshape,
    rollup,
    watering,
)
from verification import standins as S
from verification.base import R, check, grid_index_sql, suction
from verification.sources_shape import _daily_cols, _daily_sql, _ts, _wc, _wp
from verification.standins import LINE_YEARS, snap, snapped

# ---- D: joins --------------------------------------------------------------


@check(
    "d1_attach_design",
    ("readings", "design"),
    f"SELECT id, dt, {R('value')} AS value, summer, winter FROM readings LEFT JOIN design USING (house, plot)",
)
def _(spark, sf):
    out = rollup.with_design(S.readings(spark, sf), S.design(spark, sf))
    return snapped(out.select("id", "dt", "value", "summer", "winter"), "value")


@check(
    "d2_watering_full_join",
    ("watering",),
    f"SELECT date, treatment, {R('irrigation_mm')} AS irrigation_mm, {R('ppt_mm')} AS ppt_mm FROM watering",
)
def _(spark, sf):
    return snapped(S.watering_long(spark, sf), "irrigation_mm", "ppt_mm")


_SHIP_DAYS = "(SELECT l_orderkey, CAST(l_shipdate AS DATE) AS date FROM lineitem)"
_SEASON_SQL = f"""SELECT year, season, COUNT(*) AS n, COUNT(DISTINCT date) AS n_days
                  FROM {_SHIP_DAYS} JOIN seasons_li ON date BETWEEN st AND en GROUP BY 1, 2"""


def _ship_days(spark, sf):
    return S.table(spark, sf, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("date"))


def _per_season(df):
    return df.groupBy("year", "season").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("n_days"))


@check("d3_season_by_calendar_join", ("seasons_li",), _SEASON_SQL)
def _(spark, sf):
    seasons = calendar.season_calendar(spark, 1994, 2002)
    return _per_season(calendar.label_by_interval(_ship_days(spark, sf), seasons, how="inner", width="month"))


@check("d3_season_by_range_join", ("seasons_li",), _SEASON_SQL)
def _(spark, sf):
    seasons = calendar.season_calendar(spark, 1994, 2002)
    return _per_season(calendar.label_by_range(_ship_days(spark, sf), seasons).where(F.col("season").isNotNull()))


@check("d3_season_by_expression", ("seasons_li",), _SEASON_SQL)
def _(spark, sf):
    return _per_season(calendar.with_season(_ship_days(spark, sf), **LINE_YEARS))


# Season bounds as moments, windows of hours and terms of days to months.
@check(
    "d3_season_of_each_moment",
    ("readings", "seasons_ev"),
    """SELECT year, season, COUNT(*) AS n, MAX(dt) AS last_dt FROM readings
       LEFT JOIN (SELECT year, season, CAST(st AS TIMESTAMP) AS st, CAST(en AS TIMESTAMP) + INTERVAL 86399999999 MICROSECOND AS en
                  FROM seasons_ev) ON dt BETWEEN st AND en GROUP BY ALL""",
)
def _(spark, sf):
    seasons = calendar.season_calendar(spark, **S.EVENT_YEARS).select(
        "year",
        "season",
        F.col("st").cast("timestamp_ntz").alias("st"),
        (F.col("en").cast("timestamp_ntz") + F.expr("INTERVAL '23:59:59.999999' HOUR TO SECOND")).alias("en"),
    )
    out = intervals.join_intervals(S.readings(spark, sf), seasons, "dt", width="month")
    return out.groupBy("year", "season").agg(F.count(F.lit(1)).alias("n"), F.max("dt").alias("last_dt"))


@check(
    "d8_readings_in_event_hours",
    ("readings", "design", "irrigation_jan"),
    f"""SELECT id, dt, {R('value')} AS value, e.date AS event_date, {R('e.irrigation_mm')} AS irrigation_mm
        FROM readings JOIN design USING (house, plot)
        LEFT JOIN (SELECT *, date + INTERVAL 6 HOUR AS st, date + INTERVAL 930 MINUTE AS en FROM irrigation_jan WHERE irrigation_mm <> 0) e
          ON e.treatment = summer AND dt BETWEEN e.st AND e.en""",
)
def _(spark, sf):
    """The event of its treatment that each half-hourly reading falls into, from six o'clock to half past three."""
    events = S.irrigation_jan(spark, sf).where(F.col("irrigation_mm") != 0)
    hours = events.select(
        F.col("treatment").alias("summer"),
        F.col("date").alias("event_date"),
        "irrigation_mm",
        timekeys.at_hour(F.col("date"), 6).alias("st"),
        (timekeys.at_hour(F.col("date"), 15) + F.make_dt_interval(mins=F.lit(30))).alias("en"),
    )
    readings = rollup.with_design(S.readings(spark, sf), S.design(spark, sf)).where(F.col("summer").isNotNull())
    out = intervals.join_intervals(readings, hours, "dt", ["summer"], width="hour")
    return snapped(out.select("id", "dt", "value", "event_date", "irrigation_mm"), "value", "irrigation_mm")


@check(
    "d8_shipments_within_terms",
    (),
    """SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem
       LEFT JOIN (SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS st,
                         CAST(o_orderdate AS DATE) + CAST(o_custkey % 400 - 20 AS INTEGER) AS en FROM orders)
         ON o_orderkey = l_orderkey AND CAST(l_shipdate AS DATE) BETWEEN st AND en""",
)
def _(spark, sf):
    """Shipments that fall into their order's term, of none to 380 days and sometimes reversed."""
    first = F.to_date("o_orderdate")
    terms = S.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        "o_orderpriority",
        first.alias("st"),
        F.date_add(first, (F.col("o_custkey") % 400 - 20).cast("int")).alias("en"),
    )
    lines = S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("date"))
    found = intervals.join_intervals(lines, terms, "date", ["l_orderkey"], width="month")
    return found.select("l_orderkey", "l_linenumber", "o_orderpriority")


_PAIR_STATS = ("wp_mean", "wp_min", "wp_max", "wc_mean", "wc_min", "wc_max")
_PAIR_SQL = ", ".join(f"{R(c)} AS {c}" for c in _PAIR_STATS)


@check(
    "d4_pair_by_place_and_day",
    ("wp_daily", "wc_daily"),
    f"""SELECT p.id, p.house, p.plot, p.depth, p.date, p.summer, p.winter, {_PAIR_SQL} FROM wp_daily p
        LEFT JOIN (SELECT house, plot, depth, date, wc_mean, wc_min, wc_max FROM wc_daily) c USING (house, plot, depth, date)""",
)
def _(spark, sf):
    beside = rollup.soil_beside(S.soil(spark, sf))
    out = rollup.paired_table(beside, S.design(spark, sf), **S.EVENT_YEARS)
    return snapped(
        out.select("id", "house", "plot", "depth", "date", "summer", "winter", *_PAIR_STATS), *_PAIR_STATS
    )


@check(
    "d4_pair_by_join",
    ("wp_daily", "wc_daily"),
    f"""SELECT p.id, p.house, p.plot, p.depth, p.date, p.summer, p.winter, {_PAIR_SQL} FROM wp_daily p
        LEFT JOIN (SELECT house, plot, depth, date, wc_mean, wc_min, wc_max FROM wc_daily) c USING (house, plot, depth, date)""",
)
def _(spark, sf):
    out = rollup.paired_days(_wp(spark, sf), _wc(spark, sf))
    return snapped(
        out.select("id", "house", "plot", "depth", "date", "summer", "winter", *_PAIR_STATS), *_PAIR_STATS
    )


@check(
    "d4_pair_null_safe",
    ("wp_daily", "wc_daily"),
    f"""SELECT p.id, p.house, p.plot, p.depth, p.date, p.summer, p.winter, {_PAIR_SQL} FROM wp_daily p
        LEFT JOIN (SELECT house, plot, depth, date, wc_mean, wc_min, wc_max FROM wc_daily) c USING (house, plot, depth, date)""",
)
def _(spark, sf):
    out = rollup.paired_days_null_safe(_wp(spark, sf), _wc(spark, sf))
    return snapped(
        out.select("id", "house", "plot", "depth", "date", "summer", "winter", *_PAIR_STATS), *_PAIR_STATS
    )


@check(
    "d5_match_side_by_side",
    ("wp_daily", "wc_daily"),
    f"""SELECT c.id, c.house, c.plot, c.depth, c.date, c.summer, c.winter, {_PAIR_SQL} FROM wc_daily c
        LEFT JOIN (SELECT house, plot, depth, date, wp_mean, wp_min, wp_max FROM wp_daily) p USING (house, plot, depth, date)""",
)
def _(spark, sf):
    beside = rollup.soil_beside(S.soil(spark, sf))
    out = rollup.paired_table(beside, S.design(spark, sf), ("wc",), **S.EVENT_YEARS)
    return snapped(
        out.select("id", "house", "plot", "depth", "date", "summer", "winter", *_PAIR_STATS), *_PAIR_STATS
    )


@check(
    "d5_match_from_content",
    ("wp_days", "wc_days"),
    f"""SELECT c.date, c.house, c.plot, c.depth, {_PAIR_SQL} FROM wc_days c
        LEFT JOIN (SELECT date, house, depth, plot, wp_mean, wp_min, wp_max FROM wp_days) p USING (date, house, depth, plot)
        WHERE c.plot_id IN (SELECT plot_id FROM wp_days)""",
)
def _(spark, sf):
    out = rollup.matched_from_content(S.wc_days(spark, sf), S.wp_days(spark, sf))
    return snapped(out.select("date", "house", "plot", "depth", *_PAIR_STATS), *_PAIR_STATS)


@check(
    "d6_attach_irrigation",
    ("paired", "irrigation"),
    f"""SELECT p.date, p.plot_id, p.depth, {R('wc_mean')} AS wc_mean, {R('i.irrigation_mm')} AS irrigation_mm
        FROM paired p LEFT JOIN irrigation i ON i.date = p.date AND i.treatment = p.summer""",
)
def _(spark, sf):
    out = watering.with_irrigation(S.paired(spark, sf), S.irrigation(spark, sf))
    return snapped(out.select("date", "plot_id", "depth", "wc_mean", "irrigation_mm"), "wc_mean", "irrigation_mm")


_WINDOW_SQL = """(SELECT date + CAST(k AS INTEGER) AS date, CAST(k AS INTEGER) AS off FROM irrigation, range(0, 3) t(k)
                  WHERE treatment = 'S4' AND irrigation_mm <> 0)"""


@check(
    "d7_outside_event_windows",
    ("paired", "irrigation"),
    f"""SELECT date, plot_id, depth, {R('wc_mean')} AS wc_mean FROM paired
        WHERE summer = 'S4' AND date NOT IN (SELECT date FROM {_WINDOW_SQL})""",
)
def _(spark, sf):
    days = S.paired(spark, sf).where(F.col("summer") == "S4")
    out = pulses.outside_windows(days, S.irrigation(spark, sf), "S4", 2)
    return snapped(out.select("date", "plot_id", "depth", "wc_mean"), "wc_mean")


# Pulses of one treatment; lead() runs over every nonzero event before any filter.
PULSES_SQL = """(SELECT treatment, st, en, CAST(ROW_NUMBER() OVER (ORDER BY st) AS INTEGER) AS pulse,
                        CAST(ROW_NUMBER() OVER (PARTITION BY year ORDER BY st) AS INTEGER) AS pulse_in_season
                 FROM (SELECT e.treatment, e.date AS st, LEAST(e.next_date - 1, s.en) AS en, s.year, s.season, irrigation_mm
                       FROM (SELECT *, LEAD(date) OVER (PARTITION BY treatment ORDER BY date) AS next_date
                             FROM irrigation WHERE irrigation_mm <> 0) e
                       JOIN seasons_li s ON e.date BETWEEN s.st AND s.en)
                 WHERE treatment = 'S4' AND season = 'Growing' AND year IN (1996, 1997) AND irrigation_mm <> 30)"""


def _pulses(spark, sf):
    return pulses.pulse_table(S.irrigation(spark, sf), "S4", (1996, 1997), **LINE_YEARS)


@check(
    "d8_assign_pulse",
    ("paired", "irrigation", "seasons_li"),
    f"""SELECT d.date, d.plot_id, d.depth, p.pulse, p.pulse_in_season FROM paired d
        LEFT JOIN {PULSES_SQL} p ON d.date BETWEEN p.st AND p.en WHERE d.summer = 'S4'""",
)
def _(spark, sf):
    days = S.paired(spark, sf).where(F.col("summer") == "S4")
    out = pulses.with_pulse(days, _pulses(spark, sf))
    return out.select("date", "plot_id", "depth", "pulse", "pulse_in_season")


@check(
    "d9_days_since_irrigation",
    ("paired", "irrigation"),
    f"""SELECT d.date, d.plot_id, d.depth, w.irig_label FROM paired d
        LEFT JOIN (SELECT date, MIN(off) AS irig_label FROM {_WINDOW_SQL} GROUP BY 1) w USING (date) WHERE d.summer = 'S4'""",
)
def _(spark, sf):
    days = S.paired(spark, sf).where(F.col("summer") == "S4")
    out = days.join(pulses.days_since(S.irrigation(spark, sf), "S4"), "date", "left")
    return out.select("date", "plot_id", "depth", "irig_label")


@check(
    "d10_nearest_grid_point",
    ("wc_days",),
    f"SELECT date, plot_id, depth, {grid_index_sql('wc_mean')} AS swc_idx FROM wc_days",
)
def _(spark, sf):
    return S.wc_days(spark, sf).select(
        "date", "plot_id", "depth", nearest.grid_index(F.col("wc_mean")).alias("swc_idx")
    )


@check(
    "d10_nearest_value",
    ("wc_days", "obs"),
    f"""SELECT c.date, c.plot_id, c.depth, {R('MIN_BY(g.theta, (abs(g.theta - c.wc_mean), g.theta))')} AS theta
        FROM wc_days c, (SELECT DISTINCT theta FROM obs) g GROUP BY ALL""",
)
def _(spark, sf):
    grid = S.observations(spark, sf).select("theta").distinct()
    out = nearest.nearest_join(S.wc_days(spark, sf), grid, "wc_mean", "theta", 0.002)
    return snapped(out.select("date", "plot_id", "depth", "theta"), "theta")


@check(
    "d11_bind_predictions",
    ("reps",),
    f"""SELECT o.obs_id, {R('o.theta')} AS theta, {R('p.estimate')} AS estimate FROM obs o
        JOIN (SELECT obs_id, AVG(mu) AS estimate FROM reps GROUP BY 1) p USING (obs_id)""",
)
def _(spark, sf):
    obs = S.observations(spark, sf)
    predicted = posterior.replicates(obs, S.draws(spark, sf)).groupBy("obs_id").agg(F.avg("mu").alias("estimate"))
    return snapped(obs.join(predicted, "obs_id").select("obs_id", "theta", "estimate"), "theta", "estimate")


@check(
    "d12_draws_by_grid",
    ("draws", "swc_grid"),
    f"""SELECT swc_idx, grp, COUNT(*) AS n_pairs, COUNT(s) AS n_defined, {R('LOG10(MAX(s))')} AS log_max
        FROM (SELECT swc_idx, grp, {suction('swc', 'alpha_cm', 'n', 'theta_r')} AS s FROM swc_grid, draws) GROUP BY 1, 2""",
)
def _(spark, sf):
    pairs, _ = lookup.inverse_curves(S.draws(spark, sf))
    return pairs.groupBy("swc_idx", "grp").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count("suction_mpa").alias("n_defined"),
        snap(F.log10(F.max("suction_mpa"))).alias("log_max"),
    )


# ---- E: aggregations -------------------------------------------------------


@check("e1_daily_temperature", ("ts_daily",), _daily_sql("ts", "ts_daily"))
def _(spark, sf):
    return snapped(_ts(spark, sf), *_daily_cols("ts"))


@check("e2_daily_water_content", ("wc_daily",), _daily_sql("wc", "wc_daily"))
def _(spark, sf):
    return snapped(_wc(spark, sf), *_daily_cols("wc"))


@check("e3_daily_water_potential", ("wp_daily",), _daily_sql("wp", "wp_daily"))
def _(spark, sf):
    return snapped(_wp(spark, sf), *_daily_cols("wp"))


@check(
    "e4_daily_air",
    ("air_daily",),
    f"SELECT variable, location, date, {R('mean')} AS mean, {R('min')} AS min, {R('max')} AS max, var_label, location_ord, year, season FROM air_daily",
)
def _(spark, sf):
    return snapped(S.air_daily(spark, sf), "mean", "min", "max")


@check(
    "e5_constants_carried",
    ("readings",),
    """SELECT id, MIN(house) AS house, MIN(plot) AS plot, MIN(depth) AS depth, COUNT(DISTINCT house * 1000 + plot * 10 + depth) AS n_places
       FROM readings GROUP BY 1""",
)
def _(spark, sf):
    return S.readings(spark, sf).groupBy("id").agg(
        *[F.any_value(c).alias(c) for c in ("house", "plot", "depth")],
        F.count_distinct(F.col("house") * 1000 + F.col("plot") * 10 + F.col("depth")).alias("n_places"),
    )


def _means_sql(prefix, source, keys, poisoned=False):
    def mean(c):
        return f"CASE WHEN COUNT({c}) = COUNT(*) THEN AVG({c}) END" if poisoned else f"AVG({c})"

    stats = ", ".join(f"{R(mean(c))} AS mean_{c}" for c in _daily_cols(prefix))
    return f"SELECT {keys}, {stats}, COUNT(*) AS n FROM {source} GROUP BY {keys}"


def _mean_cols(prefix):
    return [f"mean_{c}" for c in _daily_cols(prefix)]


@check("e6_plot_means", ("wc_daily",), _means_sql("wc", "wc_daily", "date, depth"))
def _(spark, sf):
    return snapped(rollup.plot_means(_wc(spark, sf), ("date", "depth"), "wc"), *_mean_cols("wc"))


@check(
    "e7_treatment_comparison", ("wc_daily",), _means_sql("wc", "wc_daily", "summer, date, depth", poisoned=True)
)
def _(spark, sf):
    return snapped(
        rollup.plot_means(_wc(spark, sf), ("summer", "date", "depth"), "wc", skip_nulls=False), *_mean_cols("wc")
    )


_AIR_MEANS = [f"mean_{v}_{s}" for v in ("T", "D") for s in ("mean", "min", "max")]
AIR_MEANS_SQL = "SELECT date, " + ", ".join(
    f"AVG({s}) FILTER (WHERE variable = '{v}') AS mean_{v}_{s}" for v in ("T", "D") for s in ("mean", "min", "max")
) + " FROM air_daily WHERE location = 'outside' AND variable IN ('T', 'D') GROUP BY 1"


@check(
    "e8_outside_air",
    ("air_daily",),
    f"SELECT date, {', '.join(f'{R(c)} AS {c}' for c in _AIR_MEANS)} FROM ({AIR_MEANS_SQL})",
)
def _(spark, sf):
    return snapped(rollup.outside_air_means(S.air_daily(spark, sf)), *_AIR_MEANS)


DEPTH_CASE = "CASE depth WHEN 1 THEN '0-12 cm' WHEN 2 THEN '25 cm' WHEN 3 THEN '75 cm' END"


@check(
    "e9_size_labels",
    ("wc_daily",),
    f"""SELECT depth, MAX(n) AS n_plots, {DEPTH_CASE} || ' (n = ' || MAX(n) || ')' AS label
        FROM (SELECT date, depth, COUNT(*) AS n FROM wc_daily GROUP BY 1, 2) GROUP BY 1""",
)
def _(spark, sf):
    means = rollup.plot_means(_wc(spark, sf), ("date", "depth"), "wc")
    return rollup.size_labels(means, ("depth",), labels.depth_label(F.col("depth")))


@check(
    "e10_axis_ratio",
    ("watering_jan", "wc_daily"),
    f"""SELECT {R('amount / top')} AS ratio, {R('low / amount')} AS inverse FROM
        (SELECT GREATEST(MAX(irrigation_mm), MAX(ppt_mm)) AS amount FROM watering_jan),
        (SELECT MAX(m) AS top, MIN(m) AS low FROM (SELECT AVG(wc_max) AS m FROM wc_daily GROUP BY date, depth))""",
)
def _(spark, sf):
    means = rollup.plot_means(_wc(spark, sf), ("date", "depth"), "wc")
    water = S.watering_jan(spark, sf)
    one = watering.axis_ratio(water, means, F.max("mean_wc_max")).withColumn("kind", F.lit("ratio"))
    two = watering.axis_ratio(water, means, F.min("mean_wc_max"), inverse=True).withColumn("kind", F.lit("inverse"))
    both = one.unionByName(two)
    return both.agg(
        *[snap(F.max(F.when(F.col("kind") == k, F.col("ratio")))).alias(k) for k in ("ratio", "inverse")]
    )


_WEEK = "isoyear(date) || '_' || weekofyear(date)"
WEEKLY_PAIRS_SQL = f"""(SELECT dt, date, plot, depth, house, {_WEEK} AS year_week,
                        MAX(value) FILTER (WHERE variable = 'VWC') AS vwc,
                        MAX(value) FILTER (WHERE variable = 'SWP') / 1000 AS swp
                        FROM six_hourly WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4, 5)"""


def _weekly_pairs(spark, sf):
    from loamline.functions import timekeys

    long = S.bucketed(S.readings(spark, sf).where(F.col("variable").isin("VWC", "SWP")), 360)
    ids = ["dt", "date", "plot", "depth", "house"]
    mean = long.groupBy(*ids, "variable").agg(F.avg("value").alias("value")).where(F.col("value").isNotNull())
    wide = reshape.variables_wide(mean, ids, ["VWC", "SWP"])
    return wide.select(
        *ids,
        timekeys.year_week(F.col("date")).alias("year_week"),
        F.col("VWC").alias("vwc"),
        (F.col("SWP") / 1000).alias("swp"),
    )


@check(
    "e11_weekly_range_ratio",
    ("six_hourly",),
    f"""SELECT w.dt, w.plot, w.depth, w.house, w.year_week, {R('prop')} AS prop, {R('lo')} AS lo, {R('vwc * prop + lo')} AS vwc_scaled
        FROM {WEEKLY_PAIRS_SQL} w JOIN (SELECT year_week, (MAX(swp) - MIN(swp)) / (MAX(vwc) - MIN(vwc)) AS prop, MIN(swp) AS lo
             FROM {WEEKLY_PAIRS_SQL} GROUP BY 1) USING (year_week)""",
)
def _(spark, sf):
    out = rollup.rescaled_by_week(_weekly_pairs(spark, sf))
    return snapped(
        out.select("dt", "plot", "depth", "house", "year_week", "prop", "lo", "vwc_scaled"), "prop", "lo", "vwc_scaled"
    )


@check(
    "e12_weekly_watered",
    ("irrigation",),
    f"""SELECT {_WEEK} AS year_week, COUNT(*) FILTER (WHERE irrigation_mm > 0) AS n_watered,
               COALESCE(BOOL_OR(irrigation_mm > 0), FALSE) AS watered FROM irrigation GROUP BY 1""",
)
def _(spark, sf):
    from loamline.functions import timekeys

    irrigation = S.irrigation(spark, sf).withColumn("year_week", timekeys.year_week(F.col("date")))
    return rollup.weekly_watered(irrigation)


@check(
    "e13_suction_histogram",
    ("obs",),
    f"""SELECT bin, COUNT(*) AS n, {R('-1.0e0 + 4.0 / 30 * (bin - 1)')} AS log_from FROM
        (SELECT CAST(CASE WHEN v < -1 THEN 0 WHEN v >= 3 THEN 31 ELSE floor((v + 1.0) / 4.0 * 30) + 1 END AS BIGINT) AS bin
         FROM (SELECT log10(h_cm / 100.0) AS v FROM obs WHERE depth = 2)) GROUP BY 1""",
)
def _(spark, sf):
    middle = S.observations(spark, sf).where(F.col("depth") == 2)
    return snapped(quality.log_histogram(middle, curves.suction_m(F.col("wp_mean")), -1.0, 3.0, 30), "log_from")


@check("e14_defined_predictions", ("lookup_q",), "SELECT swc_idx, grp, n_ok FROM lookup_q")
def _(spark, sf):
    pairs, _ = lookup.inverse_curves(S.draws(spark, sf))
    return pairs.groupBy("swc_idx", "grp").agg(F.count(nulls.finite(F.col("suction_mpa"))).alias("n_ok"))


_QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
_QUARTILE_SQL = ", ".join(f"{R(f'quantile_cont(x, {p})')} AS {q}" for q, p in _QUARTILES.items())
_PRICES_SQL = "(SELECT l_returnflag AS grp, l_extendedprice AS x FROM lineitem)"


def _prices(spark, sf):
    return S.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("x"))


@check("e15_exact_quantiles", (), f"SELECT grp, COUNT(x) AS n_ok, {_QUARTILE_SQL} FROM {_PRICES_SQL} GROUP BY 1")
def _(spark, sf):
    return snapped(ranking.exact_quantiles(_prices(spark, sf), ["grp"], "x", _QUARTILES), *_QUARTILES)


@check("e15_exact_quantiles_by_bin", (), f"SELECT grp, COUNT(x) AS n_ok, {_QUARTILE_SQL} FROM {_PRICES_SQL} GROUP BY 1")
def _(spark, sf):
    return snapped(
        ranking.exact_quantiles(_prices(spark, sf), ["grp"], "x", _QUARTILES, strategy="binned"), *_QUARTILES
    )


@check(
    "e15_exact_quantiles_by_rank", (), f"SELECT grp, COUNT(x) AS n_ok, {_QUARTILE_SQL} FROM {_PRICES_SQL} GROUP BY 1"
)
def _(spark, sf):
    return snapped(
        ranking.exact_quantiles(_prices(spark, sf), ["grp"], "x", _QUARTILES, strategy="ranked"), *_QUARTILES
    )


@check(
    "e16_regression",
    ("obs",),
    f"""SELECT trt, CAST(REGR_COUNT(theta, wp_mean) AS BIGINT) AS n, {R('REGR_SLOPE(theta, wp_mean)')} AS slope,
               {R('1 - (1 - REGR_R2(theta, wp_mean)) * (COUNT(*) - 1) / (COUNT(*) - 2)')} AS adj_r2
        FROM obs GROUP BY 1""",
)
def _(spark, sf):
    return snapped(quality.regression(S.observations(spark, sf), ["trt"], "theta", "wp_mean"), "slope", "adj_r2")


@check(
    "e17_interval_coverage",
    ("wc_days",),
    f"SELECT depth, COUNT(*) AS n, {R('AVG(CASE WHEN wc_mean BETWEEN wc_min + 0.01 AND wc_max - 0.01 THEN 1.0 ELSE 0.0 END)')} AS coverage FROM wc_days GROUP BY 1",
)
def _(spark, sf):
    days = S.wc_days(spark, sf).withColumn("lo", F.col("wc_min") + 0.01).withColumn("hi", F.col("wc_max") - 0.01)
    return days.groupBy("depth").agg(
        F.count(F.lit(1)).alias("n"), snap(quality.covered("wc_mean", "lo", "hi")).alias("coverage")
    )


@check(
    "e18_group_sizes",
    ("paired",),
    "SELECT season, depth, COUNT(*) AS n_rows, COUNT(DISTINCT summer) AS n_distinct FROM paired GROUP BY 1, 2",
)
def _(spark, sf):
    return quality.group_sizes(S.paired(spark, sf), ["season", "depth"], "summer")


# ---- F: windows ------------------------------------------------------------


@check(
    "f1_pulse_numbers",
    ("irrigation",),
    """SELECT date, treatment, CAST(ROW_NUMBER() OVER (PARTITION BY treatment ORDER BY date) AS INTEGER) AS pulse
       FROM irrigation WHERE irrigation_mm <> 0""",
)
def _(spark, sf):
    return pulses.numbered_events(S.irrigation(spark, sf)).select("date", "treatment", "pulse")


@check(
    "f2_pulse_intervals",
    ("irrigation", "seasons_li"),
    f"""SELECT e.treatment, e.date AS st, LEAST(e.next_date - 1, s.en) AS en, {R('irrigation_mm')} AS irrigation_mm, s.year, s.season
        FROM (SELECT *, LEAD(date) OVER (PARTITION BY treatment ORDER BY date) AS next_date FROM irrigation WHERE irrigation_mm <> 0) e
        JOIN seasons_li s ON e.date BETWEEN s.st AND s.en""",
)
def _(spark, sf):
    return snapped(pulses.event_spans(S.irrigation(spark, sf), **LINE_YEARS), "irrigation_mm")


@check(
    "f3_without_first_pulse",
    ("irrigation", "seasons_li"),
    f"SELECT * FROM {PULSES_SQL} WHERE pulse_in_season > 1",
)
def _(spark, sf):
    return pulses.without_first(_pulses(spark, sf))


def hdi_sql(source: str, keys: tuple[str, ...], x: str = "x") -> str:
    """Shortest-interval query over ``source``: keys, conf_low, conf_high."""
    k = ", ".join(keys)
    match = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    ranked = f"SELECT {k}, {x} AS x, ROW_NUMBER() OVER (PARTITION BY {k} ORDER BY {x}) AS rn, COUNT(*) OVER (PARTITION BY {k}) AS cnt FROM {source}"
    ka = ", ".join(f"a.{c}" for c in keys)
    return f"""(SELECT {k}, best[2] AS conf_low, best[3] AS conf_high FROM
        (WITH r AS ({ranked}) SELECT {ka}, MIN([b.x - a.x, a.x, b.x]) AS best FROM r a JOIN r b
         ON {match} AND b.rn = a.rn + GREATEST(1, LEAST(a.cnt - 1, CAST(round_even(a.cnt * 0.95, 0) AS BIGINT))) GROUP BY {ka}))"""


@check(
    "f4_shortest_interval",
    ("terms",),
    f"SELECT grp, parameter, {R('conf_low')} AS conf_low, {R('conf_high')} AS conf_high FROM {hdi_sql('terms', ('grp', 'parameter'))}",
)
def _(spark, sf):
    long = posterior.terms_long(S.draws(spark, sf))
    return snapped(ranking.shortest_intervals(long, ["grp", "parameter"], "x"), "conf_low", "conf_high")


@check(
    "f4_shortest_interval_by_rank",
    (),
    f"SELECT grp, {R('conf_low')} AS conf_low, {R('conf_high')} AS conf_high FROM {hdi_sql(_PRICES_SQL, ('grp',))}",
)
def _(spark, sf):
    return snapped(
        ranking.shortest_intervals(_prices(spark, sf), ["grp"], "x", strategy="ranked"), "conf_low", "conf_high"
    )


@check(
    "f5_factor_codes",
    ("paired",),
    """SELECT summer, season, CAST(CASE summer WHEN 'S1' THEN 1 WHEN 'S2' THEN 2 WHEN 'S3' THEN 3 WHEN 'S4' THEN 4 END AS INTEGER) AS summer_code,
              CAST(CASE season WHEN 'Winter' THEN 1 WHEN 'Spring' THEN 2 WHEN 'Premonsoon' THEN 3 ELSE 4 END AS INTEGER) AS season_code,
              COUNT(*) AS n FROM paired GROUP BY ALL""",
)
def _(spark, sf):
    return S.paired(spark, sf).groupBy(
        "summer",
        "season",
        labels.level_index(F.col("summer"), labels.SUMMER_LEVELS).alias("summer_code"),
        labels.level_index(F.col("season"), labels.SEASON_LEVELS).alias("season_code"),
    ).agg(F.count(F.lit(1)).alias("n"))


@check(
    "f5_depth_treatment_codes",
    ("obs",),
    """SELECT trt, CAST(CASE trt WHEN '1_S1' THEN 1 WHEN '2_S1' THEN 2 WHEN '1_S4' THEN 3 WHEN '2_S4' THEN 4 END AS INTEGER) AS trt_code,
              COUNT(*) AS n FROM obs GROUP BY ALL""",
)
def _(spark, sf):
    """Depth x treatment levels; depths outside the model have no code."""
    trt = labels.joined_key(F.col("depth"), F.col("summer"))
    coded = S.observations(spark, sf).select(trt.alias("trt"))
    return coded.groupBy("trt", labels.level_index(F.col("trt"), labels.TRT_LEVELS).alias("trt_code")).agg(
        F.count(F.lit(1)).alias("n")
    )


# ---- G: sort, limit, set operations ----------------------------------------


@check(
    "g1_sorted_watering",
    ("watering",),
    f"SELECT date, treatment, {R('irrigation_mm')} AS irrigation_mm, {R('ppt_mm')} AS ppt_mm FROM watering ORDER BY date, treatment",
)
def _(spark, sf):
    return reshape.ordered(snapped(S.watering_long(spark, sf), "irrigation_mm", "ppt_mm"), "date", "treatment")


@check("g2_first_row", ("obs",), f"SELECT obs_id, {R('theta')} AS theta FROM obs ORDER BY obs_id LIMIT 1")
def _(spark, sf):
    return snapped(reshape.first_row(S.observations(spark, sf).select("obs_id", "theta"), "obs_id"), "theta")


@check(
    "g3_union_on_common",
    ("wc_days", "wp_days"),
    "SELECT house, plot, depth, date, summer, winter, plot_id, year, season FROM wc_days UNION ALL SELECT house, plot, depth, date, summer, winter, plot_id, year, season FROM wp_days",
)
def _(spark, sf):
    return reshape.union_on_common(S.wc_days(spark, sf), S.wp_days(spark, sf))


@check(
    "g4_concatenated_chains",
    ("draws",),
    f"SELECT chain, iter, grp, {R('alpha_cm')} AS alpha_cm, {R('n')} AS n, {R('theta_r')} AS theta_r, {R('sigma')} AS sigma FROM draws",
)
def _(spark, sf):
    draws = S.draws(spark, sf)
    parts = {k: draws.where(F.col("chain") == k).drop("chain") for k in (1, 2, 3)}
    return snapped(reshape.concatenated(parts), "alpha_cm", "n", "theta_r", "sigma")


@check(
    "g5_rows_with_total",
    ("obs",),
    f"SELECT trt AS type, COUNT(*) AS n, {R('AVG(theta)')} AS theta FROM obs GROUP BY 1 UNION ALL SELECT 'all', COUNT(*), {R('AVG(theta)')} FROM obs",
)
def _(spark, sf):
    obs = S.observations(spark, sf)
    measures = [F.count(F.lit(1)).alias("n"), snap(F.avg("theta")).alias("theta")]
    per = obs.groupBy(F.col("trt").alias("type")).agg(*measures)
    return per.unionByName(obs.agg(*measures).withColumn("type", F.lit("all")))


@check(
    "g6_distinct_choices",
    ("wc_daily", "seasons_ev"),
    """SELECT DISTINCT 'winter' AS kind, winter AS choice FROM wc_daily UNION ALL SELECT DISTINCT 'summer', summer FROM wc_daily
       UNION ALL SELECT DISTINCT 'year', CAST(year AS VARCHAR) FROM wc_daily""",
)
def _(spark, sf):
    wc = _wc(spark, sf)
    parts = [
        wc.select(F.col(c).cast("string").alias("choice")).distinct().withColumn("kind", F.lit(c))
        for c in ("winter", "summer", "year")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
