"""Dashboard queries and pipelines (N)."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import functions as F

from loamline.operators import calendar, rollup
from loamline.plans import dashboard, halfhourly, preparation, selection
from loamline.session import scratch_path
from loamline.sources import tables
from verification import standins as S
from verification.base import R, check
from verification.joins_aggregates import (
    _AIR_MEANS,
    AIR_MEANS_SQL,
    DEPTH_CASE,
    PULSES_SQL,
    _mean_cols,
    _means_sql,
)
from verification.soil_physics import BETWEEN, BETWEEN_SQL, WINDOW_S1
from verification.sources_shape import _csv_day, _ts, _wc
from verification.standins import snap, snapped

FIRST, LAST = dt.date(2024, 1, 3), dt.date(2024, 1, 25)
SUMMERS, WINTERS = ("S1", "S3"), ("W1", "W3")
_IN_RANGE = f"date BETWEEN DATE '{FIRST}' AND DATE '{LAST}'"
_CHOSEN = f"summer IN ('S1', 'S3') AND winter IN ('W1', 'W3') AND {_IN_RANGE}"


def _tables(spark, sf):
    return {
        "water_content": _wc(spark, sf),
        "temperature": _ts(spark, sf),
        "air": S.air_daily(spark, sf),
        "watering": S.watering_jan(spark, sf),
    }


def _seasonal(spark, sf):
    return dashboard.seasonal(_tables(spark, sf), SUMMERS, WINTERS, FIRST, LAST)


# ---- N1: seasonal tab ------------------------------------------------------


@check("n1_seasonal_water_content", ("wc_daily",), _means_sql("wc", f"(SELECT * FROM wc_daily WHERE {_CHOSEN})", "date, depth"))
def _(spark, sf):
    return snapped(_seasonal(spark, sf)["wc"], *_mean_cols("wc"))


@check("n1_seasonal_temperature", ("ts_daily",), _means_sql("ts", f"(SELECT * FROM ts_daily WHERE {_CHOSEN})", "date, depth"))
def _(spark, sf):
    return snapped(_seasonal(spark, sf)["ts"], *_mean_cols("ts"))


_WATER_JAN = f"(SELECT date, treatment, COALESCE(irrigation_mm, 0) AS irrigation_mm, COALESCE(ppt_mm, 0) AS ppt_mm FROM watering_jan WHERE {_IN_RANGE})"


@check(
    "n1_seasonal_watering",
    ("watering_jan",),
    f"SELECT date, treatment, {R('irrigation_mm')} AS irrigation_mm, {R('ppt_mm')} AS ppt_mm FROM {_WATER_JAN} WHERE treatment IN ('S1', 'S3', 'W1', 'W3')",
)
def _(spark, sf):
    return snapped(_seasonal(spark, sf)["watering"], "irrigation_mm", "ppt_mm")


@check(
    "n1_seasonal_air",
    ("air_daily",),
    f"SELECT date, {', '.join(f'{R(c)} AS {c}' for c in _AIR_MEANS)} FROM ({AIR_MEANS_SQL}) WHERE {_IN_RANGE}",
)
def _(spark, sf):
    return snapped(_seasonal(spark, sf)["air"], *_AIR_MEANS)


def _labels_sql(source, name):
    return f"""SELECT '{name}' AS series, depth, MAX(n) AS n_plots, {DEPTH_CASE} || ' (n = ' || MAX(n) || ')' AS label
               FROM (SELECT date, depth, COUNT(*) AS n FROM {source} WHERE {_CHOSEN} GROUP BY 1, 2) GROUP BY depth"""


@check(
    "n1_seasonal_size_labels",
    ("wc_daily", "ts_daily"),
    _labels_sql("wc_daily", "wc") + " UNION ALL " + _labels_sql("ts_daily", "ts"),
)
def _(spark, sf):
    out = _seasonal(spark, sf)
    parts = [out[f"{s}_sizes"].withColumn("series", F.lit(s)) for s in ("wc", "ts")]
    return parts[0].unionByName(parts[1]).select("series", "depth", "n_plots", "label")


_AMOUNT = f"(SELECT GREATEST(MAX(irrigation_mm), MAX(ppt_mm)) FROM {_WATER_JAN} WHERE treatment IN ('S1', 'S3', 'W1', 'W3'))"


@check(
    "n1_seasonal_ratios",
    ("wc_daily", "ts_daily", "air_daily", "watering_jan"),
    f"""SELECT 'wc' AS series, {R(f"{_AMOUNT} / (SELECT MAX(m) FROM (SELECT AVG(wc_max) AS m FROM wc_daily WHERE {_CHOSEN} GROUP BY date, depth))")} AS ratio
        UNION ALL SELECT 'ts', {R(f"{_AMOUNT} / (SELECT MAX(m) FROM (SELECT AVG(ts_max) AS m FROM ts_daily WHERE {_CHOSEN} GROUP BY date, depth))")}
        UNION ALL SELECT 'air', {R('MAX(mean_D_max) / MAX(mean_T_max)')} FROM ({AIR_MEANS_SQL}) WHERE {_IN_RANGE}""",
)
def _(spark, sf):
    out = _seasonal(spark, sf)
    parts = [out[f"{s}_ratio"].select(F.lit(s).alias("series"), snap("ratio").alias("ratio")) for s in ("wc", "ts", "air")]
    return reduce(lambda a, b: a.unionByName(b), parts)


# ---- N2: treatment comparison ----------------------------------------------


def _comparison(spark, sf):
    return dashboard.comparison(_tables(spark, sf), "winter", FIRST, LAST)


@check(
    "n2_comparison_water_content",
    ("wc_daily",),
    f"""SELECT *, {DEPTH_CASE} AS depth_label FROM ({_means_sql('wc', f"(SELECT *, winter AS treatment FROM wc_daily WHERE {_IN_RANGE})", 'treatment, date, depth', poisoned=True)})""",
)
def _(spark, sf):
    return snapped(_comparison(spark, sf)["wc"], *_mean_cols("wc"))


@check(
    "n2_comparison_watering",
    ("watering_jan",),
    f"SELECT date, treatment, {R('irrigation_mm')} AS irrigation_mm, {R('ppt_mm')} AS ppt_mm FROM watering_jan WHERE {_IN_RANGE}",
)
def _(spark, sf):
    return snapped(_comparison(spark, sf)["watering"], "irrigation_mm", "ppt_mm")


@check(
    "n2_comparison_size_labels",
    ("wc_daily",),
    f"""SELECT treatment, depth_label, MAX(n) AS n_plots, treatment || ' (n = ' || MAX(n) || ')' AS label FROM
        (SELECT winter AS treatment, date, {DEPTH_CASE} AS depth_label, COUNT(*) AS n FROM wc_daily WHERE {_IN_RANGE} GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def _(spark, sf):
    return _comparison(spark, sf)["wc_sizes"]


# ---- N3: paired tab --------------------------------------------------------

_FROM, _TO = dt.date(1996, 7, 1), dt.date(1996, 10, 31)
_IN_1996 = f"date BETWEEN DATE '{_FROM}' AND DATE '{_TO}'"
_PAIR = ("wp_mean", "wp_min", "wp_max", "wc_mean", "wc_min", "wc_max")


def _pairs(spark, sf):
    made = {"paired": S.paired(spark, sf), "watering": S.watering_long(spark, sf)}
    return dashboard.pairs(made, "S1", _FROM, _TO)


@check(
    "n3_paired_days",
    ("paired",),
    f"SELECT date, plot_id, depth, {', '.join(f'{R(c)} AS {c}' for c in _PAIR)} FROM paired WHERE summer = 'S1' AND {_IN_1996}",
)
def _(spark, sf):
    return snapped(_pairs(spark, sf)["paired"].select("date", "plot_id", "depth", *_PAIR), *_PAIR)


_WATER_96 = f"(SELECT date, treatment, COALESCE(irrigation_mm, 0) AS irrigation_mm, COALESCE(ppt_mm, 0) AS ppt_mm FROM watering WHERE treatment IN ('S1', 'W3') AND {_IN_1996})"


@check(
    "n3_paired_watering",
    ("watering",),
    f"SELECT date, treatment, {R('irrigation_mm')} AS irrigation_mm, {R('ppt_mm')} AS ppt_mm FROM {_WATER_96}",
)
def _(spark, sf):
    return snapped(_pairs(spark, sf)["watering"], "irrigation_mm", "ppt_mm")


@check(
    "n3_paired_ratios",
    ("paired", "watering"),
    f"""SELECT {R('lo / amount')} AS wp_ratio, {R('hi / amount')} AS wc_ratio FROM
        (SELECT MIN(wp_min) AS lo, MAX(wc_max) AS hi FROM paired WHERE summer = 'S1' AND {_IN_1996}),
        (SELECT GREATEST(MAX(irrigation_mm), MAX(ppt_mm)) AS amount FROM {_WATER_96})""",
)
def _(spark, sf):
    out = _pairs(spark, sf)
    both = out["wp_ratio"].withColumn("k", F.lit("wp")).unionByName(out["wc_ratio"].withColumn("k", F.lit("wc")))
    return both.agg(
        snap(F.max(F.when(F.col("k") == "wp", F.col("ratio")))).alias("wp_ratio"),
        snap(F.max(F.when(F.col("k") == "wc", F.col("ratio")))).alias("wc_ratio"),
    )


# ---- N4: choices -----------------------------------------------------------


@check(
    "n4_choices",
    ("wc_days", "seasons_li"),
    """SELECT 'year' AS kind, CAST(year AS VARCHAR) AS choice, NULL::DATE AS st, NULL::DATE AS en FROM wc_days GROUP BY year
       UNION ALL SELECT 'season', season, NULL, NULL FROM wc_days WHERE year = 1996 GROUP BY season
       UNION ALL SELECT 'range', 'year', MIN(st), MAX(en) FROM seasons_li WHERE year = 1996 AND (year, season) IN (SELECT (year, season) FROM wc_days)
       UNION ALL SELECT 'range', 'season', MIN(st), MAX(en) FROM seasons_li WHERE year = 1996 AND season = 'Spring'""",
)
def _(spark, sf):
    used = S.wc_days(spark, sf).select("year", "season").distinct()
    seasons = calendar.season_calendar(spark, 1994, 2002).join(used, ["year", "season"], "left_semi")
    whole, one = dashboard.choices(seasons, 1996), dashboard.choices(seasons, 1996, "Spring")
    none = [F.lit(None).cast("date").alias(c) for c in ("st", "en")]
    return (
        whole["years"].select(F.lit("year").alias("kind"), F.col("year").cast("string").alias("choice"), *none)
        .unionByName(whole["seasons"].select(F.lit("season").alias("kind"), F.col("season").alias("choice"), *none))
        .unionByName(whole["range"].select(F.lit("range").alias("kind"), F.lit("year").alias("choice"), "st", "en"))
        .unionByName(one["range"].select(F.lit("range").alias("kind"), F.lit("season").alias("choice"), "st", "en"))
    )


# ---- N5: preparation -------------------------------------------------------

_SIX = "(SELECT time_bucket(INTERVAL '6 hours', dt) AS dt, date, variable, house, plot, depth, AVG(value) AS value FROM readings WHERE variable IN ('VWC', 'SWP', 'TS') GROUP BY ALL)"
_AIR_SIX = """(SELECT dt, date, t, rh, location, (1.0 - rh / 100.0) * ((1.0007 + 3.46e-8 * 101000.0) * 611.21 * exp(17.502 * t / (240.97 + t))) / 1000.0 AS d
  FROM (SELECT dt, date, location, CASE WHEN t >= -10 THEN t END AS t, rh FROM
    (SELECT time_bucket(INTERVAL '6 hours', dt) AS dt, date, location, AVG(value) FILTER (WHERE variable = 'T') AS t,
            AVG(value) FILTER (WHERE variable = 'RH') AS rh FROM readings WHERE variable IN ('T', 'RH') GROUP BY ALL)))"""


def _n5_sql() -> str:
    parts = []
    for name, variable, scale in (("temperature", "TS", 1), ("water_content", "VWC", 1), ("water_potential", "SWP", 1000)):
        parts.append(
            f"SELECT '{name}' AS name, COUNT(m) AS n_days, {R('AVG(m)')} AS level FROM (SELECT AVG(value) / {scale} AS m FROM {_SIX} WHERE variable = '{variable}' GROUP BY date, house, plot, depth)"
        )
    for v in ("t", "rh", "d"):
        parts.append(
            f"SELECT 'air_{v}', COUNT(m), {R('AVG(m)')} FROM (SELECT AVG({v}) AS m FROM {_AIR_SIX} GROUP BY date, location)"
        )
    parts.append(f"SELECT 'watering', COUNT(*), {R('AVG(irrigation_mm)')} FROM watering")
    parts.append(
        f"""SELECT 'paired', COUNT(*) FILTER (WHERE p IS NOT NULL AND c IS NOT NULL), {R('AVG(CASE WHEN p IS NOT NULL THEN c END)')} FROM
            (SELECT AVG(value) FILTER (WHERE variable = 'SWP') AS p, AVG(value) FILTER (WHERE variable = 'VWC') AS c FROM {_SIX} GROUP BY date, house, plot, depth)"""
    )
    return " UNION ALL ".join(parts)


def _csv(df, name):
    path = scratch_path(df.sparkSession, name)
    tables.export_csv(df, path)
    return path


@check("n5_prepared_tables", ("readings", "watering"), _n5_sql())
def _(spark, sf):
    stamp = F.date_format("dt", "yyyy-MM-dd HH:mm:ss").alias("TIMESTAMP")
    soil = S.wide_logger(spark, sf)
    heat = S.wide_soil(spark, sf, ("TS",))
    design = S.design(spark, sf).select(
        F.col("house").alias("House"), F.col("plot").alias("Plot"), F.col("winter").alias("Winter"), F.col("summer").alias("Summer")
    )
    gauge = S.gauge_inches(spark, sf).select(
        F.concat(_csv_day(), F.lit(" 0:00")).alias("TIMESTAMP"), F.col("inches").alias("Rainfall (inch)")
    )
    paths = preparation.prepare(
        spark,
        _csv(heat.select(stamp, *[c for c in heat.columns if c not in ("dt", "date")]), "ts"),
        _csv(soil.select(stamp, *[c for c in soil.columns if c not in ("dt", "date")]), "soil"),
        _csv(design, "design"),
        _csv(S.irrigation_wide(spark, sf).withColumn("date", _csv_day()), "irrigation"),
        _csv(gauge, "gauge"),
        scratch_path(spark, "prepared"),
        first_year=2023,
        last_year=2024,
        roof_day=dt.date(1998, 6, 30),
    )
    made = {name: tables.load_table(spark, path) for name, path in paths.items() if name != "sensor_days"}

    def line(name, df, value):
        return df.agg(F.count(value).alias("n_days"), snap(F.avg(value)).alias("level")).select(F.lit(name).alias("name"), "n_days", "level")

    parts = [
        line("temperature", made["temperature"], "ts_mean"),
        line("water_content", made["water_content"], "wc_mean"),
        line("water_potential", made["water_potential"], "wp_mean"),
        *[line(f"air_{v.lower()}", made["air"].where(F.col("variable") == v), "mean") for v in ("T", "RH", "D")],
        made["watering"].agg(F.count(F.lit(1)).alias("n_days"), snap(F.avg("irrigation_mm")).alias("level")).select(
            F.lit("watering").alias("name"), "n_days", "level"
        ),
        line("paired", made["paired"].where(F.col("wp_mean").isNotNull()), "wc_mean"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


# ---- N6, N7: selections ----------------------------------------------------

RULES = selection.Rules(
    mid_year=1996,
    mid_from=dt.date(1995, 12, 1),
    spring_ends=((1996, dt.date(1996, 3, 18)), (1997, dt.date(1997, 3, 22))),
    pulse_years=(1996, 1997),
    first_year=1995,
    last_year=2001,
)
_WINDOW_S4 = "(SELECT date + CAST(k AS INTEGER) FROM irrigation, range(0, 3) t(k) WHERE treatment = 'S4' AND irrigation_mm <> 0)"
_SPRING_SQL = """summer = 'S1' AND depth = 1 AND season = 'Spring'
    AND ((year = 1996 AND date < DATE '1996-03-18') OR (year = 1997 AND date < DATE '1997-03-22'))"""
_MID_SQL = "year = 1996 AND depth = 2 AND season IN ('Winter', 'Spring') AND date >= DATE '1995-12-01'"


@check(
    "n6_curve_input",
    ("paired", "irrigation", "seasons_li"),
    f"""SELECT d.date, d.plot_id, d.depth, d.summer, {R('wc_mean')} AS wc_mean, {R('wp_mean')} AS wp_mean, {R('i.irrigation_mm')} AS irrigation_mm FROM
        (SELECT q.* FROM paired q JOIN {PULSES_SQL} p ON q.date BETWEEN p.st AND p.en
           WHERE q.summer = 'S4' AND q.depth = 1 AND p.pulse_in_season > 1 AND q.date NOT IN {_WINDOW_S4}
         UNION ALL SELECT * FROM paired WHERE {_SPRING_SQL}
         UNION ALL SELECT * FROM paired WHERE {_MID_SQL}) d
        LEFT JOIN irrigation i ON i.date = d.date AND i.treatment = d.summer""",
)
def _(spark, sf):
    out = selection.curve_input(S.paired(spark, sf), S.irrigation(spark, sf), RULES)
    return snapped(
        out.select("date", "plot_id", "depth", "summer", "wc_mean", "wp_mean", "irrigation_mm"),
        "wc_mean",
        "wp_mean",
        "irrigation_mm",
    )


_CHOSEN_SEASONS = ("1996_Growing", "1997_Spring", "1997_Growing")
_CHOSEN_SQL = "year || '_' || season IN ('1996_Growing', '1997_Spring', '1997_Growing')"


@check(
    "n7_between_label",
    ("paired", "irrigation"),
    f"""SELECT date, plot_id, year_season, irig_label, {R('wc_mean')} AS wc_mean FROM
        (SELECT d.*, d.year || '_' || d.season AS year_season, COALESCE(w.off, CASE WHEN {BETWEEN_SQL} THEN 3 END) AS irig_label
         FROM paired d LEFT JOIN {WINDOW_S1} w ON w.date = d.date WHERE d.summer = 'S1' AND d.depth = 1 AND {_CHOSEN_SQL}) WHERE irig_label IS NOT NULL""",
)
def _(spark, sf):
    out = selection.between_label(S.paired(spark, sf), S.irrigation(spark, sf), _CHOSEN_SEASONS, BETWEEN)
    return snapped(out.select("date", "plot_id", "year_season", "irig_label", "wc_mean"), "wc_mean")


@check(
    "n7_seasons_outside_windows",
    ("paired", "irrigation"),
    f"""SELECT date, plot_id, year || '_' || season AS year_season, {R('wc_mean')} AS wc_mean FROM paired
        WHERE summer = 'S1' AND depth = 1 AND {_CHOSEN_SQL} AND date NOT IN
          (SELECT date + CAST(k AS INTEGER) FROM irrigation, range(0, 2) t(k) WHERE treatment = 'S1' AND irrigation_mm <> 0)""",
)
def _(spark, sf):
    out = selection.seasons_outside_windows(S.paired(spark, sf), S.irrigation(spark, sf), _CHOSEN_SEASONS)
    return snapped(out.select("date", "plot_id", "year_season", "wc_mean"), "wc_mean")


@check(
    "n7_pulse_days",
    ("paired", "irrigation", "seasons_li"),
    f"""SELECT d.date, d.plot_id, d.year || '_' || d.season AS year_season, p.pulse FROM paired d
        LEFT JOIN {PULSES_SQL} p ON d.date BETWEEN p.st AND p.en WHERE d.summer = 'S4' AND d.depth = 1 AND d.date NOT IN {_WINDOW_S4}""",
)
def _(spark, sf):
    out = selection.labelled_pulses(S.paired(spark, sf), S.irrigation(spark, sf), RULES)
    return out.select("date", "plot_id", "year_season", "pulse")


@check(
    "n7_mid_spring",
    ("paired",),
    f"SELECT date, plot_id, summer, {R('wc_mean')} AS wc_mean FROM paired WHERE year = 1996 AND season = 'Spring' AND depth = 2",
)
def _(spark, sf):
    return snapped(selection.mid_spring(S.paired(spark, sf), 1996).select("date", "plot_id", "summer", "wc_mean"), "wc_mean")


# ---- N8-N10 ----------------------------------------------------------------

JAN_PERIODS = (
    ("early", dt.date(2024, 1, 1), dt.date(2024, 1, 10)),
    ("late", dt.date(2024, 1, 15), dt.date(2024, 1, 25)),
)


@check(
    "n8_paired_weeks",
    ("six_hourly",),
    f"""SELECT dt, date, plot, depth, house, {R("MAX(value) FILTER (WHERE variable = 'VWC')")} AS vwc,
               {R("MAX(value) FILTER (WHERE variable = 'SWP') / 1000")} AS swp,
               CASE WHEN date <= DATE '2024-01-10' THEN 'early' WHEN date BETWEEN DATE '2024-01-15' AND DATE '2024-01-25' THEN 'late' END AS period,
               {DEPTH_CASE} AS depth_label, isoyear(date) || '_' || weekofyear(date) AS year_week
        FROM six_hourly WHERE house = 3 AND plot IN (4, 7) AND value IS NOT NULL GROUP BY 1, 2, 3, 4, 5""",
)
def _(spark, sf):
    ids = ["dt", "date", "house", "plot", "depth", "variable"]
    long = S.bucketed(S.soil(spark, sf), 360).groupBy(*ids).agg(F.avg("value").alias("value"))
    return snapped(halfhourly.paired_weeks(long, periods=JAN_PERIODS), "vwc", "swp")


@check(
    "n9_noon_irrigation",
    ("irrigation_wide",),
    f"""SELECT date + INTERVAL 12 HOUR AS dt, date, plot, {R('mm')} AS irrigation_mm, mm > 0 AS irig_tf, isoyear(date) || '_' || weekofyear(date) AS year_week, depth_label
        FROM (SELECT date, 4 AS plot, S1 AS mm FROM irrigation_wide UNION ALL SELECT date, 7, S4 FROM irrigation_wide),
             (VALUES ('0-12 cm'), ('25 cm'), ('75 cm')) d(depth_label)""",
)
def _(spark, sf):
    return snapped(halfhourly.noon_irrigation(S.irrigation_wide(spark, sf)), "irrigation_mm")


@check(
    "n10_long_pairs",
    ("wc_days", "wp_days"),
    " UNION ALL ".join(
        f"""SELECT date, plot_id, 'P' || plot || '_' || depth || '_H' || house AS id, plot, depth, house, '{v.upper()}' AS variable, {R(f'{v}_mean')} AS mean, {R(f'{v}_min')} AS min, {R(f'{v}_max')} AS max, '{text}' AS var
            FROM (SELECT c.*, p.wp_mean, p.wp_min, p.wp_max FROM wc_days c JOIN (SELECT date, house, plot, depth, wp_mean, wp_min, wp_max FROM wp_days) p
                  USING (date, house, plot, depth)) WHERE summer IS NOT NULL"""
        for v, text in (("wc", "Theta~(m^3~m^-3)"), ("wp", "Psi~(MPa)"))
    ),
)
def _(spark, sf):
    return snapped(dashboard.long_pairs(S.wc_days(spark, sf), S.wp_days(spark, sf)), "mean", "min", "max")


@check(
    "n10_long_pairs_side_by_side",
    ("wc_daily", "wp_daily"),
    " UNION ALL ".join(
        f"""SELECT date, plot_id, 'P' || plot || '_' || depth || '_H' || house AS id, plot, depth, house, '{v.upper()}' AS variable, {R(f'{v}_mean')} AS mean, {R(f'{v}_min')} AS min, {R(f'{v}_max')} AS max, '{text}' AS var
            FROM (SELECT c.*, p.wp_mean, p.wp_min, p.wp_max FROM wc_daily c JOIN (SELECT date, house, plot, depth, wp_mean, wp_min, wp_max FROM wp_daily) p
                  USING (date, house, plot, depth)) WHERE summer IS NOT NULL AND wc_mean IS NOT NULL AND wp_mean IS NOT NULL"""
        for v, text in (("wc", "Theta~(m^3~m^-3)"), ("wp", "Psi~(MPa)"))
    ),
)
def _(spark, sf):
    beside = rollup.soil_beside(S.soil(spark, sf))
    paired = rollup.paired_table(beside, S.design(spark, sf), ("wp", "wc"), **S.EVENT_YEARS)
    return snapped(dashboard.long_pairs_of(paired), "mean", "min", "max")
