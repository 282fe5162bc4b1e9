"""Sources and sinks (A), reshaping (B), filters and cleaning (C)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from loamline.functions import labels, nulls, timekeys
from loamline.operators import reshape, rollup, watering
from loamline.plans import dashboard
from loamline.session import scratch_path
from loamline.sources import readers, tables
from verification import standins as S
from verification.base import R, check
from verification.standins import EVENT_YEARS, snap, snapped

AIR = ("T_inside", "T_outside", "RH_inside", "RH_outside")


def _as_csv(df, name):
    path = scratch_path(df.sparkSession, name)
    tables.export_csv(df, path)
    return path


def _csv_day(c="date"):
    return F.date_format(c, "M/d/yyyy")


# ---- A: sources and sinks -------------------------------------------------


@check("a1_wide_sensor_csv", ("air_wide",), f"SELECT dt, date, {', '.join(f'{R(c)} AS {c}' for c in AIR)} FROM air_wide")
def _(spark, sf):
    stamped = S.wide_air(spark, sf).select(
        F.date_format("dt", "yyyy-MM-dd HH:mm:ss").alias("TIMESTAMP"), F.lit(1).alias("X"), *[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in AIR]
    )
    return snapped(readers.read_wide_sensors(spark, _as_csv(stamped, "air")), *AIR)


@check(
    "a2_irrigation_csv",
    ("irrigation_wide",),
    f"SELECT date, {', '.join(f'{R(c)} AS {c}' for c in ('S1', 'S2', 'S3', 'S4', 'W1'))} FROM irrigation_wide",
)
def _(spark, sf):
    raw = S.irrigation_wide(spark, sf).withColumn("date", _csv_day())
    return snapped(readers.read_irrigation(spark, _as_csv(raw, "irrigation")), "S1", "S2", "S3", "S4", "W1")


@check("a3_rain_gauge_csv", ("gauge",), f"SELECT date, {R('inches * 25.4')} AS ppt_mm FROM gauge")
def _(spark, sf):
    raw = S.gauge_inches(spark, sf).select(
        F.concat(_csv_day(), F.lit(" 0:00")).alias("TIMESTAMP"), F.col("inches").alias("Rainfall (inch)")
    )
    return snapped(readers.read_gauge(spark, _as_csv(raw, "gauge")), "ppt_mm")


@check(
    "a4_design_csv",
    ("readings", "design"),
    """SELECT house, plot, winter, summer, CAST(right(winter, 1) AS INTEGER) AS winter_ord,
              CAST(right(summer, 1) AS INTEGER) AS summer_ord, COUNT(variable) AS n_readings
       FROM design LEFT JOIN readings USING (house, plot) GROUP BY ALL""",
)
def _(spark, sf):
    raw = S.design(spark, sf).select(
        F.col("house").alias("House"), F.col("plot").alias("Plot"), F.col("winter").alias("Winter"), F.col("summer").alias("Summer")
    )
    counted = S.readings(spark, sf).groupBy("house", "plot").agg(F.count(F.lit(1)).alias("n_readings"))
    design = readers.read_design(spark, _as_csv(raw, "design"))
    return design.join(counted, ["house", "plot"], "left").fillna(0, ["n_readings"])


def _daily_cols(prefix):
    return [f"{prefix}_mean", f"{prefix}_min", f"{prefix}_max"]


def _daily_sql(prefix, source):
    stats = ", ".join(f"{R(c)} AS {c}" for c in _daily_cols(prefix))
    return f"SELECT id, house, plot, depth, date, {stats}, summer, winter, plot_id, year, season FROM {source}"


def _wc(spark, sf):
    return rollup.daily_water_content(S.soil(spark, sf), S.design(spark, sf), **EVENT_YEARS)


def _wp(spark, sf):
    return rollup.daily_water_potential(S.soil(spark, sf), S.design(spark, sf), **EVENT_YEARS)


def _ts(spark, sf):
    return rollup.daily_temperature(S.soil(spark, sf), S.design(spark, sf), **EVENT_YEARS)


@check("a5_saved_daily_table", ("wc_daily",), _daily_sql("wc", "wc_daily"))
def _(spark, sf):
    path = scratch_path(spark, "wc_daily")
    tables.save_table(_wc(spark, sf), path, ("year",), ("date",))
    return snapped(tables.load_table(spark, path), *_daily_cols("wc"))


@check(
    "a6_exported_curve_input",
    ("obs",),
    f"SELECT obs_id, date, depth, summer, {R('theta')} AS theta, {R('h_cm')} AS h_cm FROM obs",
)
def _(spark, sf):
    out = S.observations(spark, sf).select("obs_id", "date", "depth", "summer", "theta", "h_cm")
    path = _as_csv(out, "curve_input")
    back = spark.read.csv(path, header=True, schema="obs_id BIGINT, date DATE, depth INT, summer STRING, theta DOUBLE, h_cm DOUBLE")
    return snapped(back, "theta", "h_cm")


# ---- B: projection and reshape --------------------------------------------


@check(
    "b1_sensors_long",
    ("soil_grid",),
    f"""SELECT dt, date, variable, plot, depth, house, {R('value')} AS value,
               variable || '_P' || plot || '_' || depth || '_H' || house AS id FROM soil_grid""",
)
def _(spark, sf):
    return snapped(reshape.soil_sensors_long(S.wide_soil(spark, sf)), "value")


@check(
    "b1_soil_temperature_long",
    ("readings",),
    f"""SELECT b.dt, b.date, p.plot, d.depth, h.house, {R('s.value')} AS value, 'TS' AS variable,
               'P' || p.plot || '_' || d.depth || '_H' || h.house AS id
        FROM (SELECT DISTINCT time_bucket(INTERVAL '6 hours', dt) AS dt, date FROM readings WHERE variable = 'TS') b,
             (SELECT CAST(i AS INTEGER) AS house FROM range(1, 6) t(i)) h,
             (SELECT CAST(i AS INTEGER) AS plot FROM range(1, 13) t(i)) p,
             (SELECT CAST(i AS INTEGER) AS depth FROM range(1, 4) t(i)) d
        LEFT JOIN (SELECT time_bucket(INTERVAL '6 hours', dt) AS dt, house, plot, depth, AVG(value) AS value
                   FROM readings WHERE variable = 'TS' GROUP BY 1, 2, 3, 4) s
          ON s.dt = b.dt AND s.house = h.house AND s.plot = p.plot AND s.depth = d.depth""",
)
def _(spark, sf):
    return snapped(reshape.soil_temperature_long(S.wide_soil(spark, sf, ("TS",))), "value")


_AIR_RAW_SQL = " UNION ALL ".join(
    f"SELECT dt, date, '{v}' AS variable, '{p}' AS location, {R(f'{v}_{p}')} AS value FROM air_wide"
    for v in ("T", "RH")
    for p in ("inside", "outside")
)


@check("b2_air_long", ("air_wide",), _AIR_RAW_SQL)
def _(spark, sf):
    return snapped(reshape.air_long(S.wide_air(spark, sf)), "value")


@check("b3_treatments_long", ("irrigation",), f"SELECT date, treatment, {R('irrigation_mm')} AS irrigation_mm FROM irrigation")
def _(spark, sf):
    return snapped(reshape.treatments_long(S.irrigation_wide(spark, sf)), "irrigation_mm")


def _stat_union(source, cells):
    return " UNION ALL ".join(
        f"SELECT date, plot_id, depth, '{v}' AS variable, '{t}' AS type, {R(f'{v}_{t}')} AS value FROM {source}"
        for v, t in cells
    )


STAT_CELLS = [(v, t) for v in ("wc", "wp") for t in ("mean", "min", "max")]


@check("b4_statistics_long", ("paired",), _stat_union("paired", STAT_CELLS))
def _(spark, sf):
    return snapped(reshape.statistics_long(S.paired(spark, sf), ["date", "plot_id", "depth"]), "value")


@check(
    "b5_statistics_wide",
    ("paired",),
    " UNION ALL ".join(
        f"SELECT date, plot_id, depth, '{v}' AS variable, {R(f'{v}_mean')} AS mean, {R(f'{v}_min')} AS min, {R(f'{v}_max')} AS max FROM paired"
        for v in ("wc", "wp")
    ),
)
def _(spark, sf):
    ids = ["date", "plot_id", "depth"]
    long = reshape.statistics_long(S.paired(spark, sf), ids)
    return snapped(reshape.statistics_wide(long, [*ids, "variable"]), "mean", "min", "max")


@check(
    "b6_variables_wide",
    ("six_hourly",),
    f"""SELECT dt, date, plot, depth, house, {R("MAX(value) FILTER (WHERE variable = 'VWC')")} AS VWC,
               {R("MAX(value) FILTER (WHERE variable = 'SWP')")} AS SWP
        FROM six_hourly WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4, 5""",
)
def _(spark, sf):
    long = reshape.soil_sensors_long(S.wide_soil(spark, sf)).where(F.col("value").isNotNull())
    wide = reshape.variables_wide(long, ["dt", "date", "plot", "depth", "house"], ["VWC", "SWP"])
    return snapped(wide, "VWC", "SWP")


@check(
    "b7_chosen_treatment",
    ("wc_daily",),
    f"""SELECT date, depth, winter AS treatment, COUNT(*) AS n, {R('AVG(wc_mean)')} AS wc_mean FROM wc_daily GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    chosen = reshape.chosen_treatment(_wc(spark, sf), "winter")
    return chosen.groupBy("date", "depth", "treatment").agg(
        F.count(F.lit(1)).alias("n"), snap(F.avg("wc_mean")).alias("wc_mean")
    )


@check(
    "b8_composite_keys",
    ("paired",),
    """SELECT DISTINCT 'P' || plot || '_' || depth || '_H' || house AS id, house || '_' || plot AS plot_id,
              year || '_' || season AS year_season, isoyear(date) || '_' || weekofyear(date) AS year_week,
              depth || '_' || COALESCE(summer, 'none') AS trt FROM paired""",
)
def _(spark, sf):
    c = F.col
    return (
        S.paired(spark, sf)
        .select(
            labels.sensor_id(c("plot"), c("depth"), c("house")).alias("id"),
            labels.plot_id(c("house"), c("plot")).alias("plot_id"),
            labels.joined_key(c("year"), c("season")).alias("year_season"),
            timekeys.year_week(c("date")).alias("year_week"),
            labels.joined_key(c("depth"), F.coalesce(c("summer"), F.lit("none"))).alias("trt"),
        )
        .distinct()
    )


@check(
    "b9_projection",
    ("paired",),
    f"SELECT date AS day, house, plot, depth, {R('wc_mean')} AS wc_mean, {R('wc_min')} AS wc_min, {R('wc_max')} AS wc_max FROM paired",
)
def _(spark, sf):
    kept = reshape.with_prefix(S.paired(spark, sf), "wc_", "house", "plot", "depth", "date")
    front = reshape.moved_first(kept, "date", "house").withColumnRenamed("date", "day")
    return snapped(front, *_daily_cols("wc"))


@check(
    "b10_label_mapping",
    ("readings",),
    """SELECT house, plot, variable, CASE depth WHEN 1 THEN '0-12 cm' WHEN 2 THEN '25 cm' WHEN 3 THEN '75 cm' END AS depth_label,
              CASE variable WHEN 'T' THEN 'T~(~degree~C)' WHEN 'RH' THEN 'RH~(''%'')' WHEN 'D' THEN 'D~(kPa)' END AS axis_label,
              COUNT(*) AS n FROM readings GROUP BY ALL""",
)
def _(spark, sf):
    r = S.readings(spark, sf)
    return r.groupBy(
        "house",
        "plot",
        "variable",
        labels.depth_label(F.col("depth")).alias("depth_label"),
        labels.mapped(F.col("variable"), labels.AIR_LABELS).alias("axis_label"),
    ).agg(F.count(F.lit(1)).alias("n"))


@check(
    "b11_replicated",
    ("rain",),
    f"""SELECT date, treatment, {R('ppt_mm')} AS ppt_mm FROM rain,
        (VALUES ('S1'), ('S2'), ('S3'), ('S4'), ('W1'), ('W2'), ('W3')) t(treatment)""",
)
def _(spark, sf):
    return snapped(reshape.replicated(S.rain(spark, sf), "treatment", labels.TREATMENTS), "ppt_mm")


@check(
    "b12_offset_days",
    ("irrigation",),
    """SELECT treatment, date + CAST(k AS INTEGER) AS date, CAST(k AS INTEGER) AS "offset"
       FROM irrigation, range(0, 3) t(k) WHERE irrigation_mm <> 0""",
)
def _(spark, sf):
    events = S.irrigation(spark, sf).where(F.col("irrigation_mm") != 0).select("treatment", "date")
    return reshape.offset_days(events, 2)


# ---- C: filters and cleaning ----------------------------------------------


@check(
    "c1_blank_below_floor",
    ("air_wide",),
    f"""SELECT dt, {R('CASE WHEN T_inside >= -10 THEN T_inside END')} AS T_inside,
               {R('CASE WHEN T_outside >= -10 THEN T_outside END')} AS T_outside FROM air_wide""",
)
def _(spark, sf):
    air = S.wide_air(spark, sf)
    return air.select("dt", *[snap(nulls.at_least(F.col(c), -10.0)).alias(c) for c in ("T_inside", "T_outside")])


@check(
    "c2_empty_days_null",
    ("readings",),
    f"""SELECT id, date, COUNT(*) AS n_rows, COUNT(value) AS n_values, {R('MIN(value)')} AS lo, {R('MAX(value)')} AS hi
        FROM readings GROUP BY 1, 2""",
)
def _(spark, sf):
    # Missing readings arrive as NaN here, as they would from other loaders.
    noisy = S.readings(spark, sf).withColumn("value", F.coalesce("value", F.lit(float("nan"))))
    clean = nulls.finite(F.col("value"))
    return noisy.groupBy("id", "date").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(clean).alias("n_values"),
        snap(F.min(clean)).alias("lo"),
        snap(F.max(clean)).alias("hi"),
    )


@check("c3_days_with_mean", ("ts_daily",), f"SELECT id, date, {R('ts_mean')} AS ts_mean FROM ts_daily")
def _(spark, sf):
    return snapped(_ts(spark, sf).select("id", "date", "ts_mean"), "ts_mean")


@check(
    "c4_complete_rows",
    ("air_wide",),
    f"""SELECT dt, date, {', '.join(f'{R(c)} AS {c}' for c in AIR)} FROM air_wide
        WHERE T_inside IS NOT NULL AND T_outside IS NOT NULL AND RH_inside IS NOT NULL AND RH_outside IS NOT NULL""",
)
def _(spark, sf):
    return snapped(S.wide_air(spark, sf).dropna("any"), *AIR)


@check(
    "c5_date_range",
    ("readings",),
    f"""SELECT id, dt, {R('value')} AS value FROM readings WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
)
def _(spark, sf):
    ranged = dashboard.in_range(S.readings(spark, sf), dt.date(2024, 1, 5), dt.date(2024, 1, 20))
    return snapped(ranged.select("id", "dt", "value"), "value")


@check(
    "c6_membership",
    ("paired",),
    f"""SELECT date, plot_id, depth, {R('wc_mean')} AS wc_mean FROM paired
        WHERE summer IN ('S1', 'S4') AND winter IN ('W1', 'W3') AND season IN ('Winter', 'Spring')""",
)
def _(spark, sf):
    chosen = dashboard.of_treatments(S.paired(spark, sf), ("S1", "S4"), ("W1", "W3"))
    return snapped(chosen.where(F.col("season").isin("Winter", "Spring")).select("date", "plot_id", "depth", "wc_mean"), "wc_mean")


@check(
    "c7_semi_filter",
    ("wc_daily", "wp_daily"),
    f"SELECT id, date, {R('wc_mean')} AS wc_mean FROM wc_daily WHERE plot_id IN (SELECT plot_id FROM wp_daily)",
)
def _(spark, sf):
    plots = _wp(spark, sf).select("plot_id").distinct()
    return snapped(_wc(spark, sf).join(plots, "plot_id", "left_semi").select("id", "date", "wc_mean"), "wc_mean")


@check("c8_rain_before_roof", ("rain",), f"SELECT date, {R('ppt_mm')} AS ppt_mm FROM rain")
def _(spark, sf):
    return snapped(watering.rain_before_roof(S.rain_all(spark, sf), dt.date(1998, 6, 30)), "ppt_mm")


@check(
    "c9_either_treatment",
    ("watering",),
    f"SELECT date, treatment, {R('irrigation_mm')} AS irrigation_mm, {R('ppt_mm')} AS ppt_mm FROM watering WHERE treatment = 'S2' OR treatment = 'W3'",
)
def _(spark, sf):
    w = S.watering_long(spark, sf)
    return snapped(w.where((F.col("treatment") == "S2") | (F.col("treatment") == "W3")), "irrigation_mm", "ppt_mm")


@check(
    "c10_zero_filled",
    ("watering",),
    f"SELECT date, treatment, {R('COALESCE(irrigation_mm, 0)')} AS irrigation_mm, {R('COALESCE(ppt_mm, 0)')} AS ppt_mm FROM watering",
)
def _(spark, sf):
    return snapped(watering.zero_filled(S.watering_long(spark, sf)), "irrigation_mm", "ppt_mm")


@check(
    "c11_one_variable",
    ("readings",),
    f"SELECT id, dt, house, plot, depth, {R('value')} AS value FROM readings WHERE variable = 'VWC'",
)
def _(spark, sf):
    vwc = S.readings(spark, sf).where(F.col("variable") == "VWC")
    return snapped(vwc.select("id", "dt", "house", "plot", "depth", "value"), "value")
