"""Values known from the experiment's own small files, embedded here."""

import datetime as dt

from pyspark.sql import functions as F

from loamline.functions import curves, timekeys
from loamline.operators import calendar, fitting, pulses, ranking, rollup, watering

# Nonzero S4 irrigation (mm) of the experiment.
S4_EVENTS = """
10/31/2019 57; 11/1/2019 4.1; 11/4/2019 4.1; 11/8/2019 6.1; 11/13/2019 10.2; 12/19/2019 4.1; 2/4/2020 4.1;
3/27/2020 12.2; 4/3/2020 12.2; 4/9/2020 12.2; 4/17/2020 12.2; 4/24/2020 12.2; 4/30/2020 12.2; 7/14/2020 38;
8/3/2020 61.3; 8/24/2020 48.2; 9/14/2020 57.4; 10/29/2020 30; 11/13/2020 9; 12/2/2020 16; 12/16/2020 19;
12/27/2020 16.3; 1/8/2021 14.7; 1/20/2021 11; 2/3/2021 14.4; 2/22/2021 25; 3/8/2021 14; 3/22/2021 9.5;
3/29/2021 32.4; 4/12/2021 6.9; 5/3/2021 15; 7/5/2021 38; 7/26/2021 61.3; 8/16/2021 48.2; 9/6/2021 57.4;
7/4/2022 38; 7/25/2022 61.3; 8/15/2022 48.2; 9/5/2022 57.4
"""


def _events(spark):
    rows = [e.split() for e in S4_EVENTS.replace("\n", " ").split(";")]
    raw = spark.createDataFrame([(d, float(mm)) for d, mm in rows], "day string, irrigation_mm double")
    return raw.select(timekeys.slash_day(F.col("day")).alias("date"), F.lit("S4").alias("treatment"), "irrigation_mm")


def test_pulses_of_both_seasons(spark):
    rows = pulses.pulse_table(_events(spark), "S4").orderBy("pulse").collect()
    spans = [(r.st.strftime("%Y-%m-%d"), r.en.strftime("%Y-%m-%d")) for r in rows]
    assert spans == [
        ("2020-07-14", "2020-08-02"),
        ("2020-08-03", "2020-08-23"),
        ("2020-08-24", "2020-09-13"),
        ("2020-09-14", "2020-10-28"),
        ("2021-07-05", "2021-07-25"),
        ("2021-07-26", "2021-08-15"),
        ("2021-08-16", "2021-09-05"),
        ("2021-09-06", "2021-10-31"),
    ]
    assert [r.pulse for r in rows] == list(range(1, 9))
    kept = pulses.without_first(pulses.pulse_table(_events(spark), "S4")).select("pulse").collect()
    assert sorted(r.pulse for r in kept) == [2, 3, 4, 6, 7, 8]


def test_event_windows_overlap(spark):
    windows = pulses.event_windows(_events(spark), "S4", 2)
    assert windows.count() == 117
    assert windows.select("date").distinct().count() == 115
    assert pulses.days_since(_events(spark), "S4").count() == 115


def test_events_by_season(spark):
    seasons = calendar.with_season(_events(spark)).groupBy("year", "season").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("irrigation_mm"), 1).alias("mm")
    )
    assert {(r.year, r.season): (r.n, r.mm) for r in seasons.collect()} == {
        (2019, "Growing"): (1, 57.0),
        (2020, "Winter"): (5, 28.6),
        (2020, "Spring"): (7, 77.3),
        (2020, "Growing"): (5, 234.9),
        (2021, "Winter"): (6, 86.0),
        (2021, "Spring"): (6, 102.2),
        (2021, "Premonsoon"): (1, 15.0),
        (2021, "Growing"): (4, 204.9),
        (2022, "Growing"): (4, 204.9),
    }


def test_calendar_is_gap_free(spark):
    seasons = calendar.season_calendar(spark)
    assert seasons.count() == 17
    days = calendar.interval_days(seasons)
    span = days.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("d"), F.min("date").alias("a"), F.max("date").alias("b")).first()
    assert (span.n, span.d, span.a, span.b) == (1584, 1584, dt.date(2019, 7, 1), dt.date(2023, 10, 31))


def test_quantiles_interpolate_linearly(spark):
    values = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "x double").withColumn("k", F.lit(1))
    for strategy in ("array", "ranked"):
        row = ranking.exact_quantiles(values, ["k"], "x", {"a": 0.25, "b": 0.5, "c": 0.75}, strategy=strategy).first()
        assert (row.n_ok, row.a, row.b, row.c) == (4, 1.75, 3.0, 5.25)


def test_duplicate_gauge_day_without_rain_vanishes(spark):
    gauge = spark.createDataFrame(
        [("10/9/2019 0:00", 0.0), ("10/9/2019 0:00", 0.0), ("4/12/2020 0:00", 1.0), ("6/1/2020 0:00", 2.0)], "t string, inch double"
    ).select(timekeys.gauge_day(F.col("t")).alias("date"), (F.col("inch") * 25.4).alias("ppt_mm"))
    assert [tuple(r) for r in watering.rain_before_roof(gauge).collect()] == [(dt.date(2020, 4, 12), 25.4)]


def test_week_modes_around_new_year(spark):
    days = spark.createDataFrame(
        [(dt.date(2020, 12, 31),), (dt.date(2021, 1, 2),), (dt.date(2019, 12, 30),)], "d date"
    )
    keys = [timekeys.year_week(F.col("d"), m).alias(m) for m in ("iso", "calendar", "plain")]
    rows = {r.d: (r.iso, r.calendar, r.plain) for r in days.select("d", *keys).collect()}
    assert rows[dt.date(2020, 12, 31)] == ("2020_53", "2020_53", "2020_53")
    assert rows[dt.date(2021, 1, 2)] == ("2020_53", "2021_53", "2021_53")
    assert rows[dt.date(2019, 12, 30)] == ("2020_1", "2020_1", "2019_1")


def test_forward_and_inverse_agree(spark):
    h = spark.range(1, 10001).select(F.col("id").cast("double").alias("h"))
    a, n, r = F.lit(0.05), F.lit(1.8), F.lit(0.03)
    back = curves.suction_mpa(curves.water_content(F.col("h"), a, n, r), a, n, r) * 1.0e6 / 98.0665
    worst = h.select(F.max(F.abs(back / F.col("h") - 1)).alias("w")).first().w
    assert worst < 1e-9


def test_inverse_outside_its_domain_is_null(spark):
    one = spark.range(1)
    def at(t, a=0.05, n=1.8, r=0.03):
        return one.select(curves.suction_mpa(F.lit(t), F.lit(a), F.lit(n), F.lit(r)).alias("x")).first().x
    assert at(0.03) is None and at(0.02) is None and at(0.45) is None
    assert at(0.1, n=1.0) is None and at(0.1, n=0.9) is None and at(0.1, a=0.0) is None
    assert at(0.44) == 0.0


def test_vapour_pressure_deficit(spark):
    from loamline.functions import units

    def at(rh, t):
        return spark.range(1).select(units.vapour_pressure_deficit(F.lit(rh), F.lit(t)).alias("d")).first().d

    assert at(100.0, 25.0) == 0.0
    assert abs(at(0.0, 0.0) - 0.61121 * 1.0041946) < 1e-9
    assert abs(at(50.0, 25.0) - 1.590) < 2e-3


def test_units(spark):
    from loamline.functions import units

    row = spark.range(1).select(
        units.mpa_to_cm_water(F.lit(1.0)).alias("cm"),
        units.cm_water_to_mpa(units.mpa_to_cm_water(F.lit(-1.5))).alias("mpa"),
        units.inch_to_mm(F.lit(2.0)).alias("mm"),
    ).first()
    assert abs(row.cm - 10197.162129779) < 1e-6 and abs(row.mpa + 1.5) < 1e-12 and row.mm == 50.8


def test_missing_values_follow_one_rule(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, nan), (1, None), (2, 3.0), (2, nan), (3, inf), (3, 5.0)]
    stats = rollup.daily(spark.createDataFrame(rows, "k int, value double"), ["k"], F.col("value")).collect()
    assert {r.k: (r["mean"], r["min"], r["max"]) for r in stats} == {1: (None, None, None), 2: (3.0, 3.0, 3.0), 3: (5.0, 5.0, 5.0)}


def test_tempered_posterior_spreads_every_parameter(spark):
    """A check in which all weight lies on one grid point would prove nothing."""
    sse = spark.createDataFrame(
        [("g", a, n, r, 0.5 + a + n + r, 100) for a in (0.1, 0.2) for n in (1.5, 2.0) for r in (0.01, 0.02)],
        "grp string, alpha_cm double, n double, theta_r double, sse double, n_obs long",
    )
    out = fitting.weighted_summary(fitting.grid_posterior(sse, fitting.Axis(0.1, 0.1, 4), power=0.01), {"low": 0.025})
    rows = {r.parameter: r for r in out.collect()}
    assert set(rows) == {"alpha_cm", "n", "theta_r", "sigma"} and all(r.std_error > 0 for r in rows.values())
    total = fitting.grid_posterior(sse, fitting.Axis(0.1, 0.1, 4)).agg(F.sum("weight")).first()[0]
    assert abs(total - 1) < 1e-12
