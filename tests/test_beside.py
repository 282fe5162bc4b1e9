"""Content and potential side by side from one aggregate equal the joined daily tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loamline.operators import rollup
from loamline.plans import dashboard

STATS = ["wc_mean", "wc_min", "wc_max", "wp_mean", "wp_min", "wp_max"]


def rows_of(df, *columns):
    """Values to 12 digits after the point: averages depend on the order of addition."""
    rows = df.select(*columns).collect()
    return sorted(repr([round(v, 12) if isinstance(v, float) else v for v in row]) for row in rows)


@pytest.fixture(scope="module")
def readings(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(4000):
        variable = rng.choice(("VWC", "SWP", "TS"))
        house, plot = rng.randint(1, 3), rng.randint(1, 3)
        # House 1 has content alone, house 2 mostly missing values, plot 3 of house 3 potential alone.
        if (house == 1 and variable == "SWP") or (house, plot, variable) == (3, 3, "VWC"):
            continue
        value = rng.choice((None, float("nan"), None, 0.25)) if house == 2 else rng.randint(0, 64) / 64.0
        day = dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 20))
        rows.append((variable, house, plot, rng.randint(1, 2), day, value))
    return spark.createDataFrame(rows, "variable string, house int, plot int, depth int, date date, value double").repartition(5)


@pytest.fixture(scope="module")
def design(spark):
    return spark.createDataFrame([(h, p, "S1", "W1") for h in (1, 2, 3) for p in (1, 3)], "house int, plot int, summer string, winter string")


def test_forms_agree(readings, design):
    wc, wp = rollup.daily_water_content(readings, design), rollup.daily_water_potential(readings, design)
    from_readings = rollup.soil_beside(readings)
    from_days = rollup.days_beside(rollup.sensor_days(readings))
    joined = rollup.paired_days(wp, wc)
    for beside in (from_readings, from_days):
        made = rollup.paired_table(beside, design)
        assert sorted(made.columns) == sorted(joined.columns)
        assert rows_of(made, *joined.columns) == rows_of(joined, *joined.columns)
        content = rollup.paired_table(beside, design, ("wc",))
        keys = ["house", "plot", "depth", "date"]
        driven = wc.join(wp.select(*keys, "wp_mean", "wp_min", "wp_max"), keys, "left")
        columns = ["id", *keys, "summer", "winter", "plot_id", "year", "season", *STATS]
        assert rows_of(content, *columns) == rows_of(driven, *columns)
        both = rollup.paired_table(beside, design, ("wp", "wc"))
        assert both.count() == wc.join(wp, keys).count() > 0
        long = dashboard.long_pairs_of(both)
        assert rows_of(long, *sorted(long.columns)) == rows_of(dashboard.long_pairs(wc, wp), *sorted(long.columns))


def test_null_keys_and_empty_tables(spark, design):
    schema = "variable string, house int, plot int, depth int, date date, value double"
    day = dt.date(2020, 1, 2)
    rows = [("VWC", None, 1, 1, day, 0.5), ("SWP", None, 1, 1, day, -20.0), (None, 1, 1, 1, day, 9.0), ("TS", 1, 1, 1, day, 9.0)]
    (row,) = rollup.soil_beside(spark.createDataFrame(rows, schema)).collect()
    assert (row.house, row.wc_mean, row.has_wc, row.has_wp) == (None, 0.5, True, True)
    made = rollup.paired_table(rollup.soil_beside(spark.createDataFrame([], schema)), design)
    assert made.count() == 0


def test_one_scan_and_one_shuffle_of_the_readings(spark, readings, design, tmp_path):
    readings.write.parquet(f"{tmp_path}/readings")
    stored = spark.read.parquet(f"{tmp_path}/readings")
    made = rollup.paired_table(rollup.soil_beside(stored), F.broadcast(design))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
