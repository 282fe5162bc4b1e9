"""Half-hourly readings to daily statistics, and means over plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions import labels, nulls, units
from loamline.operators.calendar import FIRST_YEAR, LAST_YEAR, with_season
from loamline.operators.pairing import join_same, settled_small

# A sensor of one variable on one day; also the key on which daily tables are paired, so the
# partitioning of the aggregate serves the join.
SENSOR_DAY = ("house", "plot", "depth", "date")
# Column prefix and divisor of each soil variable.
SOIL_VARIABLES = {"TS": ("ts", 1.0), "VWC": ("wc", 1.0), "SWP": ("wp", units.KPA_PER_MPA)}


def clean_air(wide: DataFrame, floor: float = -10.0) -> DataFrame:
    """Blank impossible air temperatures, then add vapour-pressure deficit per location."""
    out = wide
    for place in labels.LOCATION_LEVELS:
        out = out.withColumn(f"T_{place}", nulls.at_least(F.col(f"T_{place}"), floor))
    for place in labels.LOCATION_LEVELS:
        out = out.withColumn(
            f"D_{place}", units.vapour_pressure_deficit(F.col(f"RH_{place}"), F.col(f"T_{place}"))
        )
    return out


def stats(value: Column, prefix: str = "") -> list[Column]:
    clean = nulls.finite(value)
    return [
        F.avg(clean).alias(f"{prefix}mean"),
        F.min(clean).alias(f"{prefix}min"),
        F.max(clean).alias(f"{prefix}max"),
    ]


def daily(readings: DataFrame, keys: Sequence[str], value: Column, prefix: str = "") -> DataFrame:
    """Mean, minimum and maximum per key set, missing readings ignored.

    All three are combined map-side, so a sensor-day of any size reaches the shuffle as one
    row per task.
    """
    return readings.groupBy(*keys).agg(*stats(value, prefix))


def with_design(df: DataFrame, design: DataFrame) -> DataFrame:
    """Attach treatments; sensors outside the design keep NULL labels."""
    return df.join(design.select("house", "plot", "summer", "winter"), ["house", "plot"], "left")


def sensor_days(readings: DataFrame) -> DataFrame:
    """Daily statistics of all soil variables in one pass over the readings."""
    divisor = F.lit(1.0)
    for variable, (_, scale) in SOIL_VARIABLES.items():
        if scale != 1.0:
            divisor = F.when(F.col("variable") == variable, F.lit(scale)).otherwise(divisor)
    soil = readings.where(F.col("variable").isin(list(SOIL_VARIABLES)))
    return daily(soil, ("variable", *SENSOR_DAY), F.col("value") / divisor)


def soil_table(
    days: DataFrame,
    design: DataFrame,
    variable: str,
    drop_empty: bool = False,
    first_year: int = FIRST_YEAR,
    last_year: int = LAST_YEAR,
) -> DataFrame:
    """Daily table of one variable from (house, plot, depth, date, mean, min, max).

    Sensor name, design and season are constant per sensor-day, so they are attached to one
    row per day instead of 48.
    """
    prefix = SOIL_VARIABLES[variable][0]
    c = F.col
    table = days.where(c("mean").isNotNull()) if drop_empty else days
    name = labels.sensor_id(c("plot"), c("depth"), c("house"), None if variable == "TS" else F.lit(variable))
    table = table.select(
        name.alias("id"), *SENSOR_DAY, *[c(s).alias(f"{prefix}_{s}") for s in ("mean", "min", "max")]
    )
    table = with_design(table, design).withColumn("plot_id", labels.plot_id(c("house"), c("plot")))
    return with_season(table, "date", first_year, last_year)


def daily_soil(readings: DataFrame, design: DataFrame, variable: str, drop_empty: bool = False, **years) -> DataFrame:
    """Daily table of one soil variable from the readings."""
    scale = SOIL_VARIABLES[variable][1]
    value = F.col("value") / F.lit(scale) if scale != 1.0 else F.col("value")
    days = daily(readings.where(F.col("variable") == variable), SENSOR_DAY, value)
    return soil_table(days, design, variable, drop_empty, **years)


def daily_temperature(readings: DataFrame, design: DataFrame, **years) -> DataFrame:
    return daily_soil(readings, design, "TS", drop_empty=True, **years)


def daily_water_content(readings: DataFrame, design: DataFrame, **years) -> DataFrame:
    return daily_soil(readings, design, "VWC", **years)


def daily_water_potential(readings: DataFrame, design: DataFrame, **years) -> DataFrame:
    return daily_soil(readings, design, "SWP", **years)


def soil_beside(readings: DataFrame, variables: Sequence[str] = ("VWC", "SWP")) -> DataFrame:
    """Sensor places by day with the statistics of several variables side by side.

    One conditional aggregate: the readings are scanned once and shuffled once, as one row per
    place, day and task. ``has_<prefix>`` tells whether the variable has a row that day at all, so
    that inner, left and right pairings are filters. NULL keys are keys like others.
    """
    columns = []
    for variable in variables:
        prefix, scale = SOIL_VARIABLES[variable]
        here = F.col("variable") == variable
        value = F.col("value") / F.lit(scale) if scale != 1.0 else F.col("value")
        columns += [*stats(F.when(here, value), f"{prefix}_"), F.bool_or(here).alias(f"has_{prefix}")]
    return readings.where(F.col("variable").isin(list(variables))).groupBy(*SENSOR_DAY).agg(*columns)


def days_beside(days: DataFrame, variables: Sequence[str] = ("VWC", "SWP")) -> DataFrame:
    """The same from :func:`sensor_days`, which hold one row per variable, place and day."""
    columns = []
    for variable in variables:
        prefix, here = SOIL_VARIABLES[variable][0], F.col("variable") == variable
        columns += [F.max(F.when(here, F.col(s))).alias(f"{prefix}_{s}") for s in ("mean", "min", "max")]
        columns.append(F.bool_or(here).alias(f"has_{prefix}"))
    return days.where(F.col("variable").isin(list(variables))).groupBy(*SENSOR_DAY).agg(*columns)


def paired_table(
    beside: DataFrame,
    design: DataFrame,
    keep: Sequence[str] = ("wp",),
    first_year: int = FIRST_YEAR,
    last_year: int = LAST_YEAR,
) -> DataFrame:
    """Content beside potential, with sensor name, design and season.

    ``keep`` names the variables a day must have: ``("wp",)`` is the left join driven by the
    potential, ``("wc",)`` the one driven by the content, both the inner join. The sensor is named
    after the first of them.
    """
    names = {prefix: variable for variable, (prefix, _) in SOIL_VARIABLES.items()}
    c = F.col
    rows = beside
    for prefix in keep:
        rows = rows.where(c(f"has_{prefix}"))
    first = keep[0]
    other = "wc" if first == "wp" else "wp"
    own, beside_it = ([f"{prefix}_{s}" for s in ("mean", "min", "max")] for prefix in (first, other))
    name = labels.sensor_id(c("plot"), c("depth"), c("house"), F.lit(names[first]))
    table = with_design(rows.select(name.alias("id"), *SENSOR_DAY, *own, *beside_it), design)
    table = table.withColumn("plot_id", labels.plot_id(c("house"), c("plot")))
    table = with_season(table, "date", first_year, last_year)
    return table.select(*[x for x in table.columns if x not in beside_it], *beside_it)


def daily_air(air: DataFrame, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> DataFrame:
    table = daily(air, ("variable", "location", "date"), F.col("value"))
    table = table.withColumn("var_label", labels.mapped(F.col("variable"), labels.AIR_LABELS)).withColumn(
        "location_ord", labels.level_index(F.col("location"), labels.LOCATION_LEVELS)
    )
    return with_season(table, "date", first_year, last_year)


def paired_days(wp: DataFrame, wc: DataFrame) -> DataFrame:
    """Water content beside water potential, driven by the potential side.

    House, plot, depth and date fix every other shared column; the keys are never NULL
    after the daily aggregate, so plain equality serves.
    """
    keys = ["house", "plot", "depth", "date"]
    return wp.join(wc.select(*keys, "wc_mean", "wc_min", "wc_max"), keys, "left")


def paired_days_null_safe(wp: DataFrame, wc: DataFrame) -> DataFrame:
    """The same pairing on every shared column, NULL labels matching each other."""
    shared = [c for c in wp.columns if c in wc.columns and c != "id"]
    return join_same(wp, wc.drop("id"), shared, "left")


def matched_from_content(wc: DataFrame, wp: DataFrame) -> DataFrame:
    """Daily water content of instrumented plots with the potential beside it."""
    plots = wp.select("plot_id").distinct()
    right = wp.select("date", "house", "depth", "plot", "wp_mean", "wp_min", "wp_max")
    return wc.join(plots, "plot_id", "left_semi").join(right, ["date", "house", "depth", "plot"], "left")


def plot_means(
    table: DataFrame, keys: Sequence[str], prefix: str, skip_nulls: bool = True
) -> DataFrame:
    """Mean of the daily mean, minimum and maximum over plots, and the number of rows."""
    columns = [
        nulls.group_mean(F.col(f"{prefix}_{s}"), skip_nulls).alias(f"mean_{prefix}_{s}") for s in ("mean", "min", "max")
    ]
    return table.groupBy(*keys).agg(*columns, F.count(F.lit(1)).alias("n"))


def outside_air_means(air_daily: DataFrame) -> DataFrame:
    """Outside temperature and vapour-pressure deficit per day, both in one pass."""
    columns = [
        F.avg(F.when(F.col("variable") == v, F.col(s))).alias(f"mean_{v}_{s}")
        for v in ("T", "D")
        for s in ("mean", "min", "max")
    ]
    wanted = (F.col("location") == "outside") & F.col("variable").isin("T", "D")
    return air_daily.where(wanted).groupBy("date").agg(*columns)


def size_labels(means: DataFrame, keys: Sequence[str], text: Column) -> DataFrame:
    """Largest group size per key set as a legend label."""
    return (
        means.groupBy(*keys)
        .agg(F.max("n").alias("n_plots"))
        .withColumn("label", labels.sized_label(text, F.col("n_plots")))
    )


def weekly_ranges(paired: DataFrame) -> DataFrame:
    """Per week: ratio of the potential range to the content range, and the lowest potential."""
    swp, vwc = F.col("swp"), F.col("vwc")
    return paired.groupBy("year_week").agg(
        F.try_divide(F.max(swp) - F.min(swp), F.max(vwc) - F.min(vwc)).alias("prop"), F.min(swp).alias("lo")
    )


def rescaled_by_week(paired: DataFrame) -> DataFrame:
    """Water content on the potential axis of its week."""
    return paired.join(settled_small(weekly_ranges(paired)), "year_week").withColumn(
        "vwc_scaled", F.col("vwc") * F.col("prop") + F.col("lo")
    )


def weekly_watered(irrigation: DataFrame) -> DataFrame:
    return irrigation.groupBy("year_week").agg(
        F.count_if(F.col("irrigation_mm") > 0).alias("n_watered"),
        F.coalesce(F.bool_or(F.col("irrigation_mm") > 0), F.lit(False)).alias("watered"),
    )
