"""Raw files to prepared daily tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions import labels
from loamline.operators import calendar, lookup, reshape, rollup, watering
from loamline.sources import readers, tables


@dataclass(frozen=True)
class DailyTables:
    temperature: DataFrame
    water_content: DataFrame
    water_potential: DataFrame
    air: DataFrame
    watering: DataFrame
    seasons: DataFrame
    paired: DataFrame


def daily_tables(
    days: DataFrame,
    air_wide: DataFrame,
    design: DataFrame,
    irrigation_wide: DataFrame,
    gauge: DataFrame,
    first_year: int = calendar.FIRST_YEAR,
    last_year: int = calendar.LAST_YEAR,
    roof_day: dt.date = watering.ROOF_DAY,
) -> DailyTables:
    """The prepared tables from the sensor-days of all variables and the other raw frames."""
    years = {"first_year": first_year, "last_year": last_year}

    def table(variable: str, drop_empty: bool = False) -> DataFrame:
        return rollup.soil_table(days.where(F.col("variable") == variable), design, variable, drop_empty, **years)

    rain = watering.rain_before_roof(gauge, roof_day)
    return DailyTables(
        temperature=table("TS", drop_empty=True),
        water_content=table("VWC"),
        water_potential=table("SWP"),
        air=rollup.daily_air(reshape.air_long(rollup.clean_air(air_wide)), **years),
        watering=watering.watering_table(reshape.treatments_long(irrigation_wide), rain),
        seasons=calendar.season_calendar(days.sparkSession, **years),
        paired=rollup.paired_table(rollup.days_beside(days), design, **years),
    )


def prepare(
    spark: SparkSession,
    temperature_path: str,
    soil_path: str,
    design_path: str,
    irrigation_path: str,
    gauge_path: str,
    out: str,
    **years,
) -> dict[str, str]:
    """CSV files in, Parquet tables below ``out``; returns the path of each table.

    The half-hourly text is parsed once for the soil columns and once for the few air
    columns.  Sensor-days of all variables come out of one aggregate and are written first;
    every daily table is cut from them.  Daily tables are partitioned by hydrologic year and
    sorted by date, so that a date range reaches few files and few row groups.
    """
    soil_wide = readers.read_wide_sensors(spark, soil_path)
    air_names = [c for c in soil_wide.columns if c.endswith(("_inside", "_outside"))]
    soil = reshape.soil_sensors_long(soil_wide.drop(*air_names)).unionByName(
        reshape.soil_temperature_long(readers.read_wide_sensors(spark, temperature_path))
    )
    root = out.rstrip("/")
    paths = {"sensor_days": f"{root}/sensor_days"}
    tables.save_table(rollup.sensor_days(soil), paths["sensor_days"], ("variable",), ("date",))
    made = daily_tables(
        tables.load_table(spark, paths["sensor_days"]),
        soil_wide.select("dt", "date", *air_names),
        readers.read_design(spark, design_path),
        readers.read_irrigation(spark, irrigation_path),
        readers.read_gauge(spark, gauge_path),
        **years,
    )
    for field in fields(made):
        table, path = getattr(made, field.name), f"{root}/{field.name}"
        yearly = field.name not in ("watering", "seasons")
        tables.save_table(table, path, ("year",) if yearly else (), ("date",) if "date" in table.columns else ())
        paths[field.name] = path
    return paths


def half_hourly_potential(
    soil: DataFrame, design: DataFrame, table: DataFrame, stat: str = "median", param: str | None = None
) -> DataFrame:
    """Water potential converted from every half-hourly water content.

    ``param`` names one parameter group; without it each row uses its summer treatment.
    """
    readings = rollup.with_design(soil.where(F.col("variable") == "VWC"), design)
    group = F.col("summer") if param is None else param
    return lookup.convert(readings, table, "value", group, (stat,))


def daily_converted(
    soil: DataFrame,
    design: DataFrame,
    table: DataFrame,
    stat: str = "median",
    param: str | None = "site",
    first_year: int = calendar.FIRST_YEAR,
    last_year: int = calendar.LAST_YEAR,
) -> DataFrame:
    """Daily statistics of the converted potential."""
    converted = half_hourly_potential(soil, design, table, stat, param)
    keys = ("id", *rollup.SENSOR_DAY, "summer", "winter")
    out = rollup.daily(converted, keys, F.col(f"swp_{stat}"), "swp_")
    out = out.withColumn("plot_id", labels.plot_id(F.col("house"), F.col("plot")))
    return calendar.with_season(out, "date", first_year, last_year)
