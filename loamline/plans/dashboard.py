"""Parameterised queries behind the dashboard tabs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.functions import labels
from loamline.operators import calendar, reshape, rollup, watering

# The hydrologic year of the prepared daily tables, by which they are partitioned.
YEAR = "year"


def in_range(df: DataFrame, first: dt.date, last: dt.date, year: str | None = None) -> DataFrame:
    """Closed day range.

    ``year`` names a column with the hydrologic year, if the table is partitioned by it: the
    years the range spans are then read, and no others.
    """
    chosen = df.where(F.col("date").between(F.lit(first), F.lit(last)))
    if year is None:
        return chosen
    years = [day.year + (day.month >= 11) for day in (first, last)]
    return chosen.where(F.col(year).between(*years))


def of_treatments(df: DataFrame, summers: Sequence[str], winters: Sequence[str]) -> DataFrame:
    return df.where(F.col("summer").isin(list(summers)) & F.col("winter").isin(list(winters)))


def seasonal(
    tables: dict[str, DataFrame], summers: Sequence[str], winters: Sequence[str], first: dt.date, last: dt.date
) -> dict[str, DataFrame]:
    """Tab 1: soil series by depth with size labels, watering, air series and axis ratios."""
    out = {}
    water = watering.zero_filled(
        in_range(tables["watering"].where(F.col("treatment").isin([*summers, *winters])), first, last)
    )
    for name, table, prefix in (("wc", "water_content", "wc"), ("ts", "temperature", "ts")):
        chosen = in_range(of_treatments(tables[table], summers, winters), first, last, YEAR)
        series = rollup.plot_means(chosen, ("date", "depth"), prefix)
        out[name] = series
        out[f"{name}_sizes"] = rollup.size_labels(series, ("depth",), labels.depth_label(F.col("depth")))
        out[f"{name}_ratio"] = watering.axis_ratio(water, series, F.max(f"mean_{prefix}_max"))
    air = rollup.outside_air_means(in_range(tables["air"], first, last, YEAR))
    out["watering"] = water
    out["air"] = air
    out["air_ratio"] = air.agg(F.try_divide(F.max("mean_D_max"), F.max("mean_T_max")).alias("ratio"))
    return out


def comparison(tables: dict[str, DataFrame], by: str, first: dt.date, last: dt.date) -> dict[str, DataFrame]:
    """Tab 2: watering by treatment, and water content by treatment and depth."""
    chosen = reshape.chosen_treatment(in_range(tables["water_content"], first, last, YEAR), by)
    series = rollup.plot_means(chosen, ("treatment", "date", "depth"), "wc", skip_nulls=False).withColumn(
        "depth_label", labels.depth_label(F.col("depth"))
    )
    return {
        "watering": in_range(tables["watering"], first, last),
        "wc": series,
        "wc_sizes": rollup.size_labels(series, ("treatment", "depth_label"), F.col("treatment")),
    }


def pairs(tables: dict[str, DataFrame], summer: str, first: dt.date, last: dt.date, winter: str = "W3") -> dict[str, DataFrame]:
    """Tab 3: paired days of one summer treatment, its watering and both axis ratios."""
    days = in_range(tables["paired"].where(F.col("summer") == summer), first, last, YEAR)
    water = watering.zero_filled(
        in_range(
            tables["watering"].where((F.col("treatment") == summer) | (F.col("treatment") == winter)), first, last
        )
    )
    return {
        "paired": days,
        "watering": water,
        "wp_ratio": watering.axis_ratio(water, days, F.min("wp_min"), inverse=True),
        "wc_ratio": watering.axis_ratio(water, days, F.max("wc_max"), inverse=True),
    }


def choices(seasons: DataFrame, year: int, season: str | None = None) -> dict[str, DataFrame]:
    """Seasons of a year, and the day range of a year or season."""
    return {
        "years": seasons.select("year").distinct(),
        "seasons": calendar.year_seasons(seasons, year),
        "range": calendar.year_bounds(seasons, year, season),
    }


def long_pairs(wc: DataFrame, wp: DataFrame) -> DataFrame:
    """Complete paired days, one row per sensor place and variable with mean, min and max.

    ``id`` names the place: plot, depth and house.
    The potential arrives in MPa already, so no scaling remains to be done here.
    """
    return long_pairs_of(rollup.matched_from_content(wc, wp))


def long_pairs_of(matched: DataFrame) -> DataFrame:
    """The same from content and potential that are already side by side."""
    place = labels.sensor_id(F.col("plot"), F.col("depth"), F.col("house"))
    matched = matched.withColumn("id", place)
    ids = ["date", "plot_id", "id", "plot", "depth", "house"]
    stats = ["wc_mean", "wc_min", "wc_max", "wp_mean", "wp_min", "wp_max"]
    complete = matched.select(*ids, "summer", "winter", *stats).dropna("any").select(
        *ids, *[F.col(s).alias(s.replace("wc", "WC").replace("wp", "WP")) for s in stats]
    )
    wide = reshape.statistics_wide(reshape.statistics_long(complete, ids), [*ids, "variable"])
    return wide.withColumn("var", labels.mapped(F.col("variable"), labels.SOIL_LABELS))
