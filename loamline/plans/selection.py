"""Days that go into curve fitting, and the pulse selections around them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions import curves, labels
from loamline.operators import pulses, reshape, watering
from loamline.operators.calendar import FIRST_YEAR, LAST_YEAR


@dataclass(frozen=True)
class Rules:
    """Dates and thresholds of the selection; the defaults are the experiment's."""

    mid_year: int = 2020
    mid_from: dt.date = dt.date(2019, 12, 1)
    spring_ends: tuple[tuple[int, dt.date], ...] = ((2020, dt.date(2020, 3, 18)), (2021, dt.date(2021, 3, 22)))
    pulse_years: tuple[int, ...] = (2020, 2021)
    window_days: int = 2
    first_year: int = FIRST_YEAR
    last_year: int = LAST_YEAR


def mid_depth(paired: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """25 cm, Winter and Spring of one hydrologic year from a first day on."""
    return paired.where(
        (F.col("year") == rules.mid_year)
        & (F.col("depth") == 2)
        & F.col("season").isin("Winter", "Spring")
        & (F.col("date") >= F.lit(rules.mid_from))
    )


def shallow_spring(paired: DataFrame, rules: Rules = Rules(), treatment: str = "S1") -> DataFrame:
    """Shallow early spring of one treatment, before the top layer dries."""
    early: Column = F.lit(False)
    for year, before in rules.spring_ends:
        early = early | ((F.col("year") == year) & (F.col("date") < F.lit(before)))
    return paired.where(
        (F.col("summer") == treatment) & (F.col("depth") == 1) & (F.col("season") == "Spring") & early
    ).withColumn("year_season", labels.joined_key(F.col("year"), F.col("season")))


def labelled_pulses(paired: DataFrame, irrigation: DataFrame, rules: Rules = Rules(), treatment: str = "S4") -> DataFrame:
    """Shallow days of one treatment outside event windows, with their pulse."""
    days = paired.where((F.col("summer") == treatment) & (F.col("depth") == 1))
    kept = pulses.outside_windows(days, irrigation, treatment, rules.window_days)
    table = pulses.pulse_table(
        irrigation,
        treatment,
        rules.pulse_years,
        first_year=rules.first_year,
        last_year=rules.last_year,
    )
    return pulses.with_pulse(kept, table).withColumn(
        "year_season", labels.joined_key(F.col("year"), F.col("season"))
    )


def shallow_growing(paired: DataFrame, irrigation: DataFrame, rules: Rules = Rules(), treatment: str = "S4") -> DataFrame:
    """The pulses of each growing season but its first."""
    return labelled_pulses(paired, irrigation, rules, treatment).where(F.col("pulse_in_season") > 1)


def curve_input(paired: DataFrame, irrigation: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The three selections appended on their common columns."""
    base = watering.with_irrigation(paired, irrigation)
    return reshape.union_on_common(
        shallow_growing(base, irrigation, rules), shallow_spring(base, rules), mid_depth(base, rules)
    )


def curve_points(selected: DataFrame) -> DataFrame:
    """Observations for fitting: content and suction head with treatment keys."""
    return selected.select(
        "date",
        "house",
        "plot",
        "depth",
        "summer",
        labels.joined_key(F.col("depth"), F.col("summer")).alias("trt"),
        F.col("wc_mean").alias("theta"),
        curves.suction_cm(F.col("wp_mean")).alias("h_cm"),
        curves.suction_m(F.col("wp_mean")).alias("h_m"),
    )


def between_label(
    paired: DataFrame,
    irrigation: DataFrame,
    year_seasons: Sequence[str],
    between: Sequence[tuple[dt.date, dt.date]] = pulses.BETWEEN_WINDOWS,
    treatment: str = "S1",
) -> DataFrame:
    """Shallow days of a treatment labelled by days since irrigation, in chosen seasons."""
    days = paired.where((F.col("summer") == treatment) & (F.col("depth") == 1)).withColumn(
        "year_season", labels.joined_key(F.col("year"), F.col("season"))
    )
    chosen = days.where(F.col("year_season").isin(list(year_seasons)))
    return pulses.with_days_since(chosen, irrigation, treatment, between).where(F.col("irig_label").isNotNull())


def seasons_outside_windows(
    paired: DataFrame, irrigation: DataFrame, year_seasons: Sequence[str], treatment: str = "S1", window_days: int = 1
) -> DataFrame:
    """Shallow days of a treatment in chosen seasons, event windows removed."""
    days = paired.where((F.col("summer") == treatment) & (F.col("depth") == 1)).withColumn(
        "year_season", labels.joined_key(F.col("year"), F.col("season"))
    )
    chosen = days.where(F.col("year_season").isin(list(year_seasons)))
    return pulses.outside_windows(chosen, irrigation, treatment, window_days)


def mid_spring(paired: DataFrame, year: int = 2020) -> DataFrame:
    return paired.where((F.col("year") == year) & (F.col("season") == "Spring") & (F.col("depth") == 2))
