"""Irrigation events as pulses and day windows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.operators.calendar import FIRST_YEAR, LAST_YEAR, hydrologic_year, label_by_interval, season_name
from loamline.operators.pairing import settled_small
from loamline.operators.reshape import offset_days

# Amount of the first rewatering, and the windows of the between-irrigation label.
REWATER_MM = 30.0
BETWEEN_WINDOWS = (
    (dt.date(2020, 7, 14), dt.date(2020, 10, 8)),
    (dt.date(2021, 7, 5), dt.date(2021, 9, 23)),
)


def events_of(irrigation: DataFrame, treatment: str) -> DataFrame:
    return irrigation.where((F.col("treatment") == treatment) & (F.col("irrigation_mm") != 0))


def event_windows(irrigation: DataFrame, treatment: str, last_offset: int) -> DataFrame:
    """(date, offset): each event day and the days after it."""
    return offset_days(events_of(irrigation, treatment).select("date"), last_offset)


def outside_windows(days: DataFrame, irrigation: DataFrame, treatment: str, last_offset: int) -> DataFrame:
    """Drop days inside an event window."""
    windows = event_windows(irrigation, treatment, last_offset).select("date").distinct()
    return days.join(settled_small(windows), "date", "left_anti")


def days_since(irrigation: DataFrame, treatment: str, last_offset: int = 2) -> DataFrame:
    """One row per day; overlapping windows keep the most recent event."""
    windows = event_windows(irrigation, treatment, last_offset)
    return windows.groupBy("date").agg(F.min("offset").alias("irig_label"))


def with_days_since(
    days: DataFrame,
    irrigation: DataFrame,
    treatment: str,
    between: Sequence[tuple[dt.date, dt.date]] = BETWEEN_WINDOWS,
) -> DataFrame:
    """0, 1, 2 days since irrigation; 3 for other days inside a ``between`` window."""
    labelled = days.join(settled_small(days_since(irrigation, treatment)), "date", "left")
    inside = F.lit(False)
    for first, last in between:
        inside = inside | F.col("date").between(F.lit(first), F.lit(last))
    return labelled.withColumn(
        "irig_label", F.coalesce(F.col("irig_label"), F.when(inside, F.lit(3)))
    )


def daily_events(irrigation: DataFrame) -> DataFrame:
    """Nonzero events, those of one treatment and day summed, so that a day has one event at most."""
    events = irrigation.where((F.col("irrigation_mm") != 0) & F.col("date").isNotNull())
    return events.groupBy("treatment", "date").agg(F.sum("irrigation_mm").alias("irrigation_mm"))


def numbered_events(irrigation: DataFrame) -> DataFrame:
    """Running number of the days with nonzero events per treatment."""
    order = Window.partitionBy("treatment").orderBy("date")
    return daily_events(irrigation).withColumn("pulse", F.row_number().over(order))


def event_spans(irrigation: DataFrame, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> DataFrame:
    """Each day with an event, up to the day before the next one, cut at its season's end.

    Events of one day count as one, so a span never ends before it starts.
    """
    order = Window.partitionBy("treatment").orderBy("date")
    day = F.col("date")
    season_end = (
        F.when(F.col("season") == "Winter", F.make_date(F.col("year"), F.lit(1), F.lit(31)))
        .when(F.col("season") == "Spring", F.make_date(F.col("year"), F.lit(4), F.lit(30)))
        .when(F.col("season") == "Premonsoon", F.make_date(F.col("year"), F.lit(6), F.lit(30)))
        .otherwise(F.make_date(F.col("year"), F.lit(10), F.lit(31)))
    )
    inside = day.between(F.lit(dt.date(first_year, 7, 1)), F.lit(dt.date(last_year, 10, 31)))
    return (
        daily_events(irrigation)
        .withColumn("next_date", F.lead("date").over(order))
        .where(inside)
        .withColumn("year", hydrologic_year(day))
        .withColumn("season", season_name(day))
        .select(
            "treatment",
            F.col("date").alias("st"),
            F.least(F.date_sub(F.col("next_date"), 1), season_end).alias("en"),
            "irrigation_mm",
            "year",
            "season",
        )
    )


def pulse_table(
    irrigation: DataFrame,
    treatment: str,
    years: Sequence[int] = (2020, 2021),
    season: str = "Growing",
    rewater_mm: float = REWATER_MM,
    first_year: int = FIRST_YEAR,
    last_year: int = LAST_YEAR,
) -> DataFrame:
    """Pulses of one treatment in the chosen seasons, numbered overall and within the season."""
    spans = event_spans(irrigation.where(F.col("treatment") == treatment), first_year, last_year)
    chosen = spans.where(
        F.col("year").isin(list(years)) & (F.col("season") == season) & (F.col("irrigation_mm") != rewater_mm)
    )
    overall = Window.partitionBy("treatment").orderBy("st")
    within = Window.partitionBy("treatment", "year").orderBy("st")
    return chosen.select(
        "treatment",
        "st",
        "en",
        F.row_number().over(overall).alias("pulse"),
        F.row_number().over(within).alias("pulse_in_season"),
    )


def without_first(pulses: DataFrame) -> DataFrame:
    return pulses.where(F.col("pulse_in_season") > 1)


def with_pulse(days: DataFrame, pulses: DataFrame) -> DataFrame:
    """Pulse whose closed interval holds the day, NULL when none does; a day keeps its one row."""
    return label_by_interval(days, pulses.drop("treatment"), width="month")
