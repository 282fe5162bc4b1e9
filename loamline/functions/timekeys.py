"""Dates, weeks and study periods as Column expressions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Study periods (label, first day, last day).
STUDY_PERIODS = (
    ("Winter 2020", dt.date(2019, 11, 1), dt.date(2020, 4, 30)),
    ("Premonsoon", dt.date(2020, 5, 1), dt.date(2020, 7, 12)),
    ("S1-S4", dt.date(2020, 7, 13), dt.date(2020, 9, 30)),
    ("Winter 2021", dt.date(2020, 10, 1), dt.date(2021, 3, 6)),
)


def gauge_day(text: Column) -> Column:
    """Day of an ``M/d/yyyy H:mm`` string; the clock part is ignored."""
    return F.to_date(F.substring_index(text, " ", 1), "M/d/yyyy")


def slash_day(text: Column) -> Column:
    return F.to_date(text, "M/d/yyyy")


def at_hour(day: Column, hour: int) -> Column:
    """Wall-clock timestamp of a day at a full hour."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hour))


def period_label(day: Column, periods: Sequence[tuple[str, dt.date, dt.date]] = STUDY_PERIODS) -> Column:
    """First closed interval holding the day, else NULL."""
    out = None
    for name, first, last in periods:
        hit = day.between(F.lit(first), F.lit(last))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def week_year(day: Column, mode: str = "iso") -> Column:
    """Year that goes with the ISO week.

    ``iso`` is the ISO week-numbering year.  ``calendar`` is the calendar year with only
    week 1 moved to the later year, so 1-3 January 2021 stay in "2021_53".
    """
    if mode == "iso":
        return F.extract(F.lit("YEAROFWEEK"), day)
    if mode == "calendar":
        early = (F.weekofyear(day) == 1) & (F.month(day) == 12)
        return F.when(early, F.year(day) + 1).otherwise(F.year(day))
    if mode == "plain":
        return F.year(day)
    raise ValueError(f"unknown week mode {mode!r}")


def year_week(day: Column, mode: str = "iso") -> Column:
    return F.concat_ws("_", week_year(day, mode).cast("string"), F.weekofyear(day).cast("string"))


def padded_week(day: Column) -> Column:
    return F.lpad(F.weekofyear(day).cast("string"), 2, "0")


def offset_of(name: Column) -> Column:
    """Days that a column named ``date_k`` lies after ``date``, of any number of digits; 0 for ``date``."""
    digits = F.regexp_extract(name, r"^date_([0-9]+)$", 1)
    return F.when(name == "date", F.lit(0)).otherwise(digits.try_cast("int"))
