"""Hydrologic season calendar and interval labelling."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions.timekeys import STUDY_PERIODS
from loamline.operators.intervals import join_intervals

# Season, first month, last month, last day; Winter starts in the year before.
SEASON_BOUNDS = (
    ("Winter", 11, 1, 31),
    ("Spring", 2, 4, 30),
    ("Premonsoon", 5, 6, 30),
    ("Growing", 7, 10, 31),
)
# Years of the experiment.
FIRST_YEAR = 2019
LAST_YEAR = 2023


def season_calendar(spark: SparkSession, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> DataFrame:
    """Closed intervals from the Growing season of ``first_year`` to that of ``last_year``."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("season"),
                F.lit(order).alias("season_ord"),
                F.lit(first).alias("first"),
                F.lit(last).alias("last"),
                F.lit(day).alias("day"),
            )
            for order, (name, first, last, day) in enumerate(SEASON_BOUNDS, start=1)
        ]
    )
    years = spark.range(first_year, last_year + 1, numPartitions=1).select(F.col("id").cast("int").alias("year"))
    starts_before = F.when(F.col("season") == "Winter", F.col("year") - 1).otherwise(F.col("year"))
    return (
        years.select("year", F.inline(rows))
        .where((F.col("year") > first_year) | (F.col("season") == "Growing"))
        .select(
            "year",
            "season",
            "season_ord",
            F.make_date(starts_before, F.col("first"), F.lit(1)).alias("st"),
            F.make_date(F.col("year"), F.col("last"), F.col("day")).alias("en"),
        )
    )


def hydrologic_year(day: Column) -> Column:
    return F.when(F.month(day) >= 11, F.year(day) + 1).otherwise(F.year(day))


def season_name(day: Column) -> Column:
    month = F.month(day)
    return (
        F.when((month >= 11) | (month == 1), F.lit("Winter"))
        .when(month <= 4, F.lit("Spring"))
        .when(month <= 6, F.lit("Premonsoon"))
        .otherwise(F.lit("Growing"))
    )


def with_season(
    df: DataFrame, date: str = "date", first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR
) -> DataFrame:
    """Season label from date arithmetic alone, days outside the calendar dropped.

    Equals the interval join with :func:`season_calendar`, but needs neither join nor
    shuffle, and the date range reaches the scan as a filter.
    """
    inside = F.col(date).between(F.lit(dt.date(first_year, 7, 1)), F.lit(dt.date(last_year, 10, 31)))
    return df.where(inside).select(
        "*", hydrologic_year(F.col(date)).alias("year"), season_name(F.col(date)).alias("season")
    )


def interval_days(intervals: DataFrame, st: str = "st", en: str = "en", day: str = "date") -> DataFrame:
    """One row per day of each closed interval; none where a bound is NULL or ``en`` is before ``st``."""
    held = intervals.where(F.col(st) <= F.col(en))
    return held.withColumn(day, F.explode(F.sequence(F.col(st), F.col(en))))


def label_by_interval(
    df: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str] = (),
    how: str = "left",
    date: str = "date",
    st: str = "st",
    en: str = "en",
    width: str = "day",
) -> DataFrame:
    """Closed-interval join as an equi join on cells; see :func:`intervals.join_intervals`."""
    return join_intervals(df, intervals, date, keys, how, st, en, width)


def label_by_range(
    df: DataFrame, intervals: DataFrame, how: str = "left", date: str = "date", st: str = "st", en: str = "en"
) -> DataFrame:
    """The literal range predicate; a nested-loop join, for small frames and for comparison."""
    hit = (df[date] >= intervals[st]) & (df[date] <= intervals[en])
    return df.join(intervals, hit, how).drop(st, en)


def period_bands(
    spark: SparkSession,
    variables: Sequence[str],
    plots: Sequence[str],
    periods: Sequence[tuple[str, dt.date, dt.date]] = STUDY_PERIODS,
) -> DataFrame:
    """Study periods replicated over variable labels and plots."""
    base = spark.createDataFrame(list(periods), "period string, st date, en date")
    return base.select(
        "*",
        F.explode(F.array(*[F.lit(v) for v in variables])).alias("var"),
    ).select("*", F.explode(F.array(*[F.lit(p) for p in plots])).alias("plot_id"))


def year_bounds(calendar: DataFrame, year: int, season: str | None = None) -> DataFrame:
    """First and last day of a hydrologic year or of one of its seasons."""
    hit = calendar.where(F.col("year") == year)
    if season is not None:
        hit = hit.where(F.col("season") == season)
    return hit.agg(F.min("st").alias("st"), F.max("en").alias("en"))


def year_seasons(calendar: DataFrame, year: int) -> DataFrame:
    return calendar.where(F.col("year") == year).select("season", "season_ord").distinct()
