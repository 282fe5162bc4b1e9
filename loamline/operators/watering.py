"""Irrigation and rain by treatment, and axis ratios against a series."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions import labels, nulls
from loamline.operators.pairing import settled_small
from loamline.operators.reshape import replicated

# Fixed value: the day the roof went up.
ROOF_DAY = dt.date(2020, 5, 20)


def rain_before_roof(gauge: DataFrame, last_day: dt.date = ROOF_DAY) -> DataFrame:
    return gauge.where((F.col("date") <= F.lit(last_day)) & (F.col("ppt_mm") != 0))


def watering_table(
    irrigation: DataFrame, rain: DataFrame, treatments: Sequence[str] = labels.TREATMENTS
) -> DataFrame:
    """Irrigation and rain side by side; rain falls on every treatment."""
    everywhere = replicated(rain, "treatment", treatments)
    return irrigation.join(everywhere, ["date", "treatment"], "full").select(
        "date", "treatment", "irrigation_mm", "ppt_mm"
    )


def zero_filled(watering: DataFrame) -> DataFrame:
    return watering.select(
        "date",
        "treatment",
        nulls.zero_filled(F.col("irrigation_mm")).alias("irrigation_mm"),
        nulls.zero_filled(F.col("ppt_mm")).alias("ppt_mm"),
    )


def with_irrigation(paired: DataFrame, irrigation: DataFrame, treatment: str = "summer") -> DataFrame:
    """Irrigation of the row's own treatment on its day; the row count stays."""
    right = irrigation.select("date", F.col("treatment").alias(treatment), "irrigation_mm")
    return paired.join(settled_small(right), ["date", treatment], "left")


def axis_ratio(watering: DataFrame, series: DataFrame, top: Column, inverse: bool = False) -> DataFrame:
    """One row: largest watering amount over the series' extreme (or the inverse).

    ``top`` is the aggregate that gives the extreme.  Without watering rows the ratio is 1.
    Both one-row aggregates are appended and folded, so nothing is joined.
    """
    amounts = watering.agg(
        F.greatest(F.max("irrigation_mm"), F.max("ppt_mm")).alias("amount"), F.count(F.lit(1)).alias("n")
    ).select("amount", "n", F.lit(None).cast("double").alias("extreme"))
    extremes = series.agg(top.cast("double").alias("extreme")).select(
        F.lit(None).cast("double").alias("amount"), F.lit(0).cast("long").alias("n"), "extreme"
    )
    both = amounts.unionByName(extremes).agg(
        F.max("amount").alias("amount"), F.sum("n").alias("n"), F.max("extreme").alias("extreme")
    )
    quotient = (
        F.try_divide(F.col("extreme"), F.col("amount")) if inverse else F.try_divide(F.col("amount"), F.col("extreme"))
    )
    return both.select(F.when(F.col("n") == 0, F.lit(1.0)).otherwise(quotient).alias("ratio"))
