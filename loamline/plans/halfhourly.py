"""Half-hourly pairs of water content and potential by week."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.functions import labels, timekeys, units
from loamline.operators import reshape

# The instrumented house and plots, with the treatment each plot received.
HOUSE = 3
PLOT_TREATMENTS = {4: "S1", 7: "S4"}


def paired_weeks(
    soil: DataFrame,
    house: int = HOUSE,
    plots: Sequence[int] = tuple(PLOT_TREATMENTS),
    periods=timekeys.STUDY_PERIODS,
    week_mode: str = "iso",
) -> DataFrame:
    """Content and potential (MPa) side by side per half-hour and sensor place."""
    wanted = soil.where(
        (F.col("house") == house)
        & F.col("plot").isin(list(plots))
        & F.col("variable").isin("VWC", "SWP")
        & F.col("value").isNotNull()
    )
    wide = reshape.variables_wide(wanted, ["dt", "date", "plot", "depth", "house"], ["VWC", "SWP"])
    return wide.select(
        "dt",
        "date",
        "plot",
        "depth",
        "house",
        F.col("VWC").alias("vwc"),
        units.kpa_to_mpa(F.col("SWP")).alias("swp"),
        timekeys.period_label(F.col("date"), periods).alias("period"),
        labels.depth_label(F.col("depth")).alias("depth_label"),
        timekeys.year_week(F.col("date"), week_mode).alias("year_week"),
    )


def noon_irrigation(
    irrigation_wide: DataFrame, plot_treatments: dict[int, str] = PLOT_TREATMENTS, week_mode: str = "iso"
) -> DataFrame:
    """Irrigation of the instrumented plots at 12:00, once per depth."""
    renamed = irrigation_wide.select(
        "date", *[F.col(t).alias(f"Plot_{p}") for p, t in plot_treatments.items()]
    )
    long = reshape.unpivot_by_name(renamed, ["date"], r"Plot_(\d+)", {"plot": int}, "irrigation_mm")
    long = long.select(
        timekeys.at_hour(F.col("date"), 12).alias("dt"),
        "date",
        "plot",
        "irrigation_mm",
        (F.col("irrigation_mm") > 0).alias("irig_tf"),
        timekeys.year_week(F.col("date"), week_mode).alias("year_week"),
    )
    return reshape.replicated(long, "depth_label", list(labels.DEPTH_LABELS.values()))
