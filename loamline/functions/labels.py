"""Keys, level orders and display labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Level orders.
SUMMER_LEVELS = ("S1", "S2", "S3", "S4")
WINTER_LEVELS = ("W1", "W2", "W3")
TREATMENTS = SUMMER_LEVELS + WINTER_LEVELS
SEASON_LEVELS = ("Winter", "Spring", "Premonsoon", "Growing")
LOCATION_LEVELS = ("outside", "inside")
TRT_LEVELS = ("1_S1", "2_S1", "1_S4", "2_S4")

# Display labels.
DEPTH_LABELS = {1: "0-12 cm", 2: "25 cm", 3: "75 cm"}
AIR_LABELS = {"T": "T~(~degree~C)", "RH": "RH~('%')", "D": "D~(kPa)"}
SOIL_LABELS = {"WC": "Theta~(m^3~m^-3)", "WP": "Psi~(MPa)"}


def mapped(c: Column, labels: dict) -> Column:
    """First matching label, NULL when nothing matches."""
    out = None
    for key, text in labels.items():
        hit = c == F.lit(key)
        out = F.when(hit, F.lit(text)) if out is None else out.when(hit, F.lit(text))
    return out


def level_index(c: Column, levels: Sequence[str]) -> Column:
    """1-based position in a level order; NULL for an unknown level."""
    out = None
    for position, level in enumerate(levels, start=1):
        hit = c == F.lit(level)
        out = F.when(hit, F.lit(position)) if out is None else out.when(hit, F.lit(position))
    return out


def depth_label(depth: Column) -> Column:
    return mapped(depth, DEPTH_LABELS)


def sensor_id(plot: Column, depth: Column, house: Column, variable: Column | None = None) -> Column:
    place = F.concat(F.lit("P"), plot.cast("string"), F.lit("_"), depth.cast("string"), F.lit("_H"), house.cast("string"))
    return place if variable is None else F.concat(variable, F.lit("_"), place)


def plot_id(house: Column, plot: Column) -> Column:
    return F.concat_ws("_", house.cast("string"), plot.cast("string"))


def joined_key(*parts: Column) -> Column:
    """year_season, year_week, Depth_Summer and the like."""
    return F.concat_ws("_", *[p.cast("string") for p in parts])


def sized_label(text: Column, n: Column) -> Column:
    return F.concat(text, F.lit(" (n = "), n.cast("string"), F.lit(")"))
